"""Fitted models kept as versions of a folder: tables, Spark ML models and settings (SNK-12, SNK-13).

    <path>/v00000001/tables/<name>, models/<name>, MANIFEST.json

The manifest is written last, so a version without one isn't there: a job that dies leaves nothing that can be loaded.
"""

from __future__ import annotations

import importlib
import json
import re
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tallywind.sources.shared import place

NAME = re.compile(r"[A-Za-z0-9_-]+")


@dataclass
class Stored:
    version: int
    settings: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)
    models: dict = field(default_factory=dict)


def _found(path: str) -> dict[int, bool]:
    """Each version's number and whether it was finished."""
    system, root = place(path)
    if system.get_file_info(root).type != fs.FileType.Directory:
        return {}
    folders = [i for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and re.fullmatch(r"v\d{8}", i.base_name)]
    return {int(i.base_name[1:]): system.get_file_info(f"{i.path}/MANIFEST.json").type == fs.FileType.File for i in folders}


def versions(path: str) -> list[int]:
    """The finished versions, ascending."""
    return sorted(v for v, done in _found(path).items() if done)


def keep(path: str, settings: dict | None = None, tables: dict[str, DataFrame] | None = None, models: dict | None = None) -> int:
    """Writes a new version and returns its number. settings: what JSON can hold; models: fitted Spark ML models. Numbers
    aren't used again, those of unfinished versions neither."""
    settings, tables, models = settings or {}, tables or {}, models or {}
    if bad := [n for n in (*tables, *models) if not NAME.fullmatch(n)]:
        raise ValueError(f"no name for a table or model: {bad[0]!r}")
    version = max(_found(path), default=0) + 1
    at = f"{path.rstrip('/')}/v{version:08d}"
    system, root = place(at)
    system.create_dir(root, recursive=True)
    text = json.dumps({"settings": settings, "tables": {n: df.schema.json() for n, df in tables.items()}, "models": {n: f"{type(m).__module__}:{type(m).__name__}" for n, m in models.items()}})
    for name, df in tables.items():
        df.write.parquet(f"{at}/tables/{name}")
    for name, model in models.items():
        model.write().save(f"{at}/models/{name}")
    with system.open_output_stream(f"{root}/_MANIFEST") as f:
        f.write(text.encode())
    system.move(f"{root}/_MANIFEST", f"{root}/MANIFEST.json")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> Stored:
    """A version, by default the last finished one."""
    from pyspark.sql.types import StructType

    done = versions(path)
    if not done or (version is not None and version not in done):
        raise FileNotFoundError(f"no stored version {'' if version is None else version} in {path}")
    version = done[-1] if version is None else version
    at = f"{path.rstrip('/')}/v{version:08d}"
    system, root = place(at)
    with system.open_input_stream(f"{root}/MANIFEST.json") as f:
        about = json.loads(f.read())
    out = Stored(version, about["settings"])
    for name, schema in about["tables"].items():
        out.tables[name] = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{at}/tables/{name}")
    for name, kind in about["models"].items():
        module, cls = kind.split(":")
        if not module.startswith("pyspark.ml."):
            raise ValueError(f"not a Spark ML model: {kind}")
        out.models[name] = getattr(importlib.import_module(module), cls).load(f"{at}/models/{name}")
    return out


def clean(path: str, last: int) -> list[int]:
    """Deletes all finished versions but the last so many, and the unfinished ones older than the newest finished one; returns
    their numbers. An unfinished version newer than that may still be written and stays."""
    if last < 1:
        raise ValueError("at least one version has to stay")
    system, root = place(path)
    done = versions(path)
    gone = sorted(v for v, finished in _found(path).items() if done and (v not in done[-last:] if finished else v < done[-1]))
    for v in gone:
        system.delete_dir(f"{root}/v{v:08d}")
    return gone
