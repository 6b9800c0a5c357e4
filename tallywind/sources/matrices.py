"""Sparse matrices in the Matrix Market format and dictionaries of their columns (SNK-08, SRC-26).

A matrix is a folder of parts that, one after the other, are one file of the format. Rows, columns and entries are counted
by Spark; the header is written when all tasks are done, and only then is there anything to read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tallywind.sources.shared import numbered, place, remove, save, save_at, shuffles_removed

#: Fixed value of the format: the first line of a sparse matrix of real numbers.
BANNER = "%%MatrixMarket matrix coordinate real general"


@dataclass
class Part(WriterCommitMessage):
    hidden: str
    partition: int
    lines: int


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.head, self.overwrite, self.job = options["path"], options.get("header", ""), overwrite, uuid.uuid4().hex[:12]
        system, root = place(self.path)
        if not overwrite and system.get_file_info(root).type != fs.FileType.NotFound and self.parts():
            raise ValueError(f"{self.path} isn't empty")

    def parts(self) -> list[str]:
        system, root = place(self.path)
        return sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.startswith("part-"))

    def write(self, iterator):
        from pyspark import TaskContext

        system, root = place(self.path)
        system.create_dir(root, recursive=True)
        hidden, n = f"_part-{self.job}-{uuid.uuid4().hex[:12]}", 0
        with system.open_output_stream(f"{root}/{hidden}") as f:
            for b in iterator:
                f.write("".join(f"{line}\n" for line in b.column(0).to_pylist()).encode())
                n += b.num_rows
        return Part(hidden, TaskContext.get().partitionId(), n)

    def commit(self, messages):
        system, root = place(self.path)
        for old in self.parts():
            system.delete_file(old)
        kept = sorted((m for m in messages if m.lines), key=lambda m: m.partition)
        for i, m in enumerate(kept):
            system.move(f"{root}/{m.hidden}", f"{root}/part-{i + 1:08d}")
        for m in messages:
            if not m.lines:
                system.delete_file(f"{root}/{m.hidden}")
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/part-00000000") as f:
            f.write((self.head.replace("{lines}", str(sum(m.lines for m in messages))) + "\n").encode())

    def abort(self, messages):
        system, root = place(self.path)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            for i in system.get_file_info(fs.FileSelector(root)):
                if i.base_name.startswith(f"_part-{self.job}-"):  # those of killed tasks too
                    system.delete_file(i.path)


class Lines(DataSource):
    """Lines of text in the order of a table's partitions, after a header (option) in which {lines} is their number."""

    @classmethod
    def name(cls):
        return "tallywind_lines"

    def schema(self):
        return "line string"

    def writer(self, schema, overwrite):
        return LinesWriter(dict(self.options), overwrite)


def write_lines(df: DataFrame, path: str, header: str, overwrite: bool) -> None:
    df.sparkSession.dataSource.register(Lines)
    with shuffles_removed(df.sparkSession):
        df.write.format("tallywind_lines").mode("overwrite" if overwrite else "append").option("header", header).save(path)


def head(path: str) -> list[str]:
    """The first lines of a file, or of a folder's first part, up to the first that is neither blank nor a comment."""
    system, root = place(path)
    info = system.get_file_info(root)
    first = root if info.type == fs.FileType.File else min((i.path for i in system.get_file_info(fs.FileSelector(root)) if i.base_name[0] not in "._"), default=None) if info.type == fs.FileType.Directory else None
    if first is None:
        raise FileNotFoundError(f"no matrix or dictionary in {path}")
    out, data = [], b""
    with system.open_input_stream(first) as f:
        while True:
            more = f.read(64 << 10)
            data += more
            lines = data.decode("utf-8", "replace").split("\n")
            for line in lines if not more else lines[:-1]:
                out.append(line.rstrip("\r"))
                if line.strip() and not line.startswith("%"):
                    return out
            if not more:
                raise ValueError(f"{path} has no line of sizes")
            out = []


def write_matrix(entries: DataFrame, path: str, row: str, column: str, value: str, rows: int, columns: int, overwrite: bool = False) -> None:
    """Entries (row and column from 1, value) in order of row and column. Entries with a null are an error; so is a folder
    that isn't empty, unless overwrite."""
    ordered = entries.select(F.col(row).alias("i"), F.col(column).alias("j"), F.col(value).alias("v")).repartitionByRange("i", "j").sortWithinPartitions("i", "j")
    i, j, v = (F.col(c) for c in "ijv")
    bad = i.isNull() | j.isNull() | v.isNull() | ~i.between(1, rows) | ~j.between(1, columns)
    line = F.when(bad, F.raise_error(F.lit("an entry is null or outside the matrix")).cast("string")).otherwise(F.concat_ws(" ", i.cast("long"), j.cast("long"), v.cast("double")))
    write_lines(ordered.select(line.alias("line")), path, f"{BANNER}\n{rows} {columns} {{lines}}", overwrite)


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """((row, column, value), (rows, columns, entries)) of a file or folder in coordinate form: real, integer or pattern
    (value 1); general, or symmetric or skew-symmetric, whose other half is made."""
    lines = head(path)
    banner = lines[0].lower().split()
    if len(banner) != 5 or banner[:3] != ["%%matrixmarket", "matrix", "coordinate"] or banner[3] not in ("real", "integer", "pattern") or banner[4] not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"not a matrix that can be read: {lines[0][:80]}")
    size = lines[-1]
    text = spark.read.text(path).where("trim(value) != '' and value not like '\\%%'")
    same = F.col("value") == size  # the line of sizes, and an entry that reads like it: one at most, as places don't repeat
    again = text.where(same).groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    part = F.split(F.trim(F.col("value")), r"\s+")
    number = F.lit(1.0) if banner[3] == "pattern" else part[2].cast("double")
    out = text.where(~same).unionAll(again).select(part[0].cast("long").alias("row"), part[1].cast("long").alias("column"), number.alias("value"))
    if banner[4] != "general":
        sign = -1.0 if banner[4] == "skew-symmetric" else 1.0
        out = out.unionAll(out.where(F.col("row") != F.col("column")).select(F.col("column").alias("row"), F.col("row").alias("column"), (F.col("value") * sign).alias("value")))
    return out, tuple(int(x) for x in size.split())


def write_dictionary(terms: DataFrame, path: str, documents: int, overwrite: bool = False) -> None:
    """(id, token, df) as lines by token, tabs between, after the number of documents. A token with a tab or line break is an error."""
    fits = ~F.col("token").rlike(r"[\t\n\r]")
    line = F.when(fits, F.concat_ws("\t", "id", "token", "df")).otherwise(F.raise_error(F.lit("a token is null or has a tab or line break")).cast("string"))
    write_lines(terms.select("token", line.alias("line")).repartitionByRange("token").sortWithinPartitions("token").select("line"), path, str(documents), overwrite)


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((id, token, df), documents)."""
    part = F.split("value", "\t")
    return spark.read.text(path).where("value like '%\t%'").select(part[0].cast("long").alias("id"), part[1].alias("token"), part[2].cast("long").alias("df")), int(head(path)[-1])


def write_bag(tokens: DataFrame, doc: str, token: str, path: str, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """Counts of tokens by document as `<path>/corpus` and its columns as `<path>/dictionary`, from rows (doc, token). Documents
    are numbered from 1 by doc, columns from 1 by token; a column's id in the dictionary is one less. Returns the numbers,
    (doc, number) and (token, number). Rows with a null are left out."""
    counts, bag = save_at(tokens.select(F.col(doc).alias("doc"), F.col(token).alias("token")).where("doc is not null and token is not null").groupBy("doc", "token").agg(F.count(F.lit(1)).alias("n")), "bag")
    docs, terms = save(numbered(counts, "doc", 1), "bag-documents"), save(numbered(counts, "token", 1), "bag-tokens")
    n, m = docs.count(), terms.count()
    entries = counts.join(terms.withColumnRenamed("number", "j"), "token").select("doc", "j", "n").join(docs.withColumnRenamed("number", "i"), "doc")  # numbers instead of words first
    write_matrix(entries, f"{path}/corpus", "i", "j", "n", n, m, overwrite)
    spread = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    write_dictionary(spread.join(terms, "token").select((F.col("number") - 1).alias("id"), "token", "df"), f"{path}/dictionary", n, overwrite)
    remove(tokens.sparkSession, bag)
    return docs, terms
