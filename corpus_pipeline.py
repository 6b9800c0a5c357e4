"""The corpus pipeline: quality, near-duplicates, secrets, mixing, packing, each on all that its predecessor kept.

Defined results: a null text counts as an empty one and stays null; rows without a doc_id are never another's duplicate;
rows that repeat a doc_id stay or go together; of equal or near-equal texts the smallest doc_id stays; columns beside
doc_id, text and n_chars are passed on, whatever their names; an empty table gives no rows; texts of any length are
read whole. Without labels every score is 0.5, so that the first stage keeps nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.llm import mixing, packing, quality, secret_scan, simhash
from tallywind.llm.common import save
from tallywind.llm.queries import tokenizer_path


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 go."""
    return quality.keep(docs, quality.fit(docs, _labels(spark, sf_dir)), 0.7)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, at a similarity of 0.8 of five-word shingles, the document with the smallest doc_id stays."""
    return simhash.keep_one(docs, words_per_shingle=5, similarity=0.8)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret is replaced by a mark; n_chars follows."""
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else masked


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated or left out as its rate says."""
    return mixing.apply_mix(docs, _labels(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", simhash_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
