"""Panels, folds and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.sources.shared import numbered


def folds(df: DataFrame, entity: str, k: int) -> DataFrame:
    """S-12: contiguous chunks of the sorted entities; chunk i ends before row round(n / k * i)."""
    ids = df.select(entity).distinct()
    ranked = numbered(ids, entity).withColumnRenamed("number", "pos").crossJoin(F.broadcast(ids.agg(F.count(F.lit(1)).alias("n"))))
    fold = sum(((F.col("pos") >= F.floor(F.col("n") * i / k + 0.5)).cast("int") for i in range(1, k)), start=F.lit(0))
    return ranked.select(entity, fold.alias("fold"))


def encode_labels(df: DataFrame, column: str) -> DataFrame:
    """PRJ-17: (value, id) in ascending order of the value."""
    return numbered(df, column).select(column, F.col("number").cast("int").alias("label_id"))


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """A-17: the element-wise mean; partial sums combine before the shuffle."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def unit(vector: Column) -> Column:
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: F.try_divide(x, norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def expand_groups(vectors: DataFrame, terms: DataFrame, word: str, vector: str, top: int = 15) -> DataFrame:
    """S-04, U-03: each group's nearest words by cosine to the mean of its terms' unit vectors, its own terms left out.

    terms(grp, word) are keyword lists, written by hand, so their group vectors are broadcast."""
    units = vectors.select(F.col(word).alias("word"), unit(F.col(vector)).alias("u"))
    own = units.join(terms, "word").select("grp", F.posexplode("u").alias("pos", "x")).groupBy("grp", "pos").agg(F.avg("x").alias("x"))
    query = own.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("q")).withColumn("q", unit(F.col("q")))
    near = units.crossJoin(F.broadcast(query)).join(terms, ["grp", "word"], "left_anti").withColumn("cosine", dot(F.col("u"), F.col("q")))
    w = Window.partitionBy("grp").orderBy(F.desc(F.round("cosine", 9)), "word")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("grp", "word", "rank", "cosine")
