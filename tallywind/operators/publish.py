"""Merging with history and shaping for dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_periods(old: DataFrame, new: DataFrame, period: str) -> DataFrame:
    """J-16, ST-06: old without the periods that new has, and new; missing columns are null (U-01)."""
    return old.join(new.select(period).distinct(), period, "left_anti").unionByName(new, allowMissingColumns=True)


def truncate_append(old: DataFrame, new: DataFrame, keys: list[str], period: str) -> DataFrame:
    """J-17: each key's old rows before its first new period, and new; keys without new rows stay whole."""
    first = new.groupBy(*keys).agg(F.min(period).alias("first"))
    return old.join(first, keys, "left").where(F.col("first").isNull() | (F.col(period) < F.col("first"))).drop("first").unionByName(new)


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """PRJ-10: a row per value column; null values stay."""
    return df.unpivot(ids, values, name, value)


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """PRJ-11, J-08: a column per name, the mean of its values. names are stated, so that no job is needed to find them."""
    return df.groupBy(*ids).pivot(name, names).agg(F.avg(value))


def global_index(df: DataFrame, weights: DataFrame, world: str = "World") -> DataFrame:
    """A-16: sum of weight * 100 * value / base by (grp, period); base is a series' first value that isn't 0.

    df(country, grp, period, value), weights(country, weight). The base is sought within the series (defect Q-07)."""
    w = Window.partitionBy("grp", "country").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    based = df.withColumn("base", F.first(F.nullif("value", F.lit(0.0)), True).over(w)).join(weights, "country")
    return based.groupBy("grp", "period").agg(F.sum(F.col("weight") * 100 * F.col("value") / F.col("base")).alias("value")).withColumn("country", F.lit(world))


def top_documents(df: DataFrame, keys: list[str], hits: str, doc: str, n: int = 3) -> DataFrame:
    """W-07, W-08: the n rows of each key with most hits, ties to the smaller id. Ranks before n stop early."""
    w = Window.partitionBy(*keys).orderBy(F.desc(hits), doc)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tooltips(top: DataFrame, keys: list[str], text: str) -> DataFrame:
    """PRJ-21: the top rows of a key as one text in rank order (n rows at most)."""
    line = F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), F.col(text)).alias("line"))
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s.line), "\n").alias("tool_tips"))
