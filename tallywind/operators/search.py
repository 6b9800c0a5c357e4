"""Entity tags and keyword search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.functions.text import keyword_pattern, words
from tallywind.sources.shared import save


def entity_tags(text: Column, aliases: dict[str, list[str]], mode: str = "regex", plural: bool = True) -> Column:
    """J-13, FLT-03, Q-06: the entities that a text names, by pattern or by whole tokens. One pass, no join."""
    if mode == "regex":
        hits = [F.when(text.rlike(keyword_pattern(a, plural)), F.lit(e)) for e, a in aliases.items()]
    else:
        hits = [F.when(F.arrays_overlap(words(text), F.array(*map(F.lit, a))), F.lit(e)) for e, a in aliases.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def region_or_title(regions: Column, wanted: list[str], title: Column, terms: list[str], inclusive: bool = True) -> Column:
    """FLT-02, FLT-03: a region that matches skips the title's terms; inclusive lets the terms make up for a miss."""
    region = F.arrays_overlap(F.filter(F.split(regions, ","), lambda c: c != ""), F.array(*map(F.lit, wanted)))
    named = F.arrays_overlap(words(F.coalesce(title, F.lit(""))), F.array(*map(F.lit, terms)))
    return F.coalesce(region, F.lit(False)) | named if inclusive else F.coalesce(region, F.lit(False))


def keyword_counts(df: DataFrame, doc: str, text: str, keywords: list[str], prefix: bool = True) -> DataFrame:
    """A-10, F-17, F-19: (doc, keyword, n), the case of matches folded."""
    found = F.regexp_extract_all(F.lower(text), F.lit(keyword_pattern(keywords, prefix=prefix, fold=False)), F.lit(0))
    return df.select(doc, F.explode(found).alias("keyword")).groupBy(doc, "keyword").agg(F.count(F.lit(1)).alias("n"))


def overlap_groups(keys: list[str]) -> tuple[list[str], list[str]]:
    """U-10: the keys that no other contains, and those that another does."""
    inner = [k for k in keys if any(k != o and k in o for o in keys)]
    return [k for k in keys if k not in inner], inner


def overlapping_counts(df: DataFrame, doc: str, text: str, keywords: list[str]) -> DataFrame:
    """F-20: (doc, keyword, n) of whole keywords in two passes, so that one within another is counted too."""
    passes = [F.regexp_extract_all(F.lower(text), F.lit(keyword_pattern(g, fold=False)), F.lit(0)) for g in overlap_groups(keywords) if g]
    return df.select(doc, F.explode(F.concat(*passes)).alias("keyword")).groupBy(doc, "keyword").agg(F.count(F.lit(1)).alias("n"))


def boolean_search(df: DataFrame, text: str, keys: list[str], also: str = "\\+") -> DataFrame:
    """F-21, SRC §2.11.11: a 0/1 column per key (keys with `also` need all their parts) and keep_tag."""
    low = F.lower(text)
    hit = lambda k: low.rlike(r"\b" + re.escape(k) + r"\b")
    flags = {}
    for key in keys:
        every = hit(key.split(also)[0])
        for part in key.split(also)[1:]:
            every &= hit(part)
        flags[re.sub("[^a-z]+", "_", key)] = every.cast("int")
    df = df.withColumns(flags)
    return df.withColumn("keep_tag", F.greatest(*flags, F.lit(0)))


def keep_longest(df: DataFrame, key: str, text: str, then: str) -> DataFrame:
    """W-16: of rows with one key the one with the longest text, of these the one with the smallest `then`, which names
    rows. Only lengths are aggregated, before the shuffle; the texts meet the chosen ids in a join."""
    first = F.struct(F.coalesce(F.length(text), F.lit(-1)).alias("n"), (-F.col(then)).alias("i"))
    best = df.groupBy(key).agg(F.max(first).alias("best")).select((-F.col("best.i")).alias(then))
    return df.join(best, then, "left_semi")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row, q0 and so on: exact quantiles of a column's non-null numbers, between two of them in proportion; null without
    any. Distinct values are counted and put into ranges, whose counts (one for each shuffle partition) tell which hold
    the ranks that are wanted; no task sees all values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows = save(counts.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("part")), "quantiles")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("part").agg(F.sum("n").alias("s")).select("part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    whole = rows.agg(F.sum("n").alias("total"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    ranked = rows.join(F.broadcast(before), "part").withColumn("upto", upto).crossJoin(F.broadcast(whole))  # a row a partition, one row
    at = [(F.col("total") - 1) * p for p in shares]
    value = lambda i: F.max(F.when((i >= F.col("upto") - F.col("n")) & (i < F.col("upto")), F.col("v")))
    found = ranked.agg(F.first("total").alias("total"), *(value(f(x)).alias(f"{f.__name__}{k}") for k, x in enumerate(at) for f in (F.floor, F.ceil)))
    between = [F.when(F.col(f"floor{k}") == F.col(f"ceil{k}"), F.col(f"floor{k}")).otherwise((F.ceil(x) - x) * F.col(f"floor{k}") + (x - F.floor(x)) * F.col(f"ceil{k}")).alias(f"q{k}") for k, x in enumerate(at)]
    return found.select(*between)


def quantile_band(df: DataFrame, column: str, low: float = 0.03, high: float = 0.95) -> DataFrame:
    """FLT-12, A-22: rows strictly between two exact quantiles; extra columns stay, rows with a null go."""
    ends = quantiles(df, column, [low, high]).select(F.col("q0").alias("_q_low"), F.col("q1").alias("_q_high"))  # one row
    return df.crossJoin(F.broadcast(ends)).where((F.col(column) > F.col("_q_low")) & (F.col(column) < F.col("_q_high"))).drop("_q_low", "_q_high")
