"""Scores of spikes as warnings of crises (J-14, A-12, A-13, A-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_scores(tp: Column, fp: Column, fn: Column, beta: float = 2.0) -> dict[str, Column]:
    """A-15: recall, precision and F-beta; null where a denominator is 0."""
    b = beta * beta
    return {"recall": F.try_divide(tp, tp + fn), "precision": F.try_divide(tp, tp + fp), "fscore": F.try_divide((1 + b) * tp, (1 + b) * tp + b * fn + fp)}


def outcomes(spikes: DataFrame, crises: DataFrame, keys: list[str], months: int = 24, grid: DataFrame | None = None) -> DataFrame:
    """keys, country, tp, fp, fn. spikes(keys, country, period), crises(country, seq, start, peak), grid(keys): every key
    that is judged, with spikes or without.

    A spike within [start - months, start] of a crisis is a TP, once for each such crisis; else one within a crisis
    counts as neither; the rest are FP. A crisis without a TP is an FN. Spikes meet the crises once; what leaves is a
    row per key and country, with the crises met (as many as the country has at most)."""
    every = [*keys, "country"]
    warns = F.col("period").between(F.add_months("start", -months), F.col("start"))
    met = spikes.join(crises, "country", "left").groupBy(*every, "period").agg(F.count_if(warns).alias("tp"), F.count_if((F.col("period") > F.col("start")) & (F.col("period") <= F.col("peak"))).alias("within"), F.collect_set(F.when(warns, F.col("seq"))).alias("seqs"))
    by = met.groupBy(*every).agg(F.sum("tp").alias("tp"), F.count_if(F.expr("tp = 0 and within = 0")).alias("fp"), F.size(F.array_distinct(F.flatten(F.collect_set("seqs")))).alias("found"))
    of = F.broadcast(crises.groupBy("country").agg(F.count_distinct("seq").alias("crises")))
    frame = grid.select(*keys).distinct().crossJoin(of) if keys else of  # a grid is a list of parameters
    both = frame.join(by, every, "full")
    return both.select(*every, *(F.coalesce(x, F.lit(0)).alias(x) for x in ("tp", "fp")), (F.coalesce("crises", F.lit(0)) - F.coalesce("found", F.lit(0))).alias("fn"))


def score(marks: DataFrame, keys: list[str], total: str = "aggregate") -> DataFrame:
    """A-12, A-13: sums and scores by keys and country, with a row over all countries."""
    by = marks.groupingSets([[*keys, "country"], list(keys)], *keys, "country").agg(*(F.sum(x).cast("long").alias(x) for x in ("tp", "fp", "fn")), F.grouping("country").alias("g"))
    by = by.withColumn("country", F.when(F.col("g") == 1, total).otherwise(F.col("country"))).drop("g")
    return by.select(*keys, "country", "tp", "fp", "fn", *(F.round(v, 6).alias(k) for k, v in f_scores(F.col("tp"), F.col("fp"), F.col("fn")).items()))


def crisis_months(crises: DataFrame) -> DataFrame:
    """U-07: the distinct months of all crises of a country."""
    return crises.select("country", F.explode(F.sequence("start", "peak", F.expr("interval 1 month"))).alias("period")).distinct()


def label_period(df: DataFrame, crises: DataFrame, day: str, years_before: int = 0) -> DataFrame:
    """J-04: country and seq of each crisis that a row's day falls into: [start, peak], or [start - n years, start]."""
    c = F.broadcast(crises)
    inside = F.col(day).between(F.col("start"), F.col("peak")) if not years_before else F.col(day).between(F.add_months("start", -12 * years_before), F.col("start"))
    return df.join(c, inside)


def mark_months(df: DataFrame, crises: DataFrame, payments: DataFrame) -> DataFrame:
    """J-07, Q-09: df(country, period, ...) with crisis_window and bop_crisis, 1 in the months of a crisis, else 0, also for
    countries that no dimension has, and for a null country or period. crises(country, start, peak) and payments(country, period) are
    dimensions written by hand; a month listed twice marks once."""
    on = ["country", "period"]
    marked = df.join(crisis_months(crises).withColumn("_window", F.lit(1)), on, "left").join(payments.select(*on).distinct().withColumn("_payments", F.lit(1)), on, "left")
    return marked.select(*df.columns, F.coalesce("_window", F.lit(0)).alias("crisis_window"), F.coalesce("_payments", F.lit(0)).alias("bop_crisis"))
