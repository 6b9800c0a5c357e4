"""Series operators: rolling z-scores, spikes, means, fills, anomalies. Windows are rows of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_z(df: DataFrame, keys: list[str], order: str, value: str = "value", window: int = 24) -> DataFrame:
    """W-01, W-02: mean, deviation and z over the window rows before; null unless all of them and the row have values.

    A constant window has deviation 0: z is null there, and `over`/`under` tell whether the value left it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    v = F.col(value)
    df = df.withColumns({"_n": F.count(v).over(w), "_m": F.avg(v).over(w), "_s": F.stddev_pop(v).over(w), "_hi": F.max(v).over(w), "_lo": F.min(v).over(w)})
    full = (F.col("_n") == window) & v.isNotNull()
    flat = F.col("_hi") == F.col("_lo")
    z = F.when(full & ~flat, F.try_divide(v - F.col("_m"), F.col("_s")))
    return df.withColumns({"z": z, "over": full & flat & (v > F.col("_hi")), "under": full & flat & (v < F.col("_lo"))}).drop("_n", "_m", "_s", "_hi", "_lo")


def spikes(df: DataFrame, threshold: Column | float = 2.1, direction: str = "incr") -> DataFrame:
    """W-03, FLT-18, W-04: pred is 1 where z crosses the threshold in the direction (incr, decr, both)."""
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    up, down = F.coalesce((F.col("z") >= t) | F.col("over"), F.lit(False)), F.coalesce((F.col("z") <= -t) | F.col("under"), F.lit(False))
    hit = {"incr": up, "decr": down, "both": up | down}[direction]
    return df.withColumn("pred", hit.cast("int"))


def rolling_mean(df: DataFrame, keys: list[str], order: str, value: str, window: int) -> DataFrame:
    """W-05: null until the window is full."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    return df.withColumn("rolling_mean", F.when(F.count(value).over(w) == window, F.avg(value).over(w)))


def ewma(df: DataFrame, keys: list[str], order: str, value: str, span: int) -> DataFrame:
    """W-06: adjusted exponential mean with alpha = 2 / (span + 1), over the rows so far. Rows whose weight is below
    2**-64, less than a double can show beside the newest row's, are left out, so that a row costs the same anywhere.
    Rows without a value (null or NaN) age the others and show the last mean; before the first value there is none."""
    import math

    keep = 1 - 2 / (span + 1)
    back = math.ceil(-64 * math.log(2) / math.log(keep)) if keep > 0 else 0
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-back, 0)
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    step = lambda a, r: F.struct((a.n * keep + F.coalesce(r.x, F.lit(0.0))).alias("n"), (a.d * keep + r.x.isNotNull().cast("int")).alias("d"))
    mean = F.aggregate(F.collect_list(F.struct(x.alias("x"))).over(w), F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d")), step, lambda a: F.when(a.d > 0, a.n / a.d))
    return df.withColumn("ewma", mean).withColumn("ewma", F.last("ewma", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def spine(df: DataFrame, keys: list[str], period: str, step: str = "1 month") -> DataFrame:
    """W-14, W-15: every period between a key's first and last, nulls where it has no row."""
    ends = df.groupBy(*keys).agg(F.min(period).alias("a"), F.max(period).alias("b"))
    every = ends.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(period))
    return every.join(df, [*keys, period], "left")


def fill(df: DataFrame, keys: list[str], order: str, value: str, back: bool = False) -> DataFrame:
    """W-12 (back), W-14: the next or the last value that isn't null, within the key."""
    w = Window.partitionBy(*keys).orderBy(order)
    filled = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing)) if back else F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(value, filled)


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """W-11: a run number that grows where the value changes, to or from null too."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(F.struct(F.col(value).alias("v"))).over(w)
    return df.withColumn("changed", F.when(before.isNull() | ~before["v"].eqNullSafe(F.col(value)), 1).otherwise(0)).withColumn("run_id", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("changed")


def pre_crisis(df: DataFrame, keys: list[str], order: str, crisis: str, ahead: int) -> DataFrame:
    """W-09, W-10: crisis_pre where an onset follows in the next `ahead` rows and no crisis is on; tranquil is the rest."""
    w = Window.partitionBy(*keys).orderBy(order)
    onset = F.when((F.lead(crisis).over(w) == 1) & (F.col(crisis) == 0), 1).otherwise(0)
    df = df.withColumn("onset", onset).withColumn("soon", F.max("onset").over(w.rowsBetween(0, ahead - 1)))
    pre = F.when((F.col("soon") == 1) & (F.col(crisis) == 0), 1).otherwise(0)
    return df.withColumn("crisis_pre", pre).withColumn("crisis_tranqull", 1 - F.col("crisis_pre") - F.col(crisis)).drop("onset", "soon")


def hp_trend(x, smooth: float):
    """The Hodrick-Prescott trend of a numpy series: solves (I + smooth * D'D) t = x, D second differences, as a
    symmetric matrix of five diagonals, in time and memory proportional to the series."""
    import numpy as np

    n = len(x)
    d, e, f = np.ones(n), np.zeros(n), np.zeros(n)  # the diagonal and the two below it
    for k in range(n - 2):
        for i, u in enumerate((1.0, -2.0, 1.0)):
            d[k + i] += smooth * u * u
        e[k] += smooth * 1.0 * -2.0
        e[k + 1] += smooth * -2.0 * 1.0
        f[k] += smooth
    y = np.array(x, float)
    for i in range(n):  # L D L', row by row
        for back, band in ((1, e), (2, f)):
            if i + back < n:
                lower = band[i] / d[i]
                d[i + back] -= lower * band[i]
                if back == 1 and i + 2 < n:
                    e[i + 1] -= lower * f[i]
                y[i + back] -= lower * y[i]
    out = np.empty(n)
    for i in reversed(range(n)):
        out[i] = (y[i] - (e[i] * out[i + 1] if i + 1 < n else 0) - (f[i] * out[i + 2] if i + 2 < n else 0)) / d[i]
    return out


def hp_mad(df: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.05, smooth: float = 1600.0) -> DataFrame:
    """W-19: deviations from a Hodrick-Prescott trend, scaled by their mean absolute deviation, beyond the upper bound
    of an exponential distribution whose scale is their sample deviation. Null values are left out of the series and
    have no score. One series per task call; a series is bounded by its periods."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        known = pdf[value].notna().to_numpy()
        x = pdf[value].to_numpy(float)[known]
        score = np.full(len(pdf), np.nan)
        if len(x) >= 3:
            gap = x - hp_trend(x, smooth)
            score[known] = np.abs(gap - np.median(gap)) / (np.abs(gap - gap.mean()).mean() + 1e-12)
        over = score > np.nanmean(score) + np.nanstd(score, ddof=1) * np.log(2 / alpha) if len(x) >= 3 else np.zeros(len(pdf), bool)
        return pdf.assign(score=pd.Series(score, pdf.index).astype(object).where(~np.isnan(score), None), anomaly=over.astype(int))

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.groupBy(*keys).applyInPandas(one, f"{fields}, score double, anomaly int")
