"""Incremental jobs (ST-01..ST-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def upsert_days(spark: SparkSession, source: str, table: str, checkpoint: str) -> DataFrame:
    """ST-01, ST-03, ST-04: take what is new in a folder of event files, recompute the days it touches, replace their
    partitions; one run takes all that is there and ends. A day's raw rows are kept beside its totals, so that a
    late row changes its day alone."""

    def batch(new: DataFrame, _: int) -> None:
        new = new.withColumn("day", F.to_date("ts"))
        new.write.mode("append").partitionBy("day").parquet(f"{table}/raw")
        days = [r.day for r in new.select("day").distinct().collect()]  # of one increment
        raw = spark.read.parquet(f"{table}/raw").where(F.col("day").isin(days)).dropDuplicates(["event_id"])
        totals = raw.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        totals.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{table}/totals")

    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("pathGlobFilter", "*.parquet").parquet(source)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    return spark.read.parquet(f"{table}/totals")


def distinct_events(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """ST-07: the first of the events with one key, state kept for `late`."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def upsert_series(spark: SparkSession, source: str, table: str, checkpoint: str, keys: list[str], period: str, value: str, window: int = 24, threshold: float = 2.1) -> DataFrame:
    """ST-05: take what is new in a folder of series files (keys, period, value), replace what the kept history has for
    the same keys and period, and judge the whole history anew, an empty value as 0. Other keys of a period stay. The history
    is a log with a folder a batch, and the last batch that tells of a key and period holds: nothing is rewritten, and a batch that is
    run twice leaves the same log. Of rows with one key and period in a batch the greatest value stays. Returns keys,
    period, value, z, pred."""
    from tallywind.operators.series import rolling_z, spikes

    def batch(new: DataFrame, number: int) -> None:
        rows = new.groupBy(*keys, period).agg(F.max(F.nanvl(F.col(value).cast("double"), F.lit(None))).alias(value))
        rows.write.mode("overwrite").parquet(f"{table}/history/batch={number}")

    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("pathGlobFilter", "*.parquet").parquet(source)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    log = spark.read.parquet(f"{table}/history")
    history = log.groupBy(*keys, period).agg(F.max_by(F.struct(value), F.col("batch")).alias("_last")).select(*keys, period, F.coalesce(F.col("_last")[value], F.lit(0.0)).alias(value))
    judged = spikes(rolling_z(history, keys, period, value, window), threshold)
    return judged.select(*keys, period, value, "z", "pred")


def keyed_series(rows: DataFrame, keys: list[str], period: str, value: str, window: int = 24, threshold: float = 2.1, kept: int = 600, hours: int | None = None) -> DataFrame:
    """ST-05 with state: of a stream of rows (keys, period, value) those keys' rows judged anew: keys, period, value, z, pred, late.

    A key's state is its last `kept` periods, a ring of window values and as many more as corrections may be late. A row
    that is new or corrects an old one changes its own judgement and that of the `window` periods after it, and
    just those come out; the last row that comes out for a key and period holds (last_told). An empty value counts as 0.
    A row for a period that the state has let go comes out as late, with no judgement. hours: a key's state goes that long after its last rows.
    Of rows with one key and period in a batch the greatest value counts. The session needs the RocksDB state store."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    kinds = dict(rows.dtypes)
    names = [*keys, "period", "value", "z", "pred", "late"]

    class Judge(StatefulProcessor):
        def init(self, handle):
            self.held = handle.getMapState("held", "period date", "value double", ttlDurationMs=hours and hours * 3_600_000)
            self.gone = handle.getValueState("gone", "until date", ttlDurationMs=hours and hours * 3_600_000)

        def handleInputRows(self, key, batches, timers):
            held = {k[0]: v[0] for k, v in self.held.iterator()}
            until = self.gone.get()[0] if self.gone.exists() else None
            new: dict = {}
            for pdf in batches:
                for p, v in zip(pdf["period"], pdf["value"], strict=True):
                    if not pd.isna(p):
                        v = 0.0 if pd.isna(v) else float(v)
                        new[p] = max(v, new.get(p, v))
            late = sorted(p for p in new if until is not None and p <= until)
            for p in new.keys() - set(late):
                held[p] = new[p]
                self.held.updateValue((p,), (new[p],))
            order = sorted(held)
            place = {p: i for i, p in enumerate(order)}
            again = sorted({j for p in new.keys() - set(late) for j in range(place[p], min(place[p] + window + 1, len(order)))})
            out = [(*key, order[i], held[order[i]], *judged([held[p] for p in order[max(0, i - window) : i]], held[order[i]]), False) for i in again]
            out += [(*key, p, new[p], None, 0, True) for p in late]
            for p in order[: max(0, len(order) - kept)]:
                self.held.removeKey((p,))
                self.gone.update((p,))
            yield pd.DataFrame(out, columns=names)

        def close(self):
            pass

    def judged(before: list[float], v: float) -> tuple[float | None, int]:
        if len(before) < window:
            return None, 0
        low, high, mean = min(before), max(before), sum(before) / window
        if low == high:
            return None, int(v > high)
        z = (v - mean) / (sum((x - mean) ** 2 for x in before) / window) ** 0.5
        return z, int(z >= threshold)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "period date, value double, z double, pred int, late boolean"])
    told = rows.select(*keys, F.to_date(period).alias("period"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("value"))
    return told.groupBy(*keys).transformWithStateInPandas(Judge(), schema, "Update", "ProcessingTime" if hours else "None")


def last_told(log: DataFrame, keys: list[str]) -> DataFrame:
    """Of a log of keyed_series(), with a batch number, what holds: each key and period's rows of the last batch, late ones left out."""
    rest = [c for c in log.columns if c not in (*keys, "period")]
    return log.where("not late").groupBy(*keys, "period").agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_r")).select(*keys, "period", "_r.*").drop("batch", "late")


def judge_stream(spark: SparkSession, source: str, table: str, checkpoint: str, keys: list[str], period: str, value: str, **how) -> DataFrame:
    """ST-05: take what is new in a folder of series files through keyed_series(), add what comes out to a log with a folder a
    batch, and return what holds. One run takes all that is there and ends; a batch that is run twice leaves the same log."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("pathGlobFilter", "*.parquet").parquet(source)
    judged = keyed_series(stream, keys, period, value, **how)

    def batch(out: DataFrame, number: int) -> None:
        out.write.mode("overwrite").parquet(f"{table}/judged/batch={number}")

    judged.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    return last_told(spark.read.parquet(f"{table}/judged"), keys)
