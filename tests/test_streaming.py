"""Series kept by increments against the whole series at once."""

from pyspark.sql import functions as F

from tallywind.operators import series
from tallywind.streaming import jobs


def test_series_by_increments(spark, tmp_path):
    value = lambda c, m: float((m * 7 + len(c) * m * m) % 11 + (60 if m == 30 else 0))
    rows = [(c, f"{2000 + m // 12}-{m % 12 + 1:02d}-01", value(c, m) if m != 9 else float("nan")) for c in ("a", "bb") for m in range(36)]
    frame = lambda r: spark.createDataFrame(r, "country string, d string, n double").select("country", F.to_date("d").alias("period"), "n")
    run = lambda: jobs.upsert_series(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), ["country"], "period", "n", 12)
    june = "2001-06-01"
    first = [r for r in rows if r[1] <= june and r[:2] != ("bb", june)] + [("bb", june, -500.0)]
    frame(first).write.parquet(str(tmp_path / "in"))
    assert {(r.country, str(r.period)): r.n for r in run().collect()}["bb", june] == -500 and run().count() == 36
    frame([r for r in rows if r[1] >= june]).write.mode("append").parquet(str(tmp_path / "in"))  # June is told again, with its right value
    got = {(r.country, str(r.period)): (r.n, r.z, r.pred) for r in run().collect()}
    whole = series.spikes(series.rolling_z(frame(rows).withColumn("n", F.nanvl("n", F.lit(0.0))), ["country"], "period", "n", 12))
    assert got == {(r.country, str(r.period)): (r.n, r.z, r.pred) for r in whole.collect()} and got["a", "2002-07-01"][2] == 1 and len(got) == 72
    assert {(r.country, str(r.period)): (r.n, r.z, r.pred) for r in run().collect()} == got


def test_keyed_state_over_any_split_is_the_batch(spark, tmp_path):
    value = lambda c, m: float((m * 7 + len(c) * m * m) % 11 + (60 if m == 30 else 0))
    month = lambda m: f"{2000 + m // 12}-{m % 12 + 1:02d}-01"
    frame = lambda r: spark.createDataFrame(r, "country string, d string, n double").select("country", F.to_date("d").alias("period"), "n")
    rows = {(c, m): value(c, m) for c in ("a", "bb", "flat") for m in range(34)} | {("flat", m): 4.0 if m < 33 else 9.0 for m in range(34)}
    run = lambda: {(r.country, str(r.period)): (r.value, r.z and round(r.z, 9), r.pred) for r in jobs.judge_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), ["country"], "period", "n", window=12).collect()}

    def want():
        whole = series.spikes(series.rolling_z(frame([(c, month(m), v) for (c, m), v in rows.items()]), ["country"], "period", "n", 12))
        return {(r.country, str(r.period)): (r.n, r.z and round(r.z, 9), r.pred) for r in whole.collect()}

    told = dict(rows)
    steps = [
        [k for k in told if k[1] < 20 and k != ("a", 7)],  # a month is missing
        [k for k in told if k[0] == "a" and k[1] >= 20],  # one country alone
        [k for k in told if k[0] != "a" and k[1] >= 20] + [("a", 7)],  # the missing month comes late
    ]
    for i, step in enumerate(steps):
        frame([(c, month(m), told[c, m]) for c, m in step]).write.mode("append" if i else "errorifexists").parquet(str(tmp_path / "in"))
        got = run()
    assert got == want() and got["a", month(30)][2] == 1 and got["flat", month(33)] == (rows["flat", 33], None, 1)
    rows |= {("bb", 15): 500.0, ("bb", 31): 0.0}  # corrections, one of them empty
    frame([("bb", month(15), 500.0), ("bb", month(15), 3.0), ("bb", month(31), None)]).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == want()


def test_keyed_state_lets_old_periods_go(spark, tmp_path):
    frame = lambda r: spark.createDataFrame([("a", f"20{m // 12:02d}-{m % 12 + 1:02d}-01", v) for m, v in r], "k string, d string, n double").select("k", F.to_date("d").alias("period"), "n")
    run = lambda: jobs.judge_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "period", "n", window=3, kept=6).count()
    frame([(m, float(m % 4)) for m in range(12)]).write.parquet(str(tmp_path / "in"))
    assert run() == 12
    frame([(2, 9.0), (8, 9.0), (12, 1.0)]).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == 13
    late = spark.read.parquet(str(tmp_path / "out/judged")).where("late").collect()
    assert [(str(r.period), r.value, r.z) for r in late] == [("2000-03-01", 9.0, None)]
