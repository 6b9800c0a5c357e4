from tallywind.functions import language as L
from tallywind.plans import catalogue, extra  # noqa: F401


def test_python_gets_counted_words(spark, tmp_path):
    rows = [(1, "Running runs, ran: the runs", "en"), (2, "running the race", "en"), (3, "laufen", "de"), (4, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = catalogue.queries()["stem_counts"](spark, str(tmp_path))
    want = {}
    for w in "running runs ran the runs running the race".split():
        want[L.stem(w)] = want.get(L.stem(w), 0) + 1
    assert {r.stem: r.n for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("ArrowEvalPython") :]
