import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallywind.functions import identify, tables


def test_units_from_sql(spark):
    tables.register(spark)
    spark.createDataFrame([("a", "One two. Three!\n Four"), ("b", None), ("c", " ")], "id string, t string").createOrReplaceTempView("units_in")
    got = spark.sql("SELECT * FROM text_units(TABLE(units_in), 'sentence')")
    assert got.columns == ["id", "position", "sentence"] and sorted(map(tuple, got.collect())) == [("a", 0, "One two."), ("a", 1, "Three!"), ("a", 2, "Four")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM text_units(TABLE(units_in), 'document')").collect()] == [("a", ["one", "two", "three", "four"])]
    assert spark.sql("SELECT * FROM text_units(TABLE(units_in), 'word')").count() == 4
    for bad in ("text_units(TABLE(units_in), 'page')", "text_units(TABLE(SELECT id FROM units_in), 'word')", "text_units(TABLE(units_in), CAST(NULL AS STRING))"):
        with pytest.raises(Exception, match="the unit|takes a table|constant"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_sessions_by_key(spark):
    tables.register(spark)
    spark.createDataFrame([(k, t) for k in (1, 2) for t in (50, 0, 10, 21, 50, None)] + [(None, 7)], "k int, at long").repartition(3).createOrReplaceTempView("sessions_in")
    got = spark.sql("SELECT * FROM sessions(TABLE(sessions_in) PARTITION BY k ORDER BY (at), 10)").collect()
    want = [(k, s, a, b, n) for k in (1, 2) for s, a, b, n in ((0, 0, 10, 2), (1, 21, 21, 1), (2, 50, 50, 2))]
    assert sorted(tuple(r) for r in got if r.k is not None) == want and [tuple(r) for r in got if r.k is None] == [(None, 0, 7, 7, 1)]


def by_hand(train, rows, keep):
    cut = lambda t: [f" {w[i:i + 32]} " for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for i in range(0, len(w), 32)]
    grams = lambda t: Counter(w[i : i + n] for w in cut(t) for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")
    langs = sorted({lang for _, lang in train if lang})
    counts = {lang: sum((grams(t) for t, g in train if g == lang), Counter()) for lang in langs}
    kept = {g for c in counts.values() for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:keep]}
    total = {lang: sum(c[g] for g in kept) for lang, c in counts.items()}
    weight = {g: [math.floor(1000 * math.log((counts[lang][g] + 1) / (total[lang] + len(kept)))) for lang in langs] for g in kept}
    out = {}
    for key, t in rows:
        known = {g: n for g, n in grams(t).items() if g in kept}
        scores = [sum(n * weight[g][i] for g, n in known.items()) for i in range(len(langs))]
        out[key] = langs[scores.index(max(scores))] if len(t or "") > 10 and known else "NA"
    return out


def test_language_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(-1, None), (-2, ""), (-3, "short"), (-4, "1234567890123"), (-5, "x" * 5000), (None, "the house and the tree")]
    train = [(r.text, r.lang) for r in docs if r.doc_id % 4] + [(None, "en"), ("text", None)]
    profiles, languages = identify.learn(spark.createDataFrame(train, "text string, lang string"), "text", "lang", keep=300)
    got = {r.key: r.language for r in identify.identify(spark.createDataFrame(rows, "key long, text string"), "key", "text", profiles, languages).collect()}
    assert languages == ["de", "en", "es", "fr"] and got == by_hand(train, rows, 300)
    empty = identify.learn(spark.createDataFrame([], "text string, lang string"), "text", "lang")
    assert identify.identify(spark.createDataFrame([(1, "a long enough text")], "key long, text string"), "key", "text", *empty).collect()[0].language == "NA"


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = identify.identify(rows.where(held), "doc_id", "text", *identify.learn(rows.where(~held), "text", "lang")).join(rows, "doc_id")
    right = got.agg(F.avg((F.col("language") == F.col("lang")).cast("int")).alias("r")).first().r
    print("held-out accuracy", right)
    assert right > 0.95
