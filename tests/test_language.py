"""Stems, sentiment, topics and classifiers against published pairs, hand counts, numpy and held-out rows."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallywind.functions import identify
from tallywind.functions import language as L
from tallywind.operators import corpus, frequency, series, topics

# Pairs of the published sample vocabulary of the English stemmer.
PAIRS = """consigned consign consistency consist consolatory consolatori consolidating consolid conspicuously conspicu conspirators conspir constancy constanc knackeries knackeri kneeling kneel knives knive
 knitted knit knocker knocker knightly knight generate generat generic generic generously generous hopping hop hoping hope ties tie cries cri gas gas gaps gap say say by by feed feed agreed agre relational relat
 predication predic operator oper triplicate triplic electrical electr adoption adopt economies economi falling fall controlled control news news dying die succeeding succeed happily happili skies sky""".split()


def test_stems(spark):
    words, want = PAIRS[::2], PAIRS[1::2]
    assert [L.stem(w) for w in words] == want and L.stem("") == "" and L.stem("Banks'") == "bank" and L.stem("o'clock") == "o'clock"
    got = spark.createDataFrame([(words,), (None,), ([],), (["Banks", None],)], "w array<string>").select(L.stems(L.F.col("w")).alias("s"))
    assert [r.s for r in got.collect()] == [want, None, [], ["bank", None]]


def test_sentiment_and_sentences(spark):
    rows = spark.createDataFrame([("Good day. Bad bad day!  Nothing",), ("",), (None,), ("good",)], "t string")
    lexicon = {"good": 2.0, "bad": -1.0}
    got = [(r.s, r.v) for r in rows.select(L.sentences(L.F.col("t")).alias("s"), L.sentiment(L.F.col("t"), lexicon).alias("v")).collect()]
    assert [g[0] for g in got] == [["Good day.", "Bad bad day!", "Nothing"], [], None, ["good"]]
    one, two = 2 / math.sqrt(19), -2 / math.sqrt(19)
    assert got[0][1] == (one + two) / 3 and got[1][1] is None and got[2][1] is None and got[3][1] == one
    body = spark.range(1).selectExpr("array(array(named_struct('Value', 'a', 'Name', cast(null as string)), named_struct('Value', cast(null as string), 'Name', 'Bank')), array(named_struct('Value', cast(null as string), 'Name', cast(null as string)))) AS b")
    assert body.select(L.paragraph_text(L.F.col("b")).alias("x")).first().x == "a <<Bank>>"


def test_ewma_as_pandas(spark):
    x = np.random.default_rng(0).normal(size=400)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t int, v double")
    for span in (1, 7, 30):
        got = [r.ewma for r in series.ewma(rows, ["k"], "t", "v", span).orderBy("t").collect()]
        assert np.allclose(got, pd.Series(x).ewm(span=span).mean(), rtol=1e-9, atol=1e-12)


def test_group_index_nulls(spark):
    freq = spark.createDataFrame([("e", 1, "a", 2.0), ("e", 1, "z", 1.0), ("e", 2, "z", 5.0), ("f", 1, "z", 1.0)], "entity string, period int, token string, freq double")
    groups = spark.createDataFrame([("g", "a", 0.5), ("g", "b", 1.0), ("h", "q", 1.0)], "grp string, word string, weight double")
    periods = spark.createDataFrame([(1,), (2,), (3,)], "period int")
    got = {(r.entity, r.grp, r.period): r.value for r in frequency.group_index(freq, groups, periods, "entity", "period").collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v is not None} == {("e", "g", 1): 1.0, ("e", "g", 2): 0.0}


def test_cv_coherence_of_short_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"] * 30 + ["a"]), (4, None)], "doc int, words array<string>")
    k = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "nowhere")], "topic int, rank int, word string")
    got = {r.topic: r.coherence for r in topics.cv_coherence(docs, "doc", "words", k, 5).collect()}
    total, eps = 1 + 27, 1e-12  # one window of the first document, 27 of the third
    holds = {"a": 2, "b": 1, "c": 27}

    def npmi(joint, x, y):
        j = joint / total + eps
        return math.log(j / (holds[x] / total * holds[y] / total)) / -math.log(j)

    m = np.array([[npmi(2, "a", "a"), npmi(1, "a", "b")], [npmi(1, "b", "a"), npmi(1, "b", "b")]])
    centre = m.sum(0)
    want = np.mean([v @ centre / np.linalg.norm(v) / np.linalg.norm(centre) for v in m])
    assert abs(got[0] - want) < 1e-9 and abs(got[1] - 0.5) < 1e-9


def test_components_as_numpy(spark):
    x = np.random.default_rng(1).normal(size=(200, 6)) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1])
    got = topics.components(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>"), "v").orderBy("i").collect()
    _, vectors = np.linalg.eigh(np.cov(x.T))
    want = x @ vectors[:, ::-1][:, :2]
    assert np.allclose(np.abs([r.components for r in got]), np.abs(want), atol=1e-6)


def test_latent_topics_as_numpy(spark):
    m = np.random.default_rng(2).integers(0, 4, size=(40, 9)).astype(float)
    rows = spark.createDataFrame([(d, f"w{t}", float(m[d, t])) for d in range(40) for t in range(9) if m[d, t]], "doc int, term string, w double")
    got = topics.latent_topics(rows, "doc", "term", "w", 3, 9).collect()
    _, s, v = np.linalg.svd(m)
    for j in range(3):
        load = np.zeros(9)
        for r in got:
            if r.topic == j:
                load[int(r.term[1:])] = r.loading
                assert abs(r.singular - s[j]) < 1e-6
        assert np.allclose(np.abs(load), np.abs(v[j]), atol=1e-6) and load[np.abs(load).argmax()] > 0


def test_panel_predictions_and_grid(spark):
    from pyspark.ml.classification import LogisticRegression

    g = np.random.default_rng(3)
    data = [(f"c{i % 10}", (v := g.normal(size=3)).tolist(), int(v[0] + 0.2 * g.normal() > 0)) for i in range(400)]
    rows = spark.createDataFrame(data, "country string, v array<double>, y int")
    got = topics.panel_cv(rows, "country", "v", "y", 5).collect()
    assert len(got) == 400 and len({(r.country, r.fold) for r in got}) == 10 and {r.fold for r in got} == set(range(5))
    assert np.mean([r.y == r.prediction for r in got]) > 0.85
    grid = topics.grid_search(rows, "country", "v", "y", {"regParam": [0.0, 100.0], "elasticNetParam": [1.0]}, LogisticRegression(maxIter=20)).collect()
    assert [r.params for r in grid] == ['{"elasticNetParam": 1.0, "regParam": 0.0}', '{"elasticNetParam": 1.0, "regParam": 100.0}'] and grid[0].accuracy > 0.85 > grid[1].accuracy
    scored = topics.accuracy(spark.createDataFrame([(1, 1.0), (0, 1.0)], "y int, prediction double"), "y", "prediction").first()
    assert (scored.n, scored.accuracy) == (2, 0.5)


def test_latent_topics_of_many_terms(spark):
    g = np.random.default_rng(7)
    m = np.round(g.normal(size=(60, 4)) @ np.diag([30, 20, 12, 8]) @ g.normal(size=(4, 40)) + g.normal(size=(60, 40)) / 10, 3)
    rows = spark.createDataFrame([(d, f"w{t}", float(m[d, t])) for d in range(60) for t in range(40)] + [(None, "w1", 1.0), (1, None, 1.0), (1, "w1", None)], "doc int, term string, w double")
    got = topics.latent_topics(rows, "doc", "term", "w", 3, 5).collect()
    _, s, v = np.linalg.svd(m)
    for j in range(3):
        mine = {r.rank: r for r in got if r.topic == j}
        best = sorted(range(40), key=lambda t: -abs(v[j, t]))[:5]
        assert [mine[i].term for i in range(5)] == [f"w{t}" for t in best] and abs(mine[0].singular - s[j]) < 1e-6 * s[0] and mine[0].loading > 0
    assert topics.latent_topics(rows.where("false"), "doc", "term", "w", 3).count() == 0


def test_a_text_is_cut_once_for_all_profiles(spark):
    df = spark.createDataFrame([("der und the the of it",), ("les une",), ("nothing of these words",), ("the",), (None,)], "t string")
    named = df.select(corpus.language(F.col("t"), {"en": ["the", "of"], "de": ["der", "und"], "fr": ["les"]}).alias("l"))
    assert [r.l for r in named.collect()] == ["en", "NA", "en", "NA", "NA"]
    assert named._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_distinct_words_are_weighed_once(spark):
    texts = spark.createDataFrame([(i, "the same words again and again " * 3, "en" if i % 2 else "de") for i in range(30)], "k long, t string, l string")
    profiles, languages = identify.learn(texts, "t", "l")
    rows = identify.identify(texts, "k", "t", profiles, languages)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r.language for r in rows.collect()} == {"de"}
    generated = [line for line in plan.splitlines() if "Generate explode" in line and "gram" in line]
    assert generated and all("key" not in line for line in generated)
