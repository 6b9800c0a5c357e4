"""What is shuffled: texts or counts that a bound holds, not a row for each document and word."""

import re

from pyspark.sql import functions as F

import __spark_entry__
from tallywind.operators import corpus, frequency

SMALL = __spark_entry__.SMALL


def shuffled(df) -> list[list[str]]:
    """The columns by which each exchange of a plan is partitioned."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#\d+", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def query(spark, name):
    return __spark_entry__.queries()[name](spark, SMALL)


def test_rates_shuffle_documents_only(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (3, None)], "doc long, token string")
    known = spark.createDataFrame([("a",), ("c",), ("c",)], "token string")
    got = corpus.oov_rate(tokens, known, "doc")
    assert ["doc", "token"] not in shuffled(got) and ["doc"] in shuffled(got)
    assert {r.doc: (r.n_tokens, r.oov) for r in got.collect()} == {1: (3, 2), 2: (1, 0), 3: (1, 1)}


def test_counts_by_document_and_word_need_no_shuffle(spark):
    for name in ("oov_by_document", "vocabulary_counts", "doc_freq_filter", "tfidf_l2", "random_word_benchmark"):
        assert ["doc_id", "token"] not in shuffled(query(spark, name)), name


def test_a_kept_vocabulary_is_broadcast(spark):
    tokens, known = (spark.createDataFrame([("a",), ("b",)], "token string") for _ in range(2))
    assert "BroadcastHashJoin" in corpus.in_vocabulary(tokens, known)._jdf.queryExecution().executedPlan().toString()


def test_coherence_shuffles_the_topics_words_only(spark):
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b"), (2, "z")], "doc long, term string")
    topics = spark.createDataFrame([(0, 0, "b"), (0, 1, "a"), (1, 0, "a"), (1, 1, "b")], "topic int, rank int, word string")
    got = frequency.umass(terms, topics, "doc", "term")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan  # below the distinct words of a document
    assert {r.topic: round(r.coherence, 9) for r in got.collect()} == {0: 0.0, 1: round(float(__import__("math").log(2)), 9)}


def test_drawn_words_alone_are_counted_one_by_one(spark):
    plan = query(spark, "random_word_benchmark")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[(source|country)#\d+, period#\d+, token#\d+\]", plan)


def test_repeated_documents_are_one(spark):
    from tallywind.plans.catalogue import document_tokens

    path = __import__("tempfile").mkdtemp()
    spark.createDataFrame([(1, "one two"), (1, "two three"), (2, "two"), (None, "two"), (3, None)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    tokens = document_tokens(spark, path)
    assert {r.token: r.df for r in frequency.doc_frequency(tokens, "doc_id", "token", 1, 1.0, 10).collect()} == {"two": 3, "one": 1, "three": 1}
    assert {(r.doc_id, r.token): (r.tf, r.df) for r in frequency.tfidf(tokens, "doc_id", "token").where(F.col("token") == "two").collect()} == {(1, "two"): (2, 3), (2, "two"): (1, 3), (None, "two"): (1, 3)}


def test_texts_are_cut_into_words_once_for_their_pairs(spark, monkeypatch):
    asked, real = [], frequency.save
    monkeypatch.setattr(frequency, "save", lambda df, label: asked.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, label))
    docs = spark.createDataFrame([(1, ["a", "b", "a", "b", None]), (2, ["a", "b", "c"]), (3, []), (4, None), (5, ["c"])], "doc long, words array<string>")
    got = frequency.bigrams(docs, "doc", "words", 1, 0.0).collect()
    assert {(r.a, r.b): (r.nab, round(r.score, 6)) for r in got} == {("a", "b"): (3, round(2 * 3 / 9, 6))}
    assert sum(p.count("LogicalRDD") for p in asked) == 1 and "flatten" not in asked[0]
