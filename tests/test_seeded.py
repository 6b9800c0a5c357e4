"""Seeded topics: planted topics are found where their seeds say, in any layout."""

import math

import numpy as np
import pytest

from tallywind.operators import seeded

F = seeded.F
GROUPS = [[f"{g}{i}" for i in range(12)] for g in "abc"]


def planted(spark, n=120):
    rng = np.random.default_rng(0)
    rows = []
    for d in range(n):
        mix = rng.dirichlet([0.2] * 3)
        for _ in range(60):
            rows.append((d, GROUPS[rng.choice(3, p=mix)][int(rng.integers(0, 12))] if rng.random() > 0.1 else f"noise{int(rng.integers(0, 5))}"))
    return spark.createDataFrame([*rows, (None, "a1"), (3, None)], "doc long, term string")


def test_digamma():
    assert np.allclose(seeded.digamma(np.array([1.0, 0.5, 1e-3, 30.0])), [-0.5772156649015329, -1.9635100260214235, -1000.5755719318103, 3.384438] , atol=1e-6)
    x = np.linspace(0.1, 20, 50)
    assert np.allclose(seeded.digamma(x), [(math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5 for v in x], atol=1e-6)


def test_seeds_hold_their_topics_in_any_layout(spark, monkeypatch):
    tokens = planted(spark)
    seeds = spark.createDataFrame([("b1", 0), ("b2", 0), ("c1", 1), ("a1", 2), ("nowhere", 1)], "term string, topic int")
    one = seeded.seeded_topics(tokens, "doc", "term", 3, seeds, 4)
    monkeypatch.setattr(seeded, "ROWS", 1000)
    many = seeded.seeded_topics(tokens.repartition(7), "doc", "term", 3, seeds, 4)
    got, other = ({r.term: r.lam for r in x.collect()} for x in (one, many))
    assert set(got) == {w for g in GROUPS for w in g} | {f"noise{i}" for i in range(5)}
    assert all(np.allclose(got[t], other[t], rtol=1e-6) for t in got)
    best = seeded.topic_terms(one, 10).collect()
    for topic, letter in ((0, "b"), (1, "c"), (2, "a")):
        mine = [r for r in best if r.topic == topic]
        assert sum(r.term[0] == letter for r in mine) == 10 and sorted(r.rank for r in mine) == list(range(1, 11))
    total = np.sum(list(got.values()))
    assert abs(total - (tokens.where("doc is not null and term is not null").count() + len(got) + 4 * 50)) < 1e-3  # every token counts once, and the priors


def test_steps_by_batches(spark):
    seeds = spark.createDataFrame([("b1", 0), ("c1", 1), ("a1", 2)], "term string, topic int")
    best = seeded.topic_terms(seeded.seeded_topics(planted(spark), "doc", "term", 3, seeds, 2, batches=3), 8).collect()
    assert all(sum(r.term[0] == letter for r in best if r.topic == topic) >= 7 for topic, letter in ((0, "b"), (1, "c"), (2, "a")))


def test_odd_tables(spark):
    seeds = spark.createDataFrame([("b1", 5)], "term string, topic int")
    with pytest.raises(Exception, match="no topic 5"):
        seeded.seeded_topics(planted(spark, 5), "doc", "term", 3, seeds, 1).collect()
    assert seeded.seeded_topics(planted(spark, 5).where("false"), "doc", "term", 3, seeds.where("false"), 1).count() == 0


def test_documents_side_by_side_are_as_each_alone():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 40)
    starts = np.cumsum(sizes) - sizes
    terms, counts, beta = np.concatenate([rng.permutation(50)[:n] for n in sizes]), rng.integers(1, 5, sizes.sum()).astype(float), rng.random((50, 3))
    told = seeded.infer(terms, counts, starts, beta, 0.3)
    for at, n in zip(starts, sizes, strict=True):
        b, gamma = beta[terms[at : at + n]], np.ones(3)
        for _ in range(50):
            theta = np.exp(seeded.digamma(gamma) - seeded.digamma(np.array([gamma.sum()])))
            before, gamma = gamma, 0.3 + theta * (counts[at : at + n] / (b @ theta) @ b)
            if np.abs(before - gamma).mean() < 1e-3:
                break
        theta = np.exp(seeded.digamma(gamma) - seeded.digamma(np.array([gamma.sum()])))
        assert np.allclose(told[at : at + n], np.outer(counts[at : at + n] / (b @ theta), theta) * b)


def test_blocks_grow_with_the_table_and_not_their_number(spark, monkeypatch):
    """Each block is sent its words' weights, so that small blocks send nearly a row for each row of the table."""
    made = []
    real = seeded.save
    monkeypatch.setattr(seeded, "save", lambda df, label: made.append((label, real(df, label))) or made[-1][1])
    monkeypatch.setattr(seeded, "ROWS", 10)
    seeded.seeded_topics(planted(spark), "doc", "term", 3, spark.createDataFrame([("b1", 0)], "term string, topic int"), 1)
    blocks = dict(made)["topic-blocks"]
    assert 1 < blocks.select("at").distinct().count() <= 4 * spark.sparkContext.defaultParallelism
    assert blocks.where("word is null").count() == 120  # a row a document
