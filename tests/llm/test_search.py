"""Nearest neighbours, hard negatives and lexical search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywind.llm import hard_negatives, lexical, multi_index, queries

VECTORS = "vec_id long, embedding array<double>, label int, score string, rank int"  # score, rank: clashing names


def vectors(spark, x, labels, extra=()):
    return spark.createDataFrame([(i, [float(c) for c in v], labels[i], "x", 0) for i, v in enumerate(x)] + list(extra), VECTORS)


ODD = [
    (100001, None, 1, None, None), (100002, [], 1, "", 1), (100003, [0.0] * 6, 1, "", 1), (100004, [math.nan] + [0.0] * 5, 1, "", 1), (100005, [math.inf] * 6, 1, "", 1),
    (100006, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "", 1), (None, [0.5] * 6, 1, "", 1), (None, [0.4] * 6, 2, "", 1), (100007, [0.3] * 6, None, "", 1),
    (100008, [0.3, 0.2], 1, "", 1), (100008, [0.3, 0.25], 2, "", 1), (100009, [0.1] * 6, 3, "", 1), (100009, [0.1] * 6, 3, "", 1), (100000, [0.2] * 6, 3, "", 1), (100000, [0.9, 0.2, 0.1, 0.0, 0.0, 0.3], 2, "", 1),
]


# Nearest neighbours.


def cosines(x, q):
    return (x @ q) / np.sqrt((x * x).sum(1) * (q @ q))


@pytest.mark.parametrize("radius", [-1, 0, 3, 15, 16, 40, 63, 100, 128])
def test_probing_finds_every_code_within_the_radius(radius):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (3000, 16), np.uint8)
    codes[:500] = codes[0] ^ np.packbits(rng.random((500, 128)) < 0.1, axis=1)  # some near ones
    off = np.bitwise_count(multi_index.words(codes) ^ multi_index.words(codes[:1])).sum(1)
    assert (multi_index.radii(radius, 16) + 1).sum() == radius + 1
    assert multi_index.Tables(codes).within(codes[0], radius).tolist() == np.flatnonzero(off <= radius).tolist()


def test_rotation_is_learnt_and_keeps_lengths():
    rng = np.random.default_rng(0)
    x = multi_index.unit(rng.normal(size=(2000, 16)) * np.linspace(3, 0.2, 16))
    learnt, blind = multi_index.Rotation(16, x, 64), multi_index.Rotation(16, x, 64, rounds=0)
    for r in (learnt, blind):
        assert r.turn.shape == (16, 64)
        assert all(np.allclose(r.turn[:, s : s + 16].T @ r.turn[:, s : s + 16], np.eye(16)) for s in range(0, 64, 16))
    lost = lambda r: ((np.sign((x - r.mean) @ r.turn) / 4 - (x - r.mean) @ r.turn) ** 2).sum()
    assert lost(learnt) < 0.95 * lost(blind)


def test_neighbours_of_the_smallest_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect() if r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got, hit, asked = queries.op11_multi_index(spark, sf).collect(), 0, 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = cosines(x, x[i])
        s[ids == ids[i]] = -9
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == ids[i])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s[np.flatnonzero(ids == v)[0]] - c) < 1e-9 for _, v, c in mine)
        hit += len({v for _, v, _ in mine} & set(ids[np.argsort(-s, kind="stable")[:5]].tolist()))
        asked += 5
    assert hit >= 0.9 * asked and len(got) == asked


@pytest.mark.parametrize("dim", [3, 64, 200])
def test_recall_over_many_shards(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(3000, dim)) + 0.5  # a mean that isn't zero
    x[1000:2000] = x[rng.integers(0, 1000, 1000)] + 0.3 * rng.normal(size=(1000, dim))  # neighbours
    got = multi_index.search(vectors(spark, x, [0] * len(x)).repartition(5), F.col("vec_id") % 20 == 0, shard=700, block=64).collect()
    hit = 0
    for i in range(0, 3000, 20):
        s = cosines(x, x[i])
        s[i] = -9
        hit += len({r.vec_id for r in got if r.query_id == i} & set(np.argsort(-s, kind="stable")[:5].tolist()))
    assert len(got) == 750 and hit >= 0.9 * 750


def test_odd_vectors_ties_and_few_candidates(spark):
    x = np.random.default_rng(1).normal(size=(12, 6))
    x[5] = x[4] = 2 * x[0]
    table = vectors(spark, x, [0] * 12, ODD)
    got = multi_index.search(table, F.col("vec_id") % 10 == 0, k=50).orderBy("query_id", "rank").collect()
    first = [r for r in got if r.query_id == 0]
    assert [r.vec_id for r in first[:2]] == [4, 5] and abs(first[0].score - 1) < 1e-12 and first[0].score == first[1].score
    assert len(first) == 11 + 2 + 1 + 2 + 2 and not {r.vec_id for r in first} & {100001, 100002, 100003, 100004, 100005, 100006, 100008}  # the label is nothing here
    same = [r for r in got if r.query_id == 100000]  # two different vectors of one id, each a query
    assert sorted(r.rank for r in same)[:4] == [1, 1, 2, 2] and all(r.vec_id != 100000 for r in same)
    tied = [r.vec_id for r in same if abs(r.score - 1) < 1e-9]
    assert tied[-2:] == [None, None] and tied[:3] == [100007, 100009, 100009]
    empty = multi_index.search(table.where("false"), F.col("vec_id") % 10 == 0)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0


# Hard negatives.


def mined(rows, is_anchor, positives=5, k=10):
    """By Python's integers: rows of (vec_id, vector of ints, label)."""
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out, last = [], lambda i: (i is None, i or 0)
    for own, a, label in sorted({r for r in rows if r[0] is not None and is_anchor(r[0])}):
        scored = sorted(((dot(a, v), i, l) for i, v, l in rows if i != own), key=lambda s: (-s[0], last(s[1])))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            found = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:k]
            out += [(own, i, rank, j, p, s) for rank, (s, j, _) in enumerate(found, 1)]
    return sorted(out, key=str)


def whole(x, scale=256):
    return tuple(math.floor(scale * c) for c in x)


@pytest.mark.parametrize(("shard", "group"), [(8192, 512), (40, 3)])
def test_negatives_match_brute_force(spark, shard, group, monkeypatch):
    monkeypatch.setattr(hard_negatives, "A_PIVOT", 20)  # more pivots than so few rows would have
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(150, 6)), rng.normal(size=(150, 6)) / 20 + 3 * np.eye(6)[rng.integers(0, 6, 150)]])
    x[7] = x[8] = x[9]
    labels = rng.integers(0, 4, 300).tolist()
    labels[40] = 77  # an anchor without positives
    got = hard_negatives.mine(vectors(spark, x, labels, ODD), F.col("vec_id") % 10 == 0, shard=shard, group=group)
    valid = [(i, v, l) for i, v, l, _, _ in ODD if v is not None and l is not None and all(c is not None and math.isfinite(c) for c in v)]
    rows = [(i, whole(v), l) for i, v, l in [*((i, v.tolist(), labels[i]) for i, v in enumerate(x)), *valid]]
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows, lambda i: i % 10 == 0)


def test_negatives_of_the_smallest_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r.vec_id, whole(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table if r.embedding and r.label is not None]
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, sf).collect()), key=str) == mined(rows, lambda i: i % 100 == 0)


def test_few_candidates_go_to_groups_of_tight_cells(spark):
    rng = np.random.default_rng(4)
    centres = 100 * rng.normal(size=(12, 8))
    x = np.concatenate([c + rng.normal(size=(60, 8)) / 100 for c in centres])
    labels = [i // 60 for i in range(720)]
    sizes = []
    real = hard_negatives._join

    def counted(passed, *rest):
        sizes.append(passed.count())
        return real(passed, *rest)

    hard_negatives._join, was = counted, hard_negatives.A_PIVOT
    hard_negatives.A_PIVOT = 30
    try:
        got = hard_negatives.mine(vectors(spark, x, labels), F.col("vec_id") % 30 == 0, group=2)
        assert sorted(map(tuple, got.collect()), key=str) == mined([(i, whole(v), labels[i]) for i, v in enumerate(x)], lambda i: i % 30 == 0)
    finally:
        hard_negatives._join, hard_negatives.A_PIVOT = real, was
    assert sizes[0] < 0.5 * 720 * 12  # of every row for each family


def test_wide_and_degenerate_vectors(spark):
    big = [(i, [1e12 * (i + 1), 3.0, -2e11 * i], i % 2, "", 0) for i in range(30)]
    got = hard_negatives.mine(spark.createDataFrame(big, VECTORS), F.col("vec_id") % 5 == 0)
    assert len(got.collect()) > 0 and all(r.positive_score == (1 << 63) - 1 for r in got.collect())
    zero = spark.createDataFrame([(i, [0.0, 0.0], i % 2, "", 0) for i in range(8)], VECTORS)
    assert {(r.positive_score, r.negative_score) for r in hard_negatives.mine(zero, F.col("vec_id") == 0).collect()} == {(0, 0)}
    huge = spark.createDataFrame([(0, [1e308, 1e308], 0, "", 0), (1, [1.0, 1.0], 0, "", 0), (2, [0.6, 0.6], 1, "", 0)], VECTORS)
    assert hard_negatives.mine(huge, F.col("vec_id") == 0).count() == 0  # once scaled it isn't finite
    for none in (zero.where("false"), zero.where("label > 5"), zero.withColumn("label", F.lit(None).cast("int"))):
        assert hard_negatives.mine(none, F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mine(zero, F.lit(False)).count() == 0


# Lexical search.

TEXTS = [
    (1, "The cat sat on the mat."), (2, "the CAT, the cat; THE cat"), (3, None), (4, ""), (5, " .,-\x00\x7f "), (6, "Ünï-cödé 中文 😀 naïve İstanbul ÀÉ"), (7, "mat " * 3000 + "cat"),
    (8, "a b c"), (9, "the cat sat on the mat"), (10, "the cat sat on the mat"), (10, "the cat sat on the mat"), (None, "the cat sat on the mat"), (11, "x" * 5000), (12, "42 cats and 42 mats"),
]
ITEMS = [(1, "cat MAT"), (2, "the the THE cat"), (3, None), (4, ""), (5, "unknown words only"), (6, "中文 😀 NAÏVE"), (7, "42"), (7, "sat"), (1, "cat MAT"), (None, "on the mat")]


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, k=10):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df, out = Counter(t for _, c, _ in held for t in c), []
    for item, text in set(items):
        found = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def lexical_tables(spark, docs, items):
    return spark.createDataFrame([(*d, 1.0, "x") for d in docs], "doc_id long, text string, score double, term string"), spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, rank int")


@pytest.mark.parametrize(("documents", "bytes_", "block"), [(1 << 16, 1 << 24, 1024), (3, 1 << 24, 2), (1 << 16, 40, 1)])
def test_lexical_matches_brute_force(spark, documents, bytes_, block, monkeypatch):
    monkeypatch.setattr(lexical, "DOCUMENTS", documents)
    monkeypatch.setattr(lexical, "SHARD", bytes_)
    monkeypatch.setattr(lexical, "QUERIES", block)
    monkeypatch.setattr(lexical, "BROADCAST", (1 << 25) * (block > 1))
    docs, items = lexical_tables(spark, TEXTS, ITEMS)
    for k in (2, 10):
        got = lexical.search(spark, lexical.build(docs.coalesce(1)), items, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == ranked(TEXTS, ITEMS, k)


def test_lexical_of_the_smallest_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op13_lexical(spark, sf).collect()), key=str) == ranked(docs, items)


def test_only_some_documents_are_rescored(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 400)) for i in range(1500)]
    items = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 20) % 400)) for i in range(20)]
    tables = lexical_tables(spark, docs, items)
    index = lexical.build(tables[0].coalesce(1))
    assert sorted(map(tuple, lexical.search(spark, index, tables[1], 5).collect()), key=str) == ranked(docs, items, 5)
    held = spark.read.parquet(index.path).where("term != ''").select("bounds", "impacts").collect()
    for r in held:  # a byte is its impact over UNIT, rounded up
        impact = np.frombuffer(bytes(r.impacts), "<u4").astype(int)
        assert (np.frombuffer(bytes(r.bounds), np.uint8) == -(-impact // lexical.UNIT)).all()


def test_long_texts_are_counted_in_steps():
    text = b"alpha beta " * 5000 + b"z" * 7000 + b" alpha"
    for step in (1 << 22, 1000, 1):
        got = {(r["term"], r["doc"]): r["tf"] for r in lexical.counts([text[:300], b"", text] if step > 1 else [text[:300]], step).to_pylist()}
        want = {(t, d): n for d, x in enumerate([text[:300], b"", text] if step > 1 else [text[:300]]) for t, n in Counter(x.split()).items()}
        assert got == want


def test_lexical_of_empty_tables(spark):
    docs, items = lexical_tables(spark, TEXTS, ITEMS)
    for d, i in ((docs.where("false"), items), (docs.where("text is null"), items), (docs, items.where("false")), (docs, items.where("text is null"))):
        assert lexical.search(spark, lexical.build(d), i).count() == 0
