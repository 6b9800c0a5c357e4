"""Density clusters against a version that cuts the complete graph from the top."""

import numpy as np
import pytest

from tallywind.operators import density, topics


def brute(ids, x, least, samples):
    """HDBSCAN top-down: the spanning tree of the complete graph, its heaviest edge cut again and again."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, min(samples, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    seen, tree, best, to = {0}, [], reach[0].copy(), np.zeros(n, int)
    while len(seen) < n:
        j = min((i for i in range(n) if i not in seen), key=lambda i: best[i])
        tree.append((best[j], *sorted((to[j], j))))
        seen.add(j)
        near = reach[j] < best
        best[near], to[near] = reach[j][near], j
    tree.sort()

    def side(edges, start):
        next_, got = [start], {start}
        while next_:
            u = next_.pop()
            for _, a, b in edges:
                for p, q in ((a, b), (b, a)):
                    if p == u and q not in got:
                        got.add(q)
                        next_.append(q)
        return got

    def grow(points, edges, birth, root):
        """(stability, clusters) of the best cut below."""
        own, points, edges, total = set(points), set(points), list(edges), 0.0
        while edges:
            w, a, b = edges[-1]
            level, edges = 1 / max(w, 1e-12), edges[:-1]
            left, right = side(edges, a), side(edges, b)
            if len(left) >= least and len(right) >= least:
                total += len(points) * (level - birth)
                parts = [grow(s, [e for e in edges if e[1] in s], level, False) for s in (left, right)]
                below = sum(p[0] for p in parts)
                return (below, parts[0][1] + parts[1][1]) if root or below > total else (total, [own])
            for s, other in ((left, right), (right, left)):
                if len(s) < least:
                    total += len(s) * (level - birth)
                    points -= s
                    edges = [e for e in edges if e[1] in other] if len(other) >= least else []
        return total, [] if root else [own]

    label = {int(i): -1 for i in ids}
    clusters = grow(range(n), tree, 0.0, True)[1]
    for c, points in enumerate(sorted(clusters, key=min)):
        label |= {int(ids[p]): c for p in points}
    return label


def blobs(seed, dim=3):
    rng = np.random.default_rng(seed)
    centres = 12 * rng.normal(size=(5, dim))
    return np.concatenate([*(c + rng.normal(size=(30, dim)) * s for c, s in zip(centres, (0.3, 1, 0.5, 2, 0.2), strict=True)), 20 * rng.normal(size=(20, dim))])


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], "x", 1) for i, v in zip(ids, x, strict=True)], "id long, v array<double>, node string, w int")


@pytest.mark.parametrize("seed", [0, 1, 2])
@pytest.mark.parametrize("least", [5, 12])
def test_clusters_as_from_the_top(seed, least):
    x = blobs(seed)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, least - 1]
    a, b = np.triu_indices(len(x), 1)
    node, label, strength = density.condensed(a, b, np.maximum(d[a, b], np.maximum(core[a], core[b])), least)
    want = brute(np.arange(len(x)), x, least, least)
    assert dict(zip(node.tolist(), label.tolist(), strict=True)) == want and len(set(want.values())) > 3
    assert ((strength > 0) == (label >= 0)).all() and strength.max() == 1


def test_density_clusters_of_the_smallest_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding]
    rows = rows[:: max(1, len(rows) // 120)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {r.id: r.cluster for r in density.density_clusters(table(spark, ids, x), "id", "v", 3, near=len(ids)).collect()}
    assert got == brute(ids, x, 3, 3)


def test_planted_clusters_in_rounds_and_cells(spark):
    ids, x = np.arange(170) * 7, blobs(3)
    want = brute(ids, x, 8, 8)
    whole = density.density_clusters(table(spark, ids, x), "id", "v", 8, near=170)
    assert {r.id: r.cluster for r in whole.collect()} == want and whole.columns[:4] == ["id", "v", "node", "w"]
    near = {r.id: r.cluster for r in density.density_clusters(table(spark, ids, x), "id", "v", 8, near=15, few=0, cell=60).collect()}
    same = sum((near[i] == near[j]) == (want[i] == want[j]) for i in near for j in near)
    assert same > 0.97 * len(near) ** 2  # not every pair is compared


def test_forest_by_rounds_is_the_forest(spark):
    rng = np.random.default_rng(1)
    edges = {tuple(sorted(map(int, rng.choice(80, 2, replace=False)))): float(rng.integers(0, 9)) for _ in range(300)} | {(200, 201): 1.0, (201, 202): 1.0, (200, 202): 1.0}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, w double")
    one, rounds = (sorted(map(tuple, density.spanning_forest(df, few).collect())) for few in (10**6, 0))
    assert one == rounds and {(200, 201, 1.0), (200, 202, 1.0)} <= set(one)
    assert density.spanning_forest(df.where("false")).count() == 0


def test_odd_vectors_are_outliers(spark):
    rows = [(i, [float(i % 2 * 50) + i / 100, 0.0]) for i in range(24)] + [(100, None), (101, []), (102, [None, 1.0]), (103, [float("nan"), 0.0]), (104, [1.0]), (None, [0.0, 0.0]), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = density.density_clusters(df, "id", "v", 4).collect()
    assert len(got) == len(rows) and {r.id: r.cluster for r in got if r.id is None or r.id >= 100} == dict.fromkeys([100, 101, 102, 103, 104, None], -1)
    assert {r.id % 2: r.cluster for r in got if r.id is not None and r.id < 24 and r.id != 3} == {0: 0, 1: 1}
    assert density.density_clusters(df.where("false"), "id", "v").count() == 0
    assert {r.cluster for r in density.density_clusters(df.where("id = 1"), "id", "v").collect()} == {-1}
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(30)], "id long, v array<double>")
    assert density.density_clusters(same, "id", "v", 5).count() == 30


def test_topic_words_of_density_clusters(spark):
    x = blobs(4)
    rows = density.density_clusters(table(spark, np.arange(len(x)), x), "id", "v", 8)
    told = topics.outlier_share(rows, "cluster").first()
    assert told.topics >= 4 and 0 < told.outlier_percent < 30


@pytest.mark.parametrize("dim", [3, 64])
def test_nearest_by_products_are_those_by_differences(dim):
    rng = np.random.default_rng(dim)
    y = np.repeat(rng.normal(size=(150, dim)), 2, 0) + 1e6  # far from the origin products round much; each vector is there twice
    y[40:45] += 1e-6 * rng.normal(size=(5, dim))
    y[-1] = 1e200
    x = y[::3]
    same = np.zeros((len(x), len(y)), bool)
    same[np.arange(len(x)), np.arange(0, len(y), 3)] = True
    with np.errstate(all="ignore"):
        best, far = density._far(x, y, 7, same)
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    d[same] = np.inf
    want = np.argsort(d, 1, kind="stable")[:, :7]
    assert (best == want).all() and (far == np.take_along_axis(d, want, 1)).all() and (far[:, 0] == 0).sum() > 40
