"""Topics by density: clusters of vectors and outliers, after HDBSCAN (Campello, Moulavi and Sander 2013).

A graph of near neighbours is built by joins, its edges get mutual-reachability distances, a minimum spanning forest is found by
Boruvka's rounds, and the forest's condensed tree gives the clusters of most stability. Distances in the graph are exact;
which rows are compared is not, once there are more rows than a cell: a row is compared with those that share one of its nearest
pivots. Trees that no edge joins count as joined at an infinite distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.sources.shared import save

#: Rows of a cell on average, pivots at most, rows of a block, edges that one task finishes, rows of a condensed tree at most.
CELL, PIVOTS, BLOCK, EDGES, TREE = 4096, 1024, 2048, 1_000_000, 20_000_000


def _vectors(cosine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raws = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array(v, float) if i is not None and v and None not in v else None
                if x is not None and np.isfinite(x).all() and (not cosine or x.any()):
                    ids.append(i)
                    raws.append((x / np.linalg.norm(x) if cosine else x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary())], ["id", "v"])

    return run


def _matrix(raws: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raws)).reshape(len(raws), -1)


def _cells(pivots: np.ndarray, probes: int):
    """A row for each of a vector's nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v").to_pylist()) if b.num_rows else np.empty((0, pivots.shape[1]))
            far = (pivots * pivots).sum(1) - 2 * x @ pivots.T
            near = np.argsort(far, 1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("v").take(rows), pa.array(near.ravel().astype(np.int32))], ["id", "v", "cell"])

    return run


def _nearest(k: int):
    """Of two blocks of a cell, each row's k nearest in the other one, or of one block in itself."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        ids, x = table.column("id").to_numpy(), _matrix(table.column("v").to_pylist())
        own, lo, hi = (table.column(c).to_numpy() for c in ("own", "lo", "hi"))
        out = []
        for mine, other in {(lo[0], hi[0]), (hi[0], lo[0])}:
            l, r = np.flatnonzero(own == mine), np.flatnonzero(own == other)
            for s in range(0, len(l), 256):
                part = l[s : s + 256]
                if not len(r):
                    continue
                best, far = _far(x[part], x[r], k, ids[part][:, None] == ids[r][None, :])
                a, far = np.repeat(ids[part], best.shape[1]), far.ravel()
                keep = np.isfinite(far)
                out.append((a[keep], ids[r][best.ravel()][keep], far[keep]))
        a, b, d = (np.concatenate([o[c] for o in out]) if out else np.empty(0, (int, int, float)[c]) for c in range(3))
        return pa.table([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "d"])

    return run


def _far(x: np.ndarray, y: np.ndarray, k: int, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, distances) of each row's k nearest in y, ties by place, but for those marked `same`.

    Products, in one multiplication, leave out what is surely farther: what remains is measured by differences, so that
    equal vectors are at a distance of 0. What lies within the rounding of the k-th least is let through."""
    k = min(k, len(y))
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    rough = xx[:, None] + yy[None, :] - 2 * (x @ y.T)
    rough[same] = np.inf
    rough[np.isnan(rough)] = -np.inf  # squares beyond doubles
    bound = np.partition(rough, k - 1, 1)[:, k - 1] + 8 * (x.shape[1] + 4) * np.finfo(float).eps * (xx + yy.max(initial=0))
    bound[~np.isfinite(bound)] = np.inf
    row, col = np.nonzero((rough <= bound[:, None]) & ~same)
    exact = np.empty(len(row))
    for s in range(0, len(row), 4096):
        exact[s : s + 4096] = np.sqrt(((y[col[s : s + 4096]] - x[row[s : s + 4096]]) ** 2).sum(1))
    order = np.lexsort((col, exact, row))
    row, col, exact = row[order], col[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    best, far = np.zeros((len(x), k), int), np.full((len(x), k), np.inf)
    kept = place < k
    best[row[kept], place[kept]], far[row[kept], place[kept]] = col[kept], exact[kept]
    return best, far


def neighbours(df: DataFrame, name: str, vector: str, k: int, cosine: bool = False, probes: int = 3, cell: int | None = None) -> DataFrame:
    """(a, b, d): of each row its k nearest. Rows are named by `name`, a whole number; rows without one, and vectors that are
    null, empty, or hold null or non-finite values (zero ones too if cosine) have none; nor have two vectors of different length."""
    rows = save(df.select(F.col(name).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(_vectors(cosine), "id long, v binary").dropDuplicates(["id"]), "vectors")
    width = rows.groupBy(F.length("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not width:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d"))
    rows = rows.where(F.length("v") == width[0].w)  # vectors of the usual length
    pivots = min(PIVOTS, max(1, -(-width[0].n // (cell or CELL))))
    held = [bytes(r.v) for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
    placed = save(rows.mapInArrow(_cells(_matrix(held), probes), "id long, v binary, cell int"), "cells")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    work = placed.join(blocks, "cell").withColumn("own", own).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select("id", "v", "cell", "own", F.least("own", "at").alias("lo"), F.greatest("own", "at").alias("hi"))
    found = work.groupBy("cell", "lo", "hi").applyInArrow(_nearest(k), "a long, b long, d double").groupBy("a", "b").agg(F.min("d").alias("d"))
    order = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return save(found.withColumn("i", order).where(F.col("i") <= k).drop("i"), "neighbours")


def reachability(near: DataFrame, samples: int) -> DataFrame:
    """(a, b, w), a < b: w is the largest of the rows' distance and their core distances; a core distance is that to the samples-th
    nearest row, the row itself included, or to the farthest known where there are fewer."""
    order = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    core = near.withColumn("i", order).where(F.col("i") <= max(samples - 1, 0)).groupBy("a").agg(F.max("d").alias("core"))
    of = lambda c: core.select(F.col("a").alias(c), F.col("core").alias(f"core_{c}"))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.select("a", "b", F.greatest("d", F.coalesce("core_a", F.lit(0.0)), F.coalesce("core_b", F.lit(0.0))).alias("w"))


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _kruskal(table: pa.Table) -> pa.Table:
    """Of edges between components x and y, those of the forest, by weight and then by their ends."""
    table = table.sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")])
    _, ends = np.unique(np.r_[table.column("x").to_numpy(), table.column("y").to_numpy()], return_inverse=True)
    parent, keep = np.arange(ends.max(initial=0) + 1), []
    for i, (x, y) in enumerate(ends.reshape(2, -1).T.tolist()):
        x, y = _find(parent, x), _find(parent, y)
        if x != y:
            parent[y] = x
            keep.append(i)
    return table.take(pa.array(keep, pa.int64())).select(["a", "b", "w"])


def spanning_forest(edges: DataFrame, few: int = EDGES) -> DataFrame:
    """(a, b, w) of the minimum spanning forest of edges(a, b, w), ties by a and b.

    In a round each component takes its least edge; what hangs together becomes a component, by pointers that are
    doubled until they stay; of the edges between two components the least is kept. Once `few` edges are left,
    at most, one task finishes."""
    rest, taken = save(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", "w"), "forest-edges"), []
    while True:
        left = rest.count()
        if left <= few:
            taken.append(rest.groupBy().applyInArrow(_kruskal, "a long, b long, w double") if left else rest.select("a", "b", "w"))
            break
        edge = F.struct("w", "a", "b").alias("e")
        both = rest.select(F.col("x").alias("u"), F.col("y").alias("v"), edge).unionByName(rest.select(F.col("y").alias("u"), F.col("x").alias("v"), edge))
        best = save(both.groupBy("u").agg(F.min(F.struct("e", "v")).alias("m")).select("u", "m.v", "m.e"), "least-edges")
        taken.append(best.select("e.a", "e.b", "e.w").distinct())
        back = best.select(F.col("u").alias("v"), F.col("v").alias("back"))
        to = save(best.join(back, "v").select("u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("p")), "pointers")
        while True:  # each pointer's length doubles
            far = to.select(F.col("u").alias("p"), F.col("p").alias("q"))
            to = save(to.join(far, "p").select("u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "pointers")
            if not to.where("moved").limit(1).count():
                break
            to = to.drop("moved")
        of = lambda c: to.select(F.col("u").alias(c), F.col("p").alias(f"{c}_to"))  # noqa: E731,B023
        moved = rest.join(of("x"), "x").join(of("y"), "y").where("x_to != y_to")
        least = moved.groupBy(F.least("x_to", "y_to").alias("x"), F.greatest("x_to", "y_to").alias("y")).agg(F.min(F.struct("w", "a", "b")).alias("e"))
        rest = save(least.select("x", "y", "e.a", "e.b", "e.w"), "forest-edges")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return save(out.select("a", "b", "w"), "forest")


def condensed(a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, cluster, strength) of a spanning forest's nodes: cluster -1 is an outlier, the others are numbered by their smallest
    nodes; strength is a node's lambda over the largest of its cluster.

    From the least edge up, components under `least` nodes are joined; one that reaches that size is a cluster, smaller ones
    that join a cluster fall out of it there, and two clusters that meet are the children of a new one. A cluster stays whole
    unless its children's stabilities add up to more; the last one, of everything, never does."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    n, (x, y) = len(nodes), ends.reshape(2, -1)
    order = np.lexsort((b, a, w))
    joins = [(x[i], y[i], w[i]) for i in order]
    parent, members = np.arange(n), {i: [i] for i in range(n)}
    cluster: dict[int, int] = {}
    of, lam = np.full(n, -1), np.zeros(n)
    children, total, size, birth = [], [], [], []

    def new(kids: tuple[int, ...], points: int, level: float) -> int:
        children.append(kids)
        total.append(points * level)
        size.append(points)
        birth.append(0.0)
        return len(children) - 1

    def fall(points: list[int], c: int, level: float) -> None:
        of[points], lam[points] = c, level

    def join(i: int, j: int, level: float) -> None:
        c, d = cluster.pop(i, None), cluster.pop(j, None)
        parent[j] = i
        if c is not None and d is not None:
            birth[c] = birth[d] = level
            cluster[i] = new((c, d), size[c] + size[d], level)
        elif c is None and d is None:
            points = members.pop(i) + members.pop(j) if len(members[i]) >= len(members[j]) else members.pop(j) + members.pop(i)
            if len(points) >= least:
                cluster[i] = new((), len(points), level)
                fall(points, cluster[i], level)
            else:
                members[i] = points
        else:
            c, small = (c, j) if c is not None else (d, i)
            points = members.pop(small)
            fall(points, c, level)
            total[c] += len(points) * level
            size[c] += len(points)
            cluster[i] = c

    for i, j, far in joins:
        i, j = _find(parent, i), _find(parent, j)
        if i != j:
            join(i, j, 1 / max(far, 1e-12))
    roots = [i for i in range(n) if parent[i] == i]
    for j in roots[1:]:  # trees that no edge joins
        join(_find(parent, roots[0]), j, 0.0)
    stable = [total[c] - size[c] * birth[c] for c in range(len(children))]
    chosen = [True] * len(children)
    for c, kids in enumerate(children):  # children come before their parents
        if kids and (sum(stable[k] for k in kids) > stable[c] or c == len(children) - 1):
            chosen[c], stable[c] = False, sum(stable[k] for k in kids)
    if children:
        chosen[-1] = False
    told = [-1] * len(children)
    for c in reversed(range(len(children))):  # the highest chosen one holds all below
        if told[c] < 0 and chosen[c]:
            told[c] = c
        for k in children[c]:
            told[k] = told[c]
    label = np.array([told[c] if c >= 0 else -1 for c in of], int)
    names: dict[int, int] = {}
    for i in range(n):  # nodes rise
        if label[i] >= 0:
            names.setdefault(label[i], len(names))
    label = np.array([names.get(c, -1) for c in label], int)
    most = np.zeros(max(len(names), 1))
    np.maximum.at(most, label[label >= 0], lam[label >= 0])
    strength = np.where(label >= 0, np.divide(lam, most[label], out=np.zeros(n), where=most[label] > 0), 0.0)
    return nodes, label, strength


def _condense(least: int):
    def run(table: pa.Table) -> pa.Table:
        nodes, label, strength = condensed(*(table.column(c).to_numpy() for c in "abw"), least)
        return pa.table([pa.array(nodes), pa.array(label.astype(np.int32)), pa.array(strength)], names=["node", "cluster", "strength"])

    return run


def density_clusters(df: DataFrame, name: str, vector: str, least: int = 10, samples: int | None = None, near: int = 15, cosine: bool = False, few: int = EDGES, cell: int | None = None) -> DataFrame:
    """M-12: df with cluster (-1: an outlier) and strength. least: rows of a cluster, 2 at least; samples: for core distances, as many as
    `least` if not given; near: neighbours of each row in the graph.

    The condensed tree takes one task, with three numbers a row; over TREE rows it raises. Rows that have no neighbours
    are outliers; rows that repeat a name go with its first."""
    if least < 2:
        raise ValueError(f"clusters of {least} rows")
    samples = samples or least
    forest = spanning_forest(reachability(neighbours(df, name, vector, max(near, samples), cosine, cell=cell), samples), few)
    if (n := forest.count()) > TREE:
        raise ValueError(f"a condensed tree of {n} edges; at most {TREE}")
    told = forest.groupBy().applyInArrow(_condense(least), "node long, cluster int, strength double").toDF("_node", "_cluster", "_strength")
    out = df.join(told, F.col(name).cast("long") == F.col("_node"), "left")
    held = [c for c in df.columns if c not in ("cluster", "strength")]
    return out.select(*held, F.coalesce("_cluster", F.lit(-1)).alias("cluster"), F.coalesce("_strength", F.lit(0.0)).alias("strength"))
