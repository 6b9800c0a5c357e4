"""Near-duplicate vectors by cross-polytope hashing (operator 4).

Vectors turn by three rounds of random signs and a fast Hadamard transform; the nearest of the 2d signed axes is a
hash (Andoni et al. 2015). A table's key joins two such hashes; each vector enters its best `probes` keys in each
table (multiprobe), those whose axes lose least. Vectors of one label that share a key in any table are candidates,
and each candidate pair's cosine is verified in double precision.

Equal vectors of one label are one node, with a count. Keys that one node alone holds are dropped before vectors are
sent, in the width they came in. A key's nodes are dealt into blocks of a bounded size and each pair of blocks is compared
on its own, so that a key of n nodes sends n * n / BLOCK vectors. What leaves is a number of links per node and the edges
of a spanning forest, never all pairs. A pair is counted at the first key that both hold. Components come from
connected_components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link
with nothing; vectors of different length don't link; repeated rows link with each other; of equal vec_ids each
row counts; a null vec_id gets its row, and never is a component's id unless all are null; an empty table gives
no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.llm.common import connected_components, save

TABLES, PROBES, BLOCK, SMALL = 4, 4, 4096, 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def keys(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """(rows, tables * probes) keys of unit vectors, in the order of the tables."""
    n, dim = x.shape
    d = max(2, 1 << (dim - 1).bit_length())
    wide = np.zeros((n, d))
    wide[:, :dim] = x
    out, few = np.empty((n, tables, probes), np.int64), min(4, d)
    for t in range(tables):
        axes, loss = [], []
        for half in range(2):
            rng, y = np.random.default_rng((seed, t, half, d)), wide
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            top = np.argsort(-np.abs(y), 1, kind="stable")[:, :few]
            v = np.take_along_axis(y, top, 1)
            axes.append(2 * top + (v < 0))
            loss.append((np.abs(v[:, :1]) - np.abs(v)) ** 2)
        both = (axes[0][:, :, None] * (2 * d) + axes[1][:, None, :]).reshape(n, -1)
        order = np.argsort((loss[0][:, :, None] + loss[1][:, None, :]).reshape(n, -1), 1, kind="stable")
        best = np.take_along_axis(both, order[:, :probes], 1) + t * (2 * d) ** 2
        out[:, t] = np.pad(best, ((0, 0), (0, probes - best.shape[1])), mode="edge")
    return out.reshape(n, -1)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, and for vectors that can link their label, node (a digest of label and vector), width of values and values."""
    for b in batches:
        nodes, raws, width = [], [], 4 if pa.types.is_float32(b.column(2).type.value_type) else 8
        for label, v in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            node = raw = None
            if label is not None and v.is_valid and len(v.values) and not v.values.null_count:
                x = np.asarray(v.values, f"<f{width}")
                if np.isfinite(x).all() and x.any():
                    raw = (x + x.dtype.type(0)).tobytes()  # -0.0 is 0.0
                    node = hashlib.blake2b(f"{len(label)}:{label}:{len(x)}:".encode() + raw, digest_size=16).digest()
            nodes.append(node)
            raws.append(raw)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array([width] * len(nodes), pa.int32()), pa.array(raws, pa.binary())], ["vec_id", "label", "node", "width", "vector"])


def _unit(raw: list[bytes], width: int) -> np.ndarray:
    """Unit vectors, in double precision, of vectors of one length."""
    x = np.frombuffer(b"".join(raw), f"<f{width}").astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _enter(tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, width = b.column("vector").to_pylist(), b.column("width")[0].as_py() if b.num_rows else 8
            for size in sorted(set(map(len, raw))):
                own = np.array([i for i, r in enumerate(raw) if len(r) == size])
                held = np.sort(keys(_unit([raw[i] for i in own], width), tables, probes), 1)
                new = np.c_[np.ones(len(own), bool), held[:, 1:] != held[:, :-1]]
                rows = pa.array(np.repeat(own, new.sum(1)))
                yield pa.RecordBatch.from_arrays([b.column("node").take(rows), b.column("label").take(rows), pa.array(np.full(len(rows), size // width, np.int32)), pa.array(held[new])], ["node", "label", "dim", "key"])

    return run


def _first_shared(a: np.ndarray, b: np.ndarray, probes: int) -> np.ndarray:
    """For each row the smallest key, by table first, that rows of a and b share."""
    best = np.full(len(a), np.iinfo(np.int64).max)
    for t in range(0, a.shape[1], probes):
        for p in range(t, t + probes):
            for q in range(t, t + probes):
                best = np.where(a[:, p] == b[:, q], np.minimum(best, a[:, p]), best)
    return best


def _pairs(x: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i and j of unit vectors x with a cosine of `least` or more, one of them `left` and the other `right` of the
    same group, each pair once; group rises."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    small = np.repeat((sizes <= SMALL) & np.logical_and.reduceat(left & right, starts), sizes)
    out, at = [], np.flatnonzero(small)
    for d in range(1, SMALL):  # all small groups at once
        at = at[at + d < len(group)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        for s in range(0, len(at), 1 << 14):
            i = at[s : s + (1 << 14)]
            i = i[np.einsum("nd,nd->n", x[i], x[i + d]) >= least]
            out.append((i, i + d))
    for s, n in zip(starts[~small[starts]], sizes[~small[starts]], strict=True):
        l, r = s + np.flatnonzero(left[s : s + n]), s + np.flatnonzero(right[s : s + n])
        for c in range(0, len(l), 512):
            i, j = np.nonzero(x[l[c : c + 512]] @ x[r].T >= least)
            i, j = l[c + i], r[j]
            once = (i < j) | ~(left[j] & right[i])
            out.append((i[once & (i != j)], j[once & (i != j)]))
    return tuple(np.concatenate(c) if out else np.empty(0, int) for c in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int))


def _compare(rows: pa.Table, least: float, tables: int, probes: int) -> pa.RecordBatch:
    """Links counted by node, and forest edges, of whole groups: rows of one label, dim, key, lo and hi, in order."""
    node, many, key = rows.column("node").combine_chunks(), rows.column("many").to_numpy(), rows.column("key").to_numpy()
    place = [rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("label", "dim", "key", "lo", "hi")]
    group = np.cumsum(np.r_[False, np.logical_or.reduce([c[1:] != c[:-1] for c in place])])
    block, lo, hi = (rows.column(c).to_numpy() for c in ("block", "lo", "hi"))
    raw, dim, width = rows.column("vector").to_pylist(), rows.column("dim").to_numpy(), rows.column("width")[0].as_py()
    found = []
    for d in np.unique(dim):
        own = np.flatnonzero(dim == d)
        x = _unit([raw[k] for k in own], width)
        i, j = _pairs(x, group[own], block[own] == lo[own], block[own] == hi[own], least)
        if len(i):
            used, of = np.unique(np.concatenate([i, j]), return_inverse=True)
            held, a, b = keys(x[used], tables, probes), of[: len(i)], of[len(i) :]
            mine = np.concatenate([_first_shared(held[a[s : s + 65536]], held[b[s : s + 65536]], probes) == key[own[i[s : s + 65536]]] for s in range(0, len(i), 65536)])
            found.append((own[i[mine]], own[j[mine]]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))
    links = (np.bincount(i, many[j], len(node)) + np.bincount(j, many[i], len(node))).astype(np.int64)
    part = np.arange(len(node))  # numbers sink to the smallest until nothing moves
    while True:
        low = part.copy()
        np.minimum.at(low, i, part[j])
        np.minimum.at(low, j, part[i])
        low = low[low]
        if (low == part).all():
            break
        part = low
    linked, tied = np.flatnonzero(links), np.flatnonzero(part != np.arange(len(node)))
    other = pa.concat_arrays([pa.nulls(len(linked), pa.binary()), node.take(pa.array(part[tied]))])
    return pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate([linked, tied]))), other, pa.array(np.concatenate([links[linked], np.zeros(len(tied), np.int64)]))], ["node", "other", "links"])


def _verify(least: float, tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = ("label", "dim", "key", "lo", "hi"), []
        for b in batches:
            if not b.num_rows:
                continue
            same = np.ones(b.num_rows, bool)  # rows of the batch's last group: it may go on in the next batch
            for c in group:
                v = b.column(c).dictionary_encode().indices.to_numpy()
                same &= v == v[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if held and (cut or not all(held[-1].column(c)[-1] == b.column(c)[0] for c in group)):
                first = cut and int(np.argmin([*_alike(b, held[-1], group), False]))
                whole = [*held, b.slice(0, first)]
                yield _compare(pa.Table.from_batches(whole), least, tables, probes)
                held, b, cut = [], b.slice(first), cut - first
            if cut:
                yield _compare(pa.Table.from_batches([b.slice(0, cut)]), least, tables, probes)
                b = b.slice(cut)
            held.append(b)
        if held:
            yield _compare(pa.Table.from_batches(held), least, tables, probes)

    return run


def _alike(b: pa.RecordBatch, last: pa.RecordBatch, group: tuple[str, ...]) -> list[bool]:
    """Which rows of b are of the last row's group."""
    alike = np.ones(b.num_rows, bool)
    for c in group:
        alike &= pc.equal(b.column(c), last.column(c)[-1]).to_numpy(zero_copy_only=False)
    return alike.tolist()


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    marked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    marked = save(marked.mapInArrow(_mark, "vec_id long, label string, node binary, width int, vector binary"), "vectors")
    nodes = marked.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("width").alias("width"), F.first("vector").alias("vector"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("many"))
    nodes = save(nodes, "vector-nodes")
    entries = save(nodes.select("node", "label", "width", "vector").mapInArrow(_enter(tables, probes), "node binary, label string, dim int, key long"), "vector-keys")
    place = ["label", "dim", "key"]
    sizes = entries.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    live = entries.join(sizes.drop("n"), place).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    live = live.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    live = live.select(*place, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node")
    work = live.join(nodes.select("node", "many", "width", "vector"), "node").repartition(*place, "lo", "hi").sortWithinPartitions(*place, "lo", "hi")
    found = save(work.mapInArrow(_verify(least, tables, probes), "node binary, other binary, links long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of = nodes.select("node", "first_id", "many").join(parts, "node", "left").join(links, "node", "left").select("node", "first_id", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("part"))
    of = save(of, "vector-parts")
    smallest = save(of.groupBy("part").agg(F.min("first_id").alias("component_id")), "smallest")  # so that the join of a large part can be split
    told = of.join(smallest, "part").select(F.col("node").alias("of_node"), "n_links", "component_id")
    rows = marked.select("vec_id", "node").join(told, F.col("node") == F.col("of_node"), "left")
    component = F.when(F.col("of_node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
