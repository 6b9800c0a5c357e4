"""Approximate nearest neighbours by multi-index hashing (operator 11).

A rotation is learnt from a bounded sample of the unit vectors so that the signs of a turned vector lose little of it
(iterative quantisation, Gong and Lazebnik 2011); a vector with fewer dimensions than the code has bits is turned by
several rotations, each learnt from its own start. A code's substrings are its bytes, and a shard of rows has one table for each
substring. A radius r over m substrings gives the substrings radii whose successors add up to r + 1, so that a code within r
is within its radius in one substring at least (the general pigeonhole principle): probing those balls finds every code
of the shard within r. Found codes' whole distances are verified, and what is left is ranked by the cosines of the original vectors.

The radius is the one that holds a share TARGET of the sample's own nearest neighbours; among more rows neighbours are nearer,
so that the share can only rise. A query that finds fewer than k rows in a shard probes it again with a wider radius.

Every row is indexed. Rows are dealt to shards and queries to blocks of bounded size; each pair is separate work and gives
k rows a query. The sample is SAMPLE rows, those with the smallest hashes, or fewer if they have over NUMBERS components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; a vector's
candidates have its length; rows with the query's vec_id aren't its candidates; rows without a vec_id are candidates and never
queries, last among equal scores; repeated rows are candidates each; of rows that repeat a query's id each different
vector is a query with its own ranks; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.llm.common import save

BITS, SHARD, QUERIES, SAMPLE, NUMBERS, TARGET = 128, 32768, 4096, 4096, 1 << 22, 0.97
#: Bytes by their number of ones, and how many bytes have at most so many.
BALL = np.array(sorted(range(256), key=lambda x: (x.bit_count(), x)), np.int64)
WITHIN = np.cumsum(np.bincount([x.bit_count() for x in range(256)]))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Rotation:
    """What turns unit vectors of one length into codes, and the radius that holds their neighbours."""

    def __init__(self, dim: int, sample: np.ndarray, bits: int = BITS, k: int = 5, rounds: int = 10, seed: int = 5):
        rng, parts, left = np.random.default_rng((seed, dim)), [], bits
        self.bits, self.mean = bits, sample.mean(0) if len(sample) else np.zeros(dim)
        x = sample - self.mean
        axes = np.eye(dim)
        if dim > bits:  # the axes on which the sample spreads most
            axes = np.linalg.svd(x, full_matrices=False)[2].T if len(x) > bits else np.linalg.qr(rng.normal(size=(dim, bits)))[0]
            axes = axes[:, :bits]
        y = x @ axes
        while left > 0:
            turn = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))[0]
            for _ in range(rounds if len(y) > axes.shape[1] else 0):
                a, _, b = np.linalg.svd(y.T @ np.where(y @ turn > 0, 1.0, -1.0))
                turn = a @ b
            parts.append((axes @ turn)[:, :left])
            left -= parts[-1].shape[1]
        self.turn = np.concatenate(parts, 1)
        self.radius = self._radius(sample, k)

    def _radius(self, sample: np.ndarray, k: int) -> int:
        if len(sample) <= 4 * k:
            return self.bits
        codes, asks = words(self.codes(sample)), np.arange(0, len(sample), max(1, len(sample) // 512))
        cosine = sample[asks] @ sample.T
        cosine[np.arange(len(asks)), asks] = -np.inf
        near = np.argpartition(-cosine, k - 1, 1)[:, :k]
        off = np.bitwise_count(codes[asks][:, None, :] ^ codes[near]).sum(2)
        return int(np.quantile(off, TARGET, method="higher"))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, bits / 8) bytes of unit vectors."""
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


def words(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view("<u8")


def radii(radius: int, m: int) -> np.ndarray:
    """A radius for each of m substrings; -1: it needn't be probed."""
    return (radius + 1) // m - 1 + (np.arange(m) < (radius + 1) % m)


class Tables:
    """A shard's codes, with a table for each substring: the rows in the order of its values, and where each value starts."""

    def __init__(self, codes: np.ndarray):
        self.words, self.n, m = words(codes), *codes.shape
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(m)]
        self.starts = [np.r_[0, np.cumsum(np.bincount(codes[:, j], minlength=256))] for j in range(m)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within the radius, in order."""
        met = np.zeros(self.n, bool)
        for j, r in enumerate(radii(radius, len(code))):
            if r >= 0:
                values = BALL[: WITHIN[min(int(r), 8)]] ^ int(code[j])
                start, size = self.starts[j][values], np.diff(self.starts[j])[values]
                at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                met[self.order[j][at]] = True
        rows = np.flatnonzero(met)
        return rows[np.bitwise_count(self.words[rows] ^ words(code[None])).sum(1) <= radius]


def nearest(x: np.ndarray, q: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of unit vectors x with the largest cosines to q, ties in the rows' order, and the cosines."""
    rough = x[rows] @ q
    if len(rows) > k:
        near = rough >= np.partition(rough, len(rows) - k)[len(rows) - k] - 1e-12
        rows = rows[near]
    score = (x[rows] * q).sum(1)  # summed alike in every row, so that equal vectors have equal scores
    order = np.argsort(-score, kind="stable")[:k]
    return rows[order], score[order]


def _raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim, width, vector: the rows that take part, in the width they came in."""
    for b in batches:
        width = 4 if pa.types.is_float32(b.column(1).type.value_type) else 8
        keep, dims, raws = [], [], []
        for i, v in enumerate(b.column(1)):
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = np.asarray(v.values, f"<f{width}")
                if np.isfinite(x).all() and x.any():
                    keep.append(i)
                    dims.append(len(x))
                    raws.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array([width] * len(keep), pa.int32()), pa.array(raws, pa.binary())], ["vec_id", "dim", "width", "vector"])


def _matrix(raws: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), f"<f{width}").reshape(len(raws), -1)


def learn(rows: DataFrame, bits: int = BITS, k: int = 5) -> dict[int, Rotation]:
    """A rotation for each length of vector in the sample. bits: a multiple of 64."""
    widest = rows.agg(F.max("dim")).first()[0] or 1
    taken = rows.select("dim", "width", "vector").orderBy(F.xxhash64("vector"), "vector").limit(min(SAMPLE, max(64, NUMBERS // widest))).collect()
    by: dict[int, list] = {}
    for r in taken:
        by.setdefault(r["dim"], []).append(bytes(r["vector"]))
    return {d: Rotation(d, unit(_matrix(raws, taken[0]["width"])), bits, k) for d, raws in by.items()}


def _encode(turns: dict[int, Rotation], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare: dict[int, Rotation] = {}
        for b in batches:
            dims, raws, codes = b.column("dim").to_numpy(), b.column("vector").to_pylist(), [b""] * b.num_rows
            for d in np.unique(dims).tolist():
                turn = turns.get(d) or rare.setdefault(d, Rotation(d, np.empty((0, d)), bits))  # a length that isn't in the sample
                own = np.flatnonzero(dims == d)
                for i, code in zip(own, turn.codes(unit(_matrix([raws[i] for i in own], b.column("width")[0].as_py()))), strict=True):
                    codes[i] = code.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary())], ["vec_id", "dim", "width", "vector", "code"])

    return run


def _search(k: int, bits: int, radius: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending")])  # the order of ties, null ids last
        asks, dims = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "dim"))
        ids, raws, held = table.column("vec_id"), table.column("vector").to_pylist(), table.column("code").to_pylist()
        width = table.column("width")[0].as_py()
        number, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        found: list[tuple] = []
        for d in np.unique(dims).tolist():
            rows, ask = np.flatnonzero(~asks & (dims == d)), np.flatnonzero(asks & (dims == d))
            if not len(rows) or not len(ask):
                continue
            x, q = unit(_matrix([raws[i] for i in rows], width)), unit(_matrix([raws[i] for i in ask], width))
            codes, tables = _matrix_of_codes(held, ask), Tables(_matrix_of_codes(held, rows))
            for a, code, v in zip(ask, codes, q, strict=True):
                other, r = ~known[rows] | (number[rows] != number[a]), radius.get(d, bits)
                while True:
                    near = tables.within(code, r)
                    near = near[other[near]]
                    if len(near) >= k or r >= bits:
                        break
                    r = min(bits, r + bits // 8)
                near, score = nearest(x, v, near, k)
                found.append((np.full(len(near), a), rows[near], score))
        i, j, score = (np.concatenate([f[c] for f in found]) if found else np.empty(0, (int, int, float)[c]) for c in range(3))
        twin = table.column("twin").to_numpy()
        return pa.table([pa.array(number[i]), pa.array(twin[i]), ids.take(pa.array(j)).combine_chunks(), pa.array(score)], names=["query_id", "twin", "vec_id", "score"])

    return run


def _matrix_of_codes(held: list[bytes], rows: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(held[i] for i in rows), np.uint8).reshape(len(rows), -1)


def search(vectors: DataFrame, queries: Column, k: int = 5, bits: int = BITS, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of vectors(vec_id, embedding) for every row where `queries` holds."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).mapInArrow(_raws, "vec_id long, dim int, width int, vector binary")
    rows = save(rows, "vectors")
    turns = learn(rows, bits, k)
    rows = save(rows.mapInArrow(_encode(turns, bits), "vec_id long, dim int, width int, vector binary, code binary"), "codes")
    ask = rows.where(queries & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "vector"]).withColumn("twin", F.xxhash64("vector"))
    n, m = rows.count(), ask.count()
    shards = max(-(-n // shard), 1)
    blocks = max(-(-m // block), min(-(-2 * vectors.sparkSession.sparkContext.defaultParallelism // shards), -(-m // 64)), 1)
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    held = ["vec_id", "dim", "width", "vector", "code"]
    told = rows.select(*held, F.lit(False).alias("asks"), F.lit(0).cast("long").alias("twin"), F.pmod(F.xxhash64("vector", "vec_id"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    asked = ask.select(*held, F.lit(True).alias("asks"), "twin", every(shards).alias("shard"), F.pmod(F.xxhash64("twin", "vec_id"), F.lit(blocks)).cast("int").alias("block"))
    cell = (F.col("shard").cast("long") * blocks + F.col("block")).alias("cell")
    work = told.unionByName(asked).select(*held, "asks", "twin", cell).repartition(min(shards * blocks, 100_000), "cell")
    found = work.groupBy("cell").applyInArrow(_search(k, bits, {d: t.radius for d, t in turns.items()}), "query_id long, twin long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
