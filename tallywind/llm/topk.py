"""Exact top-k by inner product over an impact-ordered index, score at a time (operator 10).

Components are quantised to floor(scale * x). An index holds a shard's postings (row, value) in segments, one for each
dimension and impact: the impact of a posting is the bit length of its value. Neighbouring impacts are joined into bands
until a band holds at least a SHARE of the postings; a band's segments stand side by side, dimension by dimension, in a
matrix, since a dense vector has a posting in every dimension. A block of queries goes through the bands in falling
impact and adds up its accumulators: one product adds all segments of a band. After a band, a row's postings not yet
seen can add at most the query's length times the length of what the row has left. Rows that this bound proves below
the query's k-th best score drop out; once few are left, or no band is, they are rescored exactly in integers. Rows
stand in falling order of length, so that a query stops where no later row of the shard can reach its k-th score.

Rows are dealt to shards of bounded size and queries to blocks of bounded size; each pair is separate work and gives its
best k rows a query; the last step ranks k rows per shard and query. More tasks come from more blocks rather than from
smaller shards, because k-th scores, and so the proofs, are better in large shards.

Defined results: vectors that are null or hold null or non-finite components take no part (a component too large once
scaled counts as non-finite); a vector scores 0 in the dimensions that it or the query lacks; rows with the query's
vec_id aren't its candidates; rows without a vec_id are candidates and never queries, last among equal scores; repeated
rows are candidates each; of rows that repeat a query's id each different vector is a query with its own ranks; scores
beyond 64 bits are given, and ranked, as the nearest 64-bit number (rows that can reach there are scored by Python's
integers); an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.llm.common import save

SHARD, QUERIES, FIRST, CHUNK, BATCH = 32768, 32768, 1024, 4096, 256
#: Of the postings, a band's share at least; of the pairs, the share under which they are rescored.
SHARE, FEW = 0.2, 0.01
#: Vectors whose squares sum up to less have products that 64 bits hold, in every partial sum.
NARROW = float(1 << 62)


def _quantise(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 40
        for b in batches:
            raws, wide = [], []
            for v in b.column(1):
                raw, far = None, False
                if v.is_valid and not v.values.null_count:
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(scale * np.asarray(v.values, np.float64))
                        far = bool((x * x).sum() >= NARROW or (np.abs(x) >= 1 << 31).any())
                    if np.isfinite(x).all():
                        raw = x.astype("<f8" if far else "<i4").tobytes()
                raws.append(raw)
                wide.append(far)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raws, pa.binary()), pa.array(wide, pa.bool_()), pa.array(np.arange(seen, seen + len(raws)))], ["vec_id", "q", "wide", "place"])
            seen += len(raws)

    return run


def _matrix(raws: list[bytes], dim: int) -> np.ndarray:
    if all(len(r) == 4 * dim for r in raws):
        return np.frombuffer(b"".join(raws), "<i4").reshape(-1, dim)
    out = np.zeros((len(raws), dim), np.int32)
    for row, r in zip(out, raws, strict=True):
        row[: len(r) // 4] = np.frombuffer(r, "<i4")
    return out


class Index:
    """Posting segments of some rows, by falling impact; rows by falling length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        wide = rows.astype(np.float64)
        length = np.sqrt((wide * wide).sum(1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.rows, self.length, self.order, wide = ids[order], rows[order], length[order], order, wide[order]
        impact = np.frexp(np.abs(wide))[1]
        counts, self.bands, self.left, held = np.bincount(impact.ravel()), [], [], 0
        top = len(counts)  # the band so far is of impacts low to top - 1
        for low in range(max(1, top - 1), 0, -1):
            held += int(counts[low]) if low < top else 0
            if held >= SHARE * rows.size or low == 1:
                self.bands.append(np.where((impact >= low) & (impact < top), wide, 0))
                rest = np.where(impact < low, wide, 0)
                self.left.append(np.sqrt((rest * rest).sum(1)) * (1 + 1e-6))
                top, held = low, 0

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's index, row, score) of the best k rows of each query; rows are numbered as they were given."""
        q = queries.astype(np.float64)
        far = np.sqrt((q * q).sum(1))
        # Sums of whole numbers under 2**24 are exact in 32 bits; else a sum is off by its number of terms times the last bit of the lengths' product.
        exact = far.max(initial=0) * self.length.max(initial=0) < 1 << 23
        kind, off = (np.float32, 0.0) if exact else (np.float64, (q.shape[1] + 8) * 2.0**-52)
        fast, kth = q.astype(kind), np.full(len(q), -np.inf)
        best = tuple(np.empty(0, np.int64) for _ in range(3))
        s, size = 0, FIRST
        while s < len(self.ids):
            open_ = np.flatnonzero(far * self.length[s] * (1 + 1e-9) >= kth)
            if not len(open_):
                break  # lengths fall: no later row reaches any query's k-th score
            e = min(s + size, len(self.ids))
            i, j = self._possible(ids, fast, far, kth, open_, s, e, k, kind, off)
            score = self._exact(queries, i, j)
            keep = (score >= kth[i]) & (self.ids[j] != ids[i])
            best = _best(*(np.concatenate(x) for x in zip(best, (i[keep], self.order[j[keep]], score[keep]), strict=True)), k)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) == k)
            last = np.full(len(q), np.iinfo(np.int64).max)
            np.minimum.at(last, best[0], best[2])
            kth[full] = last[full]
            s, size = e, CHUNK
        return best

    def _possible(self, ids, fast, far, kth, open_, s: int, e: int, k: int, kind, off: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs of open queries and rows s to e - 1 that no bound proves below the query's k-th score."""
        q, length, sums = fast[open_], far[open_], 0.0
        slack = (off * self.length[s] * length).astype(kind)[:, None]
        for band, left in zip(self.bands, self.left, strict=True):
            sums = sums + q @ band[s:e].astype(kind).T
            floor = kth[open_]
            if left is self.left[-1] and e - s >= k and np.isinf(floor).any():  # the chunk's own k-th, of the rows that aren't the query's
                low = np.where(self.ids[None, s:e] == ids[open_, None], -np.inf, sums - slack)
                floor = np.maximum(floor, np.partition(low, e - s - k, 1)[:, e - s - k])
            if left is not self.left[-1] and np.isinf(floor).any():
                continue
            near = sums + slack >= floor[:, None].astype(np.float64) - np.multiply.outer(length, left[s:e])
            if left is self.left[-1] or np.count_nonzero(near) <= FEW * near.size:
                i, j = np.nonzero(near)
                return open_[i], s + j
        return np.empty(0, int), np.empty(0, int)

    def _exact(self, queries: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for s in range(0, len(i), 1 << 14):
            out[s : s + (1 << 14)] = np.einsum("nd,nd->n", queries[i[s : s + (1 << 14)]].astype(np.int64), self.rows[j[s : s + (1 << 14)]].astype(np.int64))
        return out


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first rows of each query by falling score, then row; ~score falls as score rises and never overflows."""
    order = np.lexsort((row, ~score, query))
    query, row, score = query[order], row[order], score[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, int)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    keep = rank < k
    return query[keep], row[keep], score[keep]


def _whole(raw: bytes, wide: bool) -> list[int]:
    return [int(x) for x in np.frombuffer(raw, "<f8" if wide else "<i4")]


def _by_integers(asks: list[tuple[int, list[int]]], rows: list[tuple[int | None, list[int]]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As Index.search, for vectors of any size: products in Python's integers, cut to 64 bits."""
    top, low, found = (1 << 63) - 1, -(1 << 63), tuple(np.empty(0, np.int64) for _ in range(3))
    for i, (own, q) in enumerate(asks):
        score = [(j, min(top, max(low, sum(a * b for a, b in zip(q, x, strict=False))))) for j, (vec_id, x) in enumerate(rows) if vec_id != own]
        one = (np.full(len(score), i), np.array([j for j, _ in score], np.int64), np.array([x for _, x in score], np.int64))
        found = tuple(np.concatenate(x) for x in zip(found, _best(*one, k), strict=True))
    return found


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending")])  # rows are in the order of ties, null ids last
        asks, wide = (table.column(n).to_numpy(zero_copy_only=False) for n in ("asks", "wide"))
        ids, twin = table.column("vec_id"), table.column("twin").to_numpy(zero_copy_only=False)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy()
        raws = table.column("q").to_pylist()
        out: list[tuple[np.ndarray, ...]] = []
        rows, ask = np.flatnonzero(~asks & ~wide), np.flatnonzero(asks & ~wide)
        if len(rows) and len(ask):
            dim = max(len(raws[i]) for i in np.concatenate([rows, ask])) // 4
            # A row without an id is never the query's own: it gets a number that no query of this task has.
            taken = set(number[ask].tolist())
            free = next(x for x in range(-1, -2 - len(ask), -1) if x not in taken)
            index = Index(np.where(known, number, free)[rows], _matrix([raws[i] for i in rows], dim))
            for s in range(0, len(ask), BATCH):
                part = ask[s : s + BATCH]
                i, j, score = index.search(number[part], _matrix([raws[x] for x in part], dim), k)
                out.append((part[i], rows[j], score))
        for a, r in ((asks & wide, ~asks), (asks & ~wide, ~asks & wide)):
            a, r = np.flatnonzero(a), np.flatnonzero(r)
            if len(a) and len(r):
                i, j, score = _by_integers([(int(number[x]), _whole(raws[x], wide[x])) for x in a], [(int(number[x]) if known[x] else None, _whole(raws[x], wide[x])) for x in r], k)
                out.append((a[i], r[j], score))
        i, j, score = (np.concatenate([x[c] for x in out]) if out else np.empty(0, np.int64) for c in range(3))
        i, j, score = _best(i, j, score, k)
        return pa.table([pa.array(number[i]), pa.array(twin[i].astype(np.int64)), ids.take(pa.array(j)).combine_chunks(), pa.array(score)], names=["query_id", "twin", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors(vec_id, embedding) for every row where `queries` holds."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = save(rows.mapInArrow(_quantise(scale), "vec_id long, q binary, wide boolean, place long").where("q is not null"), "quantised")
    ask = rows.where(queries & F.col("vec_id").isNotNull()).select("vec_id", "q", "wide").dropDuplicates().withColumn("twin", F.xxhash64("q", "wide"))
    n, m = rows.count(), ask.count()
    shards = max(-(-n // shard), 1)
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-m // block), min(-(-tasks // shards), -(-m // 64)), 1)
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    told = rows.select("vec_id", "q", "wide", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("twin"), F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    asked = ask.select("vec_id", "q", "wide", F.lit(True).alias("asks"), "twin", every(shards).alias("shard"), F.pmod(F.xxhash64("twin", "vec_id"), F.lit(blocks)).cast("int").alias("block"))
    cell = (F.col("shard").cast("long") * blocks + F.col("block")).alias("cell")
    work = told.unionByName(asked).select("vec_id", "q", "wide", "asks", "twin", cell).repartition(min(shards * blocks, 100_000), "cell")
    found = work.groupBy("cell").applyInArrow(_search(k), "query_id long, twin long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
