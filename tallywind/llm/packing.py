"""Best-fit-decreasing packing of token sequences (operator 5).

A document's ids, with an end id, are cut into full windows; what is left is a piece shorter than a window.
Pieces of one length are interchangeable, so best-fit decreasing needs only how many pieces there are of each
length: at most `window` numbers. A segment tree indexed by remaining capacity finds the tightest open window
for each length in turn, for whole runs of equal windows at once. The plan is a list of runs, (length, first
rank, count) to (first sequence, offset), whose size depends on the window alone. Each piece then finds its run by
its rank among the pieces of its length; ranks come from counts by writing task, without a sort or a gathered group.

Defined results: a null text is empty, which leaves one piece, the end id; repeated rows are packed each; an
empty table gives no rows; other columns aren't read. A document of any length is cut in one pass over its ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.llm.common import save

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, task long, nth long"


def _cut(path: str | Callable[[], str], window: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallywind.llm.tokens import encoder

        with encoder(path) as e:
            ids_of, task, seen = e.documents, TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
            for b in batches:
                doc_ids = b.column(0)
                for row, ids, sizes in ids_of(b.column(1), end_id):
                    pieces = -(-sizes // window)
                    of = np.repeat(np.arange(len(sizes)), pieces)
                    start = window * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                    length = np.minimum(window, sizes[of] - start)
                    at, raw = 4 * (np.cumsum(length) - length), memoryview(ids).cast("B")
                    cut = [raw[s : s + 4 * n] for s, n in zip(at.tolist(), length.tolist(), strict=True)]
                    order = np.argsort(length, kind="stable")
                    first = np.searchsorted(length[order], length)
                    nth = np.empty(len(of), np.int64)
                    nth[order] = np.arange(len(of))
                    nth += seen[length] - first
                    seen += np.bincount(length, minlength=window + 1)
                    whole = doc_ids.take(pa.array(row + of))
                    yield pa.RecordBatch.from_arrays(
                        [whole, *map(pa.array, (start, length)), pa.array(list(map(zlib.crc32, cut)), pa.int64()), pa.array(sizes[of]), pa.array([x.tobytes() for x in cut] if with_ids else [None] * len(of), pa.binary()), pa.array(np.full(len(of), task, np.int64)), pa.array(nth)],
                        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "task", "nth"],
                    )

    return run


class CapacityTree:
    """A segment tree over remaining capacities 0..window: which of them have open windows."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, count: int) -> None:
        i = capacity + self.size
        while i:
            self.open[i] += count
            i //= 2

    def tightest(self, length: int) -> int | None:
        """The least capacity of an open window that holds length."""
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1 and (i % 2 or not self.open[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts by length: (length, first rank, count, first sequence, offset) runs."""
    tree, runs_open, runs, sequences = CapacityTree(window), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                fits = window // length  # of new windows, each takes as many as it holds: best fit would choose it again
                full, rest = divmod(left, fits)
                for n, each in ((full, fits), (1 if rest else 0, rest)):
                    if n:
                        for k in range(each):
                            runs.append((length, rank, n, sequences, k * length))
                            rank += n
                        if free := window - each * length:
                            runs_open.setdefault(free, []).append((sequences, n))
                            tree.add(free, n)
                        sequences += n
                left = 0
                continue
            first, n = runs_open[capacity].pop()
            take = min(n, left)
            runs.append((length, rank, take, first, window - capacity))
            rank, left = rank + take, left - take
            tree.add(capacity, -take)
            if n > take:
                runs_open[capacity].append((first + take, n - take))
            if free := capacity - length:
                runs_open.setdefault(free, []).append((first, take))
                tree.add(free, take)
    return runs


def _place(runs: list[tuple[int, int, int, int, int]]):
    of: dict[int, list] = {}
    for length, rank, _, sequence, offset in sorted(runs):
        of.setdefault(length, []).append((rank, sequence, offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: ([x[0] for x in v], v) for k, v in of.items()}
        for b in batches:
            places = []
            for length, rank in zip(b.column("length").to_pylist(), b.column("rank").to_pylist(), strict=True):
                ranks, rows = tables[length]
                first, sequence, offset = rows[bisect_right(ranks, rank) - 1]
                places.append((sequence + rank - first, offset))
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array([p[i] for p in places], pa.int64()) for i in (0, 1))], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with_ids its ids (little-endian unsigned 32-bit). Each sequence holds at most `window` ids, gapless from 0."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = save(texts.mapInArrow(_cut(tokenizer, window, end_id, with_ids), PIECES), "pieces")
    by_task = pieces.groupBy("length", "task").agg((F.max("nth") + 1).alias("n"))
    by_task = save(by_task, "piece-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    base = by_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(base.select("length", "task", F.coalesce("base", F.lit(0)).alias("base")), ["length", "task"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return ranked.select(*columns, (F.col("base") + F.col("nth")).alias("rank")).mapInArrow(_place(plan(counts, window)), f"{kinds}, sequence_id long, offset long")
