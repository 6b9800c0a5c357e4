"""Ranked lexical search over a two-level quantised index (operator 13).

The index is cut into shards of documents, of bounded size. A shard has one row for each of its terms: the documents
that hold it, in order, and two levels of impacts. An impact is the term's share of the score without the term's weight,
(1000000000 * tf) div (1000 * tf + 8 * m). The first level has it as a byte, rounded up to the next multiple of UNIT; the
second has it whole. A shard's row for the empty term lists the documents and their lengths.

A search reads the posting rows of the queries' terms alone. In a shard, a query adds up weight * byte over its terms: times
UNIT this is an upper bound of every document's score, and less than UNIT for each weight below it is a lower bound. Every document
whose upper bound reaches the k-th largest lower bound is scored from the second level, in whole numbers. A shard gives k
documents a query, and the last step ranks those. Queries come in blocks of bounded size; a shard and a block are separate work.

Defined results: a null or termless text is no document of N and is never found; a query without known terms has no rows;
a repeated document is found each time; a null doc_id comes last among equal scores; rows that repeat item_id and text
are one query, those that repeat item_id alone are queries with ranks of their own; a null item_id keeps its rows; empty tables
give no rows; other columns aren't read. Whole texts count, long ones in bounded steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.llm.common import give_back, new_folder, save

#: A term, as a fixed value; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Impacts are at most 1000000; a byte counts UNITs. Bytes of text and documents of a shard; queries of a block; bytes of
#: query terms up to which they are broadcast.
UNIT, SHARD, DOCUMENTS, QUERIES, BROADCAST = -(-1_000_000 // 255), 1 << 24, 1 << 16, 1024, 1 << 25
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def tokens(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The terms of UTF-8 bytes and where each starts."""
    x = np.frombuffer(data.translate(PLAIN), np.uint8)
    on = x != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]])))
    start, end = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(x[on].tobytes())]), start


def counts(texts: list[bytes], step: int = 1 << 22) -> pa.Table:
    """(term, doc, tf) of texts, by term and document; doc is a text's place in the list."""
    found, held, size = [], [], 0

    def flush() -> None:
        starts = np.cumsum([0] + [len(t) + 1 for _, t in held])[:-1]
        terms, at = tokens(b" ".join(t for _, t in held))
        coded = terms.dictionary_encode()
        doc = np.searchsorted(starts, at, "right") - 1
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(held) + doc, return_counts=True)
        place = np.array([i for i, _ in held], np.int64)
        found.append(pa.table({"term": coded.dictionary.take(pa.array(key // max(len(held), 1))), "doc": place[key % max(len(held), 1)], "tf": tf}))
        held.clear()

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(at + step, len(text))
            while end < len(text) and PLAIN[text[end]] != 32:  # a term isn't cut
                end += 1
            held.append((i, text[at:end]))
            size += end - at
            at = end
            if size >= step:
                flush()
                size = 0
    if held or not found:
        flush()
    return pa.concat_tables(found).group_by(["term", "doc"]).aggregate([("tf", "sum")]).rename_columns(["term", "doc", "tf"]).sort_by([("term", "ascending"), ("doc", "ascending")])


def _shard(number: int, ids: list[int | None], texts: list[bytes], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """A shard's rows. Documents are numbered by doc_id, null ones last."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    table = counts([texts[i] for i in order])
    doc, tf = table.column("doc").to_numpy(), table.column("tf").to_numpy()
    n = np.bincount(doc, tf, len(ids)).astype(np.int64)
    m = np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    terms = table.column("term").combine_chunks().dictionary_encode()
    sizes = np.bincount(terms.indices.to_numpy(), minlength=len(terms.dictionary))
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def cut(values: np.ndarray, kind: str, first: bytes) -> pa.Array:
        width = np.dtype(kind).itemsize
        return pa.concat_arrays([pa.array([first], pa.large_binary()), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends * width), pa.py_buffer(values.astype(kind).tobytes())])]).cast(pa.binary())

    known = np.array([ids[i] for i in order if ids[i] is not None], "<i8")
    rows = len(sizes) + 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, number)), pa.concat_arrays([pa.array([b""], pa.binary()), terms.dictionary]).cast(pa.string()), pa.array(np.concatenate([[len(ids)], sizes]).astype(np.int32)),
            cut(doc, "<u2", known.tobytes()), cut(-(-impact // UNIT), "u1", b""), cut(impact, "<u4", n.astype("<i8").tobytes()),
        ],
        ["shard", "term", "df", "docs", "bounds", "impacts"],
    )


def _shards(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_py().encode()
                if ids and (size + len(raw) > SHARD or len(ids) == DOCUMENTS):
                    yield _shard(number, ids, texts, n_docs, n_terms)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield _shard(number, ids, texts, n_docs, n_terms)
        give_back()

    return run


class Index(NamedTuple):
    """Where an index is, its documents with terms, and their terms."""

    path: str
    n_docs: int
    n_terms: int


SCHEMA = "shard long, term string, df int, docs binary, bounds binary, impacts binary"


def build(docs: DataFrame, path: str | None = None) -> Index:
    """Write the index of every row of docs(doc_id, text) that has a term. path: a shared folder; None takes one that lasts for the session."""
    path = path or new_folder(docs.sparkSession, "lexical-index")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs, n_terms = rows.select(F.regexp_count("text", F.lit(TERM)).alias("n")).where("n > 0").agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows.where(F.col("text").rlike(TERM)).mapInArrow(_shards(n_docs, n_terms), SCHEMA).write.parquet(path)
    return Index(path, n_docs, n_terms)


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        out, head = [], None
        by: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for term, w, keys, df, docs, bounds, impacts in zip(*(table.column(c).to_pylist() for c in ("term", "w", "keys", "df", "docs", "bounds", "impacts")), strict=True):
            if not term:
                head = (df, np.frombuffer(docs, "<i8"))
                continue
            row = (w, np.frombuffer(docs, "<u2"), np.frombuffer(bounds, np.uint8).astype(np.int64) * w, np.frombuffer(impacts, "<u4"))
            for key in keys:
                by.setdefault(key, []).append(row)
        n, ids = head
        for key, rows in by.items():
            high = np.zeros(n, np.int64)
            for _, docs, bound, _ in rows:
                high[docs] += bound
            at = np.flatnonzero(high)
            if len(at) > k:  # a document's lower bound is its upper bound less UNIT - 1 for each weight
                kth = np.partition(high[at], len(at) - k)[len(at) - k] * UNIT - (UNIT - 1) * sum(r[0] for r in rows)
                at = at[high[at] * UNIT >= kth]
            score = np.zeros(len(at), np.int64)
            for w, docs, _, impact in rows:
                place = np.minimum(np.searchsorted(docs, at), len(docs) - 1)
                score += np.where(docs[place] == at, w * impact[place].astype(np.int64), 0)
            best = np.argsort(-score, kind="stable")[:k]
            best = best[score[best] > 0]
            out.append((np.full(len(best), key), at[best], score[best]))
        key, at, score = (np.concatenate([x[c] for x in out]) if out else np.empty(0, np.int64) for c in range(3))
        doc = pa.array(ids[np.minimum(at, max(len(ids) - 1, 0))] if len(ids) else np.zeros(len(at), np.int64), mask=at >= len(ids))
        return pa.table([pa.array(key, pa.int64()), doc, pa.array(score, pa.int64())], names=["key", "doc_id", "score"])

    return run


def search(spark, index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the index with the highest scores above 0 for each row of items(item_id, text)."""
    held = spark.read.schema(SCHEMA).parquet(index.path)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.translate(F.col("text").cast("string"), UPPER, LOWER).alias("text")).distinct()
    asked = asked.withColumn("key", F.xxhash64("item_id", "text"))
    blocks = max(1, -(-asked.count() // QUERIES))
    words = asked.select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("term"))
    words = save(words.groupBy("term", F.pmod("key", F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("key").alias("keys")), "query-terms")  # a block's at most
    size = words.agg(F.coalesce(F.sum(F.octet_length("term") + 8 * F.size("keys") + 64), F.lit(0))).first()[0]
    near = F.broadcast if size <= BROADCAST else (lambda df: df)  # else the postings shuffle by term
    rows = held.where("term != ''").join(near(words.select("term").distinct()), "term", "left_semi")
    df = rows.groupBy("term").agg(F.sum("df").alias("total"))
    weight = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2 * F.col("total") + 1))).cast("long")
    weighed = words.join(df, "term").withColumn("w", weight).where("w > 0").select("term", "block", "keys", "w")
    post = held.where("term != ''").join(near(weighed), "term")
    heads = held.where("term = ''").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("keys", F.array().cast("array<long>")).withColumn("w", F.lit(0).cast("long"))
    work = post.unionByName(heads).select("shard", "block", "term", "w", "keys", "df", "docs", "bounds", "impacts")
    found = work.groupBy("shard", "block").applyInArrow(_search(k), "key long, doc_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
