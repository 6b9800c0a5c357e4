"""Topics by variational Bayes with a prior for each term, so that seed words hold their topics (M-05).

The topic weights are a table with a row for each term, never gathered: a pass joins each block of documents, packed once, with the rows
of its own terms, works out the documents' topics there (Hoffman, Blei and Bach 2010), and adds up what the blocks tell of each
term. Only a number a topic, the weights' sums, comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.sources.shared import save

#: Rows (document, term) of a block on average, at least and at most; between them there are four blocks for each task that runs
#: at once, as a block is sent the weights of all its words. Numbers (rows times topics) that are worked out together.
ROWS, MOST, CELLS = 20_000, 2_000_000, 1 << 18


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, for positive numbers."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(6):
        low = x < 6
        out -= np.where(low, 1 / x, 0)
        x = x + low
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def infer(terms: np.ndarray, counts: np.ndarray, starts: np.ndarray, beta: np.ndarray, alpha: float, rounds: int = 50, close: float = 1e-3) -> np.ndarray:
    """What each row tells of its term, by topic. Rows are of documents one after the other, which begin at `starts`; beta
    has exp(E[log weight]) by term and topic. Documents are worked out side by side, each until its own weights stay."""
    whole, sizes = beta[terms], np.diff(np.r_[starts, len(terms)])
    gamma = np.ones((len(starts), beta.shape[1]))
    weigh = lambda g: np.exp(digamma(g) - digamma(g.sum(1))[:, None])
    live, b, n, size, g = np.arange(len(starts)), whole, counts, sizes, gamma.copy()
    for _ in range(rounds):
        theta = weigh(g)
        share = n / (np.einsum("rk,rk->r", b, np.repeat(theta, size, 0)) + 1e-100)
        new = alpha + theta * np.add.reduceat(share[:, None] * b, np.cumsum(size) - size, 0)
        open_ = np.abs(new - g).mean(1) >= close
        gamma[live] = g = new
        if not open_.all():
            rows = np.repeat(open_, size)
            live, b, n, size, g = live[open_], b[rows], n[rows], size[open_], g[open_]
            if not len(live):
                break
    theta = np.repeat(weigh(gamma), sizes, 0)
    return (counts / (np.einsum("rk,rk->r", whole, theta) + 1e-100))[:, None] * theta * whole


def _flat(column: pa.ChunkedArray, kind: type = float) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)


def _pack(rows: pa.Table) -> pa.Table:
    """A block's documents, a row each with their terms' places among the block's words and their counts, and the words, a row each."""
    rows = rows.sort_by([("doc", "ascending"), ("term", "ascending")])
    words = pc.unique(rows.column("term"))
    place, doc, at = pc.index_in(rows.column("term"), value_set=words).combine_chunks(), rows.column("doc").to_numpy(), rows.column("at")[0]
    starts = np.r_[0, np.flatnonzero(np.diff(doc)) + 1]
    ends = pa.array(np.r_[starts, len(doc)].astype(np.int32))
    docs = {"at": pa.repeat(at, len(starts)), "doc": pa.array(doc[starts]), "places": pa.ListArray.from_arrays(ends, place), "n": pa.ListArray.from_arrays(ends, rows.column("n").combine_chunks()), "word": pa.nulls(len(starts), pa.string()), "place": pa.nulls(len(starts), pa.int32())}
    named = {"at": pa.repeat(at, len(words)), "doc": pa.nulls(len(words), pa.int64()), "places": pa.nulls(len(words), pa.list_(pa.int32())), "n": pa.nulls(len(words), pa.list_(pa.int64())), "word": words.cast(pa.string()), "place": pa.array(np.arange(len(words), dtype=np.int32))}
    return pa.concat_tables([pa.table(docs), pa.table(named)])


def _tell(totals: list[float], alpha: float):
    def run(docs: pa.Table, weights: pa.Table) -> pa.Table:
        docs, weights = docs.sort_by("doc"), weights.sort_by("place")
        lam = _flat(weights.column("lam")).reshape(weights.num_rows, -1)
        beta, told = np.exp(digamma(lam) - digamma(np.array(totals))), np.zeros_like(lam)
        term, n = _flat(docs.column("places"), int), _flat(docs.column("n"))
        ends = np.cumsum(pc.list_value_length(docs.column("places")).to_numpy())
        part = (ends - 1) // max(1, CELLS // lam.shape[1])  # documents that are worked out together
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1), len(ends)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            low = ends[i - 1] if i else 0
            own = term[low : ends[j - 1]]
            s = infer(own, n[low : ends[j - 1]], np.r_[low, ends[i : j - 1]] - low, beta, alpha)
            for k in range(lam.shape[1]):
                told[:, k] += np.bincount(own, s[:, k], len(lam))
        return pa.table([weights.column("word").combine_chunks(), pa.ListArray.from_arrays(pa.array(np.arange(0, told.size + 1, told.shape[1], dtype=np.int32)), pa.array(told.ravel()))], names=["term", "s"])

    return run


def _start(k: int, seed: int):
    def run(batches):
        import hashlib

        for b in batches:
            rows = []
            for t, prior in zip(b.column("term").to_pylist(), b.column("prior").to_pylist(), strict=True):
                rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed}:{t}".encode(), digest_size=8).digest(), "little"))  # the same in any layout
                rows.append((rng.gamma(100.0, 0.01, k) + prior).tolist())
            yield pa.RecordBatch.from_arrays([b.column("term"), b.column("prior"), pa.array(rows, pa.list_(pa.float64()))], ["term", "prior", "lam"])

    return run


def seeded_topics(tokens: DataFrame, doc: str, term: str, k: int, seeds: DataFrame, passes: int = 10, batches: int = 1, boost: float = 50.0, alpha: float | None = None, eta: float | None = None, decay: float = 0.5, offset: float = 1.0, seed: int = 2) -> DataFrame:
    """(term, lam): each term's weight in each of k topics. tokens: a row for each occurrence (doc, a whole number, and term);
    seeds(term, topic): words written by hand, whose prior in their topic is `boost` more.

    batches: into so many parts documents are dealt by a hash; each part is a step, which moves the weights by
    (offset + steps) ** -decay, or all the way if there is one part. Null terms and documents are left out; a topic
    outside 0 to k - 1 is an error. Seeds that no document holds have no row."""
    alpha, eta = alpha or 1 / k, eta or 1 / k
    counts = tokens.select(F.col(doc).cast("long").alias("doc"), F.col(term).alias("term")).where("doc is not null and term is not null").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))
    counts = save(counts, "topic-counts")
    many = -(-counts.count() // batches)
    blocks = max(1, -(-many // MOST), min(-(-many // ROWS), 4 * counts.sparkSession.sparkContext.defaultParallelism))
    at = F.pmod(F.xxhash64("doc"), F.lit(blocks)) * batches + F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(batches))
    packed = save(counts.withColumn("at", at).groupBy("at").applyInArrow(_pack, "at long, doc long, places array<int>, n array<long>, word string, place int"), "topic-blocks")
    topic = F.when(F.col("topic").between(0, k - 1), F.col("topic")).otherwise(F.raise_error(F.concat(F.lit("no topic "), F.col("topic").cast("string"))).cast("int"))
    held = seeds.select("term", topic.cast("int").alias("topic")).distinct().groupBy("term").agg(F.collect_list("topic").alias("topics"))
    prior = F.array(*(F.when(F.array_contains("topics", i), eta + boost).otherwise(F.lit(eta)) for i in range(k))).alias("prior")
    lam = counts.select("term").distinct().join(held, "term", "left").select("term", prior)
    lam = save(lam.mapInArrow(_start(k, seed), "term string, prior array<double>, lam array<double>"), "topic-weights")
    step = 0
    for _ in range(passes):
        for part in range(batches):
            totals = lam.agg(F.array(*(F.sum(F.col("lam")[i]) for i in range(k))).alias("t")).first().t  # k numbers
            if totals[0] is None:
                return lam.select("term", "lam")
            own = packed.where(F.col("at") % batches == part)
            known = own.where("word is not null").select(F.col("at").alias("of"), "place", "word").join(lam.select(F.col("term").alias("word"), "lam"), "word")
            told = own.where("word is null").select("at", "doc", "places", "n").groupBy("at").cogroup(known.groupBy("of")).applyInArrow(_tell(list(totals), alpha), "term string, s array<double>")
            told = told.groupBy("term").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(k))).alias("s"))
            rate = 1.0 if batches == 1 else (offset + step) ** -decay
            target = F.when(F.col("s").isNull(), F.col("prior")).otherwise(F.zip_with("prior", "s", lambda p, s: p + batches * s))
            moved = F.zip_with("lam", target, lambda a, b: (1 - rate) * a + rate * b).alias("lam")  # noqa: B023
            lam = save(lam.join(told, "term", "left").select("term", "prior", moved), "topic-weights")
            step += 1
    return lam.select("term", "lam")


def topic_terms(lam: DataFrame, terms: int = 10) -> DataFrame:
    """PRJ-23: (topic, rank, term, weight), the weight a share of the topic."""
    each = lam.select("term", F.posexplode("lam").alias("topic", "x"))
    total = each.groupBy("topic").agg(F.sum("x").alias("total"))  # a row a topic
    order = Window.partitionBy("topic").orderBy(F.desc("x"), "term")
    best = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms)
    return best.join(total, "topic").select("topic", "rank", "term", (F.col("x") / F.col("total")).alias("weight"))
