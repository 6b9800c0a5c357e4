"""Word vectors from the words around (M-02), as the reference's gensim trains them by default: the mean of the vectors around a
word against the word itself and negative samples (CBOW; Mikolov, Sutskever, Chen, Corrado and Dean 2013).

Texts are dealt to blocks once and named there by numbers. A pass sends each block the vectors of its own words, trains there
on runs of words whose sums are products of matrices (Ji, Satish, Li and Dubey 2016), and sends the vectors to where those of
one word meet; their mean is written once and goes back to the blocks, and
what the pass shuffled is removed. No task or driver holds all vectors, but a block those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.operators.subwords import _blob, _floats, alias_table, draw
from tallywind.sources.shared import remove, save, save_at

#: Words of a block, on average: that few at least while there are fewer blocks than tasks at once, that many at most;
#: words of a piece of a text, numbers of a written row; words of a run, runs laid out at once, negative samples of a run; how many words' steps a vector takes in a run at most.
LEAST, MOST, PIECE, WRITTEN, RUN, LAID, DRAWN, BOUND = 250_000, 16_000_000, 1000, 16_384, 64, 64, 16, 8

#: What goes to a block: its words (kind 0, by word), with their counts there and in all texts, then its texts (kind 1, in order).
ROWS = "block int, word string, here long, n long, v binary"


def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: (its distinct values in order, then -1; how many there are of each; each one's place among them)."""
    order = np.argsort(rows, axis=1, kind="stable")
    low = np.take_along_axis(rows, order, 1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = low[:, 1:] != low[:, :-1]
    rank, place = np.cumsum(new, 1) - 1, np.empty_like(order)
    np.put_along_axis(place, order, rank, 1)
    distinct = np.full((len(rows), int(rank[:, -1].max()) + 1), -1, rows.dtype)
    np.put_along_axis(distinct, rank, low, 1)
    return distinct, np.bincount((np.arange(len(rows))[:, None] * distinct.shape[1] + rank).ravel(), minlength=distinct.size).reshape(distinct.shape), place


def steps(inner: np.ndarray, mine: np.ndarray, drawn: np.ndarray, mean: np.ndarray, push: np.ndarray, own: np.ndarray, share: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a run adds to the vectors around, and to the words' own (one row for each distinct one) and then the negative samples.

    By word (row): mean, the weights of the vectors around that make its average; push, how much of its step goes to each of them (as published,
    the whole, though they are averaged before); own, 1 at its own vector; share, how often it has a negative sample; rate, 0 for a word alone."""
    hidden = mean @ inner
    up = rate / (1 + np.exp(np.vecdot(hidden, mine)))
    down = share * rate[:, None] / (-1 - np.exp(-(hidden @ drawn.T)))
    back = mine * up[:, None]
    back += down @ drawn
    return push.T @ back, np.concatenate([own * up[:, None], down], 1).T @ hidden


def learn(inner: np.ndarray, outer: np.ndarray, number: np.ndarray, often: np.ndarray, window: int, negatives: int, rate: float, last: float, rng: np.random.Generator) -> None:
    """One pass over texts: numbers of words, before, between and after them `window` times -1. The last rows of inner and outer belong to no word.

    In a run a vector moves by at most what BOUND words would move it, so that one that is repeated over and over doesn't run away."""
    stay, other = alias_table(often**0.75)
    starts = rng.permutation(np.arange(window, len(number) - window, RUN))
    number = np.concatenate([number, np.full(RUN, -1, number.dtype)])
    away = np.r_[-window:0, 1 : window + 1]
    beside, ours = np.arange(RUN)[:, None] + window + away, np.arange(RUN) + window
    less = lambda many: (1 / np.maximum(1, many / BOUND)).astype(np.float32)[:, None, :]
    for at in range(0, len(starts), LAID):
        text = number[starts[at : at + LAID, None] + np.arange(-window, RUN + window)]
        k, word = len(text), text[:, ours]
        near = (rng.integers(1, window + 1, (k, RUN))[:, :, None] >= np.abs(away)) & (word >= 0)[:, :, None] & (text[:, beside] >= 0)
        count = near.sum(2)
        slow = (rate + (last - rate) * np.arange(at, at + k)[:, None] / len(starts)) * (count > 0)
        u, _, place = ranked(text)
        cells = (np.arange(k * RUN).reshape(k, RUN, 1) * u.shape[1] + place[:, beside])[near]
        around = np.bincount(cells, minlength=k * RUN * u.shape[1]).reshape(k, RUN, -1).astype(np.float32)
        mean, push = around / np.maximum(count, 1).astype(np.float32)[:, :, None], around * less(around.sum(1))
        w, many, mine = ranked(word)
        own = np.zeros((k, RUN, w.shape[1]), np.float32)
        np.put_along_axis(own, mine[:, :, None], 1, 2)
        own *= less(many)
        d, many, _ = ranked(draw(stay, other, rng, (k, DRAWN)))
        share = (many * np.float32(negatives / DRAWN)).astype(np.float32)[:, None, :] * (word[:, :, None] != d[:, None, :])  # a word is no negative of itself
        slow, ends = slow.astype(np.float32), np.stack([(x >= -1).sum(1) - (x[:, 1:] == -1).sum(1) for x in (u, w, d)], 1).tolist()
        for j in range(k):
            nu, nw, nd = ends[j]
            ju, jw, jd = u[j, :nu], w[j, :nw], d[j, :nd]
            held, owned, drawn = inner.take(ju, 0, mode="wrap"), outer.take(jw, 0, mode="wrap"), outer.take(jd, 0)
            si, so = steps(held, owned.take(mine[j], 0), drawn, mean[j, :, :nu], push[j, :, :nu], own[j, :, :nw], share[j, :, :nd], slow[j])
            si += held
            inner[ju] = si
            owned += so[:nw]
            outer[jw] = owned
            outer[jd] += so[nw:]


def started(word: np.ndarray, size: int, seed: int) -> np.ndarray:
    """First vectors, inner ones and zeros, of words by their hashes: the same in any block and layout (SplitMix64; Steele, Lea and Flood 2014)."""
    with np.errstate(over="ignore"):
        z = word.astype(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(size, dtype=np.uint64) + np.uint64(seed * size + 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    rows = np.zeros((len(word), 2 * size), np.float32)
    rows[:, :size] = ((z >> np.uint64(40)).astype(np.float32) / (1 << 24) - 0.5) / size
    return rows


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(block, its batches, each of one kind) of rows sorted by block and kind."""
    from itertools import groupby

    def cut() -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            block, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            ends = np.r_[np.flatnonzero(np.diff(block) | np.diff(kind)) + 1, len(block)] if len(block) else []
            for x, y in zip(np.r_[0, ends[:-1]].astype(int) if len(block) else [], ends, strict=True):
                yield int(block[x]), b.slice(x, y - x)

    for block, rows in groupby(cut(), key=lambda r: r[0]):
        yield block, (r[1] for r in rows)


def _named(window: int):
    """The texts of a block as numbers of its words in their order, words that are too rare left out."""

    def run(batches):
        for block, rows in _by_block(batches):
            known, held, full = [], [np.full(window, -1, np.int32)], window
            row = lambda ids: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ids.tobytes()])], ["block", "ids"])  # noqa: B023, E731
            words = None
            for b in rows:
                if b.column("kind")[0].as_py() == 0:
                    known.append(b.column("word"))
                    continue
                words = pa.concat_arrays(known) if words is None and known else words
                if words is None:
                    continue
                lists = b.column("words")
                flat = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int32)
                ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                for part, piece in zip(np.split(flat, ends[:-1]), b.column("piece").to_pylist(), strict=True):
                    if piece == 0 and full > window:  # a text's later pieces go on where it was cut
                        held.append(np.full(window, -1, np.int32))
                        full += window
                    held.append(part[part >= 0])
                    full += len(held[-1])
                    if full >= WRITTEN:
                        yield row(np.concatenate(held))
                        held, full = [], 2 * window
            held.append(np.full(window, -1, np.int32))
            if words is not None:
                yield row(np.concatenate(held))

    return run


def _trained(size: int, window: int, negatives: int, rate: float, last: float, seed: int, first: bool):
    def run(batches):
        for block, rows in _by_block(batches):
            given, vectors, texts = [], [], []
            for b in rows:
                if b.column("kind")[0].as_py() == 0:
                    given.append(b.select(["block", "word", "here", "n"]))
                    vectors.append(started(b.column("hash").to_numpy(), size, seed) if first else _floats(b.column("v"), 2 * size).copy())
                else:
                    texts += [np.frombuffer(t.as_buffer(), np.int32).copy() for t in b.column("ids")]
            if not given:
                continue
            inner, outer = (np.zeros((sum(map(len, vectors)) + 1, size), np.float32) for _ in range(2))
            end = len(inner) - 1
            while vectors:  # from the last, so that none is held twice
                part = vectors.pop()
                inner[end - len(part) : end], outer[end - len(part) : end] = part[:, :size], part[:, size:]
                end -= len(part)
            if texts:
                number = np.concatenate(texts)
                texts.clear()
                often = np.concatenate([g.column("n").to_numpy() for g in given]).astype(float)
                with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
                    learn(inner, outer, number, often, window, negatives, rate, last, np.random.default_rng([seed, block, int(first), int(rate * 1e9)]))
            at = 0
            for g in given:
                v = _blob(np.concatenate([inner[at : at + g.num_rows], outer[at : at + g.num_rows]], 1))
                yield pa.RecordBatch.from_arrays([*g.columns, v], ["block", "word", "here", "n", "v"])
                at += g.num_rows

    return run


def _met(size: int, last: bool):
    """Of rows sorted by word and block, the means of a word's vectors by its counts there, once for each word; at last as an array."""

    def means(t: pa.Table) -> pa.RecordBatch:
        word = t.column("word").combine_chunks()
        first = np.flatnonzero(np.r_[True, pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)])
        here = t.column("here").to_numpy().astype(float)
        v = np.add.reduceat(_floats(t.column("v"), 2 * size) * here[:, None], first, axis=0) / np.add.reduceat(here, first)[:, None]
        word = word.take(pa.array(first))
        if last:
            ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * size)
            return pa.RecordBatch.from_arrays([word, pa.ListArray.from_arrays(ends, pa.array(v[:, :size].ravel()))], ["word", "vector"])
        return pa.RecordBatch.from_arrays([word, _blob(v)], ["word", "v"])

    def run(batches):
        left = None
        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            word = t.column("word")
            done = pc.index(word, word[-1]).as_py()
            if done:
                yield means(t.slice(0, done))
            left = t.slice(done)
        if left is not None and left.num_rows:
            yield means(left)

    return run


def train(docs: DataFrame, words: str, size: int = 200, window: int = 5, least: int = 50, negatives: int = 5, passes: int = 4, rate: float = 0.025, seed: int = 1) -> DataFrame:
    """M-02: (word, vector), the vector as an array, of all words that come `least` times or more. docs: a row for each text, its words an array.

    Null words and those rarer are left out before the window is laid, as gensim does. Texts are dealt to as many blocks as the session runs
    tasks at once, if each gets LEAST words, and to more where each would get over MOST. Vectors depend on the order in which texts are read."""
    texts = docs.select(F.filter(words, lambda w: w.isNotNull()).alias("words")).where("size(words) > 0")
    texts, whole = save_at(texts.select(F.monotonically_increasing_id().alias("id"), F.size("words").alias("many"), "words"), "vector-words")
    total = texts.agg(F.sum("many")).first()[0] or 0
    blocks = max(1, min(docs.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST)), -(-total // MOST))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    heard = save(texts.select("block", F.explode("words").alias("word")).groupBy("block", "word").agg(F.count(F.lit(1)).alias("here")), "vector-heard")
    kept = heard.groupBy("word").agg(F.sum("here").alias("n")).where(F.col("n") >= least)
    own = save(heard.join(kept, "word").select("block", F.lit(0).alias("kind"), "word", "here", "n", F.xxhash64("word").alias("hash")), "vector-own")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.col("many") - 1) / PIECE).cast("int")), lambda i: F.struct(i.alias("piece"), F.slice("words", i * PIECE + 1, PIECE).alias("words")))
    pieces = texts.select("block", F.lit(1).alias("kind"), "id", F.explode(cut).alias("c")).select("block", "kind", "id", "c.*")
    dealt = own.select("block", "kind", "word").unionByName(pieces, allowMissingColumns=True).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "word", "id", "piece")
    named = dealt.mapInArrow(_named(window), "block int, ids binary")
    named = save(named.select("block", F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("id"), "ids"), "vector-texts")
    remove(docs.sparkSession, whole)
    given, old = own, None
    for step in range(passes):
        one, two = (rate * (1 - s / passes) for s in (step, step + 1))
        dealt = given.unionByName(named, allowMissingColumns=True).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "word", "id")
        moved = dealt.mapInArrow(_trained(size, window, negatives, one, two, seed, step == 0), ROWS)
        last = step == passes - 1
        met = moved.repartition("word").sortWithinPartitions("word", "block").mapInArrow(_met(size, last), "word string, vector array<double>" if last else "word string, v binary")
        met, path = save_at(met, "word-vectors")
        if old:
            remove(docs.sparkSession, old)
        given, old = met if last else own.join(met, "word"), path
    return given
