"""SimHash near-duplicates by multi-index hashing (operator 7).

A document's fingerprint is the bitwise majority over the XXH64 hashes of its word shingles. Two fingerprints
link if at most 2 of their 64 bits differ. The 64 bits are cut into 2 segments of 32: if at most 2 bits differ,
one segment differs in at most 1 bit, so the Hamming balls of radius 1 around both segments hold every link
(pigeonhole). Of two segments that differ in one bit, one has a 0 there; only that side enumerates the flip.
Candidates come from an equi-join on (segment, value), the whole distance is verified in the join's condition,
and only links leave it: at most 2080 other fingerprints are that near, so the links of a fingerprint are bounded.
Exact copies share a fingerprint and meet the join once.

near_copies and keep_one compare what the fingerprints' links tie, and link by the exact Jaccard similarity of distinct word
shingles. At a similarity of 0.8 many pairs differ in more than 2 bits: texts that share a band of minima of their sets are
candidates too, which loses a pair at the threshold with a chance of at most MISS.

Defined results: null and wordless texts have fingerprint zero, linked like any other; a null doc_id gets its row
(it is never a component's smallest id, unless all are null); repeated rows stay; an empty table gives no rows;
other columns, whatever their names, aren't read. Whole texts count, in bounded steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallywind.llm.common import connected_components, give_back, save

STEP = 1 << 16
#: Links by similarity: the chance that a pair at the threshold is no candidate, bands at most, texts and bytes of a block, columns at a time.
MISS, BANDS, BLOCK, BYTES, COLUMNS = 1e-5, 40, 512, 1 << 23, 1024


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit majority fingerprint, as a signed number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, STEP):
        h = np.fromiter(map(xxh64_intdigest, islice(shingles, STEP), repeat(seed)), "<u8", min(STEP, n - at))
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(words_per_shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), words_per_shingle, seed) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row of docs(doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(words_per_shingle, seed), "doc_id long, fp long")


def hamming_links(fps: DataFrame) -> DataFrame:
    """(a, b): every pair of distinct fingerprints in fps(fp) with at most 2 differing bits, at least once."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    segments = [(0, low), (1, F.shiftrightunsigned("fp", 32))]
    table = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), v.alias("val")) for s, v in segments))).alias("t")).select("fp", "t.*")
    flips = F.expr("transform(filter(sequence(0, 31), i -> (val & shiftleft(1L, i)) = 0), i -> val | shiftleft(1L, i))")
    probes = table.select(F.col("fp").alias("probe"), "seg", F.explode(F.concat(F.array("val"), flips)).alias("ball"), "val")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("probe"))) <= 2
    once = (F.col("ball") != F.col("p.val")) | (F.col("probe") < F.col("fp"))
    # By merging: a probe makes up to 33 rows, which Spark's estimate doesn't know, and a broadcast of them would fill the driver.
    return table.hint("merge").alias("t").join(probes.alias("p"), (F.col("t.seg") == F.col("p.seg")) & (F.col("t.val") == F.col("ball")) & (F.col("fp") != F.col("probe")) & once & near).select(F.col("probe").alias("a"), F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id (smallest doc_id reachable by links)."""
    each = save(fingerprints(docs, words_per_shingle, seed), "fingerprints")
    distinct = save(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    parts = connected_components(hamming_links(distinct.select("fp")))
    of = distinct.hint("merge").join(parts, distinct.fp == parts.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("part"))
    of = save(of, "fingerprint-parts")
    smallest = save(of.groupBy("part").agg(F.min("first_id").alias("component_id")), "smallest")  # so that the join of a large part can be split
    return each.hint("merge").join(of.hint("merge").join(smallest, "part").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, words_per_shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(words_per_shingle, len(words))
    if not k:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - k + 1))


def bands_for(similarity: float) -> tuple[int, int]:
    """(bands, minima a band): the most minima for which MISS needs at most BANDS bands, else one minimum and more bands."""
    if not 0 < similarity <= 1:
        raise ValueError(f"similarity {similarity} isn't over 0 and at most 1")
    need = lambda r: 1 if similarity == 1 else math.ceil(math.log(MISS) / math.log1p(-(similarity**r)))
    r = max((r for r in range(1, 17) if need(r) <= BANDS), default=1)
    return need(r), r


def band_keys(hashes: np.ndarray, bands: int, minima: int) -> np.ndarray:
    """A key for each band: equal for two sets where all minima of the band are; its chance is similarity ** minima."""
    odd = np.random.default_rng(1).integers(0, 1 << 63, (2, bands * minima), np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * minima, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        x = hashes[at : at + 512, None] * odd[0]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(0))
    least ^= least >> np.uint64(29)
    return (least * odd[1]).reshape(bands, minima).sum(1, dtype=np.uint64).view(np.int64)


def _banded(words_per_shingle: int, seed: int, bands: int, minima: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, fps, keys = [], [], []
            for t in b.column(2):
                hashes = shingle_set(t.as_py(), words_per_shingle, seed)
                sizes.append(len(hashes))
                fps.append(fingerprint(t.as_py(), seed=seed))
                keys.append(band_keys(hashes, bands, minima) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "size", "fp", "keys"])
        give_back()

    return run


def _sets(words_per_shingle: int, seed: int):
    """Adds the set of each row's text, and drops the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = pa.array([shingle_set(t.as_py(), words_per_shingle, seed).tobytes() for t in b.column("text")], pa.binary())
                rest = b.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, sets], [*rest.schema.names, "hashes"])
        give_back()

    return run


def exact_links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """links[i, j]: whether the Jaccard similarity of sets i and j is at least `similarity`."""
    sizes = np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1  # the others are in no intersection
    place = np.cumsum(times > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        s, e = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[row[s:e], column[s:e] - start] = 1
        both += dense @ dense.T
    return both / (sizes[:, None] + sizes[None, :] - both) >= similarity


def forest(sets: list[np.ndarray], keys: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges that tie the sets as all links between sets of equal keys would, a column of keys for each band. Buckets whose
    sets are all tied already aren't compared."""
    label, edges = np.arange(len(sets)), []
    for band in keys.T:
        order = np.argsort(band, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
            if len(rows) < 2 or (label[rows] == label[rows[0]]).all():
                continue
            links = exact_links([sets[i] for i in rows], similarity)
            left = np.ones(len(rows), bool)
            for first in range(len(rows)):  # each component once, from its first row
                todo = [first] if left[first] else []
                left[first] = False
                while todo:
                    met = np.flatnonzero(links[todo.pop()] & left)
                    left[met] = False
                    todo.extend(met.tolist())
                    for x in rows[met]:
                        if label[x] != label[rows[first]]:
                            edges.append((int(rows[first]), int(x)))
                            label[label == label[x]] = label[rows[first]]
    return edges


def _verified(similarity: float):
    """Edges within each part, or within one bucket if rows have no keys."""

    def run(table: pa.Table) -> pa.Table:
        node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
        raws = table.column("hashes").combine_chunks()
        keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(len(node), -1) if "keys" in table.column_names else np.zeros((len(node), 1), np.int64)
        edges = []
        order = np.argsort(part, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            edges += [(node[rows[a]], node[rows[b]]) for a, b in forest([np.frombuffer(raws[int(i)].as_buffer(), np.uint64) for i in rows], keys[rows], similarity)]
        give_back()
        return pa.table([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

    return run


def _similar(similarity: float):
    """Pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("hashes"), b.column("other"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared / (len(x) + len(y) - shared) >= similarity)
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
        give_back()

    return run


def _bucket_links(ties: DataFrame, table: DataFrame, large: DataFrame, texts: DataFrame, words_per_shingle: int, seed: int, similarity: float) -> DataFrame:
    """Edges of parts too large to be compared in blocks, by bucket. First each text is compared with the smallest of each of its
    buckets: that ties groups of near copies with a few pairs a text. Then the buckets that hold more than one such group are
    compared, each on its own; a large one in blocks."""
    sets = save(texts.join(large.select("node"), "node").select("node", "text").dropDuplicates(["node"]).mapInArrow(_sets(words_per_shingle, seed), "node long, hashes binary"), "large-sets")
    pairs = ties.join(large.select(F.col("node").alias("a")), "a", "left_semi")
    held = pairs.join(sets.withColumnRenamed("node", "a"), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("other")), "b")
    links = save(held.select("a", "b", "hashes", "other").mapInArrow(_similar(similarity), "a long, b long"), "star-links")
    of = connected_components(links)
    entries = table.join(large.select("node", "size"), "node").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    entries = save(entries.select("node", "band", "key", "size", "component"), "bucket-entries")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(8 * F.sum("size") / BYTES)).cast("int").alias("blocks")
    open_ = entries.groupBy("band", "key").agg(blocks, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "key", "blocks")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    cells = entries.select("node", "band", "key").join(open_, ["band", "key"]).withColumn("own", own).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("node", "band", F.col("key").alias("part"), F.least("own", "at").alias("lo"), F.greatest("own", "at").alias("hi")).join(sets, "node")
    return links.unionByName(cells.groupBy("band", "part", "lo", "hi").applyInArrow(_verified(similarity), "a long, b long"))


def near_copies(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, seed: int = 42) -> DataFrame:
    """doc_id and component_id (smallest doc_id that links reach). Two texts link where the Jaccard similarity of their
    sets of distinct word shingles is at least `similarity`; every link is verified exactly, on 64-bit hashes of the shingles.

    Candidates share a bucket. The first band's buckets are the components of the fingerprints' links (SimHash, as in near_duplicates),
    the others' are keys by minima of the sets (MinHash): a pair at the threshold shares none with a chance of at most MISS. A bucket's members are tied to its smallest, and all that ties reach is a part, so that candidate pairs
    never become rows: a part's texts come together once, and the buckets within it are compared in Python, on each text's
    set, unless links tie all of a bucket already. A part over BLOCK texts or BYTES is cut into blocks, and a pair of blocks
    is a separate piece of work, so that a text is sent as often as there are blocks. A part of more blocks than bands, which texts
    that share boilerplate make of a large corpus, isn't cut so: its buckets are separate work, see _bucket_links, and a text
    is sent at most once a band and block of its bucket. Pieces give the edges of their components, at most one a text."""
    bands, minima = bands_for(similarity)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = texts.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
    each = named.mapInArrow(_banded(words_per_shingle, seed, bands, minima), "doc_id long, node long, size long, fp long, keys array<long>")
    each = save(each.withColumn("node", F.when(F.col("size") > 0, F.col("node"))), "bands")  # wordless texts share node null
    nodes = save(each.where("size > 0").groupBy("node").agg(F.min("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "banded-nodes")
    near = save(connected_components(hamming_links(save(nodes.select("fp").distinct(), "distinct-fingerprints"))).toDF("fp", "near"), "near-fingerprints")
    first = F.array(F.coalesce("near", "fp"))
    nodes, bands = save(nodes.hint("merge").join(near, "fp", "left").select("node", "size", F.concat(first, "keys").alias("keys")), "keyed-nodes"), bands + 1
    table = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    least = table.groupBy("band", "key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key", "least")
    ties = save(table.hint("merge").join(least, ["band", "key"]).where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "ties")
    members = save(nodes.join(connected_components(ties).withColumnRenamed("component", "part"), "node"), "parts")
    sizes = members.groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(8 * F.sum("size") / BYTES)).cast("int").alias("blocks"))
    members = save(members.join(sizes, "part").select("node", "part", "blocks", "size", "keys"), "sized-parts")
    large = members.where(F.col("blocks") > bands)
    total, some = members.agg(F.sum("size"), F.max("blocks")).first()
    bins = max(1, 8 * (total or 0) // (BYTES // 4))
    rows = named.join(members.where(F.col("blocks") <= bands), "node").select("node", "part", "blocks", "keys", "text").dropDuplicates(["node"])
    sets = rows.mapInArrow(_sets(words_per_shingle, seed), "node long, part long, blocks int, keys array<long>, hashes binary")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    work = sets.withColumn("own", own).withColumn("other", other).withColumn("bin", F.when(F.col("blocks") > 1, F.col("part")).otherwise(F.pmod(F.xxhash64("part"), F.lit(bins))))
    work = work.select("node", "part", "keys", "hashes", "bin", F.col("blocks") > 1, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).toDF("node", "part", "keys", "hashes", "bin", "cut", "lo", "hi")
    links = work.groupBy("bin", "cut", "lo", "hi").applyInArrow(_verified(similarity), "a long, b long")
    if some and some > bands:
        links = links.unionByName(_bucket_links(ties, table, large, named, words_per_shingle, seed, similarity))
    wholes = connected_components(links)
    of = save(each.select("doc_id", "node").join(wholes, "node", "left").select("doc_id", F.coalesce("component", "node").alias("whole")), "wholes")
    smallest = save(of.groupBy("whole").agg(F.min("doc_id").alias("component_id")), "smallest")
    return of.alias("o").join(smallest.alias("s"), F.col("o.whole").eqNullSafe(F.col("s.whole"))).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the documents that are near-duplicates of one with a smaller doc_id. Of rows that repeat
    a doc_id all stay or all go."""
    gone = near_copies(docs, similarity, words_per_shingle).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
