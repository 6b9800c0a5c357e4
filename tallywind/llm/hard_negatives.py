"""Hard negatives by a Voronoi-partitioned distributed join (operator 12).

Vectors are quantised to floor(scale * x). Each gets one more component, sqrt(M * M - |x|^2), where M is the largest length; an
anchor's is 0. Then |a - x|^2 = M * M + |a|^2 - 2 a.x, so that falling inner products are rising distances, and the triangle
inequality holds for them. Pivots are rows from a bounded sample; every candidate belongs to its nearest pivot's cell and knows
its distance to it. Anchors belong to families, whose centres are pivots too; a family has a radius, and is cut into groups
of bounded size by a hash.

Positives: the k + 1 candidates of a label nearest to each pivot give, through the pivot, an upper bound of the distance within
which every anchor of a family finds k of its label. Only candidates whose lower bound |centre, pivot| - radius -
|pivot, x| is within it go to the family's groups. Negatives: a family's positives give the band of scores that its anchors
ask for, and only candidates whose bounds meet the band go to its groups. Bounds have slack for rounding; what is joined
is scored in whole numbers, and every rule is applied to those.

Candidates that go to a group go there in shards of bounded size, each pair of a group and a shard is separate work, and what leaves
it is at most k rows an anchor or a positive. So a group that needs every row, as with vectors without
structure, is many tasks; its work is its anchors times the rows, as any exact join's there.

Defined results: rows with a null label, a null vector or null or non-finite components (once scaled, too) take no part; a vector
scores 0 in the dimensions that it or the anchor lacks; rows with the anchor's vec_id aren't its candidates; rows without a
vec_id are candidates and never anchors, last among equal scores; repeated rows are candidates each; rows that
repeat vec_id, label and vector are one anchor, those that repeat vec_id alone are anchors with ranks of their own; scores
beyond 64 bits are given as the nearest 64-bit number (a row is held against its rules whole; scores of over 38 digits are
ranked in double precision); an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.llm.common import save

#: Rows of a shard, anchors of a group, pivots at most, rows a pivot, rows and numbers of the sample that pivots come from.
SHARD, GROUP, PIVOTS, A_PIVOT, SAMPLE, NUMBERS = 8192, 512, 256, 4096, 1024, 1 << 22
#: Relative slack of bounds. Scores below this are whole in double precision.
SLACK, WHOLE = 1e-9, float(1 << 52)


def _quantise(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, raws, lengths, dims = [], [], [], []
            for i, v in enumerate(b.column(2)):
                if v.is_valid and not v.values.null_count:
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(scale * np.asarray(v.values, np.float64))
                        big = np.abs(x).max(initial=0)
                        length = big and big * np.sqrt(((x / big) ** 2).sum())
                    if np.isfinite(length):
                        keep.append(i)
                        raws.append(x.astype("<i4" if big < 1 << 31 else "<f8").tobytes())
                        lengths.append(float(length))
                        dims.append(len(x))
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(raws, pa.binary()), pa.array(lengths, pa.float64()), pa.array(dims, pa.int32())], ["vec_id", "label", "q", "length", "dim"])

    return run


def _values(raws: list[bytes], dims, most: int) -> np.ndarray:
    """Rows of `most` doubles; shorter vectors end in zeros."""
    out = np.zeros((len(raws), most))
    for row, raw, d in zip(out, raws, dims, strict=True):
        row[:d] = np.frombuffer(raw, "<i4" if len(raw) == 4 * d else "<f8")
    return out


class Space:
    """Pivots in the space with one more component, and which of them are families' centres."""

    def __init__(self, longest: float, dim: int, pivots: np.ndarray):
        self.longest, self.dim, self.scale = longest, dim, max(longest, 1.0)
        self.pivots = self.raised(pivots)
        self.centres, self.apart = np.arange(len(pivots)), np.array([self._from(self.pivots, p) for p in self.pivots])

    def raised(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Candidates, or anchors, in that space, scaled so that the longest vector has length 1."""
        x = x / self.scale
        square = (self.longest / self.scale) ** 2
        return np.c_[x, np.zeros(len(x)) if anchors else np.sqrt(np.maximum(square - (x * x).sum(1), 0))]

    @staticmethod
    def _from(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of rows of x from y or from its rows, by differences: products would lose the small ones."""
        return np.sqrt(((x - y) ** 2).sum(1))

    def place(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the nearest of the pivots `among`, and its distance."""
        p = self.pivots[among]
        near = among[((p * p).sum(1) - 2 * x @ p.T).argmin(1)]
        return near, self._from(x, self.pivots[near])

    def choose(self, families: int) -> None:
        """Centres: one pivot, then each time the one farthest from those chosen."""
        chosen = [0]
        while len(chosen) < min(families, len(self.pivots)):
            far = self.apart[chosen].min(0)
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.centres = np.array(chosen)


def _placed(space: Space, anchors: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                c = b.slice(s, 2048)
                x = space.raised(_values(c.column("q").to_pylist(), c.column("dim").to_pylist(), space.dim), anchors)
                cell, far = space.place(x, space.centres if anchors else np.arange(len(space.pivots)))
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*c.schema.names, "cell", "far"])

    return run


def _within(space: Space):
    """Candidates whose distance from a family may be within its label's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, family, far, radius, reach = (b.column(c).to_numpy() for c in ("cell", "family", "far", "radius", "reach"))
            least = np.abs(space.apart[family, cell] - far) - radius  # of both triangles
            yield b.filter(pa.array(least <= reach + SLACK * 8)).select(PASSED)

    return run


def _in_band(space: Space, bands: list[tuple]):
    """Candidates and each family whose anchors may ask for a score that the candidate may have."""
    family, radius, near, wide, low, high, groups = (np.array(x) for x in zip(*bands, strict=True))
    square = (space.longest / space.scale) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = b.column("cell").to_numpy(), b.column("far").to_numpy()
            apart = space.apart[family][:, cell]
            least, most = np.maximum(np.abs(apart - far) - radius[:, None], 0), apart + far + radius[:, None]
            top = (square + wide[:, None] - least**2) / 2 + SLACK * 64
            bottom = (square + near[:, None] - most**2) / 2 - SLACK * 64
            f, row = np.nonzero((top >= low[:, None]) & (bottom <= high[:, None]))
            part = b.take(pa.array(row)).select(["vec_id", "label", "q", "dim"])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(family[f].astype(np.int32)), pa.array(groups[f].astype(np.int32))], PASSED)

    return run


PASSED = ["vec_id", "label", "q", "dim", "family", "groups"]
_PASSED = "vec_id long, label long, q binary, dim int, family int, groups int"


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products, as 64-bit integers, or as Python's where those might not do."""
    if np.sqrt((a * a).sum(1)).max() * np.sqrt((x * x).sum(1)).max() < WHOLE:
        return np.rint(a @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    return whole(a) @ whole(x).T


def _cell(table: pa.Table) -> tuple:
    """Anchors and candidates, those by vec_id and null ones last: (anchors' rows, candidates' rows, scores, labels, vec_ids, other)."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    a, c = np.flatnonzero(asks), np.flatnonzero(~asks)
    ids = table.column("vec_id")
    known, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    label, dims, raws = table.column("label").to_numpy(), table.column("dim").to_pylist(), table.column("q").to_pylist()
    most = max(dims, default=0)
    values = lambda rows: _values([raws[i] for i in rows], [dims[i] for i in rows], most)
    return a, c, _scores(values(a), values(c)) if len(a) and len(c) else np.empty((len(a), len(c)), np.int64), label, number, known


def _positives(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending")])
        a, c, score, label, number, known = _cell(table)
        rows, cols = [], []
        for i, own in enumerate(a):
            at = np.flatnonzero((label[c] == label[own]) & ~(known[c] & (number[c] == number[own])))
            best = at[np.argsort(-score[i, at], kind="stable")[:k]]
            rows += [i] * len(best)
            cols += best.tolist()
        far = table.column("anchor").take(pa.array(a[rows], pa.int64())).combine_chunks()
        ids = table.column("vec_id").take(pa.array(c[cols], pa.int64())).combine_chunks()
        own = [score[i, j] for i, j in zip(rows, cols, strict=True)]
        return pa.table([far, ids, pa.array([str(s) for s in own], pa.string())], names=["anchor", "positive_id", "exact"])

    return run


def _negatives(k: int, low: int, high: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending")])
        a, c, score, label, number, known = _cell(table)
        asked, out = table.column("wants").to_pylist(), []
        for i, own in enumerate(a):
            wants = [int(w) for w in asked[own]]
            at = np.flatnonzero((label[c] != label[own]) & ~(known[c] & (number[c] == number[own])) & (100 * score[i] >= low * min(wants)) & (100 * score[i] <= high * max(wants)))
            at = at[np.argsort(-score[i, at], kind="stable")]
            falling = -100 * score[i, at]
            for place, want in enumerate(wants):
                first = np.searchsorted(falling, -high * want, "left")
                best = at[first : first + k]
                out += [(own, place, j, score[i, j]) for j in best[100 * score[i, best] >= low * want]]
        own, place, j, s = zip(*out, strict=True) if out else ((), (), (), ())
        take = lambda name, rows: table.column(name).take(pa.array(rows, pa.int64())).combine_chunks()
        return pa.table([take("anchor", own), pa.array(place, pa.int32()), take("vec_id", c[list(j)] if j else []), pa.array([str(x) for x in s], pa.string())], names=["anchor", "place", "negative_id", "exact"])

    return run


def _join(passed: DataFrame, anchors: DataFrame, shards: int, by, schema: str) -> DataFrame:
    """by over each group's anchors and each shard of the candidates that go to it."""
    spread = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")
    shard = F.pmod(F.xxhash64("vec_id", "q", "label"), F.lit(shards)).cast("int").alias("shard")
    told = passed.select("vec_id", "label", "q", "dim", "family", spread, shard, F.lit(False).alias("asks"), F.lit(0).cast("long").alias("anchor"), F.array().cast("array<string>").alias("wants"))
    asked = anchors.select("vec_id", "label", "q", "dim", "family", "group", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "anchor", "wants")
    return told.unionByName(asked).groupBy("family", "group", "shard").applyInArrow(by, schema)


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every row of vectors(vec_id, embedding, label)
    where `anchors` holds: of its `positives` best rows of the same label, each one's k best rows of other labels whose score is
    from `low` to `high` percent of the positive's. label: the label to take instead of the column."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col("embedding").alias("v")).where("label is not null")
    rows = save(rows.mapInArrow(_quantise(scale), "vec_id long, label long, q binary, length double, dim int"), "quantised")
    n, longest, dim = rows.agg(F.count(F.lit(1)), F.max("length"), F.max("dim")).first()
    asked = rows.where(anchors & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "label", "q"]).withColumn("anchor", F.xxhash64("vec_id", "label", "q"))
    m = asked.count()
    sample = rows.orderBy(F.xxhash64("q", "vec_id"), "q").limit(max(1, min(SAMPLE, NUMBERS // max(dim or 1, 1), PIVOTS, max(8, n // A_PIVOT)))).select("q", "dim").collect()
    space = Space((longest or 0.0) * (1 + 1e-12), dim or 0, _values([bytes(r["q"]) for r in sample], [r["dim"] for r in sample], dim or 0))
    shards = max(1, -(-n // shard))
    space.choose(max(1, -(-m // group)))
    schema = "vec_id long, label long, q binary, length double, dim int"
    placed = save(rows.mapInArrow(_placed(space, False), f"{schema}, cell int, far double"), "cells")
    asked = asked.mapInArrow(_placed(space, True), f"{schema}, anchor long, cell int, far double").withColumnRenamed("cell", "family")
    asked = save(asked.select("vec_id", "label", "q", "dim", "length", "anchor", "family", "far"), "anchors")
    families = asked.groupBy("family").agg(F.max("far").alias("radius"), F.max("length").alias("wide"), F.min("length").alias("near"), F.ceil(F.count(F.lit(1)) / group).cast("int").alias("groups")).collect()  # a row a pivot at most
    if not families:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    told = spark.createDataFrame([(r["family"], r["radius"], r["groups"]) for r in families], "family int, radius double, groups int")
    asked = asked.join(F.broadcast(told.select("family", "groups")), "family").withColumn("group", F.pmod(F.xxhash64("anchor", F.lit(3)), F.col("groups")).cast("int")).withColumn("wants", F.array().cast("array<string>"))

    # Positives. By label and cell the candidates nearest to the pivot, and from them a reach by label and family.
    order = F.row_number().over(Window.partitionBy("label", "cell").orderBy("far"))
    close = placed.select("label", "cell", "far").withColumn("i", order).where(F.col("i") <= positives + 1).select("label", "cell", "far")
    apart = spark.createDataFrame([(int(r["family"]), c, float(space.apart[r["family"], c]) + r["radius"]) for r in families for c in range(len(space.pivots))], "family int, cell int, way double")  # families times pivots
    wanted = asked.select("label", "family").distinct()
    bound = close.join(wanted, "label").join(F.broadcast(apart), ["family", "cell"]).select("family", "label", (F.col("far") + F.col("way")).alias("reach"))
    place = F.row_number().over(Window.partitionBy("family", "label").orderBy("reach"))
    known = bound.withColumn("i", place).where(F.col("i") <= positives + 1).groupBy("family", "label").agg(F.max("reach").alias("reach"), F.count(F.lit(1)).alias("many"))
    # An anchor may be among the candidates that gave the bound, and may be there more than once: with fewer others all must come.
    twins = asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("times")).join(placed.where("vec_id is not null").groupBy("vec_id").agg(F.count(F.lit(1)).alias("rows")), "vec_id").where("rows > 1").join(asked.select("vec_id", "label", "family"), "vec_id").select("label", "family").distinct().withColumn("often", F.lit(True))
    endless = (F.col("many") <= positives) | F.col("often").isNotNull()
    reach = known.join(twins, ["label", "family"], "left").withColumn("reach", F.when(endless, float("inf")).otherwise(F.col("reach"))).join(F.broadcast(told), "family").select("family", "label", "reach", "radius", "groups")
    near = placed.select("vec_id", "label", "q", "dim", "cell", "far").join(reach, "label").mapInArrow(_within(space), _PASSED)
    found = _join(near, asked, shards, _positives(positives), "anchor long, positive_id long, exact string")
    falling = [F.col("exact").cast("double").desc(), F.col("exact").cast("decimal(38,0)").desc_nulls_last()]
    order = Window.partitionBy("anchor").orderBy(*falling, F.asc_nulls_last("positive_id"))
    best = save(found.withColumn("place", (F.row_number().over(order) - 1).cast("int")).where(F.col("place") < positives), "positives")

    # Negatives. What scores each anchor asks for, and from them a band by family.
    wants = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "exact"))), lambda s: s["exact"]).alias("wants"))  # `positives` at most
    asked = save(asked.drop("wants").join(wants, "anchor"), "asking")
    score = F.transform("wants", lambda w: w.cast("double"))
    bands = asked.groupBy("family").agg(F.min(F.array_min(score)).alias("least"), F.max(F.array_max(score)).alias("most")).collect()  # a row a pivot at most
    of = {r["family"]: r for r in families}
    part = lambda x: x / space.scale
    told = [(f, of[f]["radius"], part(of[f]["near"]) ** 2, part(of[f]["wide"]) ** 2, part(part(low / 100 * least)), part(part(high / 100 * most)), of[f]["groups"]) for f, least, most in bands]
    if not told:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    near = placed.select("vec_id", "label", "q", "dim", "cell", "far").mapInArrow(_in_band(space, told), _PASSED)
    found = _join(near, asked, shards, _negatives(k, low, high), "anchor long, place int, negative_id long, exact string")
    order = Window.partitionBy("anchor", "place").orderBy(*falling, F.asc_nulls_last("negative_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    clip = lambda c: F.when(c.cast("double") >= 2.0**63, (1 << 63) - 1).when(c.cast("double") < -(2.0**63), -(1 << 63)).otherwise(F.expr("try_cast(exact as bigint)"))
    pairs = best.select("anchor", "place", "positive_id", clip(F.col("exact")).alias("positive_score"))
    names = asked.select("anchor", F.col("vec_id").alias("anchor_id"))
    return ranked.select("anchor", "place", "rank", "negative_id", clip(F.col("exact")).alias("negative_score")).join(pairs, ["anchor", "place"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
