"""Quality scores by histogram gradient-boosted trees over document statistics (operator 9).

The statistics of a whole text are byte classes, word and line measures. The trees are trained on the driver from
a bounded sample of labelled rows (`sample`, 20 000 by default, those with the smallest hash of their id), with
quantile bins, logistic loss and second-order leaf values (Friedman 2001; Chen and Guestrin 2016). A model is four
flat arrays; all trees advance together, one level a step, by numpy indexing.

Defined results: null and empty texts have statistics of zero and a score; rows with a label other than 0 or 1
aren't learnt from; without labels every score is 0.5; repeated rows get equal scores; an empty table gives no
rows; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallywind.llm.common import free_name, give_back

BYTES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,), "bar": (124,), "bang": (33, 63),
    "mark": (35, 36, 37, 38, 42, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126), "stop": (44, 46, 58, 59), "wide": range(128, 256),
}
NAMES = [*BYTES, "bytes", "words", "word_bytes", "different_words", "longest_word", "lines", "different_lines", "word_share_line"]
_CLASS = np.zeros((256, len(BYTES)), np.float32)
for _i, _codes in enumerate(BYTES.values()):
    _CLASS[list(_codes), _i] = 1


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, in the order of NAMES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(len(NAMES), np.float32)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float32) @ _CLASS / len(data)
    words, lines = data.split(), data.split(b"\n")
    n, kinds = max(1, len(words)), set(words)
    top = words.count(max(kinds, key=lambda w: (len(w), w))) / n if kinds else 0  # junk repeats its longest words, prose doesn't
    return np.concatenate([share, [np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / n, len(kinds) / n, top, np.log1p(len(lines)), len(set(lines)) / len(lines), len(words) / len(lines)]]).astype(np.float32)


@dataclass
class Trees:
    """Node i of tree t goes right where x[feature] > threshold, to child + 1, else to child; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        z = np.full(len(x), self.base)
        if len(self.roots):
            at, rows = np.repeat(self.roots[None], len(x), 0), np.arange(len(x))[:, None]
            for _ in range(self.depth):
                right = x[rows, self.feature[at]] > self.threshold[at]
                at = self.child[at] + right
            z = z + self.value[at].sum(1)
        return 1 / (1 + np.exp(-z))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Boosted trees for labels y in {0, 1}."""
    if not len(y):
        return Trees(*(np.zeros(0) for _ in range(4)), np.zeros(0, int), 0, 0.0)
    p = np.clip(y.mean(), 0.01, 0.99)
    base, wide = float(np.log(p / (1 - p))), x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(wide)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    feature, threshold, child, value, roots, z = [], [], [], [], [], np.full(len(y), base)
    offset = np.arange(wide) * bins
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        roots.append(len(feature))
        todo = [(len(feature), np.arange(len(y)), 0)]
        for a in (feature, threshold, child, value):
            a.append(0)
        while todo:
            node, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best, cut = 1e-3, None
            if level < depth and len(rows) >= 20:
                cells = (binned[rows] + offset).ravel()
                G = np.bincount(cells, np.repeat(g[rows], wide), wide * bins).reshape(wide, bins).cumsum(1)[:, :-1]
                H = np.bincount(cells, np.repeat(h[rows], wide), wide * bins).reshape(wide, bins).cumsum(1)[:, :-1]
                gain = G**2 / (H + ridge) + (gs - G) ** 2 / (hs - H + ridge) - gs**2 / (hs + ridge)
                gain[(H < 1e-3) | (hs - H < 1e-3)] = 0
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] > best and b < len(edges[j]):
                    cut = (j, b)
            if cut is None:
                feature[node], threshold[node], child[node], value[node] = 0, np.inf, node, -rate * gs / (hs + ridge)
                z[rows] += value[node]
                continue
            j, b = cut
            feature[node], threshold[node], child[node] = int(j), float(edges[j][b]), len(feature)
            left = binned[rows, j] <= b
            for a in (feature, threshold, child, value):
                a += [0, 0]
            todo += [(child[node], rows[left], level + 1), (child[node] + 1, rows[~left], level + 1)]
    return Trees(np.array(feature), np.array(threshold, np.float64), np.array(child), np.array(value), np.array(roots), depth, base)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t.as_py()).tolist() for t in b.column(1)], pa.list_(pa.float32()))], ["doc_id", "x"])


def _score(model: Trees, columns: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            x = np.array([statistics(t.as_py()) for t in texts]).reshape(len(texts), len(NAMES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(model.score(x), pa.float64())], [*columns, name])
        give_back()

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows whose labels aren't learnt: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Trees:
    """Trees from at most `sample` labelled rows that aren't held out."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")  # `sample` ids at most
    x = few.mapInArrow(_statistics, "doc_id long, x array<float>").groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = x.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "quality").toArrow()
    return train(np.array(rows.column("x").to_pylist(), np.float32).reshape(-1, len(NAMES)), np.array(rows.column("quality").to_pylist(), np.float64))


def score(docs: DataFrame, model: Trees, name: str = "quality_score") -> DataFrame:
    """docs with the score as a column `name`; a column of that name is replaced."""
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    plain = docs.select(*(F.col(f"`{c}`") for c in columns))
    return plain.mapInArrow(_score(model, columns, name), StructType([*plain.schema.fields, StructField(name, DoubleType())]))


def keep(docs: DataFrame, model: Trees, least: float = 0.7) -> DataFrame:
    """The rows of docs that score `least` or more, with the columns of docs, whatever their names."""
    name = free_name(docs.columns, "score")
    return score(docs, model, name).where(F.col(name) >= least).drop(name)
