"""Feed-forward classifiers, trained by all tasks of a barrier stage together (M-08, M-09, SNK-12)."""

from __future__ import annotations

import io
import json
import secrets
import socket
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

EPS = 1e-5


class Network:
    """Input, hidden layers, classes. Each layer's input is normalised by batch ('batch', with a running mean and variance for
    prediction), by row ('layer') or not (None), after the linear step and before the rectifier; dropout is on every input but the last layer's."""

    def __init__(self, sizes: list[int], normalise: str | None = "batch", dropout: float = 0.1, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.sizes, self.normalise, self.dropout = list(sizes), normalise, dropout
        self.p, self.running = {}, {}
        for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
            bound = 1 / np.sqrt(a)
            self.p[f"w{i}"], self.p[f"b{i}"] = rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)
        for i, n in enumerate(sizes[:-1]):  # 0 is the input's
            if normalise:
                self.p[f"g{i}"], self.p[f"h{i}"] = np.ones(n), np.zeros(n)
            if normalise == "batch":
                self.running[f"m{i}"], self.running[f"v{i}"] = np.zeros(n), np.ones(n)

    def _normal(self, i: int, x: np.ndarray, train: bool) -> tuple[np.ndarray, tuple]:
        if not self.normalise:
            return x, ()
        axis = 0 if self.normalise == "batch" else 1
        if self.normalise == "batch" and not train:
            mean, var = self.running[f"m{i}"], self.running[f"v{i}"]
        else:
            mean, var = x.mean(axis, keepdims=True), x.var(axis, keepdims=True)
            if self.normalise == "batch":
                n = len(x)
                self.running[f"m{i}"] = 0.9 * self.running[f"m{i}"] + 0.1 * mean[0]
                self.running[f"v{i}"] = 0.9 * self.running[f"v{i}"] + 0.1 * var[0] * n / max(n - 1, 1)
        scale = 1 / np.sqrt(var + EPS)
        unit = (x - mean) * scale
        return unit * self.p[f"g{i}"] + self.p[f"h{i}"], (unit, scale, axis)

    def _normal_back(self, i: int, d: np.ndarray, kept: tuple, grad: dict) -> np.ndarray:
        if not kept:
            return d
        unit, scale, axis = kept
        grad[f"g{i}"], grad[f"h{i}"] = (d * unit).sum(0), d.sum(0)
        d = d * self.p[f"g{i}"]
        return scale * (d - d.mean(axis, keepdims=True) - unit * (d * unit).mean(axis, keepdims=True))

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """Class scores, and what the way back needs; rng: for training."""
        train, kept, last = rng is not None, [], len(self.sizes) - 2
        x, normal = self._normal(0, x, train)
        kept.append((normal, None))
        for i in range(last + 1):
            mask = (rng.random(x.shape) >= self.dropout) / (1 - self.dropout) if train and self.dropout and i < last else None
            x = x if mask is None else x * mask
            held = x
            x = x @ self.p[f"w{i}"] + self.p[f"b{i}"]
            normal = on = None
            if i < last:
                x, normal = self._normal(i + 1, x, train)
                on = x > 0
                x = x * on
            kept.append((held, mask, normal, on))
        return x, kept

    def gradients(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross-entropy of a batch, and its gradient by parameter."""
        scores, kept = self.forward(x, rng)
        share = np.exp(scores - scores.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        loss = float(-np.log(np.maximum(share[np.arange(len(y)), y], 1e-300)).mean())
        d, grad = share, {}
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        for i in reversed(range(len(self.sizes) - 1)):
            held, mask, normal, on = kept[i + 1]
            if on is not None:
                d = self._normal_back(i + 1, d * on, normal, grad)
            grad[f"w{i}"], grad[f"b{i}"] = held.T @ d, d.sum(0)
            d = d @ self.p[f"w{i}"].T
            d = d if mask is None else d * mask
        self._normal_back(0, d, kept[0][0], grad)
        return loss, grad

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[0].argmax(1) if len(x) else np.empty(0, int)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, shape=json.dumps([self.sizes, self.normalise, self.dropout]), **self.p, **{f"r{k}": v for k, v in self.running.items()})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Network:
        held = np.load(io.BytesIO(data))
        net = Network(*json.loads(str(held["shape"])))
        net.p = {k: held[k] for k in net.p}
        net.running = {k: held[f"r{k}"] for k in net.running}
        return net

    def save(self, spark: SparkSession, path: str) -> None:
        """SNK-12: the model as a table of one row."""
        spark.createDataFrame([(bytearray(self.to_bytes()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Network:
        return Network.from_bytes(bytes(spark.read.parquet(path).first().model))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict[str, np.ndarray], grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            p[k] = p[k] - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


class Together:
    """Sums over the tasks of a barrier stage. They meet once through Spark, to learn where the first task listens, and then
    send it their numbers and get the sum back: Spark's own gathering takes a second each time. A task that is lost breaks the
    others' connections, and Spark starts the stage again."""

    def __init__(self, context, told: dict, patience: float = 600.0):
        infos, self.own = context.getTaskInfos(), context.partitionId()
        server = None
        if self.own == 0:
            server = socket.create_server(("", 0), backlog=len(infos))
            server.settimeout(patience)
            told = told | {"port": server.getsockname()[1], "word": secrets.token_hex(16)}
        self.told = [json.loads(t) for t in context.allGather(json.dumps(told))]
        word, self.links = self.told[0]["word"].encode(), []
        if server:
            by: dict[int, socket.socket] = {}
            while len(by) < len(infos) - 1:
                link, _ = server.accept()
                link.settimeout(patience)
                if self._read(link, len(word)) == word:  # else it isn't one of the stage's tasks
                    by[int.from_bytes(self._read(link, 4), "little")] = link
            server.close()
            self.links = [by[i] for i in sorted(by)]
        else:
            link = socket.create_connection((infos[0].address.rsplit(":", 1)[0], self.told[0]["port"]), patience)
            link.sendall(word + self.own.to_bytes(4, "little"))
            self.links = [link]

    @staticmethod
    def _read(link: socket.socket, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            part = link.recv(n - len(out))
            if not part:
                raise ConnectionError("another task of the stage is gone")
            out += part
        return bytes(out)

    def sum(self, x: np.ndarray) -> np.ndarray:
        """The sum of every task's array of this length, in the order of the tasks, so that all get the same."""
        x = np.ascontiguousarray(x, "<f8")
        if self.own == 0:
            for link in self.links:
                x = x + np.frombuffer(self._read(link, x.nbytes), "<f8")
            for link in self.links:
                link.sendall(x.tobytes())
            return x
        self.links[0].sendall(x.tobytes())
        return np.frombuffer(self._read(self.links[0], x.nbytes), "<f8")

    def mean(self, weight: float, values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The weighted mean of every task's arrays; a task without rows weighs nothing but takes part."""
        total = self.sum(np.concatenate([[weight], *(weight * np.ravel(values[k]) for k in sorted(values))]))
        out, at = {}, 1
        for k in sorted(values):
            out[k] = (total[at : at + values[k].size] / max(total[0], 1e-30)).reshape(values[k].shape)
            at += values[k].size
        return out

    def close(self) -> None:
        for link in self.links:
            link.close()


RESULT = "model binary, epoch int, held_out_accuracy double, history string"


def _train(net: Network, epochs: int, batch: int, rate: float, warm_up: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        own = np.random.default_rng((seed, context.partitionId()))
        xs, ys, outs = [], [], []
        for b in batches:
            xs += [np.asarray(v.values, float) for v in b.column("x")]
            ys += b.column("y").to_pylist()
            outs += b.column("out").to_pylist()
        x, y, out = np.array(xs).reshape(len(xs), net.sizes[0]), np.array(ys, int), np.array(outs, bool)
        tx, ty, hx, hy = x[~out], y[~out], x[out], y[out]
        together = Together(context, {"steps": -(-len(tx) // batch)})
        steps = max(t["steps"] for t in together.told)  # every task takes part in each step
        adam, best, history = Adam(rate), None, []
        for epoch in range(epochs):
            order, losses = own.permutation(len(tx)), []
            for s in range(steps):
                part = order[s * batch : (s + 1) * batch]
                if len(part) > 1:  # a batch of one has no variance
                    loss, grad = net.gradients(tx[part], ty[part], own)
                    losses.append(loss)
                else:
                    part, grad = part[:0], {k: np.zeros_like(v) for k, v in net.p.items()}
                adam.step(net.p, together.mean(len(part), grad))  # alike in all tasks, and so the parameters
            if net.running:
                net.running = together.mean(len(tx), net.running)
            hit, n, loss, many = together.sum(np.array([(net.predict(hx) == hy).sum(), len(hy), np.sum(losses), len(losses)])).tolist()
            score = hit / n if n else -loss / max(many, 1)
            history.append([epoch, loss / max(many, 1), hit / n if n else None])
            if epoch >= min(warm_up, epochs - 1) and (best is None or score > best[0]):
                best = (score, epoch, net.to_bytes(), hit / n if n else None)
        together.close()
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([best[2]], pa.binary()), pa.array([best[1]], pa.int32()), pa.array([best[3]], pa.float64()), pa.array([json.dumps(history)])], ["model", "epoch", "held_out_accuracy", "history"])

    return run


def train(df: DataFrame, vector: str, label: str, held_out, hidden: list[int] = (256, 32), classes: int | None = None, epochs: int = 30, batch: int = 64, rate: float = 2e-4, warm_up: int = 10, normalise: str | None = "batch", dropout: float = 0.1, tasks: int | None = None, seed: int = 1) -> tuple[Network, dict]:
    """M-08, M-09: the network, and its epoch, held-out accuracy and history [epoch, loss, accuracy].

    Rows whose vector or label is null, or whose vector has another length than most, are left out; labels are 0 to classes - 1; held_out:
    the rows (a condition) that nothing is learnt from. All tasks start together (barrier), each with its share of the rows in
    memory; in every step each takes the gradient of a batch of its own, all gradients are gathered and averaged by rows, and each
    takes the same Adam step. So `tasks` times `batch` rows make a step. After each epoch from `warm_up` on the parameters are kept
    if the held-out accuracy is the best so far (the training loss, where nothing is held out). A lost task restarts the stage."""
    rows = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), F.coalesce(held_out, F.lit(False)).alias("out"))
    rows = rows.where("x is not null and y is not null and size(x) > 0").where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    width = rows.groupBy(F.size("x").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y")).orderBy(F.desc("n"), "w").first()
    if width is None:
        raise ValueError("no rows to learn from")
    tasks = tasks or max(1, min(df.sparkSession.sparkContext.defaultParallelism // 2, -(-width.n // (4 * batch))))
    net = Network([width.w, *hidden, classes or width.y + 1], normalise, dropout, seed)
    dealt = rows.where(F.size("x") == width.w).repartition(tasks)
    found = dealt.mapInArrow(_train(net, epochs, batch, rate, warm_up, seed), RESULT, barrier=True).collect()[0]  # one row
    return Network.from_bytes(bytes(found.model)), {"epoch": found.epoch, "held_out_accuracy": found.held_out_accuracy, "history": json.loads(found.history)}


def predict(df: DataFrame, vector: str, net: Network, column: str = "prediction") -> DataFrame:
    """M-10: df with the class of each vector; null for vectors that the network can't take."""
    width, data = net.sizes[0], net.to_bytes()
    shared, columns = df.sparkSession.sparkContext.broadcast(data), [c for c in df.columns if c != column]

    def run(batches):
        model = Network.from_bytes(shared.value)
        for b in batches:
            rows = b.column(vector).to_pylist()
            good = [i for i, v in enumerate(rows) if v is not None and len(v) == width and None not in v and np.isfinite(v).all()]
            told = np.zeros(len(rows), np.int64)
            told[good] = model.predict(np.array([rows[i] for i in good], float).reshape(-1, width))
            mask = np.ones(len(rows), bool)
            mask[good] = False
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(told.astype(np.int32), mask=mask)], [*columns, column])

    held = df.select(*columns)
    return held.mapInArrow(run, StructType([*held.schema.fields, StructField(column, IntegerType())]))
