import numpy as np
import pyarrow as pa
import pytest

from tallywind.operators import wordvectors as W


def test_steps_equal_differences():
    rng = np.random.default_rng(1)
    inner, outer, drawn = rng.normal(size=(5, 4)), rng.normal(size=(2, 4)), rng.normal(size=(2, 4))
    around, own = np.array([[1.0, 0, 2, 0, 0], [0, 1, 1, 1, 0], [0, 0, 0, 0, 0]]), np.array([[1.0, 0], [0, 1], [1, 0]])
    mean, share, rate = around / np.maximum(around.sum(1), 1)[:, None], np.array([[1.5, 0], [0.5, 1], [1, 1]]), np.array([1.0, 1, 0])

    def loss():
        score = mean @ inner
        good = np.log(1 / (1 + np.exp(-np.sum(score * (own @ outer), 1))))
        return np.sum(rate * (good + np.sum(share * np.log(1 / (1 + np.exp(score @ drawn.T))), 1)))

    si, so = W.steps(inner, own @ outer, drawn, mean, mean, own, share, rate)
    for table, step in ((inner, si), (outer, so[:2]), (drawn, so[2:])):
        for i in np.ndindex(table.shape):
            kept = table[i]
            table[i] = kept + 1e-6
            up = loss()
            table[i] = kept - 1e-6
            down = loss()
            table[i] = kept
            assert abs((up - down) / 2e-6 - step[i]) < 1e-4


def test_a_pass_equals_its_plain_form(monkeypatch):
    """Runs one after the other, each of whose sums is made pair by pair; no word is repeated so often that its step is bounded."""
    window, size, count = 2, 6, 300
    rng = np.random.default_rng(2)
    number = np.concatenate([[-1, -1], rng.permutation(count), [-1, -1], rng.permutation(count)[:50], [-1, -1]]).astype(np.int32)
    inner, outer = (rng.normal(size=(count + 1, size)).astype(np.float32) for _ in range(2))
    inner[-1] = outer[-1] = 0
    reach, drawn = [], []

    class Same(np.random.Generator):
        def integers(self, *a):
            reach.append(super().integers(*a))
            return reach[-1]

    draws = W.draw
    monkeypatch.setattr(W, "draw", lambda *a: drawn.append(draws(*a[:2], np.random.default_rng(3), a[3])) or drawn[-1])
    one, two = inner.astype(float), outer.astype(float)
    W.learn(inner, outer, number, np.ones(count), window, 5, 0.1, 0.05, Same(np.random.PCG64(4)))
    starts = Same(np.random.PCG64(4)).permutation(np.arange(window, len(number) - window, W.RUN))
    for j, start in enumerate(starts):
        rate, gi, go, gd = 0.1 - 0.05 * j / len(starts), np.zeros_like(one), np.zeros_like(two), np.zeros_like(two)
        for i in range(W.RUN):
            at = start + i
            near = [number[a] for a in range(at - reach[0][j, i], at + reach[0][j, i] + 1) if a != at and 0 <= a < len(number) and number[a] >= 0]
            if at >= len(number) or number[at] < 0 or not near:
                continue
            mean, back = one[near].mean(0), np.zeros(size)
            for t, weight, y in [(number[at], 1, 1), *((d, 5 / W.DRAWN, 0) for d in drawn[0][j] if d != number[at])]:
                error = weight * rate * (y - 1 / (1 + np.exp(-mean @ two[t])))
                back += error * two[t]
                (go if y else gd)[t] += error * mean
            np.add.at(gi, near, back)
        one, two = one + gi, two + go + gd
    assert np.allclose(inner, one, atol=1e-5) and np.allclose(outer, two, atol=1e-5) and not inner[-1].any()


def test_a_word_repeated_over_and_over_keeps_its_size():
    number = np.concatenate([np.full(5, -1), np.zeros(20_000, int), np.full(5, -1)]).astype(np.int32)
    inner, outer = W.started(np.array([5, 6]), 8, 1)[:, :8].copy(), np.zeros((2, 8), np.float32)
    with np.errstate(over="ignore"):
        W.learn(inner, outer, number, np.ones(1), 5, 5, 0.025, 0.01, np.random.default_rng(1))
    assert np.isfinite(inner).all() and np.abs(inner).max() < 100 and np.abs(outer).max() < 100


def test_ranked():
    distinct, many, place = W.ranked(np.array([[3, -1, 3, 2], [9, 9, 9, 9]]))
    assert distinct.tolist() == [[-1, 2, 3], [9, -1, -1]] and many.tolist() == [[1, 1, 2], [4, 0, 0]] and place.tolist() == [[2, 0, 2, 1], [0, 0, 0, 0]]


def test_rare_words_close_up_and_pieces_go_on():
    lists = pa.array([None, None, ["a", "zz", "b"], ["b"], ["zz"], ["a"]], pa.list_(pa.string()))
    b = pa.RecordBatch.from_arrays([pa.array([7] * 6, pa.int32()), pa.array([0, 0, 1, 1, 1, 1], pa.int32()), pa.array(["a", "b", *[None] * 4]), lists, pa.array([None, None, 0, 1, 0, 0], pa.int32())], ["block", "kind", "word", "words", "piece"])
    for batches in ([b], [b.slice(0, 3), b.slice(3)]):
        out = list(W._named(2)(iter(batches)))
        ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for o in out for x in o.column("ids")])
        assert {x for o in out for x in o.column("block").to_pylist()} == {7} and [g for g in "".join("ab."[i] for i in ids).split(".") if g] == ["abb", "a"]


@pytest.mark.parametrize("least", [W.LEAST, 2000])
def test_words_of_one_field_are_near(spark, monkeypatch, least):
    monkeypatch.setattr(W, "LEAST", least)
    rng = np.random.default_rng(4)
    fields = [[f"{a}{i}" for i in range(12)] for a in "xyz"]
    rows = [([*map(str, rng.choice(fields[i % 3], 40))],) for i in range(1500)] + [(None,), ([],), ([None, "rare"],), ([None] * 60,), (["alone"],)] + [(["single"],)] * 50
    got = {r.word: np.array(r.vector) for r in W.train(spark.createDataFrame(rows, "words array<string>"), "words", size=16, rate=0.05).collect()}
    assert set(got) == {w for f in fields for w in f} | {"single"} and {len(v) for v in got.values()} == {16}
    cosine = lambda a, b: got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b])
    for f in fields:
        for w in f:
            assert min(cosine(w, o) for o in f) > max(cosine(w, o) for g in fields if g is not f for o in g) + 0.3


def test_no_text_gives_no_rows(spark):
    assert W.train(spark.createDataFrame([(None,), (["a"],)], "words array<string>"), "words", size=4).collect() == []
