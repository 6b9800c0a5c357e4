"""Networks: gradients against differences, training by one and by several tasks, checkpoints."""

import numpy as np
import pytest

from tallywind.operators import networks

F = networks.F


@pytest.mark.parametrize("normalise", ["batch", "layer", None])
def test_gradients_are_the_differences(normalise):
    rng = np.random.default_rng(0)
    net = networks.Network([5, 7, 4, 3], normalise, 0.0)
    x, y = rng.normal(size=(12, 5)), rng.integers(0, 3, 12)
    _, grad = net.gradients(x, y, rng)
    assert set(grad) == set(net.p)
    for k, p in net.p.items():
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)]:
            was, near = p[at], []
            for h in (1e-5, -1e-5):
                p[at] = was + h
                near.append(net.gradients(x, y, rng)[0])
            p[at] = was
            assert abs((near[0] - near[1]) / 2e-5 - grad[k][at]) < 1e-6, (k, at)


def test_dropout_and_running_means():
    rng = np.random.default_rng(0)
    net = networks.Network([4, 50, 2], "batch", 0.5)
    x = 3 + 2 * rng.normal(size=(4000, 4))
    for _ in range(80):
        net.forward(x, rng)
    assert np.allclose(net.running["m0"], x.mean(0), atol=0.01) and np.allclose(net.running["v0"], x.var(0), rtol=0.01)
    assert (net.forward(x)[0] == net.forward(x)[0]).all() and not (net.forward(x, rng)[0] == net.forward(x, rng)[0]).all()
    again = networks.Network.from_bytes(net.to_bytes())
    assert (again.forward(x)[0] == net.forward(x)[0]).all() and again.sizes == [4, 50, 2]


def rings(n=900):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, n)
    angle = rng.uniform(0, 2 * np.pi, n)
    x = np.c_[np.cos(angle), np.sin(angle)] * (1 + 2 * y)[:, None] + rng.normal(size=(n, 2)) / 5
    return [(i, [float(c) for c in v], int(k), "x") for i, (v, k) in enumerate(zip(x, y, strict=True))]


@pytest.mark.parametrize("tasks", [1, 3])
def test_training_by_tasks_together(spark, tmp_path, tasks):
    odd = [(9001, None, 1, "x"), (9002, [1.0], 1, "x"), (9003, [1.0, None], 1, "x"), (9004, [1.0, 2.0], None, "x"), (9005, [float("nan"), 0.0], 1, "x")]
    df = spark.createDataFrame(rings() + odd, "id long, v array<double>, label int, prediction string")
    net, told = networks.train(df, "v", "label", F.col("id") % 4 == 0, [32, 16], epochs=25, batch=32, rate=5e-3, warm_up=5, tasks=tasks)
    best = max((e for e in told["history"] if e[0] >= 5), key=lambda e: e[2])
    assert told["held_out_accuracy"] == best[2] > 0.9 and told["epoch"] == best[0] and len(told["history"]) == 25
    assert told["history"][-1][1] < told["history"][0][1]
    net.save(spark, str(tmp_path / "model"))
    rows = networks.predict(df, "v", networks.Network.load(spark, str(tmp_path / "model"))).collect()
    assert rows[0].__fields__ == ["id", "v", "label", "prediction"]
    by = {r.id: r for r in rows}
    held = [by[i] for i in range(0, 900, 4)]
    assert abs(sum(r.prediction == r.label for r in held) / len(held) - told["held_out_accuracy"]) < 0.01
    assert [by[i].prediction is None for i in range(9001, 9006)] == [True, True, True, False, True]


def test_one_step_of_two_tasks_is_a_step_of_both(spark):
    """Without normalising and dropout, two tasks' mean gradient is that of their rows together."""
    rows = rings(64)
    df = spark.createDataFrame(rows, "id long, v array<double>, label int, prediction string")
    net, _ = networks.train(df, "v", "label", F.lit(False), [8], epochs=1, batch=64, rate=0.01, warm_up=0, normalise=None, dropout=0.0, tasks=2, seed=3)
    want = networks.Network([2, 8, 3], None, 0.0, 3)
    _, grad = want.gradients(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.random.default_rng(0))
    networks.Adam(0.01).step(want.p, grad)
    assert all(np.allclose(net.p[k], want.p[k], atol=1e-4) for k in want.p)


def test_no_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        networks.train(spark.createDataFrame([], "v array<double>, label int"), "v", "label", F.lit(False))
