import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import folds, losses, nets


def shape(fusion, task, hidden=(7, 5)):
    return nets.Shape(4, 3, hidden, fusion, task, {"binary": 1, "labels": 3, "range": 2}[task], 4)


@pytest.mark.parametrize("fusion", nets.FUSIONS)
@pytest.mark.parametrize("task", nets.TASKS)
def test_gradients_by_differences(fusion, task):
    rng = np.random.default_rng(1)
    net = nets.start(shape(fusion, task))
    for k in net.weights:
        net.weights[k] = net.weights[k] + rng.normal(0, 0.1, net.weights[k].shape)
    x = rng.normal(size=(9, 7))
    y = rng.integers(0, 4, (9, 1)).astype(float) if task == "range" else rng.integers(0, 2, (9, net.shape.width)).astype(float)
    if task == "labels":
        y[2, 1] = np.nan
    weight, head = rng.random(9) + 0.1, rng.integers(0, 2, 9)
    value = lambda: nets.loss(net.shape, nets.forward(net, x)[0], y, weight, head)[0]
    logits, kept = nets.forward(net, x)
    grads = nets.backward(net, kept, nets.loss(net.shape, logits, y, weight, head)[1])
    assert set(grads) == set(net.weights)
    for k, g in grads.items():
        i = tuple(rng.integers(0, n) for n in g.shape)
        net.weights[k][i] += 1e-6
        up = value()
        net.weights[k][i] -= 2e-6
        down = value()
        net.weights[k][i] += 1e-6
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_losses_equal_the_aggregates(spark):
    rng = np.random.default_rng(2)
    s = nets.Shape(2, 0, (3,), "concat", "range", 2, 3)
    logits, y, w, head = rng.normal(size=(6, 6)), rng.integers(0, 3, 6), rng.random(6) + 0.1, np.array([0, 0, 1, 1, 1, 0])
    own = logits.reshape(6, 2, 3)[np.arange(6), head]
    df = spark.createDataFrame([(own[i].tolist(), int(y[i]), int(head[i]), float(w[i])) for i in range(6)], "l array<double>, y int, h int, w double")
    assert losses.masked_cross_entropy(df, "l", "y", "h", F.col("w")).first().loss == pytest.approx(nets.loss(s, logits, y.astype(float), w, head)[0])


def test_fit_learns_and_stops(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 3] > 0).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(400)], "id int, x array<double>, y double").withColumn("p", F.lit("clash"))
    train, test = df.where("id < 300"), df.where("id >= 300")
    right = lambda net: nets.predict(net, test, out="q").where("(q > 0.5) = (y > 0.5)").count() / 100
    net = nets.fit(train, nets.Shape(3, 2, (32,), "bilinear"), rounds=12, rate=0.02, size=32, workers=2, score=right, patience=4)
    assert right(net) > 0.85
    again = nets.unpack(nets.pack(net))
    assert right(again) == right(net)
    assert nets.predict(net, test.withColumn("x", F.when(F.col("id") > 350, F.col("x"))), out="q").where("q is null").count() == 51
    empty = nets.fit(train.limit(0), net.shape, rounds=1, workers=2)
    assert set(empty.weights) == set(net.weights)


def test_grid_and_cascade(spark):
    assert nets.grid({"a": [1, 2], "b": ["x"]}) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    best = nets.search({"h": [3, 5, 4]}, lambda o: nets.start(nets.Shape(2, 0, (o["h"],))), lambda n: float(n.shape.hidden[0] >= 4))
    assert best[0] == {"h": 5} and best[2] == 1.0
    with pytest.raises(ValueError):
        nets.grid({"a": []})
    with pytest.raises(ValueError):
        nets.Shape(2, 0, (3,), "film")
    rows = [(i, i % 20, i % 37, 2000 + i % 20) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, p bigint, s bigint, y int")
    name, got = folds.holdout_cascade(df, 0.1, "id", "p", "s", "y")
    assert name == "time-protein" and got.count() == 400
    late = spark.createDataFrame([(i, i % 40, i % 40, 2000) for i in range(400)], "id bigint, p bigint, s bigint, y int")
    name, got = folds.holdout_cascade(late, 0.1, "id", "p", "s", "y")
    assert name == "double-cold" and 0 < got.where("fold = 'val'").count() <= 60
    one = spark.createDataFrame([(i, 1, 1, 2000) for i in range(40)], "id bigint, p bigint, s bigint, y int")
    assert folds.holdout_cascade(one, 0.1, "id", "p", None, "y") is None
