"""Dense networks: gradients against finite differences, Spark's sums against one block, early stopping, a planted signal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.operators import evaluate, network
from hostlens.operators.network import Net, Spec
from hostlens.operators.trees import Member

FEATURES = ["a", "b", "c"]
EVERY = Member(0, (0, 1, 2))


def rows(spark, n, signal=True):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 50, 0]
    y = (x[:, 0] + (x[:, 1] - 50) / 10 > 0.8) if signal else rng.random(n) < 0.3
    data = [(f"r{i}", f"v{i}", *map(float, x[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(data, "row_id string, vector string, a double, b double, c double, label int").repartition(5)


@pytest.mark.parametrize("batch_norm", [True, False])
@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_gradient_equals_finite_differences(batch_norm, dropout):
    spec = Spec(hidden=(5, 4), dropout=dropout, batch_norm=batch_norm)
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(30, 3)), (rng.random(30) < 0.4).astype(float), rng.random(30) + 0.5
    sizes = network.shapes(3, spec)
    at = network.fresh(3, spec, EVERY) + rng.normal(0, 0.1, sum(int(np.prod(s)) for s in sizes))
    draw = lambda: np.random.default_rng(9)
    loss = lambda v: network.gradient(network.opened(v, sizes), x, y, w, spec, draw())[1]
    got = np.concatenate([g.ravel() for g in network.gradient(network.opened(at, sizes), x, y, w, spec, draw())[0]])
    step = 1e-5 * np.eye(len(at))
    want = np.array([(loss(at + s) - loss(at - s)) / 2e-5 for s in step])
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_tasks_add_up_to_one_block(spark, monkeypatch):
    spec = Spec(hidden=(6,), dropout=0.0, batch_norm=False, steps=1, held=0.0)
    df = rows(spark, 300).withColumn("fold_0", F.pmod(F.xxhash64("row_id"), F.lit(3)).cast("int"))
    table = network.lay_out(df, FEATURES, ["row_id", "fold_0"], spec)
    members = [EVERY, Member(0, (0, 2), 0, 1)]
    nets = network.facts(table, members, 3, spec)
    got = network.gradients(table, members, dict(enumerate(nets)), spec, 1)
    monkeypatch.setattr(network, "FAN", 1)  # two levels of sums
    again = network.gradients(table, members, dict(enumerate(nets)), spec, 1)
    plain = df.toPandas()
    for m, (member, net) in enumerate(zip(members, nets)):
        seen = plain if member.fold < 0 else plain[plain["fold_0"] != member.fold]
        x, y = seen[FEATURES].to_numpy(), seen["label"].to_numpy().astype(float)
        assert np.allclose(net.center, x.mean(axis=0)) and np.allclose(net.scale, x.std(axis=0), rtol=1e-6)
        assert net.classes == pytest.approx((len(y) / (2 * (y == 0).sum()), len(y) / (2 * y.sum())))
        weight = np.where(y == 1, net.classes[1], net.classes[0])
        values = ((x - net.center) / net.scale)[:, list(member.features)]
        grads, loss, _ = network.gradient(network.opened(net.weights, network.shapes(len(member.features), spec)), values, y, weight, spec)
        want = np.concatenate([*[g.ravel() for g in grads], [loss, len(y)]])
        assert np.allclose(got[m], want) and np.allclose(again[m], want)


def test_learns_a_planted_signal(spark):
    spec = Spec(hidden=(16, 8), epochs=12, steps=4, rate=0.02, dropout=0.1)
    tests, cutoffs = evaluate.trained_together(rows(spark, 1500), FEATURES, spec, 1, 3)
    assert tests.count() == tests.select("row_id").distinct().count() == 1500
    assert 0 < cutoffs.select("row_id").distinct().count() < 1500 * 0.25
    got = evaluate.scores(evaluate.decide(tests, cutoffs, [None]), ["repeat"]).first()
    assert got["auroc"] > 0.95 and got["f1"] > 0.75


def test_stops_early_and_keeps_the_best_epoch(spark):
    spec = Spec(hidden=(8,), epochs=15, steps=2, patience=2, rate=0.05, held=0.3)
    table = network.lay_out(rows(spark, 200, signal=False), FEATURES, ["row_id"], spec)
    (net,) = network.fit(table, [EVERY], 3, spec)
    assert len(net.history) < 15 and net.history[net.epochs - 1] == max(net.history) and len(net.history) == net.epochs + 2
    assert network.areas(table.filter("held = 1"), [EVERY], {0: net}, spec)[0] == max(net.history)


def test_odd_inputs(spark):
    """Null and NaN features count as 0, constant ones are harmless, one class and an empty table train without a crash."""
    spec = Spec(hidden=(4,), epochs=2, steps=2)
    df = spark.createDataFrame([("x", "v1", None, 1.0, float("nan"), 1), ("y", None, 2.0, 1.0, 0.0, 1), (None, "v3", 3.0, 1.0, 1.0, 1)], rows(spark, 1).schema)
    for some in (df, df.limit(0)):
        table = network.lay_out(some, FEATURES, ["row_id"], spec)
        nets = network.fit(table, [EVERY], 3, spec)
        got = network.member_scores(table, [EVERY], nets, spec, ["row_id"], False).collect()
        assert len(got) == some.count() and all(0 <= r["proba"] <= 1 for r in got)


def test_weights_are_a_copy_of_rows():
    """A class weight of 2 is the same as every row of the class twice."""
    spec = Spec(hidden=(4,), dropout=0.0, batch_norm=False)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(20, 3)), (np.arange(20) % 4 == 0).astype(float)
    net = Net(network.fresh(3, spec, EVERY), [], np.zeros(3), np.ones(3))
    parts = network.opened(net.weights, network.shapes(3, spec))
    twice = np.concatenate([np.arange(20), np.flatnonzero(y == 1)])
    a = network.gradient(parts, x, y, np.where(y == 1, 2.0, 1.0), spec)
    b = network.gradient(parts, x[twice], y[twice], np.ones(len(twice)), spec)
    assert a[1] == pytest.approx(b[1]) and all(np.allclose(p, q) for p, q in zip(a[0], b[0]))
