"""Work per row: what grew faster than its input, or cost far more than it had to, stays mended."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from hostlens.operators import network, profile, trees, triage
from hostlens.plans import triaging
from hostlens.sources.tensors import read_tensors, write_tensors

SCORED = "row_id string, proba_xgb double, proba_cnn double, pred_xgb int, pred_cnn int, true_label int, technique string, fold int"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_are_searched_and_count_ties_half(spark):
    points = [float(p // 10) for p in range(1, 100)]
    tables = spark.createDataFrame([("a", points, [0.0] * 99)], "feature string, benign array<double>, attack array<double>")
    values = [-1.0, -0.0, 0.0, 4.0, 4.5, 9.0, 10.0, math.nan, math.inf, None]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(values)], "i int, a double, b double")
    out = triage.attach_ranks(df, ["a", "b"], tables)
    assert "lambda" not in plan(out)
    want = df.select("i", triage.percentile_rank(F.coalesce("a", F.lit(0.0)), F.array(*map(F.lit, points))).alias("benign"),
                     triage.percentile_rank(F.coalesce("a", F.lit(0.0)), F.array(*[F.lit(0.0)] * 99)).alias("attack")).sort("i").collect()
    got = out.sort("i").collect()
    assert [(r["ranked"][0]["benign"], r["ranked"][0]["attack"]) for r in got] == [(r["benign"], r["attack"]) for r in want]
    assert [r["ranked"][0]["name"] for r in got] == ["a"] * len(got)
    assert all(r["ranked"][1]["benign"] is None and r["ranked"][1]["v"] == 1.0 for r in got)  # no table for b


def test_four_digits_finds_the_exponent_once(spark):
    values = [0.0, 5.0, 12345.6, 0.00001234, 9999.5, 0.12346, -3.14159, 99995.0, 1e-4, 123456.7, 2.00005, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(1)
    out = df.select("v", triage.four_digits(F.col("v")).alias("t"))
    assert plan(out).count("LOG10(") == 1
    for r in out.collect():
        if r["v"] is not None and math.isfinite(r["v"]):
            assert r["t"] == (str(int(r["v"])) if r["v"] == int(r["v"]) else f"{r['v']:.4g}")


def test_replies_draw_each_number_once(spark, monkeypatch):
    rows = spark.createDataFrame([(f"r{i}", 0.5, 0.5, 0, 1, i % 2, "T1", 0) for i in range(40)], SCORED)
    monkeypatch.setattr(triaging, "oof", lambda spark, sf_dir: rows)
    out = triaging.build_replies(spark, "")
    assert plan(out).count("md5(") <= 4  # three numbers, one of them also as a filter
    got = out.groupBy("row_id").agg(F.max("attempt").alias("n")).collect()
    assert 0 < len(got) < 40 and {r["n"] for r in got} == {1, 2}


def test_heavy_rows_are_spread_by_their_number(spark):
    df = spark.range(1000).selectExpr("cast(id as string) AS row_id").coalesce(1)
    assert trees.spread(df, 100).rdd.getNumPartitions() == 10
    assert trees.spread(df, 1000).rdd.getNumPartitions() == 1  # as it was


def test_a_boosted_round_walks_no_trees_of_earlier_rounds(spark, monkeypatch):
    table = spark.createDataFrame([(i % 2, i, bytes([i % 7, i % 2])) for i in range(60)], "label int, row long, bins binary")
    seen, real = [], trees.pass_over

    def watched(rows, members, growth, grown, nodes, weights, first, level):
        seen.append({t for _, t, _ in nodes} == {first})
        return real(rows, members, growth, grown, nodes, weights, first, level)

    monkeypatch.setattr(trees, "pass_over", watched)
    grown = trees.grow(table, [trees.Member(0, (0, 1))], trees.Growth(trees=3, depth=1, boosted=True, node_features=1.0))
    assert len(seen) == 3 and all(seen) and len(grown) == 3


def test_scores_of_blocks_are_those_of_all_rows():
    spec, member = network.Spec(hidden=(8, 4)), trees.Member(0, (0, 1, 2))
    running = [(np.full(u, 0.1), np.full(u, 2.0)) for u in spec.hidden]
    net = network.Net(network.fresh(3, spec, member), running, np.zeros(3), np.ones(3))
    x, sizes, real = np.random.default_rng(0).normal(size=(2 * network.BLOCK + 3, 3)), [], network.forward
    whole = network.sigmoid(real(network.opened(net.weights, network.shapes(3, spec)), x, spec, running=running)[0])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(network, "forward", lambda parts, x, *a, **k: sizes.append(len(x)) or real(parts, x, *a, **k))
        got = network.probabilities(x, member, net, spec)
    assert np.allclose(got, whole, rtol=0, atol=1e-12) and max(sizes) == network.BLOCK
    assert len(network.probabilities(x[:0], member, net, spec)) == 0


def test_small_blocks_share_a_reader(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "array(cast(id as int), 1) AS t")
    write_tensors(df.coalesce(1), str(tmp_path / "t"), "t", (2,), 10)
    back = read_tensors(spark, str(tmp_path / "t"))
    assert back.rdd.getNumPartitions() == 1  # of 30 blocks
    assert sorted((r["id"], r["t"][0], r["row"]) for r in back.collect()) == [(i, i, i) for i in range(300)]


def test_histogram_never_shuffles_by_feature_alone(spark):
    df = spark.range(100).selectExpr("'a' AS feature", "cast(id % 2 as int) AS label", "cast(id as double) AS value")
    out = profile.histogram(df, "label")
    assert out.agg(F.sum("n")).first()[0] == 100
    physical = out._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in physical.splitlines() if "SortMergeJoin [feature" in line and "label" not in line]
