"""Statistics against brute force, on small data with ties, skew and gaps."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.functions.columns import melt
from hostlens.operators import cascade, cumulative, duplicates, iforest, joins, metrics, profile, sampling, splits, summaries, triage


def skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(400)}", float(rng.choice([0, 0, 1, 2, rng.random()]))) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(skewed(), "id bigint, key string, v double").repartition(13)


def test_prefix_sums(spark, rows):
    counts = cumulative.value_counts(rows, [], "v")
    got = {r["v"]: r["n_below"] for r in cumulative.prefix_sums(counts, [], "v", ["n"], ranges=5).collect()}
    vs = [r[2] for r in skewed()]
    assert got == {v: sum(x < v for x in vs) for v in set(vs)}


def test_quantiles(spark, rows):
    for part in (rows, rows.filter("id < 2"), rows.filter("id = 1"), rows.repartition(1)):
        vs = np.array([r["v"] for r in part.collect()])
        got = {r["pct"]: r["q"] for r in cumulative.quantile_points(cumulative.value_counts(part, [], "v"), [], "v", list(range(0, 101))).collect()}
        want = np.percentile(vs, range(0, 101))
        assert np.allclose([got[p] for p in range(0, 101)], want)


def test_join_groups_with_a_hot_key(spark, rows):
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    for hot in (10, 10_000):
        got = {(r["id"], r["key"], r["n"], round(r["s"], 6)) for r in joins.join_groups(rows, groups, ["key"], "n", ["id"], hot_rows=hot).collect()}
        want = {(r["id"], r["key"], r["n"], round(r["s"], 6)) for r in rows.select("id", "key").join(groups, "key").collect()}
        assert got == want
    some = groups.filter("key <> 'hot'")
    sizes = groups.select("key", "n")
    left = joins.join_groups(rows, some, ["key"], "n", ["id"], sizes=sizes)
    assert left.count() == 3000 and left.filter("s is null").count() == 1000
    assert joins.join_groups(rows, some, ["key"], "n", ["id"], "inner", sizes=sizes).count() == 2000


def test_join_lookup_beyond_the_bound(spark, rows):
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    a = joins.join_lookup(rows, groups, ["key"], "n", ["id"], limit=5)
    b = joins.join_lookup(rows, groups, ["key"])
    assert sorted(map(tuple, a.select("id", "n").collect())) == sorted(map(tuple, b.select("id", "n").collect()))


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_take_lowest_is_exact(spark, rows, digits):
    import hashlib

    got = sampling.take_lowest(rows, ["key"], ["id"], 7, quota=30, digits=digits)
    want = {}
    for i, k, _ in skewed():
        want.setdefault(k, []).append((hashlib.md5(f"7|{i}".encode()).hexdigest(), i))
    want = {i for v in want.values() for _, i in sorted(v)[:30]}
    assert {r["id"] for r in got.collect()} == want
    assert {r["id"] for r in sampling.sample_n(rows.repartition(1), ["id"], 500, 7).collect()} == {r["id"] for r in sampling.sample_n(rows.repartition(37), ["id"], 500, 7).collect()}
    assert sampling.sample_n(rows, ["id"], 0, 7).count() == 0
    assert sampling.sample_n(rows, ["id"], 10**6, 7).count() == 3000


def test_proportional_draw(spark):
    df = spark.createDataFrame([(f"{s}{i}", s) for s, n in (("a", 100), ("b", 50), ("c", 20)) for i in range(n)], "id string, s string")
    got = {r["s"]: r["n"] for r in sampling.stratum_sizes(sampling.subsample_proportional(df, "s", ["id"], 34, 1), ["s"]).collect()}
    assert got == {"a": 20, "b": 10, "c": 4}
    assert sampling.subsample_proportional(df, "s", ["id"], 999, 1).count() == 170


def test_targets(spark):
    df = spark.createDataFrame([(i, int(i < 40), f"T{i % 3}" if i < 40 else "benign") for i in range(140)], "id bigint, label int, technique string")
    n = lambda d: {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}
    assert n(sampling.target_rate_sample(df, ["id"], 0.2, 1)) == {0: 100, 1: 25}
    assert n(sampling.target_rate_sample(df, ["id"], 0.5, 1)) == {0: 40, 1: 40}
    assert n(sampling.target_size_sample(df, ["id"], 110, 1)) == {0: 100, 1: 10}
    assert n(sampling.target_size_sample(df, ["id"], 900, 1)) == {0: 100, 1: 40}
    assert n(sampling.ratio_sample(df, ["id"], 0.75, 1)) == {0: 30, 1: 40}
    with pytest.raises(ValueError):
        sampling.target_size_sample(df, ["id"], 100, 1)


def test_folds_keep_groups_together(spark, rows):
    keyed = rows.withColumn("label", (F.col("v") > 1).cast("int"))
    for folded in (splits.hash_folds(keyed, "key", 5, 1, 2), splits.balanced_folds(keyed, "key", "label", 5, 1, ["id"]).withColumn("repeat", F.lit(0))):
        assert all(r["n_leaking"] == 0 for r in splits.fold_leaks(folded, "key", by=["repeat"]).collect())
    thin = splits.balanced_folds(keyed.filter("key <> 'hot'"), "key", "label", 5, 1, ["id"]).groupBy("fold").count().collect()
    sizes = [r["count"] for r in thin]
    assert len(sizes) == 5 and max(sizes) < 1.1 * min(sizes)
    budget = splits.row_budget_split(keyed, "key", 0.2, 3, ["id"])
    assert splits.fold_leaks(budget, "key", "in_calibration").first()["n_leaking"] == 0
    assert budget.filter("in_calibration = 1").count() >= 600


def test_vector_key_folds_negative_zero(spark):
    df = spark.createDataFrame([(0.0, 1.00001), (-0.0, 1.00002), (-0.00001, 1.0), (None, 1.0)], "a double, b double")
    assert splits.vector_key(df, ["a", "b"]).select("vector").distinct().count() == 2


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 0), ("b", 1), ("c", 1), ("c", 1)], "k string, label int")
    assert tuple(duplicates.duplication(df, "k").first()) == (6, 3, 3, 2.0, 3)
    assert tuple(duplicates.mixed_summary(df, "k").first()) == (3, 1, 3, 0.5)


def test_threshold_hand_case(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)], "y int, p double")
    got = {r["max_fpr"]: (r["threshold"], round(r["f1"], 3)) for r in metrics.best_thresholds(df, [], "y", "p", [None, 0.4]).collect()}
    assert got == {None: (0.7, 0.8), 0.4: (0.9, 0.667)}
    assert metrics.best_cut(df.filter("y = 1"), "y", "p", None) == 0.5
    worst = spark.createDataFrame([(0, 0.9), (1, 0.1)], "y int, p double")
    assert metrics.best_cut(worst, "y", "p", 0.05) == 0.9  # no score meets the cap


def test_auroc_and_threshold_brute_force(spark):
    rng = random.Random(5)
    data = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(data, "y int, p double").repartition(7)
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.auroc(df, [], "y", "p").first()["auroc"] == pytest.approx(want)
    flipped = metrics.auroc(df.withColumn("p", -F.col("p")), [], "y", "p").first()["auroc"]
    assert flipped == pytest.approx(1 - want)
    best = None
    for t in sorted({p for _, p in data}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
        if fp / len(neg) <= 0.3 and (best is None or 2 * tp / (tp + fp + len(pos)) > best[0]):
            best = (2 * tp / (tp + fp + len(pos)), t)
    assert metrics.best_cut(df, "y", "p", 0.3) == best[1]


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = metrics.score(df, [], "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"], r["fpr"], r["tn"]) == (0.0, 0.0, 0.0, 0.0, 2)
    assert metrics.score_counts(metrics.confusion(df, [], "y", "p"), None).first()["recall"] is None


def test_rank_tests(spark):
    a, b = [1.0, 2.0, 2.0, 3.0, 9.0, 4.0], [2.0, 5.0, 6.0, 7.0, 7.0, 8.0, 9.0]
    df = spark.createDataFrame([(1, x) for x in a] + [(0, x) for x in b], "label int, f double")
    m = melt(df, ["label"], ["f"])
    r = profile.mann_whitney(m).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n1, n2 = len(a), len(b)
    ties = sum(t**3 - t for t in (3, 2, 2))
    sd = math.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    assert r["u_statistic"] == u and r["z"] == pytest.approx(z) and r["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    ks = profile.ks_two_sample(m, F.col("label") == 1).first()["ks_statistic"]
    axis = sorted(set(a + b))
    want = max(abs(sum(x <= t for x in a) / n1 - sum(x <= t for x in b) / n2) for t in axis)
    assert ks == pytest.approx(want)
    moved = melt(df.withColumn("f", F.log1p("f")), ["label"], ["f"])
    assert profile.ks_two_sample(moved, F.col("label") == 1).first()["ks_statistic"] == pytest.approx(want)


def test_kolmogorov_p(spark):
    df = spark.createDataFrame([(0.01, 100, 100), (0.2, 100, 100), (0.9, 50, 50)], "d double, a bigint, b bigint")
    got = [r["p"] for r in df.select(profile.kolmogorov_p(F.col("d"), F.col("a"), F.col("b")).alias("p")).collect()]
    lam = 0.2 * math.sqrt(50)
    want = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 50))
    assert got[0] == 1.0 and got[1] == pytest.approx(want) and got[2] < 1e-12


def test_spearman_and_correlation(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=300), 1)
    y = np.round(x + rng.normal(size=300), 1)
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y)], "x double, y double")
    import pandas as pd

    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert profile.spearman(df, "x", "y").first()["rho"] == pytest.approx(want)
    for f in (profile.correlation_pairs,):
        assert f(df, ["x", "y"]).first()["r"] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_calibration(spark):
    df = spark.createDataFrame([(0.05, 0), (0.95, 1)], "c double, ok int")
    assert metrics.calibration_error(df, [], "c", "ok").first()["ece"] == pytest.approx(0.05)
    edge = spark.createDataFrame([(0.0, 0), (0.1, 0), (0.11, 1), (1.0, 1)], "c double, ok int")
    assert {r["bin"] for r in metrics.calibration_bins(edge, [], "c", "ok").collect()} == {1, 2, 10}


def test_blends(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.3, 1.0), (0.1, 1.0), (0.6, 0.0)], "a double, b double")
    flat = [r["final"] for r in cascade.blend(df, "a", "b").collect()]
    assert flat == pytest.approx([0.75, 0.65, 0.1, 0.3])
    w = [r["final"] for r in cascade.blend(df, "a", "b", weighted=True).collect()]
    assert w == pytest.approx([1.0, 0.3, 0.1, 0.3])


def test_one_class_fold_is_flagged(spark):
    df = spark.createDataFrame([(0, 1, 0.6, 0.2, 0.5), (0, 0, 0.2, 0.1, 0.5), (1, 1, 0.6, 0.2, 0.5)], "fold int, y int, a double, b double, threshold double")
    got = {r["fold"]: r for r in cascade.score_folds(cascade.blend(df, "a", "b"), ["fold"], "y").collect()}
    assert got[0]["degenerate"] == 0 and got[0]["auroc"] == 1.0
    assert got[1]["degenerate"] == 1 and got[1]["f1"] is None and got[1]["auroc"] is None


def test_percentile_labels(spark):
    df = spark.createDataFrame([([0.0] * 99, 0.0), ([float(i) for i in range(1, 100)], 0.5), ([float(i) for i in range(1, 100)], 99.5),
                                ([float(i) for i in range(1, 100)], 50.0)], "bp array<double>, v double")
    got = [r["t"] for r in df.select(triage.rank_text(triage.percentile_rank(F.col("v"), F.col("bp"))).alias("t")).collect()]
    assert got == ["p50", "p1-", "p99+", "p50"]


def test_four_digits(spark):
    vals = [0.0, 3.0, -2.0, 0.5, 12.345678, 1234.5678, 12345.678, 0.00012345, 0.000012345, 99999.5, 9.99996, 123456789.25, 0.1, 1e-7 * 3, 911.85, 911.75, -911.85, 10.005]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r["t"] for r in df.select(triage.four_digits(F.col("v")).alias("t")).collect()]
    assert got == [str(int(v)) if v == int(v) else f"{v:.4g}" for v in vals]


GOOD = '{"verdict": "BENIGN", "confidence": 0.5, "rationale_steps": ["a", "b", "c"], "key_features": ["x"], "agrees_with": "xgb"}'


@pytest.mark.parametrize(("raw", "ok"), [
    (GOOD, True), ("Sure {not} " + GOOD, False), ("Sure " + GOOD + " done", True), (GOOD[:-1], False), ("", False),
    (GOOD.replace("0.5", "1.7"), False), (GOOD.replace("0.5", "1"), True), (GOOD.replace("0.5", '"0.5"'), False), (GOOD.replace("0.5", "true"), False),
    (GOOD.replace('["x"]', '["z"]'), False), (GOOD.replace('["x"]', "[]"), True), (GOOD.replace('["x"]', "[1]"), False),
    (GOOD.replace('"a", ', ""), False), (GOOD.replace('"a"', "1"), False), (GOOD.replace("}", ', "more": 1}'), False),
    (GOOD.replace('"agrees_with": "xgb"', '"agrees_with": "both"'), False), (GOOD.replace(', "agrees_with": "xgb"', ""), False),
    (GOOD.replace('["x"]', '["x", "x", "x", "x", "x", "x"]'), False),
])
def test_reply_rules(spark, raw, ok):
    got = triage.parse_replies(spark.createDataFrame([(raw,)], "raw string"), ["x", "y"]).first()["reply"]
    assert (got is not None) == ok


def test_reply_attempts(spark):
    df = spark.createDataFrame([("a", 1, GOOD), ("b", 1, "x"), ("b", 2, GOOD), ("c", 1, "x"), ("c", 2, "y"), ("d", 1, "x")], "row_id string, attempt int, raw string")
    got = {r["row_id"]: (r["parse_status"], r["raw"]) for r in triage.resolve_replies(df, ["x"]).collect()}
    assert got == {"a": ("ok", GOOD), "b": ("repaired", GOOD), "c": ("parse_error", "y"), "d": ("parse_error", "x")}


def test_label_spellings(spark):
    df = spark.createDataFrame([(" malicious ", 1), ("1.0", 1), ("Normal", 0), ("neg", 0), ("0.9", 0), ("what", None), (None, None)], "t string, w int")
    assert all(r["g"] == r["w"] for r in df.withColumn("g", triage.to_label(F.col("t"))).collect())


def test_verdicts(spark):
    def runs(**arms):
        return spark.createDataFrame([(a, float(v), i) for a, vs in arms.items() for i, v in enumerate(vs)], "arm string, f1 double, repeat int")

    v = lambda p, c: summaries.candidate_verdict(runs(p=p, c=c), "p", "c").first()["verdict"]
    assert v([0.5, 0.51], [0.7, 0.71]) == "candidate better"
    assert v([0.5, 0.7], [0.55, 0.75]) == "no real difference"
    assert v([0.7, 0.71], [0.5, 0.51]) == "candidate worse"
    arm = lambda a, b, c: summaries.arm_verdict(runs(a=[a], b=[b], c=[c]), "a", "b", "c").first()["verdict"]
    assert arm(0.9, 0.7, 0.85) == "flag helps"
    assert arm(0.9, 0.7, 0.701) == "flag does not help"
    assert arm(0.9, 0.7, 0.72) == "ambiguous"


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(0)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(2000, 2)))] + [(5000 + i, 8.0 + i, -9.0) for i in range(5)]
    df = spark.createDataFrame(pts, "row_id bigint, a double, b double").repartition(5)
    m = iforest.fit(df, ["a", "b"], ["row_id"], trees=60, sample=128)
    top = m.score(df).orderBy(F.desc("proba")).limit(5).collect()
    assert sum(r["row_id"] >= 5000 for r in top) >= 4
    assert m.nodes.select("tree").distinct().count() == 60
    again = iforest.fit(df.repartition(2), ["a", "b"], ["row_id"], trees=60, sample=128)
    assert sorted(map(tuple, m.nodes.collect())) == sorted(map(tuple, again.nodes.collect()))
