"""Rows with NULL strata, parts and keys stay; sizes never change a result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.operators import clean, cumulative, errors, evaluate, joins, metrics, models, profile, sampling, sequence, splits
from hostlens.operators.models import Detector
from hostlens.operators.triage import two_decimals
from hostlens.sources import audit


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 3 == 0 else f"t{i % 2}", float(i % 17), i % 2) for i in range(300)]
    return spark.createDataFrame(data, "row_id bigint, technique string, v double, label int").repartition(7)


def test_draws_keep_null_strata(rows):
    got = {r["technique"]: r["n"] for r in sampling.cap_per_stratum(rows, ["technique"], ["row_id"], 10, 1).groupBy("technique").agg(F.count("*").alias("n")).collect()}
    assert got == {None: 10, "t0": 10, "t1": 10}
    drawn = sampling.subsample_proportional(rows, "technique", ["row_id"], 90, 1)
    assert drawn.count() == 90 and drawn.filter("technique is null").count() == 30
    assert sampling.case_cap(rows, ["technique"], "row_id", 60, 1).filter("technique is null").count() == 20


def test_refined_cells_change_nothing(rows):
    plain = sorted(r["row_id"] for r in sampling.take_lowest(rows, ["technique"], ["row_id"], 5, quota=37).collect())
    finer = sampling.mark_lowest(rows, ["technique"], ["row_id"], 5, quota=37, digits=1, rank_rows=1).filter("taken = 1")
    assert sorted(r["row_id"] for r in finer.collect()) == plain and len(plain) == 111


def test_parts_keep_null(rows):
    got = {r["technique"]: r["auroc"] for r in metrics.auroc(rows, ["technique"], "label", "v").collect()}
    assert None in got and len(got) == 3
    q = cumulative.wide_quantiles(cumulative.value_counts(rows, ["technique"], "v"), ["technique"], "v", {"m": 50})
    assert {r["technique"] for r in q.collect()} == {None, "t0", "t1"}
    for n in (2, 40):
        axis = cumulative.prefix_sums(cumulative.value_counts(rows, ["technique"], "v"), ["technique"], "v", ["n"], ranges=n)
        assert {(r["technique"], r["v"]): r["n_below"] for r in axis.collect()} == {
            (t, float(v)): sum(1 for i in range(300) if (None if i % 3 == 0 else f"t{i % 2}") == t and i % 17 < v)
            for t in (None, "t0", "t1") for v in range(17)}


def test_joins_match_null_keys(rows):
    groups = rows.groupBy("technique").agg(F.count(F.lit(1)).alias("n"))
    assert joins.join_groups(rows, groups, ["technique"], "n", ["row_id"], hot_rows=1).filter("n = 100").count() == 300
    assert joins.join_lookup(rows, groups, ["technique"]).filter("n is not null").count() == 300


def test_sequences_of_processes_without_a_scenario(spark):
    ev = [("SYSCALL", float(i), i, 1, 0, 0, 0, 0, 0, "read", 0, "a", s, "h", 0, "benign", i) for s in (None, "s") for i in range(3)]
    names = "record_type string, timestamp double, seq_id bigint, pid bigint, ppid bigint, uid bigint, euid bigint, gid bigint, auid bigint, syscall_name string, " \
        "failed int, source string, scenario string, host string, label int, technique string, line_no bigint"
    df = spark.createDataFrame(ev, names)
    assert sequence.encode_sequences(df, sequence.build_vocabulary(df)).count() == 2
    cleaned = clean.clean_events(df.drop("source").withColumns({"exe": F.lit(None).cast("string"), "comm": F.lit(None).cast("string")}))
    assert {(r["source"], r["scenario"]) for r in cleaned.select("source", "scenario").collect()} == {("unknown", "unknown"), ("unknown", "s")}


def test_deal_does_not_depend_on_ranges(spark, rows, monkeypatch):
    keyed = rows.withColumn("vector", F.concat(F.lit("g"), (F.col("row_id") % 90).cast("string")))
    one = sorted(map(tuple, splits.balanced_folds(keyed, "vector", "label", 5, 3, ["row_id"]).select("row_id", "fold").collect()))
    monkeypatch.setattr(cumulative, "RANGE_ROWS", 3)
    assert sorted(map(tuple, splits.balanced_folds(keyed, "vector", "label", 5, 3, ["row_id"]).select("row_id", "fold").collect())) == one
    folds = splits.stratified_folds(keyed, "vector", "label", 5, 3, 2, ["row_id"])
    per = folds.groupBy("fold_1").agg(F.countDistinct("vector").alias("n"), F.sum("label").alias("p")).collect()
    assert len(per) == 5 and max(r["n"] for r in per) - min(r["n"] for r in per) <= 2
    assert folds.groupBy("vector").agg(F.countDistinct("fold_0").alias("n")).filter("n > 1").count() == 0


@pytest.fixture(scope="module")
def prepared(spark):
    rng = np.random.default_rng(0)
    data = [(f"r{i}", float(rng.normal() + 2 * (i % 2)), float(rng.normal()), i % 2, "x") for i in range(240)]
    return models.prepare(spark.createDataFrame(data, "row_id string, a double, b double, label int, technique string"), ["a", "b"], log=False)


def test_one_class_training_folds_are_flagged(spark, prepared):
    few = prepared.filter("label = 0").unionByName(prepared.filter("label = 1").limit(1))
    out = evaluate.repeated_cv(few, ["a", "b"], Detector("rf", {"numTrees": 3, "maxDepth": 2}), 1, 3, pooled=False)
    got = {r["fold"]: (r["degenerate"], r["f1"]) for r in out.collect()}
    assert sum(d for d, _ in got.values()) == 1 and len(got) == 3
    with pytest.raises(ValueError):
        evaluate.repeated_cv(prepared.filter("label = 0"), ["a", "b"], Detector("rf", {"numTrees": 3}), 1, 3)


def test_no_cap_is_a_cap(prepared):
    out = evaluate.cap_sweep(prepared, ["a", "b"], Detector("rf", {"numTrees": 3, "maxDepth": 3}), [0.05, None], 1, 2)
    assert {r["max_fpr_cap"] for r in out.collect()} == {0.05, None}


@pytest.mark.parametrize("kind, params", [("rf", {"numTrees": 3}), ("gbt", {"maxIter": 2}), ("mlp", {"hidden": [4], "maxIter": 3}), ("iforest", {"trees": 10, "sample": 32})])
def test_models_come_back(spark, prepared, tmp_path, kind, params):
    fitted = Detector(kind, params).fit(prepared, ["a", "b"])
    fitted.save(str(tmp_path / kind))
    again = models.load_detector(spark, str(tmp_path / kind), kind, ["a", "b"])
    one = {r["row_id"]: r["proba"] for r in fitted.score(prepared).collect()}
    assert one == {r["row_id"]: r["proba"] for r in again.score(prepared).collect()}


def test_parser_takes_the_first_field(spark):
    lines = [
        'type=SYSCALL msg=audit(1.5:7): success=yes ppid=10 pid=11 pid=12 exe="" exe="/x" comm="a b" key="k 1" SYSCALL=open',
        "  type=PATH msg=audit(2:8): name=\"/etc/shadow\" key=plain", "type=PROCTITLE msg=audit(1:1): x", "type=X msg=audit(.:1):", "garbage",
    ]
    df = spark.createDataFrame([(v, "f", i) for i, v in enumerate(lines)], "value string, file string, line_no bigint")
    got = audit.parse_lines(df).orderBy("line_no").collect()
    assert len(got) == 2
    a, b = got
    assert (a["record_type"], a["timestamp"], a["seq_id"], a["pid"], a["ppid"], a["exe"], a["comm"], a["key_tag"], a["syscall_name"], a["success"]) == (
        "SYSCALL", 1.5, 7, 11, 10, None, "a b", "k", "open", True)
    assert (b["record_type"], b["name"], b["key_tag"], b["pid"], b["syscall_name"], b["failed"]) == ("PATH", "/etc/shadow", "plain", None, "PATH", 1)


def test_correlations_leave_out_pair_by_pair(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    data = [(float(a), None if i % 4 == 0 else float(a + b), float(c), 1.0) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(data, "p double, q double, r double, k double")
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in profile.correlation_pairs(df, ["p", "q", "r", "k"]).collect()}
    keep = [i for i in range(200) if i % 4]
    assert np.isclose(got["p", "q"], np.corrcoef(x[keep, 0], x[keep, 0] + x[keep, 1])[0, 1])
    assert np.isclose(got["p", "r"], np.corrcoef(x[:, 0], x[:, 2])[0, 1]) and got["p", "k"] is None


def test_two_decimals_like_c(spark):
    values = [i / 1000 for i in range(0, 2001)] + [0.125, 0.375, 0.165, 0.285, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(two_decimals(F.col("v"))).collect()] == ["%.2f" % v for v in values]


def test_support_of_each_fold(spark):
    data = [(f, n, y) for f in (0, 1, 2) for n, y in (("a", 1), ("a", 0), (None, 1))] + [(0, "b", 1)]
    df = spark.createDataFrame(data, "fold int, proc_name string, label int")
    got = {(r["proc_name"], r["fold"]): (r["train_support"], r["train_attack_rate"]) for r in errors.name_support(df).collect()}
    assert got["a", 0] == (4, 0.5) and got["b", 0][0] == 0 and got["b", 1] == (1, 1.0)
