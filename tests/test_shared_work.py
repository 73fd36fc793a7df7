"""What the fits of an evaluation share is made once."""

import pytest

from pyspark.sql import functions as F

from hostlens.operators import clean, evaluate, models, process, splits
from hostlens.operators.models import Detector
from hostlens.plans import modeling, views
from hostlens.session import cut_lineage

RF, GBT, MLP = Detector("rf", {"numTrees": 3, "maxDepth": 3}), Detector("gbt", {"maxIter": 2, "maxDepth": 2}), Detector("mlp", {"hidden": [3], "maxIter": 3})


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    """240 rows; the label follows x with noise."""
    part = lambda i: F.conv(F.substring(F.md5(F.col("id").cast("string")), i, 6), 16, 10).cast("double") / 16777216
    table = spark.range(240).select(F.col("id").cast("string").alias("row_id"), part(1).alias("x"), part(7).alias("z"), (part(1) + part(7) * 0.4 > 0.7).cast("int").alias("label"),
                                    F.lit("T1").alias("technique"), F.lit("p").alias("proc_name"))
    return cut_lineage(models.prepare(table, ["x", "z"]))


def test_stages_are_scored_in_one_pass_and_the_second_one_in_its_band(rows, monkeypatch):
    sizes, real = [], evaluate.union
    monkeypatch.setattr(evaluate, "union", lambda parts: sizes.append([plan(p).count("Relation [") for p in parts]) or real(parts))
    stages = evaluate.stage_scores(rows, ["x", "z"], GBT, {"rf": RF, "mlp": MLP}, 1, 2, 0.4, 0.6)
    assert stages.count() == 240 == stages.select("row_id").distinct().count()
    assert sizes == [[1, 1], [1, 1]]  # one scan for test rows, one for training rows
    inside = F.col("proba_1").between(0.4, 0.6)
    assert 0 < stages.filter(inside).count() < 240
    assert stages.filter(F.col("proba_rf").isNotNull() != inside).count() == stages.filter(F.col("proba_mlp").isNotNull() != inside).count() == 0


def test_inner_split_is_drawn_once(rows):
    ready = evaluate.assign_folds(rows, 2, 42, 1)
    again = splits.group_split(ready, "vector", 0.8, evaluate.INNER_SEED)
    assert again.filter((F.col(evaluate.INNER) < 0.8).cast("int") != F.col("in_fit")).count() == 0
    assert 0 < again.filter("in_fit = 0").count() < 240


def test_arms_share_their_folds(rows, monkeypatch):
    seen, real = [], evaluate.assign_folds
    monkeypatch.setattr(evaluate, "assign_folds", lambda *a: seen.append(a) or real(*a))
    monkeypatch.setattr(modeling, "prepared", lambda spark, sf_dir: rows.withColumnsRenamed({"x": "events_per_second", "z": "seq_length"}))
    monkeypatch.setattr(modeling, "FEATS", ["events_per_second", "seq_length"])
    monkeypatch.setattr(modeling, "RF", RF)
    out = {r["arm"]: r["n_total"] for r in modeling.augmented_cv(None, "").collect()}
    assert out == {"baseline": 240, "augmented": 240} and len(seen) == 1


def test_an_augment_learns_once_a_fold(rows):
    make, added = evaluate.relative_augment(["x"])
    learnt = []
    evaluate.cross_validate(rows, ["x", "z"], RF, 1, 2, augment=(lambda train, to: learnt.append(1) or make(train, to), added))
    assert len(learnt) == 2


def test_class_weights_come_from_one_count(rows):
    want = {r["label"]: r["weight"] for r in splits.class_weights(rows).collect()}
    assert {r["label"]: r["weight"] for r in splits.weighted(rows).select("label", "weight").distinct().collect()} == want


@pytest.mark.parametrize("detector", [RF, GBT, MLP])
def test_a_stored_vector_is_taken_as_it_is(rows, detector):
    ready = evaluate.assign_folds(rows, 2, 42, 1, ["x", "z"])
    plain = ready.drop(models.ASSEMBLED)
    assert models.has_assembled(ready, ["x", "z"]) and not models.has_assembled(ready, ["z", "x"]) and not models.has_assembled(plain, ["x", "z"])
    fitted = detector.fit(ready, ["x", "z"])
    assert "struct(x" in plan(fitted.score(plain)).lower() and "struct(x" not in plan(fitted.score(ready)).lower()
    scores = [{r["row_id"]: r["proba"] for r in f.score(t).collect()} for f, t in ((fitted, ready), (fitted, plain), (detector.fit(plain, ["x", "z"]), plain))]
    assert scores[0] == scores[1] and scores[0] == pytest.approx(scores[2], abs=1e-9)
    assert detector.fit(ready, ["z"]).score(ready).count() == 240  # another set of features puts its own vector together


def test_folds_of_all_models_are_scored_without_a_join_by_row(rows, monkeypatch):
    ready, dets = evaluate.assign_folds(rows, 2, 42, 1, ["x", "z"]), {"xgb": GBT, "cnn": MLP}
    monkeypatch.setattr(evaluate, "assign_folds", lambda *a: ready)
    out = evaluate.out_of_fold(rows, ["x", "z"], dets, 2)
    assert "(row_id" not in plan(out)
    assert out.columns == ["row_id", "x", "z", "fold", "true_label", "technique", "proc_name", "pred_xgb", "proba_xgb", "pred_cnn", "proba_cnn"]
    for name, det in dets.items():
        tests, cutoffs, _ = evaluate.cross_validate(ready, ["x", "z"], det, 1, 2, folds_ready=True)
        want = {r["row_id"]: (r["pred"], pytest.approx(r["proba"], abs=1e-9)) for r in evaluate.decide(tests, cutoffs).collect()}
        assert {r["row_id"]: (r[f"pred_{name}"], r[f"proba_{name}"]) for r in out.collect()} == want


def test_rows_of_a_fold_without_a_model_have_no_vote(rows):
    few = cut_lineage(rows.filter("label = 0").unionByName(rows.filter("label = 1").limit(1)))
    out = evaluate.out_of_fold(few, ["x", "z"], {"xgb": GBT}, 3)
    got = {r["fold"]: (r["least"], r["most"], r["scored"], r["n"]) for r in out.groupBy("fold").agg(
        F.min("pred_xgb").alias("least"), F.max("pred_xgb").alias("most"), F.count("proba_xgb").alias("scored"), F.count(F.lit(1)).alias("n")).collect()}
    assert sum(n for *_, n in got.values()) == few.count() and len(got) == 3
    assert [v[:3] for v in got.values() if v[0] == -1] == [(-1, -1, 0)]
    assert all(scored == n for least, _, scored, n in got.values() if least >= 0)


def test_pairs_work_a_column_out_once(spark, sf):
    pairs = process.pair_counts(views.labeled_events(spark, sf))
    assert plan(pairs).count("get_json_object") == 1
    assert pairs.filter("child = ''").count() == 0 < pairs.count()


def test_call_names_are_counted_in_the_same_shuffle(spark, sf):
    events = views.labeled_events(spark, sf)
    assert "Expand" not in plan(process.process_features(events)) and plan(process.process_features(events)).count("count(distinct") == 0
    assert dict(process.process_features(events).dtypes)["unique_syscalls"] == "bigint"


def test_whole_numbers_are_neither_nan_nor_infinite(spark):
    df = spark.createDataFrame([(1, 5, float("inf")), (None, None, float("nan")), (-3, 2**62, None)], "a int, b bigint, c double")
    out = clean.impute(df, ["a", "b", "c"])
    assert plan(out).count("isnan") == 1
    assert [tuple(r) for r in out.collect()] == [(1.0, 5.0, 1.7976931348623157e308), (0.0, 0.0, 0.0), (-3.0, 2.0**62, 0.0)]
