"""Sources, sinks, registry and model jobs end to end."""

import pytest
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.operators import clean, cumulative, evaluate, models, sequence, triage
from hostlens.operators.models import Detector
from hostlens.session import cut_lineage, ensure_checkpoint_dir
from hostlens.sources import tables


def test_registry_and_exclusions(spark, tmp_path):
    schema = S.feature_schema(["seq_length", "exec_count"], "is_privesc")
    rows = [(1, 2, 1, "s", "T1", "p"), (3, 4, 0, "s", "T1", "p"), (5, 6, 1, "s", None, "p"), (7, 8, 1, "s", "T2", "p")]
    path = str(tmp_path / "b.csv")
    tables.write_table(spark.createDataFrame(rows, schema), path, "csv")
    reg = tables.Registry({"b": tables.Dataset(path, label="is_privesc", exclude=("T1",), features=("seq_length", "exec_count"))})
    df, feats = reg.ingest(spark, "b")
    assert feats == ["seq_length", "exec_count"] and "label" in df.columns
    assert sorted(r["seq_length"] for r in df.collect()) == [3, 5, 7]  # benign and unnamed rows stay
    with pytest.raises(KeyError):
        reg.ingest(spark, "zzz")
    with pytest.raises(ValueError):
        tables.read_table(spark, path)


def test_feature_policies():
    assert clean.select_features(["a", "b"], ["b"]) == ["a", "b"]
    assert clean.select_features(["a", "b"], ["b"], "reduced") == ["a"]
    for bad in ((["a"], ["a"], "reduced"), (["a"], [], "other")):
        with pytest.raises(ValueError):
            clean.select_features(*bad)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_id bigint, v string")
    out = str(tmp_path / "done")
    tables.append_new(spark, df, out, ["row_id"])
    tables.append_new(spark, df.unionByName(spark.createDataFrame([(3, "c")], df.schema)), out, ["row_id"])
    assert sorted(r["row_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    calls = []

    def build():
        calls.append(1)
        return df

    cache = str(tmp_path / "cache")
    assert tables.reuse_or_build(spark, cache, build).count() == tables.reuse_or_build(spark, cache, build).count() == 2
    assert len(calls) == 1
    tables.write_json(df, str(tmp_path / "j"))
    assert tables.read_table(spark, str(tmp_path / "j"), df.schema, "json").count() == 2
    part = str(tmp_path / "p")
    tables.write_table(df, part, partition_by=["v"])
    assert spark.read.parquet(part).filter("v = 'b'").first()["row_id"] == 2
    s = tables.summary_rows(spark.createDataFrame([("m", 1.0, 2.0)], "model string, f1 double, fpr double"), ["model"], ["f1", "fpr"])
    assert sorted(map(tuple, s.collect())) == [("m", "f1", 1.0), ("m", "fpr", 2.0)]


def test_results_are_built_anew_when_an_input_changes(spark, tmp_path):
    """One changed file among others, another parameter, a build that was stopped; nothing else leads to a rebuild."""
    source, cache, calls = str(tmp_path / "source"), str(tmp_path / "cache"), []
    spark.range(10).repartition(3).write.parquet(source)

    def run(parameters=None, fail=False):
        def build():
            calls.append(1)
            df = spark.read.parquet(source).selectExpr("sum(id) AS total")
            return df.select(F.raise_error(F.lit("stopped")).cast("bigint").alias("total")) if fail else df

        return tables.reuse_or_build(spark, cache, build, [source], parameters).first()["total"]

    assert (run(), run(), len(calls)) == (45, 45, 1)
    spark.range(10, 11).write.mode("append").parquet(source)
    assert (run(), run(), len(calls)) == (55, 55, 2)
    assert (run({"k": 1}), run({"k": 1}), len(calls)) == (55, 55, 3)
    with pytest.raises(Exception, match="stopped"):
        run({"k": 2}, fail=True)
    assert (run({"k": 1}), len(calls)) == (55, 5)


def test_names_of_one_count_are_ranked_in_many_tasks(spark):
    """100,000 names seen once that share their first letters, and some frequent ones: same ids as a plain sort, no task with all."""
    rare = spark.range(100_000).select(F.format_string("aa%06d", "id").alias("syscall_name"))
    often = spark.createDataFrame([("zz",)] * 3 + [("b",)] * 3 + [("c",)] * 2 + [(None,)] * 5, "syscall_name string")
    got = sequence.build_vocabulary(rare.unionByName(often).repartition(6))
    ids = {r["syscall_name"]: r["id"] for r in got.collect()}
    assert ids == {n: i + 2 for i, n in enumerate(["b", "zz", "c", *[f"aa{i:06d}" for i in range(100_000)]])}
    placed = cumulative.ranked(rare, [F.col("syscall_name")], "place").groupBy(F.floor((F.col("place") - 1) / 25_000)).count()
    assert placed.count() == 4
    assert sequence.build_vocabulary(often.limit(0)).collect() == []


def test_sweep_files(spark, tmp_path):
    for m in ("rf", "gbt"):
        (tmp_path / f"wide_{m}_operating_curve.csv").write_text("max_fpr_cap,f1_mean\n0.05,0.8\n")
    got = tables.read_sweeps(spark, f"{tmp_path}/*_operating_curve.csv", "max_fpr_cap double, f1_mean double")
    assert sorted((r["dataset"], r["model"], r["f1_mean"]) for r in got.collect()) == [("wide", "gbt", 0.8), ("wide", "rf", 0.8)]


def test_checkpoint_folder_is_honoured(spark):
    folder = ensure_checkpoint_dir(spark)
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and any(folder.split(":")[-1] in f for f in df.inputFiles())


@pytest.fixture(scope="module")
def planted(spark):
    """1,500 rows, the label follows x with noise; each row occurs twice."""
    base = spark.range(750).select(
        F.col("id"), (F.md5(F.col("id").cast("string"))).alias("h")).select(
        "id", (F.conv(F.substring("h", 1, 6), 16, 10).cast("double") / 16777216).alias("x"), (F.conv(F.substring("h", 7, 6), 16, 10).cast("double") / 16777216).alias("z"))
    rows = base.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat_ws("-", "id", "copy").alias("row_id"), "x", "z", (F.col("x") + F.col("z") * 0.3 > 0.75).cast("int").alias("label"),
        F.lit("T1").alias("technique"), F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("proc_name"))
    return cut_lineage(models.prepare(rows, ["x", "z"]))


SMALL = {
    "rf": Detector("rf", {"numTrees": 8, "maxDepth": 4}), "gbt": Detector("gbt", {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3}),
    "mlp": Detector("mlp", {"hidden": [6], "maxIter": 20}),
}


@pytest.mark.parametrize("kind", sorted(SMALL))
def test_models_learn_a_planted_signal(planted, kind):
    tests, cutoffs, _ = evaluate.cross_validate(planted, ["x", "z"], SMALL[kind], 1, 2)
    assert tests.count() == planted.count() and tests.select("row_id").distinct().count() == planted.count()
    s = evaluate.scores(evaluate.decide(tests, cutoffs), ["repeat"]).first()
    assert s["auroc"] > 0.9 and s["f1"] > 0.5 and s["n_total"] == 1500


def test_out_of_fold_feeds_triage(planted):
    oof = evaluate.out_of_fold(planted, ["x", "z"], {"xgb": SMALL["gbt"], "cnn": SMALL["mlp"]}, 2)
    assert oof.count() == 1500 and oof.filter("pred_xgb < 0 or pred_cnn < 0").count() == 0
    cases = triage.triage_cases(oof, 10)
    assert cases.count() <= 10


def test_relative_features_use_training_rows_only(planted):
    train, test = planted.filter("x < 0.5"), planted.filter("x >= 0.5")
    got = clean.relative_z(train, test, ["z"], ["row_id"]).agg(F.avg("z_relz").alias("m"), F.count("z_relz").alias("n")).first()
    assert got["n"] == test.count() and abs(got["m"]) < 0.5
    few = clean.relative_z(train, test, ["z"], ["row_id"], min_support=10**6).select("row_id", "z", "z_relz")
    g = train.agg(F.avg("z"), F.stddev_samp("z")).first()
    r = few.first()
    assert r["z_relz"] == pytest.approx((r["z"] - g[0]) / g[1])


def test_upsampling_drops_nothing(planted):
    up = models.upsample_minority(planted)
    n = {r["label"]: r["count"] for r in up.groupBy("label").count().collect()}
    assert abs(n[0.0] - n[1.0]) < 0.1 * max(n.values())
    assert up.select("row_id").distinct().count() == 1500


def test_rows_only_queries_are_registered():
    import __spark_entry__ as entry

    plain = set(entry.queries()) - set(entry.oracle_sql())
    assert {"rf_cv", "gbt_cv", "mlp_cv", "iforest_scores", "cross_dataset", "cascade_models"} <= plain
