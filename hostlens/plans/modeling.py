"""Queries that fit models on the process feature table. Learners differ from SQL, so these have no SQL twin.

Settings are small here, so that every fold of every model runs in seconds; production settings are the
defaults in `operators.models`. `second_order_cv` runs at production settings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import hash_fraction
from hostlens.operators import cascade, clean, errors, evaluate, metrics, models, summaries
from hostlens.operators.models import Detector
from hostlens.operators.network import Spec
from hostlens.operators.trees import Growth
from hostlens.plans import views as V
from hostlens.plans.catalogue import query
from hostlens.session import application_dir, cut_lineage

RF = Detector("rf", {"numTrees": 12, "maxDepth": 6})
GBT = Detector("gbt", {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3})
MLP = Detector("mlp", {"hidden": [16, 8], "maxIter": 15})
FOREST = Detector("iforest", {"trees": 60, "sample": 128})
FEATS = S.FEATURES
ABLATION = Growth(trees=12, depth=6)
BOOSTED = Growth(trees=400, depth=6, boosted=True, rate=0.05, row_share=0.8, node_features=0.8, min_child_weight=5.0)
NETWORK = Spec(epochs=12, steps=4, rate=0.01)
FOLDS = 3
ABLATION_FOLDS = 5
BOOSTED_REPEATS = 15


def prepared(spark, sf_dir):
    return V.stored(spark, sf_dir, "prepared", build_prepared)


def build_prepared(spark, sf_dir):
    """All processes, ready to fit: row id, group key, scaled features."""
    table = V.feature_table(spark, sf_dir)
    keyed = table.withColumn("row_id", F.concat_ws("_", "source", "scenario", "host", F.col("pid").cast("string")))
    return models.prepare(keyed, FEATS)


@query("rf_cv")
def rf_cv(spark, sf_dir):
    return evaluate.repeated_cv(prepared(spark, sf_dir), FEATS, RF, repeats=2, k=FOLDS)


@query("rf_cv_per_fold")
def rf_cv_per_fold(spark, sf_dir):
    return evaluate.fixed_cut_cv(prepared(spark, sf_dir), FEATS, RF, 1, FOLDS)


@query("gbt_cv")
def gbt_cv(spark, sf_dir):
    return evaluate.repeated_cv(prepared(spark, sf_dir), FEATS, GBT, repeats=1, k=FOLDS)


@query("mlp_cv")
def mlp_cv(spark, sf_dir):
    return evaluate.repeated_cv(prepared(spark, sf_dir), FEATS, MLP, repeats=1, k=FOLDS)


@query("iforest_cv")
def iforest_cv(spark, sf_dir):
    return evaluate.repeated_cv(prepared(spark, sf_dir), FEATS, FOREST, repeats=1, k=FOLDS)


@query("iforest_scores")
def iforest_scores(spark, sf_dir):
    """Novelty mode: fitted on benign processes, all processes scored."""
    rows = prepared(spark, sf_dir)
    fitted = Detector("iforest", {"trees": 60, "sample": 128, "novelty": True}).fit(rows, FEATS)
    return fitted.score(rows).select("row_id", "label", F.round("proba", 6).alias("proba"))


@query("oof_models")
def oof_models(spark, sf_dir):
    return evaluate.out_of_fold(prepared(spark, sf_dir), FEATS, {"xgb": GBT, "cnn": MLP}, FOLDS)


@query("model_cap_sweep")
def model_cap_sweep(spark, sf_dir):
    return evaluate.cap_sweep(prepared(spark, sf_dir), FEATS, RF, [0.01, 0.05, 0.1, 0.2, 1.0], 1, FOLDS)


@query("grid_sweep")
def grid_sweep(spark, sf_dir):
    return evaluate.grid_sweep(prepared(spark, sf_dir), FEATS, "rf", {"maxDepth": [3, 6], "numTrees": [4, 12]}, {}, 1, 2)


@query("candidate_models")
def candidate_models(spark, sf_dir):
    runs = evaluate.compare_configs(prepared(spark, sf_dir), FEATS, {"production": RF, "candidate": Detector("rf", {"numTrees": 6, "maxDepth": 3})}, 2, 2)
    return summaries.candidate_verdict(runs, "production", "candidate")


@query("head_to_head")
def head_to_head(spark, sf_dir):
    return evaluate.compare_configs(prepared(spark, sf_dir), FEATS, {"gbt": GBT, "mlp": MLP}, 1, 2)


def ablation_scores(spark, sf_dir):
    """Held-out scores of all feature sets, written once for every report over them."""
    build = lambda spark, sf_dir: evaluate.grown_together(prepared(spark, sf_dir), evaluate.ablation_sets(FEATS), FEATS, ABLATION, 1, ABLATION_FOLDS)
    return V.stored(spark, sf_dir, "ablation", build)


@query("feature_ablation")
def feature_ablation(spark, sf_dir):
    return evaluate.feature_ablation(evaluate.set_scores(ablation_scores(spark, sf_dir)), FEATS)


def _scored_facts(tests):
    return tests.groupBy("config", "repeat", "fold").agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_distinct("row_id").alias("n_rows"), F.sum(F.col("label").cast("bigint")).alias("n_scored_pos"),
        F.min(F.col("proba").between(0, 1).cast("int")).alias("in_range"))


@query("reduced_features")
def reduced_features(spark, sf_dir):
    summary = cut_lineage(evaluate.set_scores(ablation_scores(spark, sf_dir)))
    return evaluate.reduced_comparison(prepared(spark, sf_dir), FEATS, summary, ABLATION, 1, ABLATION_FOLDS)


@query("importance")
def importance(spark, sf_dir):
    return summaries.rank_gaps(evaluate.importances(prepared(spark, sf_dir), FEATS, RF, 1, FOLDS))


@query("unimportant_but_significant")
def unimportant_but_significant(spark, sf_dir):
    """Features that differ between classes yet carry little importance."""
    from hostlens.functions.columns import melt
    from hostlens.operators.profile import mann_whitney

    rows = prepared(spark, sf_dir)
    tests = mann_whitney(melt(rows.withColumn("label", F.col("label").cast("int")), ["label"], FEATS))
    ranks = cut_lineage(evaluate.importances(rows, FEATS, RF, 1, 2))
    marked = summaries.significant_but_unimportant(tests, ranks).withColumn("low_importance", F.lit(1))
    return tests.select("feature", "significant", F.round("z", 4).alias("z")).join(marked, "feature", "left")


@query("cascade_models")
def cascade_models(spark, sf_dir):
    """Boosted first stage, forest second stage: flat and weighted blend, and the mean miss rate over folds."""
    stages = evaluate.stage_scores(prepared(spark, sf_dir), FEATS, GBT, {"rf": RF}, 1, FOLDS)
    flat = evaluate.cascade_cv(stages, "rf", False).withColumn("variant", F.lit("flat"))
    weighted = evaluate.cascade_cv(stages, "rf", True).withColumn("variant", F.lit("weighted"))
    return metrics.summarize(flat.unionByName(weighted), ["variant"], ["f1", "auroc", "fpr", "fnr", "pct_routed", "avg_stage2_weight"])


@query("cascade_stage2_models")
def cascade_stage2_models(spark, sf_dir):
    """Two second stages over the same first stage and cutoffs."""
    stages = evaluate.stage_scores(prepared(spark, sf_dir), FEATS, GBT, {"rf": RF, "mlp": MLP}, 1, 2)
    return cascade.compare_variants({m: cascade.blend(stages, "proba_1", f"proba_{m}", weighted=True) for m in ("rf", "mlp")}, ["repeat", "fold"], "label")


@query("cascade_band_models")
def cascade_band_models(spark, sf_dir):
    """Band widths over stage scores computed once for the widest band."""
    stages = evaluate.stage_scores(prepared(spark, sf_dir), FEATS, GBT, {"rf": RF}, 1, 2, 0.1, 0.9)
    swept = cascade.band_sweep(stages, "proba_1", "proba_rf", [0.1, 0.2, 0.4], ["repeat", "fold"], "label")
    return metrics.summarize(swept, ["half_width"], ["f1", "auroc", "pct_routed"])


@query("cross_dataset")
def cross_dataset(spark, sf_dir):
    """Hosts h0-h2 and the rest as two datasets with the shared features only."""
    shared = [f for f in FEATS if f not in S.PARTIAL_FEATURES]
    rows = prepared(spark, sf_dir).drop("vector")
    keyed = models.vector_key(rows, shared)
    near = F.col("host").isin("h0", "h1", "h2")
    return evaluate.cross_dataset({"a": keyed.filter(near), "b": keyed.filter(~near)}, shared, RF, 1, recalibrate=0.1)


@query("augmented_cv")
def augmented_cv(spark, sf_dir):
    """Forest with and without per-name z-scores on the same folds."""
    ready = evaluate.assign_folds(prepared(spark, sf_dir), 2, S.CV_SEED, 1)
    arms = {"baseline": None, "augmented": evaluate.relative_augment(["events_per_second", "seq_length"])}
    return evaluate.union([evaluate.repeated_cv(ready, FEATS, RF, 1, 2, augment=extra, folds_ready=True).withColumn("arm", F.lit(arm)) for arm, extra in arms.items()])


@query("augmented_misses")
def augmented_misses(spark, sf_dir):
    """Attacks lost by the augmented forest, with the training support of their process name."""
    rows = evaluate.assign_folds(prepared(spark, sf_dir), 2, S.CV_SEED, 1)
    votes = {}
    for name, extra in (("baseline", None), ("augmented", evaluate.relative_augment(["events_per_second", "seq_length"]))):
        tests, cutoffs, _ = evaluate.cross_validate(rows, FEATS, RF, 1, 2, augment=extra, folds_ready=True)
        votes[name] = evaluate.decide(tests, cutoffs).select("row_id", "fold", "label", F.col("pred").alias(name))
    both = votes["baseline"].join(votes["augmented"].select("row_id", "augmented"), "row_id")
    named = both.join(rows.select("row_id", "proc_name"), "row_id")
    lost = errors.newly_missed(named, "baseline", "augmented", "label").select("row_id", "fold", "proc_name")
    return errors.explain_misses(lost, rows.withColumnRenamed("fold_0", "fold"), ["row_id"])


@query("missingness_cv")
def missingness_cv(spark, sf_dir):
    hidden = ["parent_child_rarity", "is_suid_exec"]
    runs = evaluate.missingness_cv(prepared(spark, sf_dir), FEATS, hidden, hash_fraction(S.CV_SEED, "row_id") < 0.5, RF, 1, 2)
    return metrics.summarize(runs, ["arm"], ["f1", "auroc", "fpr"])


def _facts_sql(repeats: int, k: int, seed: int) -> str:
    """Per repeat and fold, what SQL can know about a run: rows, positives, and that each row is scored once."""
    vector = "md5(concat_ws('|', " + ", ".join(_vector_part(f) for f in FEATS) + "))"
    shift = "('0x' || substr(md5(concat_ws('|', ({seed} + r.repeat)::VARCHAR, major::VARCHAR, (turn // {k})::VARCHAR)), 1, 8))::BIGINT"
    return V.sql(V.FEATURES, f""", vec AS (SELECT label, {vector} AS vector FROM features
), groups AS (SELECT vector, count(*) AS n, sum(label) AS n1 FROM vec GROUP BY vector
), turns AS (SELECT vector, CAST(n1 * 2 > n AS INT) AS major, row_number() OVER (PARTITION BY n1 * 2 > n ORDER BY n DESC, md5(concat_ws('|', '{seed}', vector))) - 1 AS turn FROM groups
), folds AS (SELECT v.label, r.repeat, CAST((turn + {shift.format(seed=seed, k=k)}) % {k} AS INT) AS fold FROM vec v JOIN turns USING (vector), (SELECT unnest(range({repeats}))::INT AS repeat) r)
SELECT repeat, fold, count(*) AS n, sum(label)::BIGINT AS n_pos, 0 AS degenerate, count(*) AS n_scored, count(*) AS n_rows, sum(label)::BIGINT AS n_scored_pos, 1 AS in_range
FROM folds GROUP BY repeat, fold""")


def _vector_part(f: str) -> str:
    exact = f in ("lifetime_seconds", "events_per_second", "max_uid_euid_delta", "failed_call_rate", "parent_child_rarity")
    return f"coalesce({f}::DECIMAL(38,4)::VARCHAR, 'NA')" if exact else f"coalesce({f}::VARCHAR, 'NA')"


def _facts(spark, sf_dir, detector, repeats, k):
    ready = evaluate.assign_folds(prepared(spark, sf_dir), k, S.CV_SEED, repeats)
    tests, _, _ = evaluate.cross_validate(ready, FEATS, detector, repeats, k, folds_ready=True)
    seen = tests.groupBy("repeat", "fold").agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_distinct("row_id").alias("n_rows"), F.sum(F.col("label").cast("bigint")).alias("n_scored_pos"),
        F.min(F.col("proba").between(0, 1).cast("int")).alias("in_range"))
    return evaluate.fold_facts(ready, repeats, k).join(seen, ["repeat", "fold"])


_SIDES = """, s AS (SELECT host IN ('h0', 'h1', 'h2') AS near, label FROM features), n AS (SELECT count(*) FILTER (near) AS n_source, count(*) FILTER (NOT near) AS n_target,
  sum(label) FILTER (near)::BIGINT AS source_pos, sum(label) FILTER (NOT near)::BIGINT AS target_pos FROM s)"""


def missingness_arms(spark, sf_dir):
    """Two datasets, the second without the partial features: shared features only, and all with a flag for real values."""
    rows = prepared(spark, sf_dir).drop("vector")
    near = F.col("host").isin("h0", "h1", "h2")
    shared = [f for f in FEATS if f not in S.PARTIAL_FEATURES]
    keyed = models.vector_key(rows, shared)  # groups follow the real features in both arms
    has, lacks = keyed.filter(near), keyed.filter(~near).drop(*S.PARTIAL_FEATURES)
    flagged = {"a": clean.with_availability(has, FEATS, True), "b": clean.with_availability(lacks, FEATS, False)}
    return {"shared": ({"a": has, "b": lacks}, shared), "unified": (flagged, [*FEATS, "features_available"])}


@query("missingness_transfer")
def missingness_transfer(spark, sf_dir):
    """Does a flag for missing features transfer better than the shared features? Both ways, with a recalibrated cutoff."""
    outs = [evaluate.cross_dataset(data, cols, RF, 1, recalibrate=0.1).withColumn("arm", F.lit(arm)) for arm, (data, cols) in missingness_arms(spark, sf_dir).items()]
    return evaluate.union(outs)


@query("missingness_rows", V.sql(V.FEATURES + _SIDES, """SELECT arm, n_source, n_target, source_pos, target_pos, CASE arm WHEN 'shared' THEN 0 ELSE n_source END AS source_flagged, 0::BIGINT AS target_flagged
FROM n, (VALUES ('shared'), ('unified')) t(arm)"""))
def missingness_rows(spark, sf_dir):
    """What the two arms are made of: rows and positives of both sides, and rows flagged as having all features."""
    outs = []
    for arm, (data, cols) in missingness_arms(spark, sf_dir).items():
        flagged = F.sum("features_available").cast("bigint") if "features_available" in cols else F.lit(0).cast("bigint")
        side = {k: d.agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("p"), flagged.alias("f")).select(F.struct("n", "p", "f")).scalar() for k, d in data.items()}
        outs.append(spark.range(1).select(
            F.lit(arm).alias("arm"), side["a"]["n"].alias("n_source"), side["b"]["n"].alias("n_target"), side["a"]["p"].alias("source_pos"), side["b"]["p"].alias("target_pos"),
            side["a"]["f"].alias("source_flagged"), side["b"]["f"].alias("target_flagged")))
    return evaluate.union(outs)


@query("rf_cv_facts", _facts_sql(2, FOLDS, S.CV_SEED))
def rf_cv_facts(spark, sf_dir):
    """Every row of every fold is scored exactly once, by a model that saw both classes."""
    return _facts(spark, sf_dir, RF, 2, FOLDS)


@query("gbt_cv_facts", _facts_sql(1, FOLDS, S.CV_SEED))
def gbt_cv_facts(spark, sf_dir):
    return _facts(spark, sf_dir, GBT, 1, FOLDS)


def _set_facts_sql(configs: int) -> str:
    facts = _facts_sql(1, ABLATION_FOLDS, S.CV_SEED)
    return f"SELECT config::INT AS config, repeat, fold, n_scored, n_rows, n_scored_pos, in_range FROM ({facts}) f, range({configs}) c(config)"


@query("ablation_facts", _set_facts_sql(len(FEATS) + 1))
def ablation_facts(spark, sf_dir):
    """Every row of every fold is scored exactly once by the model of each feature set."""
    return _scored_facts(ablation_scores(spark, sf_dir))


def boosted_scores(spark, sf_dir, repeats):
    """Held-out scores of the production booster; a repeat's do not depend on how many others there are."""
    build = lambda spark, sf_dir: evaluate.grown_together(prepared(spark, sf_dir), {0: FEATS}, FEATS, BOOSTED, repeats, ABLATION_FOLDS)
    return V.stored(spark, sf_dir, f"boosted-{repeats}", build)


@query("second_order_cv")
def second_order_cv(spark, sf_dir):
    """Boosting with second-order gain, L2, minimum child weight, row and column sampling and weighted positives: production rounds, repeats and folds."""
    return evaluate.set_scores(boosted_scores(spark, sf_dir, BOOSTED_REPEATS))


@query("second_order_facts", _set_facts_sql(1))
def second_order_facts(spark, sf_dir):
    return _scored_facts(boosted_scores(spark, sf_dir, 1))


def network_scores(spark, sf_dir, part):
    """Test scores and cutoff scores of the weighted networks; both are written by one training."""
    def build(spark, sf_dir):
        tests, cutoffs = evaluate.trained_together(prepared(spark, sf_dir), FEATS, NETWORK, 1, ABLATION_FOLDS)
        return tests.withColumn("part", F.lit("test")).unionByName(cutoffs.withColumn("part", F.lit("cutoff")))

    return V.stored(spark, sf_dir, "network", build).filter(F.col("part") == part).drop("part")


@query("weighted_network_cv")
def weighted_network_cv(spark, sf_dir):
    """Dense networks with class weights, batch norm, dropout and early stopping, cutoffs from held-out groups."""
    decided = evaluate.decide(network_scores(spark, sf_dir, "test"), network_scores(spark, sf_dir, "cutoff"))
    return evaluate.scores(decided, ["repeat"])


@query("weighted_network_facts", _set_facts_sql(1))
def weighted_network_facts(spark, sf_dir):
    return _scored_facts(network_scores(spark, sf_dir, "test"))


@query("model_roundtrip", V.sql(V.FEATURES, "SELECT model, count(*) AS n_rows, 0.0::DOUBLE AS max_difference FROM features, (VALUES ('rf'), ('gbt'), ('mlp'), ('iforest')) m(model) GROUP BY model"))
def model_roundtrip(spark, sf_dir):
    """Models fitted on everything, saved, loaded and compared with the ones in memory."""
    rows = prepared(spark, sf_dir)
    folder = application_dir(spark)
    outs = []
    for det in (RF, GBT, MLP, FOREST):
        fitted = det.fit(rows, FEATS)
        path = f"{folder}/model-{det.kind}-{abs(hash(sf_dir)) % 10**8}"
        fitted.save(path)
        again = models.load_detector(spark, path, det.kind, FEATS).score(rows).select("row_id", F.col("proba").alias("again"))
        both = fitted.score(rows).select("row_id", "proba").join(again, "row_id")
        outs.append(both.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.max(F.abs(F.col("proba") - F.col("again"))), 9).alias("max_difference")).withColumn("model", F.lit(det.kind)))
    return evaluate.union(outs)
