"""Verdicts over result tables: operating curves, candidates, arms, stability, rank gaps, ablation tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import flag
from hostlens.operators.joins import join_lookup
from hostlens.operators.triage import to_label


def curve_summary(curves: DataFrame, reference_cap: float = S.MAX_FPR, by: tuple[str, ...] = ("dataset", "model")) -> DataFrame:
    """Best cap per curve, the score at the reference cap, and whether the reference holds.

    `curves` has max_fpr_cap, f1_mean, actual_fpr_mean, auroc_mean. Ties (to 9 digits) go to the smaller cap.
    """
    best = F.max(F.struct(F.round("f1_mean", 9).alias("key"), (-F.col("max_fpr_cap")).alias("neg_cap"), "f1_mean", "actual_fpr_mean", "auroc_mean"))
    near = F.min(F.struct(F.abs(F.col("max_fpr_cap") - reference_cap).alias("d"), "max_fpr_cap", "f1_mean"))
    out = curves.groupBy(*by).agg(best.alias("b"), near.alias("r"))
    gap = F.col("b.f1_mean") - F.col("r.f1_mean")
    verdict = F.when(F.col("b.auroc_mean") < 0.6, "not discriminative").when(gap < 0.01, "reference holds").otherwise("reference suboptimal")
    return out.select(
        *by, (-F.col("b.neg_cap")).alias("best_cap"), F.col("b.f1_mean").alias("best_f1_mean"), F.col("b.actual_fpr_mean").alias("best_actual_fpr_mean"),
        F.col("r.f1_mean").alias("f1_at_reference"), gap.alias("gap_vs_best_f1"), F.col("b.auroc_mean").alias("auroc_mean"), verdict.alias("verdict"))


def _arm(name: str, column: Column, arm: str) -> Column:
    return F.when(F.col(arm) == name, column)


def candidate_verdict(runs: DataFrame, production: str, candidate: str, arm: str = "arm", metric: str = "f1") -> DataFrame:
    """Is the candidate better by more than its noise? `runs` holds one row per (arm, repeat)."""
    aggs = []
    for name, tag in ((production, "production"), (candidate, "candidate")):
        v = _arm(name, F.col(metric), arm)
        aggs += [F.avg(v).alias(f"{tag}_mean"), F.stddev_samp(v).alias(f"{tag}_std")]
    out = runs.agg(*aggs).withColumn("delta", F.col("candidate_mean") - F.col("production_mean"))
    noise = F.sqrt(F.col("production_std") * F.col("production_std") + F.col("candidate_std") * F.col("candidate_std"))
    out = out.withColumn("signal_to_noise", F.when(noise > 0, F.abs("delta") / noise).otherwise(F.lit(float("inf"))))
    better = (F.col("delta") > 0.01) & (F.col("signal_to_noise") > 1.0)
    return out.withColumn("verdict", F.when(better, "candidate better").when(F.col("signal_to_noise") < 1.0, "no real difference").otherwise("candidate worse"))


def arm_verdict(runs: DataFrame, full: str, masked: str, flagged: str, arm: str = "arm", metric: str = "f1") -> DataFrame:
    """How much of what masking costs does the availability flag win back?"""
    means = runs.agg(*[F.avg(_arm(n, F.col(metric), arm)).alias(t) for n, t in ((full, "full_mean"), (masked, "masked_mean"), (flagged, "flagged_mean"))])
    gap, gain = F.col("full_mean") - F.col("masked_mean"), F.col("flagged_mean") - F.col("masked_mean")
    out = means.withColumns({"gap": gap, "recovered": F.when(F.abs(gap) > 1e-9, gain / gap)})
    helps = (gain > 0.01) & (F.col("recovered").isNull() | (F.col("recovered") > 0.3))
    return out.withColumn("verdict", F.when(helps, "flag helps").when(F.abs(gain) < 0.01, "flag does not help").otherwise("ambiguous"))


def transfer_stability(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and deviation per (train, test) pair, and how much F1 the move costs."""
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    out = runs.groupBy("train_dataset", "test_dataset").agg(*aggs)
    return out.withColumn("f1_drop", F.col("insample_f1_mean") - F.col("crossdataset_f1_mean"))


def domain_ranks(spark) -> DataFrame:
    return spark.createDataFrame([(f, i) for i, f in enumerate(S.DOMAIN_ORDER, start=1)], "feature string, domain_rank int")


def with_domain_rank(df: DataFrame) -> DataFrame:
    """Analyst rank of each feature, 99 where there is none."""
    ranked = df.join(F.broadcast(domain_ranks(df.sparkSession)), "feature", "left")
    return ranked.withColumn("domain_rank", F.coalesce("domain_rank", F.lit(99)))


def rank_gaps(importance: DataFrame, limit: int = 5) -> DataFrame:
    """Model rank against analyst rank; one row per feature, so one small window. Importances are ranked to 9 digits."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.round("importance", 9).desc(), "feature")
    out = with_domain_rank(importance).withColumn("model_rank", F.row_number().over(order))
    out = out.withColumn("rank_diff", F.abs(F.col("model_rank") - F.col("domain_rank")))
    return out.withColumn("discrepant", flag(F.col("rank_diff") > limit))


def significant_but_unimportant(tests: DataFrame, importance: DataFrame) -> DataFrame:
    """Features that differ between the classes yet rank in the lower half by importance."""
    half = importance.agg(F.percentile("importance", F.lit(0.5)).alias("m")).scalar()  # one row per feature
    low = importance.filter(F.col("importance") < half)
    return low.join(tests.filter("significant = 1").select("feature"), "feature", "left_semi")


def ablation_tags(ablation: DataFrame, step: float = 0.005) -> DataFrame:
    """delta = score without the feature - score with all; a clear loss makes it important."""
    d = F.col("delta_f1")
    return ablation.withColumn("tag", F.when(d < -step, "important").when(d > step, "hurts").otherwise("neutral"))


def condition_summary(decisions: DataFrame, truth: DataFrame, by: str = "condition", key: str = "row_id") -> DataFrame:
    """Accuracy and agreement per condition; labels come in any spelling and keys in any padding."""
    usable = decisions.filter(F.col("parse_status").isin("ok", "repaired"))
    clean_key = F.trim(F.col(key).cast("string"))
    facts = truth.select(clean_key.alias("_k"), to_label(F.col("true_label")).alias("_y")).filter(F.col("_k").isNotNull())
    keyed = usable.withColumn("_k", clean_key)
    joined = join_lookup(keyed, facts, ["_k"])
    d, m, y = to_label(F.col("decision")), to_label(F.col("model_vote")), F.col("_y")
    # a missing side never counts as equal
    same = lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(y) > 0, F.avg(same(d, y))).alias("accuracy"),
        F.avg(same(d, m)).alias("agreement"),
    )


def compare_repeats(runs: DataFrame, production: str, augmented: str, repeats: list[int], arm: str = "arm", metrics: tuple[str, ...] = ("f1", "fpr")) -> DataFrame:
    """Both arms side by side for chosen repeats."""
    chosen = runs.filter(F.col("repeat").isin(repeats))
    aggs = []
    for m in metrics:
        aggs += [F.max(_arm(production, F.col(m), arm)).alias(f"{m}_production"), F.max(_arm(augmented, F.col(m), arm)).alias(f"{m}_augmented")]
    out = chosen.groupBy("repeat").agg(*aggs)
    return out.withColumns({f"{m}_delta": F.col(f"{m}_augmented") - F.col(f"{m}_production") for m in metrics})


