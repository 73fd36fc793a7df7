"""Detector scores: confusion counts, rates, ranking quality, thresholds, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.columns import div, flag
from hostlens.operators.cumulative import PART, prefix_sums

DEFAULT_CUT = 0.5


def outcome(label: str, pred: str | Column) -> Column:
    y, p = F.col(label) == 1, (F.col(pred) if isinstance(pred, str) else pred) == 1
    return F.when(y & p, "TP").when(y & ~p, "FN").when(~y & p, "FP").otherwise("TN")


def with_outcomes(df: DataFrame, models: list[str], label: str = "true_label") -> DataFrame:
    cols = {}
    for m in models:
        cols[f"correct_{m}"] = (F.col(f"pred_{m}") == F.col(label)).cast("int")
        cols[f"errtype_{m}"] = outcome(label, f"pred_{m}")
    return df.withColumns(cols)


def confusion_counts(label: str, pred: str | Column) -> list[Column]:
    p = F.col(pred) if isinstance(pred, str) else pred
    y = F.col(label)
    return [
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    ]


def confusion(df: DataFrame, by: list[str], label: str, pred: str | Column) -> DataFrame:
    return df.groupBy(*by).agg(*confusion_counts(label, pred)) if by else df.agg(*confusion_counts(label, pred))


def rates(tp: Column, fp: Column, fn: Column, tn: Column, zero: float | None = 0.0) -> dict[str, Column]:
    """Rates from confusion counts; a zero denominator gives `zero` (None leaves it NULL)."""
    return {
        "precision": div(tp, tp + fp, zero), "recall": div(tp, tp + fn, zero), "f1": div(2 * tp, 2 * tp + fp + fn, zero),
        "fpr": div(fp, fp + tn, zero), "fnr": div(fn, tp + fn, zero), "accuracy": div(tp + tn, tp + tn + fp + fn, zero),
    }


def score_counts(counts: DataFrame, zero: float | None = 0.0) -> DataFrame:
    c = F.col
    out = rates(c("tp"), c("fp"), c("fn"), c("tn"), zero)
    return counts.withColumns({**out, "n_total": c("tp") + c("fp") + c("fn") + c("tn")})


def score(df: DataFrame, by: list[str], label: str, pred: str | Column) -> DataFrame:
    return score_counts(confusion(df, by, label, pred))


def score_axis(df: DataFrame, by: list[str], label: str, proba: str) -> DataFrame:
    """(by, score, pos, neg): positives and negatives per distinct score."""
    y = F.col(label)
    return df.filter(F.col(proba).isNotNull()).groupBy(*by, F.col(proba).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))


def auroc(df: DataFrame, by: list[str], label: str, proba: str) -> DataFrame:
    """Probability that a positive outranks a negative, ties half; NULL when a class is missing."""
    axis = prefix_sums(score_axis(df, by, label, proba), by, "score", ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    aggs = [won.alias("_won"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")]
    sums = axis.groupBy(*by).agg(*aggs) if by else axis.agg(*aggs)
    return sums.select(*by, div(F.col("_won"), F.col("_p").cast("double") * F.col("_n")).alias("auroc"))


def operating_points(axis: DataFrame, by: list[str]) -> DataFrame:
    """`axis` is (by, score, pos, neg). One row per score t with the counts and rates of the rule score >= t."""
    axis = prefix_sums(axis, by, "score", ["pos", "neg"]).withColumn(PART, F.struct(*by) if by else F.struct(F.lit(0).alias("all")))
    totals = axis.groupBy(PART).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    pts = axis.join(totals, PART).withColumns({
        "tp": F.col("n_pos") - F.col("pos_below"), "fp": F.col("n_neg") - F.col("neg_below"),
    })
    r = rates(F.col("tp"), F.col("fp"), F.col("n_pos") - F.col("tp"), F.col("n_neg") - F.col("fp"))
    return pts.select(*by, "score", "n_pos", "n_neg", "tp", "fp", r["precision"].alias("precision"), r["recall"].alias("recall"),
                      r["f1"].alias("f1"), r["fpr"].alias("fpr"))


def pick_thresholds(points: DataFrame, by: list[str], caps: list[float | None]) -> DataFrame:
    """F1-best cutoff under each false-positive cap, from one pass over the operating points.

    Among scores whose FPR meets the cap the highest F1 wins, then the highest score; if none meets it, the
    lowest FPR, which is the highest score. With one class only the cutoff is 0.5. Cutoffs are whole tie
    blocks, since `score >= t` cannot split equal scores.
    """
    fields = ["f1", "score", "precision", "recall", "fpr"]
    aggs = [F.max(F.struct("score", "f1", "precision", "recall", "fpr")).alias("_top"), F.max("n_pos").alias("_p"), F.max("n_neg").alias("_n")]
    for i, cap in enumerate(caps):
        allowed = F.lit(True) if cap is None else F.col("fpr") <= cap
        aggs.append(F.max(F.when(allowed, F.struct(*fields))).alias(f"_c{i}"))
    best = points.groupBy(*by).agg(*aggs) if by else points.agg(*aggs)
    two = (F.col("_p") > 0) & (F.col("_n") > 0)

    def pick(i: int, field: str) -> Column:
        return F.coalesce(F.col(f"_c{i}.{field}"), F.col(f"_top.{field}"))

    rows = [
        F.struct(
            F.lit(cap).cast("double").alias("max_fpr"),
            F.when(two, pick(i, "score")).otherwise(F.lit(DEFAULT_CUT)).alias("threshold"),
            *[F.when(two, pick(i, f)).alias(f) for f in ("f1", "precision", "recall", "fpr")],
        )
        for i, cap in enumerate(caps)
    ]
    return best.select(*by, F.inline(F.array(*rows)))


def best_thresholds(df: DataFrame, by: list[str], label: str, proba: str, caps: list[float | None]) -> DataFrame:
    return pick_thresholds(operating_points(score_axis(df, by, label, proba), by), by, caps)


def fold_thresholds(df: DataFrame, label: str, proba: str, caps: list[float | None], folds: int, fold: str = "fold") -> DataFrame:
    """Cutoff for each fold from the rows of all other folds.

    Scores are counted per fold first, so what is copied to the other folds is a score axis, not rows.
    """
    axis = score_axis(df, [fold], label, proba)
    others = F.array_remove(F.sequence(F.lit(0), F.lit(folds - 1)), F.col(fold))
    train = axis.select(F.explode(others).alias("_to"), "score", "pos", "neg").groupBy(F.col("_to").alias(fold), "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return pick_thresholds(operating_points(train, [fold]), [fold], caps)


def best_cut(df: DataFrame, label: str, proba: str, max_fpr: float | None) -> float:
    """The same as a number, for a model loop on the driver."""
    row = best_thresholds(df, [], label, proba, [max_fpr]).first()
    return DEFAULT_CUT if row is None or row["threshold"] is None else float(row["threshold"])


def summarize(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation over repeats or folds; undefined scores are left out."""
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def median_fold(df: DataFrame, by: list[str], metric: str = "auroc") -> DataFrame:
    """The fold whose score is closest to the median score; ties go to the lower fold."""
    med = df.groupBy(*by).agg(F.median(metric).alias("median"))  # one row per fold, a handful per run
    near = F.min(F.struct(F.abs(F.col(metric) - F.col("median")).alias("d"), "fold"))["fold"]
    return df.join(med, by).groupBy(*by).agg(near.alias("median_fold"), F.max("median").alias("median"))


def calibration_bins(df: DataFrame, by: list[str], confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, open to the left except the first."""
    bin_no = F.greatest(F.ceil(F.col(confidence) * bins), F.lit(1))
    return df.filter(F.col(confidence).isNotNull()).groupBy(*by, bin_no.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def calibration_error(df: DataFrame, by: list[str], confidence: str, correct: str, bins: int = 10) -> DataFrame:
    b = calibration_bins(df, by, confidence, correct, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")
    aggs = [F.sum("n").alias("n"), gap.alias("ece")]
    return b.groupBy(*by).agg(*aggs) if by else b.agg(*aggs)


def degenerate(label: str) -> Column:
    return flag(F.min(label) == F.max(label))
