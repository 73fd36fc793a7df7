"""Two-stage detectors: a second score is blended in where the first one is unsure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.operators.joins import join_lookup
from hostlens.operators.metrics import auroc, confusion_counts, rates


def in_band(p: Column, low: float | Column = S.BAND_LOW, high: float | Column = S.BAND_HIGH) -> Column:
    return p.between(low, high)


def band_weight(p: Column, low: float | Column, high: float | Column) -> Column:
    """1 at the centre of the band, falling to 0 at its edges."""
    center, half = (F.lit(high) + F.lit(low)) / 2, (F.lit(high) - F.lit(low)) / 2
    return F.least(F.greatest(1 - F.abs(p - center) / half, F.lit(0.0)), F.lit(1.0))


def blend(df: DataFrame, first: str, second: str, low: float | Column = S.BAND_LOW, high: float | Column = S.BAND_HIGH,
          weighted: bool = False) -> DataFrame:
    """Adds `routed`, `stage2_weight` and `final`; rows outside the band keep the first score."""
    p1, p2 = F.col(first), F.col(second)
    routed = in_band(p1, low, high)
    w = band_weight(p1, low, high) if weighted else F.lit(0.5)
    return df.withColumns({
        "routed": routed.cast("int"),
        "stage2_weight": F.when(routed, w),
        "final": F.when(routed, (1 - w) * p1 + w * p2).otherwise(p1),
    })


def score_folds(df: DataFrame, by: list[str], label: str = "true_label", final: str = "final", cut: str = "threshold") -> DataFrame:
    """Scores per (by): rates at the cutoff column, ranking quality, routing share and mean weight.

    A part with one class keeps a flagged row whose scores are NULL.
    """
    pred = (F.col(final) >= F.col(cut)).cast("int")
    aggs = [
        *confusion_counts(label, pred), (100 * F.avg("routed")).alias("pct_routed"),
        F.coalesce(F.avg("stage2_weight"), F.lit(0.0)).alias("avg_stage2_weight"), F.max(cut).alias("threshold"),
    ]
    c = F.col
    counts = df.groupBy(*by).agg(*aggs)
    one_class = (c("tp") + c("fn") == 0) | (c("fp") + c("tn") == 0)
    r = rates(c("tp"), c("fp"), c("fn"), c("tn"))
    known = {m: F.when(~one_class, r[m]) for m in ("f1", "precision", "recall", "fpr", "fnr")}
    out = counts.withColumns({**known, "degenerate": one_class.cast("int"), "n_total": c("tp") + c("fp") + c("fn") + c("tn")})
    ranking = auroc(df, by, label, final)
    return out.join(F.broadcast(ranking), by).drop("tp", "fp", "fn", "tn")


def with_cut(df: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    return join_lookup(df, cuts.select(*by, "threshold"), by)


def band_sweep(df: DataFrame, first: str, second: str, half_widths: list[float], by: list[str], label: str = "true_label",
               weighted: bool = True) -> DataFrame:
    """Scores for bands of several widths around 0.5. The stage scores are computed once; each row is repeated per width."""
    wide = df.withColumn("half_width", F.explode(F.array(*[F.lit(float(h)) for h in half_widths])))
    low, high = F.lit(0.5) - F.col("half_width"), F.lit(0.5) + F.col("half_width")
    return score_folds(blend(wide, first, second, low, high, weighted), ["half_width", *by], label)


def compare_variants(variants: dict[str, DataFrame], by: list[str], label: str = "true_label") -> DataFrame:
    """Paired comparison: the same rows and cutoffs scored under several blended columns."""
    out = None
    for name, part in variants.items():
        scored = score_folds(part, by, label).withColumn("variant", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return out
