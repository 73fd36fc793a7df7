"""Per-feature profiles of two classes or two datasets, always from one melted, pre-aggregated table."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.functions.columns import div, flag
from hostlens.operators.cumulative import prefix_sums, value_counts, wide_quantiles
from hostlens.operators.joins import join_groups
from hostlens.session import cut_lineage

MIN_PER_SIDE = 5


def _side(cond: Column, x: Column | str) -> Column:
    return F.when(cond, F.col(x) if isinstance(x, str) else x)


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rate", F.col("n") / counts.agg(F.sum("n").alias("t")).scalar())


def class_by_source(df: DataFrame, source: str = "source", label: str = "label") -> DataFrame:
    return df.groupBy(source).agg(F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("attack"))


def top_techniques(df: DataFrame, k: int = 10, technique: str = "technique", label: str = "label") -> DataFrame:
    counts = df.filter(F.col(label) == 1).groupBy(technique).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), technique).limit(k)


def class_moments(melted: DataFrame, label: str = "label") -> DataFrame:
    """n, mean and sample variance of every feature in each class, in one aggregate."""
    benign, attack = F.col(label) == 0, F.col(label) == 1
    aggs = []
    for name, cond in (("benign", benign), ("attack", attack)):
        v = _side(cond, "value")
        aggs += [F.count(v).alias(f"{name}_n"), F.avg(v).alias(f"{name}_mean"), F.var_samp(v).alias(f"{name}_variance")]
    return melted.groupBy("feature").agg(*aggs)


def enough(df: DataFrame, a: str = "benign_n", b: str = "attack_n") -> DataFrame:
    return df.filter((F.col(a) >= MIN_PER_SIDE) & (F.col(b) >= MIN_PER_SIDE))


def class_medians(melted: DataFrame, label: str = "label") -> DataFrame:
    med = wide_quantiles(value_counts(melted, ["feature", label], "value"), ["feature", label], "value", {"median": 50})
    return med.groupBy("feature").agg(
        F.max(_side(F.col(label) == 0, "median")).alias("benign_median"), F.max(_side(F.col(label) == 1, "median")).alias("attack_median")
    )


def feature_profile(melted: DataFrame, label: str = "label") -> DataFrame:
    out = enough(class_moments(melted, label)).join(F.broadcast(class_medians(melted, label)), "feature")
    ratio = F.when(F.col("benign_mean") > 0.0001, F.col("attack_mean") / F.col("benign_mean"))
    return out.withColumn("mean_ratio", ratio)


def cohens_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.when(pooled == 0, F.lit(0.0)).otherwise((m1 - m2) / pooled)


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size >= 0.8, "large").when(size >= 0.5, "medium").when(size >= 0.2, "small").otherwise("negligible")


def effect_sizes(melted: DataFrame, label: str = "label") -> DataFrame:
    m = enough(class_moments(melted, label))
    c = F.col
    d = cohens_d(c("attack_n"), c("attack_mean"), c("attack_variance"), c("benign_n"), c("benign_mean"), c("benign_variance"))
    return m.select("feature", d.alias("cohens_d"), effect_label(d).alias("effect_size"))


def two_sided_counts(melted: DataFrame, is_first: Column) -> DataFrame:
    """(feature, value, n_a, n_b): rows per distinct value on each side."""
    return melted.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count_if(is_first).alias("n_a"), F.count_if(~is_first).alias("n_b")
    )


@F.pandas_udf(T.DoubleType())
def _two_sided_normal(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else min(1.0, math.erfc(v / math.sqrt(2.0))))


def mann_whitney(melted: DataFrame, label: str = "label") -> DataFrame:
    """U of the attack class, its share of n1*n2, z with tie and continuity correction, two-sided p."""
    axis = prefix_sums(two_sided_counts(melted, F.col(label) == 1), ["feature"], "value", ["n_b"])
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    t = a + b
    sums = axis.groupBy("feature").agg(
        F.sum("n_a").alias("n1"), F.sum("n_b").alias("n2"), F.sum(a * (F.col("n_b_below") + b / 2)).alias("u"), F.sum(t * t * t - t).alias("ties"),
    )
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    pairs = n1.cast("double") * n2
    spread = F.sqrt(pairs / 12 * ((n + 1) - F.col("ties") / (n.cast("double") * (n - 1))))
    # 0 where all values are equal
    z = F.when(spread > 0, (F.greatest(F.col("u"), pairs - F.col("u")) - pairs / 2 - 0.5) / spread).otherwise(F.lit(0.0))
    out = sums.filter((n1 >= MIN_PER_SIDE) & (n2 >= MIN_PER_SIDE)).select(
        "feature", F.col("u").alias("u_statistic"), (F.col("u") / pairs).alias("u_share"), z.alias("z"))
    return out.withColumn("p_value", _two_sided_normal("z")).withColumn("significant", flag(F.col("p_value") < 0.05))


def label_correlation(melted: DataFrame, label: str = "label") -> DataFrame:
    """Point-biserial r of each feature with the label; missing values take the feature's median."""
    med = wide_quantiles(value_counts(melted, ["feature"], "value"), ["feature"], "value", {"_median": 50})
    filled = melted.join(F.broadcast(med), "feature").withColumn("value", F.coalesce("value", "_median"))
    return filled.groupBy("feature").agg(pearson("value", label).alias("label_corr_r"))


def pearson(x: str, y: str) -> Column:
    """Pearson r of rows in which both are present; NULL where a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def correlation_pairs(df: DataFrame, features: list[str], strong: float = 0.7) -> DataFrame:
    """Pearson r of every feature pair (a before b), rows with a missing side left out pair by pair; one pass."""
    each = [
        F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(features[i]).cast("double").alias("x"), F.col(features[j]).cast("double").alias("y"))
        for i in range(len(features)) for j in range(i + 1, len(features))
    ]
    both = df.select(F.inline(F.array(*each))).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    names = F.array(*map(F.lit, features))
    pairs = both.groupBy("a", "b").agg(pearson("x", "y").alias("r"))
    pairs = pairs.select(F.get(names, F.col("a")).alias("feature_a"), F.get(names, F.col("b")).alias("feature_b"), "r")
    return pairs.withColumn("strong", flag(F.abs("r") > strong))


def top_correlates(pairs: DataFrame) -> DataFrame:
    """The strongest partner of each feature."""
    both = pairs.select("feature_a", "feature_b", "r").unionByName(
        pairs.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "r")).filter(F.col("r").isNotNull())
    best = F.row_number().over(Window.partitionBy("feature_a").orderBy(F.abs("r").desc(), "feature_b"))
    return both.withColumn("_b", best).filter("_b = 1").select(F.col("feature_a").alias("feature"), F.col("feature_b").alias("partner"), "r")


def average_ranks(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """Average rank of each distinct value, ties shared."""
    return prefix_sums(counts, by, value, [n]).withColumn("rank", F.col(f"{n}_below") + (F.col(n) + 1) / 2)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns over their distinct pairs, weighted by multiplicity."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))

    def ranks(c: str) -> DataFrame:
        values = pairs.groupBy(c).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("_pairs"))
        return average_ranks(values, [], c).select(c, "_pairs", F.col("rank").alias(f"r{c}"))

    ranked = join_groups(pairs, ranks("x"), ["x"], "_pairs", ["y"]).drop("_pairs")
    ranked = join_groups(ranked, ranks("y"), ["y"], "_pairs", ["x"]).drop("_pairs")
    # ranks average (N + 1) / 2 whatever the ties, so centred sums need no second pass
    mid = (pairs.agg(F.sum("n").alias("t")).scalar() + 1) / 2
    rx, ry, n = F.col("rx") - mid, F.col("ry") - mid, F.col("n")
    sums = ranked.agg(F.sum(n * rx * ry).alias("xy"), F.sum(n * rx * rx).alias("xx"), F.sum(n * ry * ry).alias("yy"), F.sum("n").alias("n_rows"))
    return sums.select("n_rows", div(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


def kolmogorov_p(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p of the two-sample statistic."""
    lam2 = d * d * (n1.cast("double") * n2 / (n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * lam2),
    )
    return F.when(lam2 < 0.04, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_two_sample(melted: DataFrame, is_first: Column) -> DataFrame:
    """Largest gap between the two empirical distribution functions, per feature."""
    counts = two_sided_counts(melted, is_first)
    sizes = counts.groupBy("feature").agg(F.sum("n_a").alias("n1"), F.sum("n_b").alias("n2"))
    axis = prefix_sums(counts, ["feature"], "value", ["n_a", "n_b"]).join(F.broadcast(sizes), "feature")
    gap = F.abs((F.col("n_a_below") + F.col("n_a")) / F.col("n1") - (F.col("n_b_below") + F.col("n_b")) / F.col("n2"))
    out = axis.groupBy("feature").agg(F.max(gap).alias("ks_statistic"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    return out.withColumn("ks_p_value", kolmogorov_p(F.col("ks_statistic"), F.col("n1"), F.col("n2")))


def drift_stats(melted: DataFrame, is_first: Column) -> DataFrame:
    """Means, variances, skews, mean ratio and KS between two datasets, per shared feature."""
    aggs = []
    for name, cond in (("a", is_first), ("b", ~is_first)):
        v = _side(cond, "value")
        aggs += [F.count(v).alias(f"{name}_n"), F.avg(v).alias(f"{name}_mean"), F.var_samp(v).alias(f"{name}_variance"), F.skewness(v).alias(f"{name}_skew")]
    moments = enough(melted.groupBy("feature").agg(*aggs), "a_n", "b_n")
    ks = ks_two_sample(melted, is_first).select("feature", "ks_statistic", "ks_p_value")
    out = moments.join(F.broadcast(ks), "feature")
    return out.withColumns({"mean_ratio": div(F.col("a_mean"), F.col("b_mean")), "differ": flag(F.col("ks_p_value") < 0.05)})


REMEDIES = ["none", "log1p", "zscore", "robust"]


def scaling_remedies(melted: DataFrame, is_first: Column) -> DataFrame:
    """Standardised mean gap between two datasets under four scalings, and the one that closes it most.

    The gap divides by the pooled spread, so centring and scaling by shared constants cannot move it; those two
    are reported for the record and lose every tie to "none". Gaps equal to 9 decimals count as tied.
    """
    v = F.col("value")
    lg = F.log1p(F.greatest(v, F.lit(0.0)))

    def gap(x: Column) -> Column:
        return F.coalesce(div(F.abs(F.avg(F.when(is_first, x)) - F.avg(F.when(~is_first, x))), F.stddev_pop(x)), F.lit(0.0))

    some = melted.filter(v.isNotNull())
    gaps = some.groupBy("feature").agg(
        F.count_if(is_first).alias("a_n"), F.count_if(~is_first).alias("b_n"), gap(v).alias("gap_none"), gap(lg).alias("gap_log1p"))
    spread = wide_quantiles(value_counts(some, ["feature"], "value"), ["feature"], "value", {"q1": 25, "median": 50, "q3": 75})
    out = enough(gaps, "a_n", "b_n").join(F.broadcast(spread), "feature").withColumns({
        "gap_zscore": F.col("gap_none"), "gap_robust": F.col("gap_none"), "iqr": F.col("q3") - F.col("q1"),
    })
    ranked = F.array_sort(F.array(*[F.struct(F.round(f"gap_{r}", 9).alias("near"), F.lit(i).alias("i"), F.lit(r).alias("name"), F.col(f"gap_{r}").alias("gap")) for i, r in enumerate(REMEDIES)]))
    best = ranked[0]
    return out.select(
        "feature", *[f"gap_{r}" for r in REMEDIES], "median", "iqr", best["name"].alias("best_remedy"), best["gap"].alias("gap_after_best"),
        F.when(F.col("gap_none") > 0, 100 * (F.col("gap_none") - best["gap"]) / F.col("gap_none")).otherwise(0.0).alias("gap_reduction_pct"),
    )


def remedy_vote(remedies: DataFrame) -> DataFrame:
    votes = remedies.groupBy("best_remedy").agg(F.count(F.lit(1)).alias("n_features"))
    top = votes.agg(F.max(F.struct("n_features", "best_remedy"))["best_remedy"].alias("w")).scalar()
    return votes.withColumn("winner", flag(F.col("best_remedy") == top))


def histogram(melted: DataFrame, by: str, bins: int = 40, clip_percent: int | None = 99) -> DataFrame:
    """Density per bin of each feature and side, values clipped to [0, p99] when `clip_percent` is set."""
    values = cut_lineage(value_counts(melted, ["feature", by], "value"))  # everything below reads this one small table
    if clip_percent is not None:
        both = values.groupBy("feature", "value").agg(F.sum("n").alias("n"))
        top = wide_quantiles(both, ["feature"], "value", {"_top": clip_percent})
        # a row per feature; in a shuffle all values of one feature would meet in a task
        values = values.join(F.broadcast(top), "feature").withColumn("value", F.least(F.greatest("value", F.lit(0.0)), "_top")).drop("_top")
    edges = values.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    sides = values.groupBy("feature", by).agg(F.sum("n").alias("side_n"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = values.join(F.broadcast(edges), "feature").groupBy("feature", by, bin_no.cast("int").alias("bin")).agg(F.sum("n").alias("n"), F.max(width).alias("width"))
    return counts.join(sides, ["feature", by]).withColumn("density", div(F.col("n") / F.col("side_n"), F.col("width"))).drop("side_n")


def binary_rates(df: DataFrame, features: list[str], by: str) -> DataFrame:
    row = df.groupBy(by).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    return row.select(by, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("rate")) for f in features])))
