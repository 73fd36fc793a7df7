"""Where a detector fails: by technique, by feature, and against another detector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.columns import div, flag, melt
from hostlens.operators.joins import join_groups
from hostlens.operators.metrics import outcome


def technique_breakdown(df: DataFrame, model: str, label: str = "true_label", technique: str = "technique") -> DataFrame:
    """Missed and caught attacks per technique, worst first."""
    caught = F.col(f"pred_{model}") == 1
    out = df.filter(F.col(label) == 1).groupBy(technique).agg(F.count_if(~caught).alias("fn"), F.count_if(caught).alias("tp"))
    out = out.withColumn("total", F.col("fn") + F.col("tp"))
    return out.withColumns({"fn_rate": div(F.col("fn"), F.col("total")), "detection_rate": div(F.col("tp"), F.col("total"))}).orderBy(
        F.col("fn_rate").desc(), technique)


def benign_false_positives(df: DataFrame, models: list[str], label: str = "true_label") -> DataFrame:
    benign = df.filter(F.col(label) == 0).select(*[f"pred_{m}" for m in models])
    counts = benign.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"pred_{m}") == 1).alias(m) for m in models])
    rows = [F.struct(F.lit(m).alias("model"), F.col("n").alias("n_benign"), F.col(m).alias("n_fp"), div(F.col(m), F.col("n")).alias("fp_rate")) for m in models]
    return counts.select(F.inline(F.array(*rows)))


def _by_feature(df: DataFrame, features: list[str], tag: Column) -> DataFrame:
    return melt(df.withColumn("_tag", tag).filter(F.col("_tag").isNotNull()), ["_tag"], features)


def missed_vs_caught(df: DataFrame, features: list[str], model: str, label: str = "true_label") -> DataFrame:
    """Feature means of missed against caught attacks; the ratio far from 1 first."""
    m = _by_feature(df.filter(F.col(label) == 1), features, outcome(label, f"pred_{model}"))
    fn, tp = F.col("_tag") == "FN", F.col("_tag") == "TP"
    out = m.groupBy("feature").agg(
        F.count_if(fn).alias("n_fn"), F.count_if(tp).alias("n_tp"), F.avg(F.when(fn, F.col("value"))).alias("fn_mean"),
        F.avg(F.when(tp, F.col("value"))).alias("tp_mean"))
    out = out.withColumn("fn_over_tp", div(F.col("fn_mean"), F.col("tp_mean")))
    return out.withColumn("abs_dev_from_1", F.abs(F.col("fn_over_tp") - 1)).orderBy(F.col("abs_dev_from_1").desc_nulls_last(), "feature")


def false_alarm_effect(df: DataFrame, features: list[str], model: str, label: str = "true_label") -> DataFrame:
    """Standardised difference of false alarms from cleared benign rows, plain mean of both variances."""
    m = _by_feature(df.filter(F.col(label) == 0), features, outcome(label, f"pred_{model}"))
    fp, tn = F.col("_tag") == "FP", F.col("_tag") == "TN"
    v = F.col("value")
    out = m.groupBy("feature").agg(
        F.count_if(fp).alias("n_fp"), F.count_if(tn).alias("n_tn"), F.avg(F.when(fp, v)).alias("fp_mean"), F.avg(F.when(tn, v)).alias("tn_mean"),
        F.var_samp(F.when(fp, v)).alias("_vf"), F.var_samp(F.when(tn, v)).alias("_vt"))
    pooled = F.sqrt((F.coalesce("_vf", F.lit(0.0)) + F.coalesce("_vt", F.lit(0.0))) / 2)
    d = F.when(pooled > 0, (F.col("fp_mean") - F.col("tn_mean")) / pooled)
    return out.withColumn("cohens_d", d).drop("_vf", "_vt").orderBy(F.abs("cohens_d").desc_nulls_last(), "feature")


def disagreement(df: DataFrame, features: list[str], pairs: list[tuple[str, str]], label: str = "true_label") -> DataFrame:
    """For each pair of models, the rows only one of them gets right: counts and feature means both ways; one scan for all pairs."""
    each = []
    for a, b in pairs:
        ok_a, ok_b = F.col(f"pred_{a}") == F.col(label), F.col(f"pred_{b}") == F.col(label)
        tag = F.when(~ok_a & ok_b, "b_only").when(ok_a & ~ok_b, "a_only")
        each.append(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), tag.alias("_tag")))
    tagged = df.select(*features, F.inline(F.array(*each))).filter(F.col("_tag").isNotNull())
    only_a, only_b = F.col("_tag") == "a_only", F.col("_tag") == "b_only"
    return melt(tagged, ["model_a", "model_b", "_tag"], features).groupBy("model_a", "model_b", "feature").agg(
        F.count_if(only_b).alias("n_a_wrong_b_right"), F.count_if(only_a).alias("n_a_right_b_wrong"),
        F.avg(F.when(only_b, F.col("value"))).alias("a_wrong_b_right_mean"), F.avg(F.when(only_a, F.col("value"))).alias("a_right_b_wrong_mean"))


def newly_missed(df: DataFrame, baseline: str, augmented: str, label: str = "true_label") -> DataFrame:
    """Attacks the baseline caught and the augmented model lost."""
    return df.filter((F.col(label) == 1) & (F.col(baseline) == 1) & (F.col(augmented) == 0))


def name_support(df: DataFrame, name: str = "proc_name", label: str = "label", fold: str = "fold") -> DataFrame:
    """Rows and attack rate of each name in the training part of each fold, which is every other fold; NULL is no name."""
    per = df.filter(F.col(name).isNotNull()).groupBy(name, fold).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_n1"))
    folds = df.select(fold).distinct().groupBy().agg(F.collect_set(fold).alias("_folds"))  # one small row
    held = per.groupBy(name).agg(F.sum("_n").alias("_all"), F.sum("_n1").alias("_all1"), F.map_from_entries(F.collect_list(F.struct(fold, F.struct("_n", "_n1")))).alias("_own"))
    each = held.withColumn(fold, F.explode(folds.scalar()))
    own = F.try_element_at("_own", F.col(fold))
    n = F.col("_all") - F.coalesce(own["_n"], F.lit(0))
    n1 = F.col("_all1") - F.coalesce(own["_n1"], F.lit(0))
    return each.select(name, fold, n.alias("train_support"), F.when(n > 0, n1 / n).alias("train_attack_rate"))


def explain_misses(misses: DataFrame, df: DataFrame, row_key: list[str], name: str = "proc_name", label: str = "label", fold: str = "fold") -> DataFrame:
    """Training support and attack rate of the process name of each newly missed row, fold by fold."""
    return _with_support(misses, name_support(df, name, label, fold), [name, fold], row_key)


def _with_support(rows: DataFrame, support: DataFrame, keys: list[str], row_key: list[str]) -> DataFrame:
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = join_groups(rows, support.withColumn("_n", F.lit(0)), keys, "_n", row_key, sizes=sizes).drop("_n")
    return out.withColumn("train_support", F.coalesce("train_support", F.lit(0)))


def mixed_group_names(df: DataFrame, group: str, name: str = "proc_name", label: str = "label", fold: str = "fold", min_size: int = 100, min_support: int = 30) -> DataFrame:
    """Process names inside large groups that carry both labels, for each fold that tests some of the group.

    `group_size` and `n_rows` count the whole group, `train_support` the name's rows in the other folds.
    """
    mixed = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"), (F.min(label) != F.max(label)).alias("_mixed"))
    mixed = mixed.filter(F.col("_mixed") & (F.col("group_size") >= min_size)).drop("_mixed")
    names = df.groupBy(group, name).agg(F.count(F.lit(1)).alias("n_rows")).join(mixed, group)
    tested = df.select(group, fold).distinct()
    inside = names.join(tested, group)
    out = _with_support(inside, name_support(df, name, label, fold).drop("train_attack_rate"), [name, fold], [group])
    return out.withColumn("above_min_support", flag(F.col("train_support") >= min_support))
