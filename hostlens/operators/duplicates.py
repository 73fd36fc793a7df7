"""Duplicate vectors, groups with both labels, and how groups spread over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.columns import div
from hostlens.operators.joins import join_groups
from hostlens.session import cut_lineage


def group_table(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """One row per vector: size, rows per class, 1 when both classes occur."""
    n1 = F.sum(label).cast("bigint")
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(
        n.alias("n"), (n - n1).alias("n_benign"), n1.alias("n_attack"), (F.min(label) != F.max(label)).cast("int").alias("mixed")
    )


def duplication(df: DataFrame, key: str) -> DataFrame:
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_vectors"), F.sum(F.col("n") - 1).alias("n_duplicates"),
        F.avg("n").alias("mean_copies"), F.max("n").alias("max_copies"),
    )


def mixed_summary(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    g = group_table(df, key, label)
    rows = F.sum(F.when(F.col("mixed") == 1, F.col("n")).otherwise(0))
    return g.agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("mixed").alias("n_mixed"), rows.alias("rows_in_mixed"),
        div(rows, F.sum("n")).alias("share_in_mixed"),
    )


def mark_mixed(df: DataFrame, key: str, row_key: list[str], label: str = "label") -> DataFrame:
    return join_groups(df, group_table(df, key, label).select(key, "n", "mixed"), [key], "n", row_key).drop("n")


def mixed_metadata(df: DataFrame, key: str, columns: list[str], label: str = "label", sample: int = 5) -> DataFrame:
    """Per mixed group and descriptive column: distinct values and the first few of them.

    Values are made distinct before anything is collected, and only `sample` of them ever are.
    """
    mixed = cut_lineage(group_table(df, key, label).filter("mixed = 1").select(key, "n", "n_benign", "n_attack"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.join(mixed.select(key), key, "left_semi").select(key, F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()
    sizes = values.groupBy(key, "column").agg(F.count(F.lit(1)).alias("n_distinct"))
    first = values.withColumn("_r", F.row_number().over(Window.partitionBy(key, "column").orderBy("value"))).filter(F.col("_r") <= sample)
    first = first.groupBy(key, "column").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("sample"))
    return mixed.join(sizes, key).join(first, [key, "column"])


def largest_groups(df: DataFrame, key: str, top: int = 10) -> DataFrame:
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), F.max("label").alias("group_label"))
    return sizes.orderBy(F.col("group_size").desc(), key).limit(top)


def fold_composition(df: DataFrame, key: str, top: int = 10, min_size: int = 500, min_share: float = 0.9) -> DataFrame:
    """Where the largest groups lie per (repeat, fold); flags big ones almost wholly in one fold."""
    once = df.filter(F.col("repeat") == 0) if "repeat" in df.columns else df
    big = largest_groups(once, key, top)
    cells = df.groupBy("repeat", "fold", key).agg(F.count(F.lit(1)).alias("n_in_fold"))
    out = cells.join(F.broadcast(big), key)
    share = F.col("n_in_fold") / F.col("group_size")
    return out.withColumn("share", share).withColumn(
        "concentrated", ((F.col("group_size") > min_size) & (share > min_share)).cast("int"))


def mixed_exposure(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Rows of mixed groups in each test fold. `df` carries repeat and fold."""
    g = df.groupBy("repeat", "fold", key).agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    return g.groupBy("repeat", "fold").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("lo") != F.col("hi"), F.col("n")).otherwise(0)).alias("n_mixed")
    )
