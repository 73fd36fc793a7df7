"""Leak-free folds and splits: a split is a function of the group key, so copies of a row never part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.columns import fixed_text, hash_fraction, hash_hex, hex_prefix
from hostlens.operators.cumulative import prefix_sums
from hostlens.operators.joins import join_groups
from hostlens.session import cut_lineage


def vector_key(df: DataFrame, columns: list[str], out: str = "vector") -> DataFrame:
    """Digest of the columns rounded to 4 decimals; equal vectors share it."""
    parts = [fixed_text(c) if dict(df.dtypes)[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("NA"))
             for c in columns]
    return df.withColumn(out, F.md5(F.concat_ws("|", *parts)))


def with_repeats(df: DataFrame, repeats: int) -> DataFrame:
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def hash_folds(df: DataFrame, key: str, k: int, seed: int, repeats: int = 1) -> DataFrame:
    """`repeat` and `fold` columns; seed + repeat drives each repeat. Needs no shuffle."""
    hexed = F.md5(F.concat_ws("|", (F.lit(seed) + F.col("repeat")).cast("string"), F.col(key)))
    return with_repeats(df, repeats).withColumn("fold", (hex_prefix(hexed, 8) % k).cast("int"))


def deal_groups(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """(key, _n, major, turn): the place of each group in the deal of its dominant label, by falling size, then hash.

    The place is the number of larger groups, plus those of the same size with a smaller hash prefix, plus the rank
    among those that share the prefix.
    """
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_n1"))
    groups = cut_lineage(groups.withColumns({"major": (F.col("_n1") * 2 > F.col("_n")).cast("int"), "_hex": hash_hex(seed, key)}))
    groups = groups.withColumn("_at", F.lit(-1) * F.col("_n") * F.lit(1 << 20) + hex_prefix(F.col("_hex"), 5))
    axis = prefix_sums(groups.groupBy("major", "_at").agg(F.count(F.lit(1)).alias("_g")), ["major"], "_at", ["_g"])
    dealt = groups.join(axis.select("major", "_at", "_g_below"), ["major", "_at"])
    turn = F.col("_g_below") + F.row_number().over(Window.partitionBy("major", "_at").orderBy("_hex", key)) - 1
    return dealt.select(key, "_n", "major", turn.cast("bigint").alias("turn"))


def balanced_folds(df: DataFrame, key: str, label: str, k: int, seed: int, row_key: list[str]) -> DataFrame:
    """Folds with about equal rows per class: groups are dealt out by falling size, back and forth."""
    lap = F.col("turn") % (2 * k)
    fold = F.when(lap < k, lap).otherwise(2 * k - 1 - lap)
    folds = deal_groups(df, key, label, seed).select(key, "_n", fold.cast("int").alias("fold"))
    return join_groups(df, folds, [key], "_n", row_key).drop("_n")


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int, repeats: int, row_key: list[str]) -> DataFrame:
    """`fold_<r>` per repeat: every k neighbours of the deal go to k different folds, in an order that each repeat rotates."""
    dealt = join_groups(df, deal_groups(df, key, label, seed), [key], "_n", row_key).drop("_n")

    def fold(r: int):
        shift = hex_prefix(hash_hex(seed + r, "major", F.floor(F.col("turn") / k).cast("bigint")), 8)
        return ((F.col("turn") + shift) % k).cast("int")

    return dealt.withColumns({f"fold_{r}": fold(r) for r in range(repeats)}).drop("major", "turn")


def group_split(df: DataFrame, key: str, share: float, seed: int, out: str = "in_fit") -> DataFrame:
    """Put about `share` of the groups on one side."""
    return df.withColumn(out, (hash_fraction(seed, key) < share).cast("int"))


def row_budget_groups(df: DataFrame, key: str, share: float, seed: int, out: str = "in_calibration") -> DataFrame:
    """(key, n, out): groups are taken in hash order until they hold `share` of the rows."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    placed = groups.withColumn("_pos", hex_prefix(hash_hex(seed, key), 12))
    axis = prefix_sums(placed.groupBy("_pos").agg(F.sum("n").alias("n")), [], "_pos", ["n"]).select("_pos", "n_below")
    total = groups.agg(F.sum("n").alias("t")).scalar()
    budget = F.rint(F.lit(float(share)) * total)
    return placed.join(axis, "_pos").select(key, "n", (F.col("n_below") < budget).cast("int").alias(out))


def row_budget_split(df: DataFrame, key: str, share: float, seed: int, row_key: list[str], out: str = "in_calibration") -> DataFrame:
    return join_groups(df, row_budget_groups(df, key, share, seed, out), [key], "n", row_key).drop("n")


def fold_leaks(df: DataFrame, key: str, fold: str = "fold", by: list[str] | None = None) -> DataFrame:
    """Groups seen, and groups that sit in more than one fold (0 when the folds are sound)."""
    by = by or []
    per_key = df.groupBy(*by, key).agg((F.min(fold) != F.max(fold)).cast("int").alias("_leak"))
    return per_key.groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("_leak").alias("n_leaking"))


def degenerate_folds(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and positives per (repeat, fold), flagged where only one class is present."""
    return df.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("bigint").alias("n_pos")).withColumn(
        "degenerate", ((F.col("n_pos") == 0) | (F.col("n_pos") == F.col("n"))).cast("int")
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (2 n_c) per class, and negatives per positive."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.agg(
        F.sum("n").alias("t"), F.coalesce(F.sum(F.when(F.col(label) == 0, F.col("n"))), F.lit(0)).alias("neg"),
        F.coalesce(F.sum(F.when(F.col(label) == 1, F.col("n"))), F.lit(0)).alias("pos"),
    ).select(F.struct("t", "neg", "pos").alias("s")).scalar()
    ratio = F.when(sides["pos"] > 0, sides["neg"] / sides["pos"]).otherwise(1.0)
    return counts.select(label, "n", (sides["t"] / (2 * F.col("n"))).alias("weight"), ratio.alias("neg_per_pos"))


def weighted(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach the balanced class weight as a column; two classes, so two literals, from one count."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    w = {cls: sum(n.values()) / (2 * rows) for cls, rows in n.items()}
    col = F.lit(1.0)
    for cls, weight in sorted(w.items()):
        col = F.when(F.col(label) == cls, F.lit(weight)).otherwise(col)
    return df.withColumn(out, col)
