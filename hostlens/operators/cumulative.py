"""Distributed prefix sums over a value axis, and the exact order statistics built on them.

A window without partitions would put the whole axis into one task. Here every caller first reduces to one
row per distinct value, the axis is cut into ranges of about equal size, each range is summed on its own,
and the totals of the ranges below are added. A NULL part is a part like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.session import cut_lineage

PART = "_part"

RANGE_ROWS = 1_000_000  # distinct values that one task should sort


def _cuts(counts: DataFrame, order: str, ranges: int | None) -> list:
    """Bounds between ranges of about equal size: as many as keep a range near RANGE_ROWS, and one per shuffle partition."""
    least = ranges or max(2, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = lambda n: F.percentile_approx(order, [i / n for i in range(1, n)], 20 * n).alias("cuts")
    row = counts.agg(F.count(F.lit(1)).alias("n"), points(least)).first()
    wanted = -(-row["n"] // RANGE_ROWS)
    if ranges is None and wanted > least:
        row = counts.agg(points(wanted)).first()
    return sorted(set(row["cuts"] or []))


def _range_of(order: str, cuts: list) -> Column:
    """Number of the range that holds a row, by binary search in the cuts, which all parts share."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(order) <= F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def prefix_sums(counts: DataFrame, by: list[str], order: str, measures: list[str], ranges: int | None = None) -> DataFrame:
    """Add `<m>_below`, the sum of m over smaller values of `order` in the same `by` part.

    `counts` holds one row per (by, order). `by` names parts of a report (features, models, repeats), so it
    has few values; `order` may have any number.
    """
    names = counts.columns
    counts = cut_lineage(counts)  # it is read for the cuts, the totals and the rows
    keyed = counts.withColumn(PART, F.struct(*by) if by else F.struct(F.lit(0).alias("all")))
    placed = keyed.withColumn("_range", _range_of(order, _cuts(counts, order, ranges)))
    below = Window.partitionBy(PART).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(PART, "_range").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    offsets = totals.select(PART, "_range", *[F.coalesce(F.sum(f"_t_{m}").over(below), F.lit(0)).alias(f"_o_{m}") for m in measures])
    inside = Window.partitionBy(PART, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_i_{m}") for m in measures])
    out = out.join(offsets, [PART, "_range"])
    return out.select(*names, *[(F.col(f"_i_{m}") + F.col(f"_o_{m}")).alias(f"{m}_below") for m in measures])


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add `name`, the row's place (from 1) in the order of the whole table; `order` tells all rows apart.

    Rows are sorted into ranges of the full order, so equal first keys, however many, are cut as well. A range is numbered
    on its own; the rows before it are a broadcast of one number per range.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut_lineage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = placed.withColumn("_inside", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return inside.join(F.broadcast(offsets), "_range").select(*df.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(name))


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row per distinct value with its multiplicity `n`; partial counts absorb hot values."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def quantile_points(counts: DataFrame, by: list[str], value: str, percents: list[int], n: str = "n") -> DataFrame:
    """Exact percentiles with linear interpolation, one row per (by, pct).

    `counts` is one row per (by, value) with multiplicity `n`. Percentile p sits at rank p(N-1)/100; each
    value row claims the percentiles whose lower or upper rank falls inside its own block of ranks.
    """
    axis = prefix_sums(counts, by, value, [n])
    axis = axis.withColumn(PART, F.struct(*by) if by else F.struct(F.lit(0).alias("all")))
    totals = axis.groupBy(PART).agg(F.sum(n).alias("_total"))
    wanted = F.array(*[F.lit(p) for p in percents])
    lo_rank = F.floor(F.col("pct") * (F.col("_total") - 1) / 100)
    rows = (
        axis.join(totals, PART)
        .withColumn("_first", F.col(f"{n}_below") - 1)
        .withColumn("_last", F.col(f"{n}_below") + F.col(n))
        # ranks p(N-1)/100 in [first, last) are the only ones this block can serve
        .withColumn("_pct", F.filter(wanted, lambda p: (p * (F.col("_total") - 1) >= F.col("_first") * 100)
                                     & (p * (F.col("_total") - 1) < F.col("_last") * 100)))
        .filter(F.size("_pct") > 0)
        .withColumn("pct", F.explode("_pct"))
        .withColumn("_lo", lo_rank)
    )
    hi_rank = F.least(F.col("_lo") + 1, F.col("_total") - 1)
    holds = lambda r: (r >= F.col(f"{n}_below")) & (r < F.col("_last"))
    out = rows.groupBy(PART, "pct").agg(
        F.max(F.when(holds(F.col("_lo")), F.col(value))).alias("_vlo"),
        F.max(F.when(holds(hi_rank), F.col(value))).alias("_vhi"),
        F.max("_total").alias("_total"),
    )
    frac = (F.col("pct") * (F.col("_total") - 1) % 100) / 100.0
    return out.select(*[F.col(f"{PART}.{c}").alias(c) for c in by], "pct", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac).alias("q"))


def wide_quantiles(counts: DataFrame, by: list[str], value: str, names: dict[str, int], n: str = "n") -> DataFrame:
    """`quantile_points` with one column per requested percentile."""
    pts = quantile_points(counts, by, value, sorted(set(names.values())), n)
    aggs = [F.max(F.when(F.col("pct") == p, F.col("q"))).alias(c) for c, p in names.items()]
    return pts.groupBy(*by).agg(*aggs) if by else pts.agg(*aggs)
