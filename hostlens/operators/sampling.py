"""Exact seeded draws. Every draw orders rows by md5(seed|key), so it does not depend on the data layout.

Taking the q lowest hashes of a stratum never sorts the stratum: a histogram over hash prefixes tells which
prefix holds the q-th row, everything below it is taken as is, and only that one prefix is ranked. Where it still
holds too many rows, it is split by a longer prefix first. Rows of a NULL stratum are a stratum like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.columns import hash_hex, hex_prefix
from hostlens.operators.joins import KEY, as_small, join_groups, together
from hostlens.session import cut_lineage

PREFIX_DIGITS = 4  # 65,536 histogram cells per stratum and step
RANK_ROWS = 1_000_000  # rows of a cell that one task ranks


def stratum_sizes(df: DataFrame, strata: list[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))


def mark_lowest(
    df: DataFrame,
    strata: list[str],
    key: list[str],
    seed: int,
    quota: int | Column | None = None,
    quotas: DataFrame | None = None,
    digits: int = PREFIX_DIGITS,
    out: str = "taken",
    rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """Flag exactly min(quota, size) rows of each stratum, the ones with the lowest md5(seed|key).

    `quota` is one number (or a column over the stratum columns) for all; `quotas` is a table
    (strata, quota). `key` must identify a row.
    """
    work = df.withColumn(KEY, F.struct(*strata) if strata else F.struct(F.lit(0).alias("all"))).withColumn("_hex", hash_hex(seed, *key))
    if quotas is not None:
        small = as_small(quotas)
        limits = (quotas if small is None else small).select(together(strata), "quota")
        limits = limits if small is None else F.broadcast(limits)
        limit = lambda cells: cells.join(limits, KEY)
    else:
        fields = [F.col(f"{KEY}.{c}").alias(c) for c in strata]
        limit = lambda cells: cells.select("*", *fields).withColumn("quota", quota if isinstance(quota, Column) else F.lit(quota))
    return _settle(work, limit, df.columns, key, 0, digits, out, rank_rows)


def _settle(work: DataFrame, limit: Callable[[DataFrame], DataFrame], cols: list[str], key: list[str], start: int, digits: int, out: str,
            rank_rows: int) -> DataFrame:
    """Decide all rows by the `digits` hex digits from `start` on; the cell in which a quota ends is ranked, or split again."""
    work = work.withColumn("_cell", hex_prefix(F.substring("_hex", start + 1, digits), digits))
    cells = work.groupBy(KEY, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(KEY).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = limit(cells.withColumn("_upto", F.sum("_n").over(upto)))
    # one row per stratum: the first cell that overruns the quota, and what is still free when it starts
    overrun = F.struct("_cell", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_free"), F.col("_n").alias("_rows"))
    edge = cells.groupBy(KEY).agg(F.min(F.when(F.col("_upto") > F.col("quota"), overrun)).alias("_edge"), F.sum("_n").alias("_size"))
    small = as_small(edge)
    if small is not None:
        placed = work.join(F.broadcast(small), KEY)
        crowded = max([r["_edge"]["_rows"] for r in small.collect() if r["_edge"]], default=0)
    else:
        edge = cut_lineage(edge)
        placed = join_groups(work, edge, [KEY], "_size", ["_hex"], "inner")
        crowded = edge.agg(F.max("_edge._rows")).first()[0] or 0
    below = F.col("_edge").isNull() | (F.col("_cell") < F.col("_edge._cell"))
    on_edge = F.coalesce(F.col("_cell") == F.col("_edge._cell"), F.lit(False))
    settled = placed.filter(~on_edge).select(*cols, below.cast("int").alias(out))
    open_ = placed.filter(on_edge)
    if crowded > rank_rows and start + 2 * digits <= 32:
        free = (edge if small is None else small).filter("_edge is not null").select(KEY, F.col("_edge._free").alias("quota"))
        free = free if small is None else F.broadcast(free)
        rest = _settle(open_.select(*cols, KEY, "_hex"), lambda c: c.join(free, KEY), cols, key, start + digits, digits, out, rank_rows)
    else:
        rank = F.row_number().over(Window.partitionBy(KEY).orderBy("_hex", *key))
        rest = open_.withColumn("_rank", rank).select(*cols, (F.col("_rank") <= F.col("_edge._free")).cast("int").alias(out))
    return settled.unionByName(rest)


def take_lowest(df: DataFrame, strata: list[str], key: list[str], seed: int, quota: int | Column | None = None, quotas: DataFrame | None = None,
                digits: int = PREFIX_DIGITS) -> DataFrame:
    """Keep exactly min(quota, size) rows of each stratum."""
    return mark_lowest(df, strata, key, seed, quota, quotas, digits, "_taken").filter("_taken = 1").drop("_taken")


def split_lowest(df: DataFrame, strata: list[str], key: list[str], seed: int, share: float) -> DataFrame:
    """Stratified row split: `in_test` = 1 for exactly rint(share * size) rows of each stratum."""
    quotas = stratum_sizes(df, strata).select(*strata, F.rint(F.col("n") * F.lit(float(share))).cast("bigint").alias("quota"))
    return mark_lowest(df, strata, key, seed, quotas=quotas, out="in_test")


def proportional_quotas(sizes: DataFrame, stratum: str, target: int) -> DataFrame:
    """Share of `target` per stratum: rint(target * share), the last stratum by name takes the rest.

    `sizes` is (stratum, n), one row per stratum name; NULL is the last name.
    """
    last = F.max(F.struct(F.col(stratum).isNull().alias("no"), F.col(stratum).alias("name")))
    whole = sizes.agg(F.struct(F.sum("n").alias("total"), last["name"].alias("last")).alias("w")).scalar()
    share = F.rint(F.lit(float(target)) * F.col("n") / whole["total"]).cast("bigint")
    sized = sizes.select(stratum, "n", whole["total"].alias("total"), F.col(stratum).eqNullSafe(whole["last"]).alias("_last"), F.least(share, "n").alias("_share"))
    given = sized.agg(F.coalesce(F.sum(F.when(~F.col("_last"), F.col("_share"))), F.lit(0)).alias("g")).scalar()
    rest = F.greatest(F.lit(target) - given, F.lit(0))
    want = F.when(F.col("total") <= target, F.col("n")).when(F.col("_last"), F.least(rest, "n")).otherwise(F.col("_share"))
    return sized.select(stratum, "n", want.cast("bigint").alias("quota"))


def cap_per_stratum(df: DataFrame, strata: list[str], key: list[str], cap: int, seed: int) -> DataFrame:
    return take_lowest(df, strata, key, seed, quota=cap)


def sample_n(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    return take_lowest(df, [], key, seed, quota=n)


def subsample_proportional(df: DataFrame, stratum: str, key: list[str], target: int, seed: int) -> DataFrame:
    quotas = proportional_quotas(stratum_sizes(df, [stratum]), stratum, target).select(stratum, "quota")
    return take_lowest(df, [stratum], key, seed, quotas=quotas)


def ratio_sample(processes: DataFrame, key: list[str], ratio: float, seed: int) -> DataFrame:
    """All attack rows plus floor(ratio * attacks) benign rows."""
    attack = processes.filter("label = 1")
    target = int(attack.count() * ratio)
    return attack.unionByName(sample_n(processes.filter("label = 0"), key, target, seed))


def target_rate_sample(processes: DataFrame, key: list[str], rate: float, seed: int) -> DataFrame:
    """Reach an attack share of `rate`: thin the attacks by technique, or the benign rows if attacks are short."""
    attack, benign = processes.filter("label = 1"), processes.filter("label = 0")
    n = {r["label"]: r["n"] for r in stratum_sizes(processes, ["label"]).collect()}
    n_attack, n_benign = n.get(1, 0), n.get(0, 0)
    target = int(round(n_benign * rate / (1 - rate)))
    if target < n_attack:
        return benign.unionByName(subsample_proportional(attack, "technique", key, target, seed))
    keep = int(round(n_attack * (1 - rate) / rate))
    return attack.unionByName(sample_n(benign, key, keep, seed))


def target_size_sample(processes: DataFrame, key: list[str], size: int, seed: int) -> DataFrame:
    """All benign rows, and attacks (by technique) up to `size` rows in total."""
    attack, benign = processes.filter("label = 1"), processes.filter("label = 0")
    n_benign = benign.count()
    if size <= n_benign:
        raise ValueError(f"target size {size} does not exceed the benign pool of {n_benign}")
    return benign.unionByName(subsample_proportional(attack, "technique", key, size - n_benign, seed))


def case_cap(cases: DataFrame, strata: list[str], key: str, max_cases: int, seed: int) -> DataFrame:
    """At least one case per stratum, otherwise proportional, never more than `max_cases`."""
    sizes = stratum_sizes(cases, strata)
    total = sizes.agg(F.sum("n").alias("t")).scalar()
    share = F.greatest(F.lit(1), F.rint(F.lit(float(max_cases)) * F.col("n") / total)).cast("bigint")
    quota = F.when(total <= max_cases, F.col("n")).otherwise(F.least(share, F.col("n")))
    picked = take_lowest(cases, strata, [key], seed, quotas=sizes.select(*strata, quota.alias("quota")))
    return take_lowest(picked, [], [key], seed + 1, quota=max_cases)
