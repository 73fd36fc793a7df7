"""Joins of a big table to a lookup or to its own group table, safe when one key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 10_000  # the most rows ever broadcast by these helpers
KEY = "_key"


def together(keys: list[str]) -> Column:
    """All key columns as one struct; structs with equal fields are equal in joins, NULL fields included."""
    return F.struct(*keys).alias(KEY)


def as_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame | None:
    """A driver-held copy of `df` when it provably has at most `limit` rows, else None."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def join_groups(
    big: DataFrame,
    groups: DataFrame,
    keys: list[str],
    size_col: str,
    spread_by: list[str],
    how: str = "left",
    hot_rows: int = SMALL_ROWS,
    sizes: DataFrame | None = None,
    unmatched: Column | None = None,
) -> DataFrame:
    """Attach one row per key of `groups` to `big` without sending a hot key to one task.

    `size_col` bounds the rows of `big` per key. Where `groups` lacks some keys of `big`, give `sizes`
    (keys, size_col) for all of them, or `unmatched`, a test for rows that cannot match.

    Keys that hold more than 1/hot_rows of all rows (so fewer than `hot_rows` of them can exist) travel by
    broadcast. Rows already served that way are spread over the second join by a hash of their own
    identity, so only the thin keys are ever gathered. NULL keys match NULL keys.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type {how!r}")
    payload = [c for c in groups.columns if c not in keys]
    if sizes is not None:
        wanted = groups.drop(size_col).withColumn("_found", F.lit(True))
        wanted = wanted.select(together(keys), *[c for c in payload if c != size_col], "_found")
        groups = sizes.select(*keys, size_col).withColumn(KEY, F.struct(*keys)).join(wanted, KEY, "left").drop(KEY)
    else:
        groups = groups.withColumn("_found", F.lit(True))
    total = groups.agg(F.sum(size_col).alias("t"))
    packed = groups.select(together(keys), F.struct(*payload, "_found").alias("_p"), F.col(size_col).alias("_n"))
    is_hot = F.col("_n") * F.lit(hot_rows) > total.scalar()
    hot = packed.filter(is_hot).select(KEY, F.col("_p").alias("_hot"))
    cold = packed.filter(~is_hot).select(KEY, F.col("_p").alias("_cold"), F.lit(0).alias("_salt"))
    gather = F.col("_hot").isNull() if unmatched is None else F.col("_hot").isNull() & ~unmatched
    served = big.withColumn(KEY, F.struct(*keys)).join(F.broadcast(hot), KEY, "left").withColumn(
        "_salt", F.when(gather, 0).otherwise(F.hash(*spread_by)).cast("int")
    )
    out = served.join(cold, [KEY, "_salt"], "left").withColumn("_p", F.coalesce("_hot", "_cold"))
    if how == "inner":
        out = out.filter(F.col("_p._found"))
    return out.select(*big.columns, *[F.col(f"_p.{c}").alias(c) for c in payload])


def join_lookup(
    big: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    size_col: str | None = None,
    spread_by: list[str] | None = None,
    how: str = "left",
    limit: int = SMALL_ROWS,
) -> DataFrame:
    """Lookup join: broadcast after its row count is checked, otherwise a hot-key-safe shuffle join."""
    small = as_small(lookup, limit)
    if small is None and size_col and spread_by:
        return join_groups(big, lookup, keys, size_col, spread_by, how)
    packed = (lookup if small is None else small).select(together(keys), *[c for c in lookup.columns if c not in keys])
    return big.withColumn(KEY, F.struct(*keys)).join(packed if small is None else F.broadcast(packed), KEY, how).drop(KEY)
