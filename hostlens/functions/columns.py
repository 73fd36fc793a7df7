"""Column helpers shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def flag(cond: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def nan_to_null(c: str | Column) -> Column:
    c = col(c).cast("double")
    return F.when(F.isnan(c), None).otherwise(c)


def div(a: Column, b: Column, zero: float | None = None) -> Column:
    """a / b as DOUBLE; `zero` (or NULL) where b is 0 or NULL."""
    out = F.when(b != 0, a.cast("double") / b)
    return out if zero is None else F.coalesce(out, F.lit(float(zero)))


def hash_hex(seed: int | str, *keys: str | Column) -> Column:
    """32 hex digits that order rows pseudo-randomly and identically on every engine and layout."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def hex_prefix(hexed: Column, digits: int) -> Column:
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("bigint")


def hash_fraction(seed: int | str, *keys: str | Column) -> Column:
    """Uniform in [0, 1), a function of (seed, keys) only."""
    return hex_prefix(hash_hex(seed, *keys), 8) / F.lit(4294967296.0)


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def fixed_text(c: str | Column) -> Column:
    """Text of a number at 4 decimals; the same on every engine, with no negative zero."""
    return F.coalesce(col(c).cast("decimal(38,4)").cast("string"), F.lit("NA"))


def melt(df, id_cols: list[str], value_cols: list[str], name: str = "feature", value: str = "value"):
    """One row per (row, column): a projection plus explode, no shuffle."""
    pairs = [F.struct(F.lit(c).alias(name), nan_to_null(c).alias(value)) for c in value_cols]
    return df.select(*id_cols, F.explode(F.array(*pairs)).alias("_kv")).select(*id_cols, "_kv.*")
