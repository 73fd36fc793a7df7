"""Cleaning and per-column transforms of events and feature tables: all narrow projections and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import any_of, basename, flag, nan_to_null
from hostlens.operators.joins import as_small, join_groups


def clean_events(events: DataFrame, missing_uid_is_root: bool = True, core: list[str] | None = None) -> DataFrame:
    """Fill dependent defaults and drop what no feature uses.

    A missing uid becomes 0, that is root, as the published tables have it; pass
    `missing_uid_is_root=False` to leave such events without a uid instead.
    """
    for c in ("host", "scenario", "source"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    uid = F.coalesce("uid", F.lit(0)) if missing_uid_is_root else F.col("uid")
    exe = F.coalesce("exe", F.lit("unknown"))
    out = events.select(
        *[c for c in events.columns if c not in ("success", "key_tag", "name", "acct")]
    ).withColumns({
        "pid": F.coalesce("pid", F.lit(0)),
        "ppid": F.coalesce("ppid", F.lit(0)),
        "uid": uid,
        "euid": F.coalesce(F.col("euid"), uid),
        "auid": F.coalesce("auid", F.lit(S.UNSET_AUID)),
        "gid": F.coalesce(F.col("gid"), uid),
        "seq_id": F.coalesce("seq_id", F.lit(0)),
        "exe": exe,
        "comm": F.coalesce(F.col("comm"), basename(exe)),
        "syscall_name": F.coalesce("syscall_name", "record_type", F.lit("unknown")),
        "failed": F.coalesce("failed", F.lit(0)),
        "host": F.coalesce("host", F.lit("unknown_host")),
        "scenario": F.coalesce("scenario", F.lit("unknown")),
        "source": F.coalesce("source", F.lit("unknown")),
    })
    return zero_fill(out, core or ["timestamp", "pid", "uid", "euid", "failed", "label"])


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(0, subset=[c for c in columns if c in df.columns])


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its number of NULLs, from a single pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])
    return counts.select(F.inline(pairs))


def exe_basename(exe: Column) -> Column:
    return F.when(exe.isNull() | exe.isin("unknown", ""), F.lit("")).otherwise(F.lower(basename(exe)))


def is_sensitive(exe: Column) -> Column:
    return any_of(*[exe.startswith(p) for p in S.SENSITIVE_PREFIXES])


def uid_class(uid: Column) -> Column:
    return F.when(uid == 0, 0).when(uid < 1000, 1).otherwise(2)


def call_flags(call: Column) -> dict[str, Column]:
    return {
        "is_priv": flag(call.isin(S.PRIV_CALLS)),
        "is_exec": flag(call.isin(S.EXEC_CALLS)),
        "is_file": flag(call.isin(S.FILE_CALLS)),
        "is_network": flag(call.isin(S.NET_CALLS)),
    }


def exclude_techniques(df: DataFrame, techniques: list[str] | None, technique: str = "technique", label: str = "label") -> DataFrame:
    """Drop listed techniques; benign rows and rows without a technique always stay."""
    if not techniques:
        return df
    listed = F.coalesce(F.col(technique).isin(techniques), F.lit(False))
    return df.filter(~listed | (F.col(label) == 0))


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def select_features(columns: list[str], droppable: list[str], policy: str = "full") -> list[str]:
    if policy == "full":
        return list(columns)
    if policy != "reduced":
        raise ValueError(f"unknown feature policy {policy!r}")
    kept = [c for c in columns if c not in set(droppable)]
    if not kept:
        raise ValueError("the reduced policy drops every feature")
    return kept


def schema_compatibility(a: DataFrame, b: DataFrame, name_a: str, name_b: str, features: list[str] = S.FEATURES) -> DataFrame:
    """Which features both datasets have: the column exists and some row has a value."""
    def held(df: DataFrame, out: str) -> DataFrame:
        cells = [F.struct(F.lit(f).alias("feature"), (F.count(F.col(f)) if f in df.columns else F.lit(0).cast("bigint")).alias(out)) for f in features]
        return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))

    na, nb = f"n_{name_a}", f"n_{name_b}"
    both = held(a, na).join(held(b, nb), "feature")
    ina, inb = F.col(na) > 0, F.col(nb) > 0
    status = (
        F.when(ina & inb, "Direct (native to both)").when(ina, f"Unavailable in {name_b}").when(inb, f"Unavailable in {name_a}").otherwise("Not present in either")
    )
    return both.select("feature", na, nb, ina.alias(f"in_{name_a}"), inb.alias(f"in_{name_b}"), status.alias("status"))


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL and NaN become 0, infinities the largest finite DOUBLE; whole numbers are neither NaN nor infinite."""
    big = F.lit(1.7976931348623157e308)
    kinds = dict(df.dtypes)

    def value(c: str) -> Column:
        if kinds[c] in ("tinyint", "smallint", "int", "bigint"):
            return F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return F.least(F.greatest(F.coalesce(nan_to_null(c), F.lit(0.0)), -big), big)

    return df.withColumns({c: value(c) for c in columns})


def log1p_continuous(df: DataFrame, columns: list[str], binary: list[str] = S.BINARY_FEATURES) -> DataFrame:
    return df.withColumns({
        c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in columns if c not in set(binary)
    })


def standard_scale(train: DataFrame, apply_to: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population std, both taken from `train`; a constant column is only centred."""
    stats = train.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    ).first()
    out = {}
    for c in columns:
        mean, std = stats[f"_m_{c}"], stats[f"_s_{c}"]
        out[c] = (F.col(c) - F.lit(mean)) / F.lit(std if std else 1.0)
    return apply_to.withColumns(out)


def with_availability(df: DataFrame, columns: list[str], available: bool, name: str = "features_available") -> DataFrame:
    """Zero-fill the columns a dataset lacks and flag whether its own values are real."""
    missing = {c: F.lit(0.0) for c in columns if c not in df.columns}
    return df.withColumns({**missing, name: F.lit(1.0 if available else 0.0)})


def masked_arms(df: DataFrame, hidden: list[str], masked: Column, name: str = "features_available") -> dict[str, DataFrame]:
    """Three views of one table: all known, some rows hidden, hidden rows flagged."""
    blank = df.withColumns({c: F.when(masked, F.lit(0.0)).otherwise(F.col(c).cast("double")) for c in hidden})
    return {
        "A_full_info": df,
        "B_masked_no_flag": blank,
        "C_masked_with_flag": blank.withColumn(name, F.when(masked, F.lit(0.0)).otherwise(F.lit(1.0))),
    }


def relative_z(train: DataFrame, apply_to: DataFrame, features: list[str], row_key: list[str], name_col: str = "proc_name",
               min_support: int = 30) -> DataFrame:
    """z-score of each feature against rows of the same name in `train`.

    Names with fewer than `min_support` training rows, and constant ones, fall back to the global figures.
    """
    aggs = [F.avg(f).alias(f"_m_{f}") for f in features] + [F.stddev_samp(f).alias(f"_s_{f}") for f in features]
    overall = train.agg(*aggs).first()
    names = train.groupBy(name_col).agg(F.count(F.lit(1)).alias("_support"), *aggs)
    supported = as_small(names.filter(F.col("_support") >= min_support))
    if supported is not None:
        joined = apply_to.join(F.broadcast(supported), name_col, "left")
    else:
        usable = names.filter(F.col("_support") >= min_support)
        sizes = apply_to.groupBy(name_col).agg(F.count(F.lit(1)).alias("_support"))
        joined = join_groups(apply_to, usable, [name_col], "_support", row_key, sizes=sizes)
    out = {}
    for f in features:
        spread = overall[f"_s_{f}"] or 1.0
        std = F.coalesce(F.nullif(F.col(f"_s_{f}"), F.lit(0.0)), F.lit(spread))
        mean = F.coalesce(F.col(f"_m_{f}"), F.lit(overall[f"_m_{f}"]))
        out[f"{f}_relz"] = (F.col(f) - mean) / std
    return joined.withColumns(out).select(*apply_to.columns, *out)


def minmax_from_train(train: DataFrame, apply_to: DataFrame, score: str, out: str) -> DataFrame:
    """(x - min) / (max - min) with the bounds of `train`; other tables may leave [0, 1]."""
    lo, hi = train.agg(F.min(score), F.max(score)).first()
    return apply_to.withColumn(out, (F.col(score) - F.lit(lo)) / F.lit(hi - lo + 1e-12))


def identifier_leaks(df: DataFrame) -> DataFrame:
    """(feature, suspect, n_values): columns whose name contains a raw identifier or time token, and how many values they hold."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.count(F.col(c)).alias("n_values")) for c in df.columns])
    tokens = F.split(F.lower("feature"), "_")
    suspect = flag(F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in S.IDENTIFIER_TOKENS])))
    return df.agg(cells.alias("c")).select(F.inline("c")).withColumn("suspect", suspect)
