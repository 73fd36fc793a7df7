"""Process roll-up: one grouped aggregate over cleaned events, plus the exec-pair rarity lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import flag
from hostlens.operators.clean import call_flags, exe_basename, is_sensitive
from hostlens.operators.joins import join_groups

PROCESS_KEY = ["source", "scenario", "host", "pid"]
ROOT = "__root__"


def _any(cond: Column) -> Column:
    return F.max(flag(cond))


def rollup_aggregates(order: list[str]) -> list[Column]:
    """The aggregate list of the roll-up, also used by the streaming job.

    The three "first" values travel in two MINs over structs, because each string-typed MIN forces the
    aggregate to sort, and one sort serves both.
    """
    child = exe_basename(F.col("exe"))
    ord_cols = [F.col(c) for c in order]
    call = call_flags(F.col("syscall_name"))
    return [
        F.min("timestamp").alias("t_min"),
        F.max("timestamp").alias("t_max"),
        F.count(F.lit(1)).alias("n"),
        _any(F.col("uid") == 0).alias("uid_is_root"),
        (F.min("uid") != F.max("uid")).cast("int").alias("uid_changed"),
        _any(F.col("euid") == 0).alias("euid_root"),
        F.max(F.abs(F.col("euid") - F.col("uid"))).cast("double").alias("max_uid_euid_delta"),
        _any((F.col("uid") != 0) & (F.col("euid") == 0)).alias("is_suid_exec"),
        _any((F.col("auid") < 65534) & (F.col("euid") == 0) & (F.col("auid") != F.col("euid"))).alias("auid_euid_mismatch"),
        F.avg("failed").alias("failed_mean"),
        F.sum("failed").alias("failed_call_count"),
        F.sum(call["is_priv"]).alias("priv_op_count"),
        F.sum(call["is_exec"]).alias("exec_count"),
        F.sum(call["is_file"]).alias("file_access_count"),
        F.sum(call["is_network"]).alias("network_count"),
        _any(child.isin(S.SHELL_NAMES)).alias("any_shell"),
        _any(child.isin(S.SERVICE_NAMES)).alias("any_service"),
        _any(is_sensitive(F.col("exe"))).alias("sensitive_path_access"),
        F.max("label").alias("label"),
        F.min(F.struct(*ord_cols, "technique", F.col("ppid"), child.alias("child"))).alias("first"),
        F.min(F.when(F.col("label") == 1, F.struct(*ord_cols, "technique"))).alias("first_attack"),
    ]


def rollup_projection(n_calls: Column) -> list[Column]:
    duration = F.greatest(F.col("t_max") - F.col("t_min"), F.lit(0.001))
    return [
        F.round(duration, 3).alias("lifetime_seconds"),
        F.round(F.col("n") / duration, 3).alias("events_per_second"),
        F.col("n").alias("seq_length"),
        n_calls.alias("unique_syscalls"),
        F.col("uid_is_root"), F.col("uid_changed"), F.col("euid_root"),
        F.round("max_uid_euid_delta", 1).alias("max_uid_euid_delta"),
        F.col("is_suid_exec"), F.col("auid_euid_mismatch"),
        flag((duration < 2.0) & (F.col("uid_is_root") == 1)).alias("ephemeral_privileged"),
        F.round("failed_mean", 4).alias("failed_call_rate"),
        F.col("failed_call_count"), F.col("priv_op_count"), F.col("exec_count"), F.col("file_access_count"),
        F.col("network_count"),
        flag((F.col("any_shell") == 1) & (F.col("any_service") == 1)).alias("shell_from_service"),
        F.col("sensitive_path_access"),
        F.col("label"),
        F.coalesce(F.col("first_attack.technique"), F.col("first.technique")).alias("technique"),
        F.col("first.child").alias("proc_name"),
        F.col("first.ppid").alias("ppid"),
    ]


def pair_counts(events: DataFrame) -> DataFrame:
    """How often each (parent, child) exec pair occurs.

    The parent is the event's own executable, or a root mark without a parent id; events without an
    executable name do not count. They are left out after the count: a filter before it would be pushed down to the scan,
    where the columns that it needs are worked out a second time.
    """
    child = exe_basename(F.col("exe"))
    return (
        events.select(F.when(F.coalesce("ppid", F.lit(0)) == 0, F.lit(ROOT)).otherwise(child).alias("parent"), child.alias("child"))
        .groupBy("parent", "child").agg(F.count(F.nullif("child", F.lit(""))).alias("pairs"))
        .filter(F.col("pairs") > 0)
    )


def true_pair_counts(events: DataFrame) -> DataFrame:
    """Corrected variant: the parent is the executable of the process with that pid on the same host of the same scenario."""
    child = exe_basename(F.col("exe"))
    place = ["source", "scenario", "host"]
    ev = events.select(*place, "pid", "ppid", "timestamp", child.alias("child")).filter(F.col("child") != "")
    names = ev.groupBy(*place, F.col("pid").alias("ppid")).agg(
        F.min(F.struct("timestamp", "child"))["child"].alias("parent"), F.count(F.lit(1)).alias("_n"))
    need = ev.groupBy(*place, "ppid", "child").agg(F.count(F.lit(1)).alias("pairs"))
    joined = join_groups(need, names, [*place, "ppid"], "_n", ["child"]).withColumn("parent", F.coalesce("parent", F.lit(ROOT)))
    return joined.groupBy("parent", "child").agg(F.sum("pairs").alias("pairs"))


def with_rarity(processes: DataFrame, pairs: DataFrame) -> DataFrame:
    """1 - pairs / all pairs for the first executable of each process."""
    total = pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("t")).scalar()
    keyed = processes.withColumns({
        "parent": F.when(F.coalesce("ppid", F.lit(0)) == 0, F.lit(ROOT)).otherwise(F.col("proc_name")),
        "child": F.col("proc_name"),
    })
    # a process opens with an event of its own pair, so `pairs` bounds the processes per key
    joined = join_groups(keyed, pairs.withColumn("_size", F.col("pairs")), ["parent", "child"], "_size", PROCESS_KEY,
                         unmatched=F.col("child") == "")
    rarity = F.round(1.0 - F.coalesce("pairs", F.lit(0)) / F.greatest(total, F.lit(1)), 6)
    return joined.withColumn("parent_child_rarity", rarity).drop("parent", "child", "pairs", "_size", "ppid")


def process_features(events: DataFrame, min_events: int = S.MIN_EVENTS, order: tuple[str, ...] = ("timestamp", "seq_id", "line_no"),
                     pairs: DataFrame | None = None) -> DataFrame:
    """Twenty behavioural features per process from cleaned, labelled events."""
    grouped = events.groupBy(*PROCESS_KEY).agg(
        *rollup_aggregates(list(order)), F.size(F.collect_set("syscall_name")).cast("bigint").alias("n_calls")  # a distinct count would shuffle twice
    )
    base = grouped.filter(F.col("n") >= min_events).select(*PROCESS_KEY, *rollup_projection(F.col("n_calls")))
    full = with_rarity(base, pair_counts(events) if pairs is None else pairs)
    return full.select(*PROCESS_KEY, *S.FEATURES, "label", "technique", "proc_name")
