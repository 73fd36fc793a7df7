"""Syscall vocabulary and fixed-size token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import flag
from hostlens.operators.clean import call_flags, uid_class
from hostlens.operators.cumulative import ranked
from hostlens.operators.joins import KEY, join_lookup, together
from hostlens.operators.process import PROCESS_KEY

PAD, UNK, FIRST_ID = 0, 1, 2


def build_vocabulary(events: DataFrame, name: str = "syscall_name") -> DataFrame:
    """(name, n, id): ids from 2 by falling frequency, ties by name; no task ever holds all names, or all of one count."""
    counts = events.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    places = ranked(counts, [F.col("n").desc(), F.col(name)], "id")
    return places.withColumn("id", F.col("id") + (FIRST_ID - 1))


def encode_sequences(events: DataFrame, vocabulary: DataFrame, max_len: int = S.MAX_SEQUENCE, min_events: int = S.MIN_EVENTS,
                     order: tuple[str, ...] = ("timestamp", "seq_id", "line_no")) -> DataFrame:
    """Newest `max_len` events of each process as a left-padded max_len x 7 integer array.

    The row_number filter is pushed below the shuffle by Spark, so a process of any length sends at most
    `max_len` rows per task, and no array exceeds `max_len`.
    """
    meta = events.groupBy(*PROCESS_KEY).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max("label").alias("label"),
        F.min(F.struct(*order, "technique"))["technique"].alias("_first"),
        F.min(F.when(F.col("label") == 1, F.struct(*order, "technique")))["technique"].alias("_attack"),
    ).filter(F.col("n_events") >= min_events)
    newest = Window.partitionBy(*PROCESS_KEY).orderBy(*[F.col(c).desc() for c in order])
    call = F.col("syscall_name")
    flags = call_flags(call)
    kept = (
        events.select(*PROCESS_KEY, *order, "syscall_name", "uid", "failed")
        .withColumn("_pos", F.row_number().over(newest))
        .filter(F.col("_pos") <= max_len)
    )
    kept = join_lookup(kept, vocabulary.select("syscall_name", "n", "id"), ["syscall_name"], "n", ["pid", "_pos"])
    token = F.array(
        F.coalesce("id", F.lit(UNK)).cast("int"), uid_class(F.col("uid")), flag(F.col("failed") != 0),
        flags["is_priv"], flags["is_exec"], flags["is_file"], flags["is_network"],
    )
    arrays = kept.groupBy(*PROCESS_KEY).agg(F.collect_list(F.struct((-F.col("_pos")).alias("p"), token.alias("t"))).alias("_toks"))
    toks = F.transform(F.array_sort("_toks"), lambda s: s["t"])
    pad = F.array_repeat(F.array(*[F.lit(0)] * S.TOKEN_WIDTH), F.lit(max_len) - F.size("_toks"))
    packed = arrays.select(together(PROCESS_KEY), "_toks")
    return meta.withColumn(KEY, F.struct(*PROCESS_KEY)).join(packed, KEY).select(
        *PROCESS_KEY, "label", F.coalesce("_attack", "_first").alias("technique"), "n_events", F.concat(pad, toks).alias("tokens")
    )
