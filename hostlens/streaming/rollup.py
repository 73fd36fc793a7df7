"""The process roll-up over an event stream: the batch aggregate list per session instead of per pid.

A session closes after `gap` without events, so a reused pid starts a new process.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hostlens import schemas as S
from hostlens.operators.process import PROCESS_KEY, rollup_aggregates, rollup_projection


def stream_process_features(events: DataFrame, gap: str = "10 minutes", late: str = "5 minutes", min_events: int = S.MIN_EVENTS,
                            order: tuple[str, ...] = ("timestamp", "seq_id", "line_no")) -> DataFrame:
    """Features of finished sessions from a stream of cleaned, labelled events (all but pair rarity).

    Pair rarity needs counts over the whole corpus; join a stored pair table to the result for it.
    """
    timed = events.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", late)
    session = F.session_window("event_time", gap).alias("session")
    # syscall names are a small fixed vocabulary, so the set stays small
    calls = F.size(F.collect_set("syscall_name")).cast("bigint").alias("n_calls")
    grouped = timed.groupBy(session, *PROCESS_KEY).agg(*rollup_aggregates(list(order)), calls)
    return grouped.filter(F.col("n") >= min_events).select(
        F.col("session.start").alias("session_start"), *PROCESS_KEY, *rollup_projection(F.col("n_calls")))


def run_sessions(spark: SparkSession, schema: StructType, source: str, sink: str, checkpoint: str, gap: str = "10 minutes", late: str = "5 minutes",
                 files_a_batch: int = 1, min_events: int = S.MIN_EVENTS) -> None:
    """Process all files that `source` holds by now, in micro-batches, and stop; the next run goes on from the checkpoint.

    The file sink records each batch once, so a batch that is repeated after a failure does not appear twice.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    done = stream_process_features(events, gap, late, min_events).writeStream.format("parquet").outputMode("append")
    done.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
