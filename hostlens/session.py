"""Session helpers: a local test session and a durable, shared place to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "hostlens") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; where none is configured, one inside the session's warehouse folder.

    Both are named by the session and seen by every executor, so a lost executor loses nothing that was written.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def application_dir(spark: SparkSession) -> str:
    """This application's own folder for intermediates; it is deleted when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hostlens-{spark.sparkContext.applicationId}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediates that nothing reads any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Write `df` once to the application's folder; the table read back, and its path for `remove_dir`."""
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and read it back.

    Later readers neither recompute it nor depend on any executor still being alive, and column pruning and
    filters reach the written files.
    """
    return store(df)[0]
