"""Typed table scans, dataset registry, and sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens import schemas as S
from hostlens.operators.clean import exclude_techniques, present
from hostlens.sources.reconcile import read_reconciled

VERSION = "3"  # of the code that writes intermediates; a change of their contents raises it


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """CSV (with header), JSON, ORC or parquet by suffix; CSV and JSON need a schema, nothing is inferred."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1]
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"a schema is required to read {fmt}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_events(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return read_table(spark, path, S.event_schema(), fmt)


@dataclass(frozen=True)
class Dataset:
    """Where a feature table lives and how its columns are named.

    With `spellings`, the path is a folder or pattern of delimited files whose headers may differ; `from_path` names parts of
    their paths.
    """

    path: str
    label: str = "label"
    technique: str = "technique"
    exclude: tuple[str, ...] = ()
    features: tuple[str, ...] = tuple(S.FEATURES)
    spellings: dict[str, list[str]] | None = None
    from_path: dict[str, str] | None = None


@dataclass
class Registry:
    datasets: dict[str, Dataset] = field(default_factory=dict)

    def ingest(self, spark: SparkSession, name: str) -> tuple[DataFrame, list[str]]:
        """The normalised table (features, `label`, `technique`) and the features it really has."""
        if name not in self.datasets:
            raise KeyError(f"unknown dataset {name!r}; known: {sorted(self.datasets)}")
        d = self.datasets[name]
        schema = S.feature_schema(list(d.features), d.label)
        if d.spellings is not None:
            df = read_reconciled(spark, d.path, schema, d.spellings, d.from_path)
        else:
            df = spark.read.parquet(d.path) if d.path.endswith(".parquet") else read_table(spark, d.path, schema)
        return normalise(df, d)


def normalise(df: DataFrame, d: Dataset) -> tuple[DataFrame, list[str]]:
    if d.label not in df.columns:
        raise ValueError(f"label column {d.label!r} is missing")
    df = df.withColumnRenamed(d.label, "label")
    if d.technique in df.columns:
        df = exclude_techniques(df.withColumnRenamed(d.technique, "technique"), list(d.exclude))
    return df, present(df, S.FEATURES)


_SWEEP = r"/{}_{}_[^/]*\.csv(?:/[^/]*)?$"  # a file, or a folder of parts
_NAME = "[^/_]+"


def read_sweeps(spark: SparkSession, pattern: str, schema: T.StructType | str, spellings: dict[str, list[str]] | None = None) -> DataFrame:
    """Sweep files named `<dataset>_<model>_<what>.csv`, stacked, with both names as columns; headers may differ."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = {"dataset": _SWEEP.format(f"({_NAME})", _NAME), "model": _SWEEP.format(_NAME, f"({_NAME})")}
    return read_reconciled(spark, pattern, wanted, spellings, names)


def resolve_alias(df: DataFrame, candidates: list[str], to: str) -> DataFrame:
    """Rename the first column of `candidates` that exists."""
    for c in candidates:
        if c in df.columns:
            return df.withColumnRenamed(c, to)
    raise ValueError(f"none of {candidates} is a column")


# --- sinks --------------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def summary_rows(df: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """A report as one row per (key, metric)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*key, F.inline(pairs))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def pending(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in `done` yet."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def append_new(spark: SparkSession, todo: DataFrame, path: str, key: list[str]) -> None:
    """Resumable sink: only keys not yet written are computed and appended."""
    if _exists(spark, path):
        todo = pending(todo, spark.read.parquet(path), key)
    todo.write.mode("append").parquet(path)


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict | None = None) -> str:
    """What a result depends on: names, sizes and times of all files under `inputs` (paths or patterns), the package's
    version and `parameters`. Files are listed by Spark and none is opened; the digest does not depend on their order."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(inputs).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    mark = F.md5(F.concat_ws("|", "path", "length", "at"))
    half = lambda start: F.sum(F.conv(F.substring(mark, start, 15), 16, 10).cast("decimal(38,0)"))
    files = listed.agg(F.count(F.lit(1)), half(1), half(16)).first()
    said = json.dumps([VERSION, [str(x) for x in files], parameters or {}], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()


def _built_from(spark: SparkSession, path: str) -> str | None:
    """The fingerprint beside a finished result; None where nothing was finished."""
    if not _exists(spark, f"{path}/_fingerprint/_SUCCESS"):
        return None
    rows = spark.read.text(f"{path}/_fingerprint").collect()  # one line
    return rows[0]["value"] if len(rows) == 1 else None


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: list[str] | None = None, parameters: dict | None = None) -> DataFrame:
    """Read an intermediate if it was completed before, else build and write it.

    With `inputs` it is reused only while their files, the package's version and `parameters` are what it was built from;
    the fingerprint is written last, so a build that was stopped is done again.
    """
    path = path.rstrip("/")
    if inputs is None:
        if not _exists(spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    now = fingerprint(spark, inputs, parameters)
    if _built_from(spark, path) != now:
        build().write.mode("overwrite").parquet(path)  # removes the old fingerprint with the old files
        spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_fingerprint")
    return spark.read.parquet(path)
