"""A resumable sink: batches by key, each staged, then committed by renaming one small manifest.

A batch is visible only through its manifest. A run that stops before the rename leaves staged files that no reader sees
and that the next run replaces; one that stops after it has nothing left to do for that batch. So however often a job is
stopped and started, every row is written once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> dict[int, dict]:
    """The manifest of each batch that is done: a small file per batch."""
    hadoop, fs = _fs(spark, path)
    folder = hadoop(f"{path}/_manifests")
    if not fs.exists(folder):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("batch-")]
    if not names:
        return {}
    rows = spark.read.text([f"{path}/_manifests/{n}" for n in names], wholetext=True).collect()
    return {m["batch"]: m for m in (json.loads(r["value"]) for r in rows)}


def commit(spark: SparkSession, path: str, batch: int, folder: str, batches: int) -> bool:
    """Publish a staged folder; False if another run has published this batch before."""
    hadoop, fs = _fs(spark, path)
    draft = hadoop(f"{path}/_drafts/{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"batch": batch, "folder": folder, "batches": batches}).encode()))
    out.close()
    final = hadoop(f"{path}/_manifests/batch-{batch}")
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        return False
    return True


def write_batches(todo: DataFrame, path: str, key: list[str], batches: int, compute: Callable[[DataFrame], DataFrame] = lambda df: df,
                  stop: Callable[[str, int], None] = lambda step, batch: None) -> list[int]:
    """Compute and commit every batch that no earlier run has committed; the numbers of those done now.

    A batch holds the keys of one residue of their hash, NULL keys included. The number of batches is fixed by the first
    run. `stop` is called after each step (staged, committed) and may end the run.
    """
    spark = todo.sparkSession
    done = committed(spark, path)
    if done and {m["batches"] for m in done.values()} != {batches}:
        raise ValueError("this table was begun with another number of batches")
    now = []
    for batch in range(batches):
        if batch in done:
            continue
        folder = f"data/batch-{batch}-{uuid.uuid4().hex}"
        compute(todo.filter(F.pmod(F.xxhash64(*key), F.lit(batches)) == batch)).write.parquet(f"{path}/{folder}")
        stop("staged", batch)
        if commit(spark, path, batch, folder, batches):
            now.append(batch)
        stop("committed", batch)
    return now


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches."""
    folders = [f"{path}/{m['folder']}" for _, m in sorted(committed(spark, path).items())]
    if not folders:
        raise FileNotFoundError(f"nothing is committed at {path}")
    return spark.read.parquet(*folders)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete staged folders that no manifest names; call it when no run is under way."""
    hadoop, fs = _fs(spark, path)
    named = {m["folder"].rsplit("/", 1)[-1] for m in committed(spark, path).values()}
    data = hadoop(f"{path}/data")
    stale = [f.getPath() for f in fs.listStatus(data) if f.getPath().getName() not in named] if fs.exists(data) else []
    for folder in stale:
        fs.delete(folder, True)
    return len(stale)
