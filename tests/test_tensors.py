"""Tensor blocks: round trips, failed writes and retried tasks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.sources.tensors import read_index, read_tensors, sweep_tensors, write_tensors


def table(spark, n=100, parts=3):
    tensor = F.array(*[F.array(*[(F.col("id") * 6 + 2 * i + j).cast("int") for j in range(2)]) for i in range(3)])
    return spark.range(n, numPartitions=parts).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"), tensor.alias("t"), F.lit("x").alias("a.b"))


def rows(df):
    return sorted(str((r["k"], r["t"], r["a.b"])) for r in df.collect())


@pytest.mark.parametrize("block_rows", [10, 33, 1000])
def test_round_trip(spark, tmp_path, block_rows):
    path = str(tmp_path / "x")
    write_tensors(table(spark), path, "t", (3, 2), block_rows)
    back = read_tensors(spark, path).orderBy("row").collect()
    assert sorted(str((r["k"], r["t"], r["a.b"])) for r in back) == rows(table(spark))
    assert [r["row"] for r in back] == list(range(100))
    index = read_index(path)
    assert all(b["rows"] <= block_rows for b in index["blocks"])
    for b in index["blocks"]:  # numpy itself reads a block, and its rows lie where the index says
        whole = np.load(os.path.join(path, f"{b['name']}.npy"))
        assert whole.shape == (b["rows"], 3, 2) and whole.dtype == np.int32
        assert [r["t"] for r in back[b["first"] : b["first"] + b["rows"]]] == whole.tolist()


def test_append_overwrite_and_empty(spark, tmp_path):
    path = str(tmp_path / "x")
    write_tensors(table(spark), path, "t", (3, 2), 40)
    write_tensors(table(spark, 7), path, "t", (3, 2), 40, mode="append")
    assert sorted(r["row"] for r in read_tensors(spark, path).collect()) == list(range(107))
    with pytest.raises(Exception, match="another schema"):
        write_tensors(table(spark, 7).drop("k"), path, "t", (3, 2), mode="append")
    assert read_tensors(spark, path).count() == 107
    write_tensors(table(spark, 7).select("t"), path, "t", (3, 2))
    assert read_tensors(spark, path).columns == ["t", "row"] and read_tensors(spark, path).count() == 7
    write_tensors(table(spark).limit(0), path, "t", (3, 2))
    assert read_tensors(spark, path).collect() == []
    assert sweep_tensors(spark, path) > 0
    assert [f for f in os.listdir(path) if f.startswith("block-")] == []
    with pytest.raises(Exception, match="nothing is committed"):
        read_tensors(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("bad", ["null", "short", "null inside", "row"])
def test_a_failed_write_leaves_what_was_there(spark, tmp_path, bad):
    path = str(tmp_path / "x")
    write_tensors(table(spark, 20), path, "t", (3, 2))
    at = F.col("k") == 50
    broken = {
        "null": F.when(~F.coalesce(at, F.lit(False)), F.col("t")),
        "short": F.when(at, F.slice("t", 1, 2)).otherwise(F.col("t")),
        "null inside": F.when(at, F.array(*[F.array(F.lit(1), F.lit(None).cast("int"))] * 3)).otherwise(F.col("t")),
    }
    df = table(spark).withColumn("row", F.lit(1)) if bad == "row" else table(spark).withColumn("t", broken[bad])
    with pytest.raises(Exception, match="shape|nulls|called"):
        write_tensors(df, path, "t", (3, 2), 5)
    assert rows(read_tensors(spark, path)) == rows(table(spark, 20))


def test_blocks_that_no_index_names_are_not_read(spark, tmp_path):
    path = str(tmp_path / "x")
    write_tensors(table(spark, 20), path, "t", (3, 2), 6)
    before = rows(read_tensors(spark, path))
    name = read_index(path)["blocks"][0]["name"]  # as a task that ran twice leaves it
    for end in ("npy", "parquet"):
        with open(os.path.join(path, f"{name}.{end}"), "rb") as a, open(os.path.join(path, f"block-again.{end}"), "wb") as b:
            b.write(a.read())
    assert rows(read_tensors(spark, path)) == before
    assert sweep_tensors(spark, path) == 2 and rows(read_tensors(spark, path)) == before
