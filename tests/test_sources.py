"""Scans of split files, the session stream and the resumable sink."""

import os

import pytest
from pyspark.sql import functions as F

from hostlens.operators import process
from hostlens.sources import audit, batches
from hostlens.streaming.rollup import run_sessions
from test_extract import EVENT, event


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    want = []
    for name, n in (("a/h1/logs/audit", 2000), ("b/scenario_x/h2/logs/log/audit", 3), ("c", 0), ("a/h2/logs/audit", 777)):
        folder = tmp_path / "tree" / name
        os.makedirs(folder)
        lines = [f"type=SYSCALL msg=audit(1.0:{i}): " + "x" * (i % 97) for i in range(n)]
        (folder / "audit.log").write_text("".join(x + "\n" for x in lines))
        (folder / "other.log").write_text("not read\n")
        want += [(name, i + 1, x) for i, x in enumerate(lines)]
    for size in ("1k", "10k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = audit.numbered_lines(spark, str(tmp_path / "tree")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        got = sorted((r["file"].split("/tree/")[1].rsplit("/", 1)[0], r["line_no"], r["value"]) for r in rows)
        assert got == sorted(want), size


def test_a_written_tree_is_read_back(spark, tmp_path):
    rows = [(f"line {i}", f"/x/scenario_{i % 3}/h{i % 2}/logs/audit.log", i) for i in range(500)]
    lines = spark.createDataFrame(rows, "value string, file string, line_no long").repartition(7)
    audit.write_audit_tree(lines, str(tmp_path / "out"))
    got = audit.numbered_lines(spark, str(tmp_path / "out")).collect()
    by_file = {}
    for value, file, _ in rows:
        by_file.setdefault(file, []).append(value)
    assert {(r["file"].split("/out", 1)[1], r["line_no"], r["value"]) for r in got} == {(f, i + 1, v) for f, vs in by_file.items() for i, v in enumerate(vs)}


def test_sessions_restart_and_drop_late_rows(spark, tmp_path):
    def arrive(rows):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        run_sessions(spark, spark.createDataFrame([], EVENT).schema, *[str(tmp_path / x) for x in ("in", "out", "state")])
        return {(r["pid"], r["seq_length"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    arrive([event(1, 1000.0 + i, n=i) for i in range(5)])
    arrive([event(2, 1100.0 + i, n=10 + i) for i in range(3)])
    assert run() == set()  # both may still go on
    arrive([event(1, 1010.0, n=20)])  # the state of the first run is still there
    arrive([event(3, 9000.0 + i, n=30 + i) for i in range(2)])
    assert run() == {(1, 6), (2, 3)}
    arrive([event(1, 1020.0 + i, n=40 + i) for i in range(4)])  # too late: dropped, and no session is reported twice
    arrive([event(9, 90000.0, n=50)])
    assert run() == {(1, 6), (2, 3), (3, 2)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    batch = process.process_features(spark.createDataFrame([event(3, 9000.0 + i, n=30 + i) for i in range(2)], EVENT)).first()
    live = spark.read.parquet(str(tmp_path / "out")).filter("pid = 3").first()
    assert all(live[c] == batch[c] for c in live.asDict() if c in batch.asDict())


class Lost(Exception):
    pass


@pytest.mark.parametrize("where", [("staged", 0), ("committed", 0), ("staged", 2), ("committed", 4)])
def test_a_stopped_run_is_finished_once(spark, tmp_path, where):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select(F.when(F.col("id") > 3, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    computed = []

    def stop(step, batch):
        if (step, batch) == where:
            raise Lost

    def compute(df):
        computed.append(1)
        return df

    with pytest.raises(Lost):
        batches.write_batches(rows, path, ["k"], 5, compute, stop)
    before = len(computed)
    batches.write_batches(rows, path, ["k"], 5, compute)
    assert sorted(map(str, batches.read_batches(spark, path).collect())) == sorted(map(str, rows.collect()))
    assert len(computed) - before == 5 - len([b for b in range(5) if b < where[1] or (b, "committed") == (where[1], where[0])])
    assert batches.write_batches(rows, path, ["k"], 5) == []
    assert batches.sweep(spark, path) == (1 if where[0] == "staged" else 0)
    assert batches.read_batches(spark, path).count() == 1000


def test_a_batch_is_committed_by_one_run_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(f"{path}/data/one")
    spark.range(5).write.parquet(f"{path}/data/two")
    assert batches.commit(spark, path, 0, "data/one", 1) and not batches.commit(spark, path, 0, "data/two", 1)
    assert batches.read_batches(spark, path).count() == 3
    with pytest.raises(ValueError):
        batches.write_batches(spark.range(3), path, ["id"], 2)
    with pytest.raises(FileNotFoundError):
        batches.read_batches(spark, str(tmp_path / "none"))
