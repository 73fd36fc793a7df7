"""Files with different headers become one table, each read once."""

import gzip

import pytest
from pyspark.sql import types as T

from hostlens.sources.reconcile import choose, headers, list_files, read_reconciled

SCHEMA = T.StructType().add("n", "long").add("score", "double").add("who", "string")
SPELLINGS = {"n": ["count", "cnt"], "who": ["name"]}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_spellings():
    assert choose(["Cnt", " NAME ", "x"], ["n", "who", "score"], SPELLINGS) == {"n": 0, "who": 1, "score": None}
    assert choose(["n", "cnt", "count"], ["n"], SPELLINGS) == {"n": 2}  # the first of the spellings
    assert choose(["n", "N"], ["n"], {}) == {"n": 0}


def test_one_table_of_many_layouts(spark, tmp_path):
    for folder in ("a b+c", "p[1]%20", "deep/er"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "a b+c" / "one.csv").write_text("n,score,who\n1,0.5,x\n2,,\n")
    (tmp_path / "a b+c" / "two.csv").write_text("n,score,who\r\n3,1e-3, y \r\n")
    (tmp_path / "p[1]%20" / "three.csv").write_bytes('﻿"NAME",extra,Count\n"a,""b""",zz,4.0\nshort\n'.encode())
    (tmp_path / "deep" / "er" / "four.csv.gz").write_bytes(gzip.compress(b"score,cnt\nbad,5.5\n7, 6 \n"))
    (tmp_path / "deep" / "empty.csv").write_text("")
    (tmp_path / "deep" / "head.csv").write_text("n,score,who")
    (tmp_path / "deep" / "other.txt").write_text("n\n1\n")
    got = read_reconciled(spark, str(tmp_path), SCHEMA, SPELLINGS, {"folder": r"/([^/]*)/[^/]*$"})
    assert got.columns == ["n", "score", "who", "folder"] and [f.dataType for f in got.schema][:3] == [f.dataType for f in SCHEMA]
    assert rows(got) == sorted([
        (1, 0.5, "x", "a b+c"), (2, None, None, "a b+c"), (3, 0.001, " y ", "a b+c"), (4, None, 'a,"b"', "p[1]%20"), (None, None, "short", "p[1]%20"),
        (None, None, None, "er"), (6, 7.0, None, "er"),
    ], key=repr)


def test_every_file_is_scanned_once(spark, tmp_path):
    header = {0: "n,score,who", 1: "who,count", 2: "cnt,score"}
    for i in range(12):
        (tmp_path / f"f{i}.csv").write_text(header[i % 3] + "\n" + "".join(",".join(str(i * 100 + j) for _ in header[i % 3].split(",")) + "\n" for j in range(5)))
    got = read_reconciled(spark, str(tmp_path), SCHEMA, SPELLINGS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 3  # a scan per header, not per file
    assert sorted(r["n"] for r in got.collect()) == sorted(i * 100 + j for i in range(12) for j in range(5))
    narrow = got.select("score")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<_c1:string>" in narrow  # columns that nobody asked for are not read
    assert headers(list_files(spark, str(tmp_path))).count() == 12


def test_long_header_and_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_reconciled(spark, str(tmp_path), SCHEMA)
    with pytest.raises(ValueError):
        read_reconciled(spark, str(tmp_path), SCHEMA, from_path={"x": "no group"})
    names = [f"column_{i:05d}" for i in range(3000)]  # more than the first block of the file
    (tmp_path / "wide.csv").write_text(",".join([*names, "n"]) + "\n" + ",".join(["0"] * 3000 + ["9"]) + "\n")
    assert rows(read_reconciled(spark, str(tmp_path), T.StructType.fromDDL("n bigint"))) == [(9,)]


def test_a_report_without_replies(spark):
    from hostlens import schemas as S
    from hostlens.operators import triage

    arb = spark.createDataFrame([], S.arbitration_schema())
    oof = spark.createDataFrame([("a", 0, 1, 0.9, 0.2), ("b", 0, 0, 0.4, 0.9), ("c", 1, 1, 0.5, 0.6)], "row_id string, fold int, true_label int, proba_xgb double, proba_cnn double")
    got = {(r["section"], r["key"], r["metric"]): r["value"] for r in triage.evaluation_report(arb, oof, ["x"]).collect()}
    assert not [k for k in got if k[0] == "accuracy"]
    assert [got["reasoning", "all", m] for m in ("ece", "key_feature_overlap", "parse_error_rate", "call_error_rate", "failure_rate")] == [None] * 5
    assert got["delta", "pooled", "delta_f1"] == 0.0 and got["effect", "cascade@0.5thr/pooled", "recall"] == 1.0
    assert {k[1] for k in got if k[0] == "effect"} == {f"{v}/{f}" for v in ("cascade@0.5thr", "cascade+llm") for f in ("0", "1", "pooled")}
