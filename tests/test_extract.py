"""Parsing, event assembly, cleaning and the roll-up on hand cases."""

import pytest
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.operators import clean, process, sequence
from hostlens.sources import audit

LINES = [
    'type=SYSCALL msg=audit(1700000000.123:42): success=yes ppid=10 pid=11 auid=1000 uid=0 gid=0 euid=0 comm="su" exe="/usr/bin/su" key="T1548_X" SYSCALL=execve',
    'type=PATH msg=audit(1700000000.123:42): item=0 name="/etc/shadow"',
    "type=PROCTITLE msg=audit(1700000000.123:42): proctitle=7375",
    "garbage line",
    "",
    'type=PATH msg=audit(1700000001.5:43): name="/tmp/x"',
    "  type=SYSCALL msg=audit(1700000002.5:44): pid=11 key=auditlog res=success  ",
]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(v, "/c/scenario_4/web/logs/log/audit/audit.log", i) for i, v in enumerate(LINES)]
    return spark.createDataFrame(rows, "value string, file string, line_no bigint")


def test_parse(lines):
    got = {r["line_no"]: r for r in audit.parse_lines(lines).collect()}
    assert sorted(got) == [0, 1, 5, 6]
    a, b = got[0], got[1]
    assert (a["timestamp"], a["seq_id"], a["pid"], a["ppid"], a["uid"], a["comm"], a["key_tag"], a["syscall_name"], a["failed"]) == (
        1700000000.123, 42, 11, 10, 0, "su", "T1548_X", "execve", 0)
    assert (b["pid"], b["syscall_name"], b["failed"], b["name"]) == (None, "PATH", 1, "/etc/shadow")
    assert (got[6]["key_tag"], got[6]["failed"], got[6]["success"]) == ("auditlog", 0, True)
    fixed = {r["line_no"]: r["failed"] for r in audit.parse_lines(lines, syscall_only=True).collect()}
    assert fixed == {0: 0, 1: 0, 5: 0, 6: 0}


def test_event_and_process(lines):
    stamped = audit.stamp_event_pid(audit.parse_lines(lines))
    got = {r["line_no"]: r["pid"] for r in stamped.collect()}
    assert got == {0: 11, 1: 11, 6: 11}  # event 43 starts without a pid
    p = audit.label_processes(stamped).collect()
    assert [(r["pid"], r["n_events"], r["technique"], r["label"]) for r in p] == [(11, 3, "T1548_X", 1)]
    rec = audit.label_records(stamped, audit.label_processes(stamped)).collect()
    assert {(r["line_no"], r["label"]) for r in rec} == {(0, 1), (1, 1), (6, 1)}


def test_origin(spark):
    df = spark.createDataFrame([("/c/scenario_4/web/logs/a",), ("/c/x/audit.log",), ("/c/3_ssh_scenario-33_34/db/logs/audit.log",)], "file string")
    got = audit.tag_origin(df, "s").select("scenario", "host", audit.scenario_family(F.col("scenario")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("scenario_4", "web", "scenario_4"), ("unknown", "unknown_host", "unknown"),
                                      ("3_ssh_scenario-33_34", "db", "3_ssh_scenario")]


def test_scan_keeps_line_order(spark, tmp_path):
    for host, n in (("h1", 4000), ("h2", 10)):
        d = tmp_path / "scenario_1-2" / host / "logs"
        d.mkdir(parents=True)
        (d / "audit.log").write_text("".join(f"type=SYSCALL msg=audit(1.5:{i}): pid=1\n" for i in range(n)))
        (d / "other.log").write_text("type=SYSCALL msg=audit(1.5:1): pid=1\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728", "20000", "7001"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            scan = audit.scan_sources(spark, str(tmp_path), ["scenario_*"])
            rows = audit.parse_lines(scan).select("file", "line_no", "seq_id", "family").collect()
            assert len(rows) == 4010 and {r["family"] for r in rows} == {"scenario_1"}
            for host in ("h1", "h2"):
                mine = sorted((r["line_no"], r["seq_id"]) for r in rows if f"/{host}/" in r["file"])
                assert [s for _, s in mine] == list(range(len(mine)))
                assert len({n for n, _ in mine}) == len(mine)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(ValueError):
        audit.scan_sources(spark, str(tmp_path), ["scenario_*"], ["nothing"])


def test_cleaning(spark):
    schema = S.event_schema()
    row = {f.name: None for f in schema}
    row.update(exe="/bin/Sh", record_type="CWD", timestamp=1.0, label=1, source="s", scenario="x")
    got = clean.clean_events(spark.createDataFrame([tuple(row[f.name] for f in schema)], schema)).first()
    assert (got["uid"], got["euid"], got["gid"], got["auid"], got["exe"], got["comm"]) == (0, 0, 0, 4294967295, "/bin/Sh", "Sh")
    assert (got["syscall_name"], got["failed"], got["host"], got["pid"]) == ("CWD", 0, "unknown_host", 0)
    assert not {"success", "key_tag", "name", "acct"} & set(got.asDict())


EVENT = "source string, scenario string, host string, pid bigint, ppid bigint, timestamp double, seq_id bigint, line_no bigint, uid bigint, euid bigint, " \
        "auid bigint, syscall_name string, failed int, exe string, label int, technique string"


def event(pid, t, uid=1000, euid=0, auid=1000, call="read", failed=0, exe="/bin/sh", label=0, technique="benign", ppid=0, n=0):
    return ("s", "x", "h", pid, ppid, t, n, n, uid, euid, auid, call, failed, exe, label, technique)


def test_rollup_hand_case(spark):
    ev = spark.createDataFrame([
        event(1, 10.0, call="execve", n=1), event(1, 10.5, call="setuid", failed=1, exe="/usr/sbin/nginx", label=1, technique="T1", n=2),
        event(2, 5.0, uid=0, exe="unknown", n=3), event(2, 5.0, uid=0, exe="/root/x", n=4), event(3, 1.0, n=5),
    ], EVENT)
    got = {r["pid"]: r for r in process.process_features(ev).collect()}
    assert sorted(got) == [1, 2]
    r = got[1]
    want = dict(lifetime_seconds=0.5, events_per_second=4.0, seq_length=2, unique_syscalls=2, uid_is_root=0, uid_changed=0, euid_root=1,
                max_uid_euid_delta=1000.0, is_suid_exec=1, auid_euid_mismatch=1, ephemeral_privileged=0, failed_call_rate=0.5, failed_call_count=1,
                priv_op_count=1, exec_count=1, file_access_count=0, network_count=0, shell_from_service=1, sensitive_path_access=0, label=1,
                technique="T1", proc_name="sh")
    assert {k: r[k] for k in want} == want
    assert r["parent_child_rarity"] == pytest.approx(1 - 2 / 4)  # pairs: root-sh twice, root-nginx, root-x
    assert (got[2]["events_per_second"], got[2]["proc_name"], got[2]["sensitive_path_access"], got[2]["ephemeral_privileged"]) == (2000.0, "", 1, 1)
    assert got[2]["parent_child_rarity"] == 1.0


def test_rollup_does_not_depend_on_layout(spark):
    rows = [event(i % 7, float(i * 37 % 101), uid=i % 3, exe=["/bin/sh", "unknown", "/usr/sbin/sshd"][i % 3], call=["execve", "open", "read"][i % 3],
                  label=int(i % 11 == 0), technique=f"T{i % 4}" if i % 11 == 0 else "benign", ppid=i % 2, n=i) for i in range(300)]
    ev = spark.createDataFrame(rows, EVENT)
    one, many = (sorted(map(tuple, process.process_features(ev.repartition(n)).collect()), key=repr) for n in (1, 37))
    assert one == many


def test_sequences(spark):
    rows = [event(1, float(i), call="execve" if i % 2 else "open", n=i) for i in range(60)] + [event(2, 1.0, uid=0, call="rare", n=100), event(2, 2.0, uid=5, n=101)]
    ev = spark.createDataFrame(rows, EVENT)
    vocab = sequence.build_vocabulary(ev)
    ids = {r["syscall_name"]: r["id"] for r in vocab.collect()}
    assert ids == {"execve": 2, "open": 3, "rare": 4, "read": 5}
    got = {r["pid"]: r for r in sequence.encode_sequences(ev, vocab.filter("syscall_name <> 'rare'")).collect()}
    assert len(got[1]["tokens"]) == 50 and len(got[2]["tokens"]) == 50 and got[1]["n_events"] == 60
    assert got[1]["tokens"][0] == [3, 2, 0, 0, 0, 0, 0] or got[1]["tokens"][0] == [3, 2, 0, 0, 0, 1, 0]
    assert got[1]["tokens"][-1] == [2, 2, 0, 0, 1, 0, 0]
    assert got[2]["tokens"][:48] == [[0] * 7] * 48 and got[2]["tokens"][48:] == [[1, 0, 0, 0, 0, 0, 0], [5, 1, 0, 0, 0, 0, 0]]


def test_vocabulary_is_a_dense_ranking(spark):
    rows = [(f"name{i % 83}",) for i in range(4000)] + [(f"x{i}",) for i in range(50)]
    df = spark.createDataFrame(rows, "syscall_name string")
    got = {r["syscall_name"]: r["id"] for r in sequence.build_vocabulary(df).collect()}
    from collections import Counter

    want = sorted(Counter(r[0] for r in rows).items(), key=lambda kv: (-kv[1], kv[0]))
    assert got == {name: i for i, (name, _) in enumerate(want, start=2)}


def test_streaming_rollup_matches_batch(spark, tmp_path):
    from hostlens.streaming.rollup import stream_process_features

    rows = [event(i % 3, 1000.0 + i, uid=i % 2, call=["execve", "open"][i % 2], n=i) for i in range(30)]
    rows.append(event(9, 100000.0, n=99))  # moves the watermark past the sessions above
    src = str(tmp_path / "events")
    spark.createDataFrame(rows[:-1], EVENT).coalesce(1).write.parquet(src)
    spark.createDataFrame(rows[-1:], EVENT).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([event(9, 100001.0, n=100)], EVENT).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src)
    q = (stream_process_features(stream).writeStream.format("memory").queryName("sessions").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    names = [f for f in S.FEATURES if f != "parent_child_rarity"]
    got = {r["pid"]: tuple(r[f] for f in names) for r in spark.table("sessions").collect()}
    batch = process.process_features(spark.createDataFrame(rows[:-1], EVENT))
    assert got == {r["pid"]: tuple(r[f] for f in names) for r in batch.collect()}
