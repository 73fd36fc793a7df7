"""Views over the driver tables that have the shape of telemetry, each with the same view in SQL.

`events` plays the raw audit feed, `lineitem` a large labelled table with heavy duplication and, with two
deterministic scores, the out-of-fold table of two detectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import hash_fraction
from hostlens.operators.clean import clean_events
from hostlens.operators.process import process_features
from hostlens.session import application_dir
from hostlens.sources.tables import reuse_or_build

DAY_US = 86_400_000_000


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """An intermediate of the pipeline, written to the shared folder and read by every later job until an input file changes."""
    return reuse_or_build(spark, stored_path(spark, sf_dir, name), lambda: build(spark, sf_dir), [f"{sf_dir}/*.parquet"])


def stored_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{application_dir(spark)}/{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}-{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events with the gaps real logs have."""
    k, us = F.col("k"), F.col("us")
    ev = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), micros("ts").alias("us"),
    )
    exes = ["/bin/bash", "/usr/sbin/nginx", "/usr/sbin/sshd", "/bin/SH", "/etc/shadow", None, "/usr/bin/su", "/root/run.sh"]
    exe = F.element_at(F.array(*[F.lit(e) for e in exes]), (k % 8 + 1).cast("int"))
    call = (
        F.when(F.col("event_type") == "signup", "execve").when(F.col("event_type") == "purchase", "setuid")
        .when(F.col("event_type") == "error", "connect").when(F.col("event_type") == "view", "openat").otherwise("read")
    )
    uid = F.when(k % 17 != 0, F.when(k % 10 == 0, 0).otherwise(1000 + k % 3))
    tag = F.when(k < 3, "T1548").when(k < 6, "T1078").when(k == 50, "auditlog")
    attack = k < 6
    return ev.select(
        F.lit("SYSCALL").alias("record_type"),
        (us / F.lit(1e6)).alias("timestamp"),
        F.col("event_id").alias("seq_id"),
        (F.col("user_id") * 100000 + F.floor(us / F.lit(DAY_US))).cast("bigint").alias("pid"),
        F.when(k % 19 != 0, F.when(k % 4 == 0, 0).otherwise(F.col("user_id"))).cast("bigint").alias("ppid"),
        uid.cast("bigint").alias("uid"),
        F.when(k % 11 != 0, F.when(k % 13 == 0, 0).otherwise(F.coalesce(uid, F.lit(0)))).cast("bigint").alias("euid"),
        F.when(k % 5 != 0, 100).cast("bigint").alias("gid"),
        F.when(k % 9 != 0, 1000 + k % 2).cast("bigint").alias("auid"),
        F.when(k % 3 != 0, F.concat(F.lit("c"), (k % 6).cast("string"))).alias("comm"),
        exe.alias("exe"),
        F.when(k % 23 != 0, call).alias("syscall_name"),
        tag.alias("key_tag"),
        F.when(k % 29 != 0, (F.col("event_type") == "error").cast("int")).alias("failed"),
        F.when(F.col("user_id") % 11 != 5, F.lit("feed")).alias("source"),
        F.when(F.col("user_id") % 13 != 4, F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string"))).alias("scenario"),
        F.when(F.col("user_id") % 50 != 7, F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string"))).alias("host"),
        F.when(attack, 1).otherwise(0).alias("label"),
        F.when(attack, tag).otherwise(F.lit("benign")).alias("technique"),
        F.col("event_id").alias("line_no"),
        "us", "user_id", "k", "event_type", "value",
    )


RAW = f"""ev AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events
), raw_events AS (
  SELECT 'SYSCALL' AS record_type, us / 1e6::DOUBLE AS "timestamp", event_id AS seq_id, user_id * 100000 + us // {DAY_US} AS pid,
    CASE WHEN k % 19 <> 0 THEN CASE WHEN k % 4 = 0 THEN 0 ELSE user_id END END AS ppid,
    CASE WHEN k % 17 <> 0 THEN CASE WHEN k % 10 = 0 THEN 0 ELSE 1000 + k % 3 END END AS uid,
    CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 13 = 0 THEN 0 ELSE
      coalesce(CASE WHEN k % 17 <> 0 THEN CASE WHEN k % 10 = 0 THEN 0 ELSE 1000 + k % 3 END END, 0) END END AS euid,
    CASE WHEN k % 5 <> 0 THEN 100 END AS gid,
    CASE WHEN k % 9 <> 0 THEN 1000 + k % 2 END AS auid,
    CASE WHEN k % 3 <> 0 THEN 'c' || (k % 6) END AS comm,
    (['/bin/bash', '/usr/sbin/nginx', '/usr/sbin/sshd', '/bin/SH', '/etc/shadow', NULL, '/usr/bin/su', '/root/run.sh'])[k % 8 + 1] AS exe,
    CASE WHEN k % 23 <> 0 THEN CASE event_type WHEN 'signup' THEN 'execve' WHEN 'purchase' THEN 'setuid' WHEN 'error' THEN 'connect'
      WHEN 'view' THEN 'openat' ELSE 'read' END END AS syscall_name,
    CASE WHEN k < 3 THEN 'T1548' WHEN k < 6 THEN 'T1078' WHEN k = 50 THEN 'auditlog' END AS key_tag,
    CASE WHEN k % 29 <> 0 THEN CAST(event_type = 'error' AS INT) END AS failed,
    CASE WHEN user_id % 11 <> 5 THEN 'feed' END AS source, CASE WHEN user_id % 13 <> 4 THEN 's' || (user_id % 7) END AS scenario,
    CASE WHEN user_id % 50 <> 7 THEN 'h' || (user_id % 5) END AS host,
    CASE WHEN k < 6 THEN 1 ELSE 0 END AS label,
    CASE WHEN k < 3 THEN 'T1548' WHEN k < 6 THEN 'T1078' ELSE 'benign' END AS technique,
    event_id AS line_no, us, user_id, k, event_type, value
  FROM ev
)"""


def labeled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_events(raw_events(spark, sf_dir))


CLEAN = RAW + """, clean AS (
  SELECT record_type, "timestamp", seq_id, pid, coalesce(ppid, 0) AS ppid, coalesce(uid, 0) AS uid, coalesce(euid, uid, 0) AS euid,
    coalesce(gid, uid, 0) AS gid, coalesce(auid, 4294967295) AS auid,
    coalesce(comm, CASE WHEN exe IS NULL THEN 'unknown' ELSE split_part(exe, '/', -1) END) AS comm, coalesce(exe, 'unknown') AS exe,
    coalesce(syscall_name, record_type, 'unknown') AS syscall_name, coalesce(failed, 0) AS failed, coalesce(source, 'unknown') AS source,
    coalesce(scenario, 'unknown') AS scenario,
    coalesce(host, 'unknown_host') AS host, label, technique, line_no, us, user_id, k, event_type, value,
    CASE WHEN exe IS NULL THEN '' ELSE lower(split_part(exe, '/', -1)) END AS child
  FROM raw_events
)"""


def build_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_features(labeled_events(spark, sf_dir))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "features", build_features)


FEATURES = CLEAN + """, pairs AS (
  SELECT CASE WHEN ppid = 0 THEN '__root__' ELSE child END AS parent, child, count(*) AS pairs FROM clean WHERE child <> '' GROUP BY ALL
), grouped AS (
  SELECT source, scenario, host, pid, greatest(max("timestamp") - min("timestamp"), 0.001::DOUBLE) AS dur, count(*) AS n,
    count(DISTINCT syscall_name) AS unique_syscalls, CAST(bool_or(uid = 0) AS INT) AS uid_is_root,
    CAST(count(DISTINCT uid) > 1 AS INT) AS uid_changed, CAST(bool_or(euid = 0) AS INT) AS euid_root,
    max(abs(euid - uid))::DOUBLE AS max_uid_euid_delta, CAST(bool_or(uid <> 0 AND euid = 0) AS INT) AS is_suid_exec,
    CAST(bool_or(auid < 65534 AND euid = 0 AND auid <> euid) AS INT) AS auid_euid_mismatch,
    avg(failed) AS failed_mean, sum(failed)::BIGINT AS failed_call_count,
    count(*) FILTER (syscall_name IN ('setuid','setgid','setreuid','setregid','setresuid','setresgid','capset','ptrace','chown',
      'fchown','lchown','fchownat','chmod','fchmod','fchmodat')) AS priv_op_count,
    count(*) FILTER (syscall_name IN ('execve','execveat')) AS exec_count,
    count(*) FILTER (syscall_name IN ('openat','open','creat','rename','renameat','unlink','unlinkat','mkdir','mkdirat','rmdir',
      'link','symlink')) AS file_access_count,
    count(*) FILTER (syscall_name IN ('connect','bind','accept','accept4','socket')) AS network_count,
    CAST(bool_or(child IN ('bash','sh','dash','zsh','fish','csh','tcsh')) AND bool_or(child IN ('apache2','nginx','vsftpd','sshd',
      'mysqld','postgres','php-fpm','httpd','www-data','apache','tomcat')) AS INT) AS shell_from_service,
    CAST(bool_or(starts_with(exe, '/etc/shadow') OR starts_with(exe, '/etc/passwd') OR starts_with(exe, '/etc/sudoers')
      OR starts_with(exe, '/root/') OR starts_with(exe, '/.ssh/authorized_keys') OR starts_with(exe, '/proc/mem')) AS INT) AS sensitive_path_access,
    max(label) AS label,
    coalesce(first(technique ORDER BY "timestamp", seq_id, line_no) FILTER (label = 1), first(technique ORDER BY "timestamp", seq_id, line_no)) AS technique,
    first(child ORDER BY "timestamp", seq_id, line_no) AS proc_name, first(ppid ORDER BY "timestamp", seq_id, line_no) AS ppid
  FROM clean GROUP BY source, scenario, host, pid HAVING count(*) >= 2
), features AS (
  SELECT g.source, g.scenario, g.host, g.pid, round(dur, 3) AS lifetime_seconds, round(n / dur, 3) AS events_per_second, n AS seq_length,
    unique_syscalls, uid_is_root, uid_changed, euid_root, round(max_uid_euid_delta, 1) AS max_uid_euid_delta, is_suid_exec,
    auid_euid_mismatch, CAST(dur < 2.0 AND uid_is_root = 1 AS INT) AS ephemeral_privileged, round(failed_mean, 4) AS failed_call_rate,
    failed_call_count, priv_op_count, exec_count, file_access_count, network_count, shell_from_service, sensitive_path_access,
    round(1.0::DOUBLE - coalesce(p.pairs, 0) / greatest((SELECT sum(pairs) FROM pairs), 1)::DOUBLE, 6) AS parent_child_rarity,
    label, technique, proc_name
  FROM grouped g LEFT JOIN pairs p ON p.child = g.proc_name AND p.parent = CASE WHEN g.ppid = 0 THEN '__root__' ELSE g.proc_name END
)"""

PROFILE_FEATURES = S.FEATURES


def melted_sql(source: str, ids: str, features: list[str]) -> str:
    """UNION ALL melt of `source` in SQL."""
    return " UNION ALL ".join(f"SELECT {ids}, '{f}' AS feature, {f}::DOUBLE AS value FROM {source}" for f in features)


MELTED = FEATURES + ", melted AS (" + melted_sql("features", "label, source, pid", PROFILE_FEATURES) + ")"


def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a labelled feature table with a row id."""
    day = F.floor(micros("l_shipdate") / F.lit(DAY_US)).cast("bigint")
    label = (F.col("l_returnflag") == "R").cast("int")
    row_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day)
    return table(spark, sf_dir, "lineitem").select(
        row_id.alias("row_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        label.alias("label"),
        F.when(label == 1, F.concat(F.lit("T"), (F.col("l_suppkey") % 6).cast("string"))).otherwise("benign").alias("technique"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("proc_name"),
        F.col("l_linestatus").alias("source"),
        F.year("l_shipdate").alias("year"),
    )


WIDE_FEATURES = ["quantity", "price", "discount", "tax"]
GROUP_FEATURES = ["quantity", "discount", "tax"]  # heavily duplicated vectors

WIDE = f"""wide AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) // {DAY_US}) AS row_id,
    l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
    CAST(l_returnflag = 'R' AS INT) AS label, CASE WHEN l_returnflag = 'R' THEN 'T' || (l_suppkey % 6) ELSE 'benign' END AS technique,
    'p' || (l_partkey % 40) AS proc_name, l_linestatus AS source, year(l_shipdate)::INT AS "year"
  FROM lineitem
)"""


def hash_fraction_sql(seed: int | str, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def hash_order_sql(seed: int | str, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def oof_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "oof", build_oof)


def build_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detectors' out-of-fold scores with a planted signal, ties, folds and a few rows never predicted."""
    wide = wide_table(spark, sf_dir)
    base = wide.withColumnRenamed("label", "true_label").withColumns({
        "fold": F.floor(hash_fraction(7, "row_id") * 5).cast("int"),
        "proba_xgb": F.round(hash_fraction(1, "row_id") * 0.65 + F.col("true_label") * 0.3, 2),
        "proba_cnn": F.round(hash_fraction(2, "row_id") * 0.8 + F.col("true_label") * 0.15, 3),
    })
    unseen = hash_fraction(3, "row_id") < 0.01
    return base.withColumns({
        "pred_xgb": (F.col("proba_xgb") >= 0.5).cast("int"),
        "pred_cnn": F.when(unseen, -1).otherwise((F.col("proba_cnn") >= 0.45).cast("int")),
    })


OOF = WIDE + f""", oof0 AS (
  SELECT * EXCLUDE (label), label AS true_label, floor({hash_fraction_sql(7, 'row_id')} * 5)::INT AS fold,
    round({hash_fraction_sql(1, 'row_id')} * 0.65::DOUBLE + label * 0.3::DOUBLE, 2) AS proba_xgb,
    round({hash_fraction_sql(2, 'row_id')} * 0.8::DOUBLE + label * 0.15::DOUBLE, 3) AS proba_cnn
  FROM wide
), oof AS (
  SELECT *, CAST(proba_xgb >= 0.5 AS INT) AS pred_xgb,
    CASE WHEN {hash_fraction_sql(3, 'row_id')} < 0.01 THEN -1 ELSE CAST(proba_cnn >= 0.45 AS INT) END AS pred_cnn
  FROM oof0
)"""


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"
