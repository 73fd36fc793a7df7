"""Queries: audit text to records, events, processes, features and sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import hash_fraction
from hostlens.operators import clean, cumulative, process, sequence
from hostlens.plans import views as V
from hostlens.plans.catalogue import query
from hostlens.session import application_dir, cut_lineage
from hostlens.sources import audit
from hostlens.sources.tables import Dataset, Registry, read_events, write_table
from hostlens.sources.tensors import read_tensors, write_tensors
from hostlens.streaming.rollup import run_sessions

# --- audit text, written from the events table and parsed back -----------------------------------------


def audit_lines(spark, sf_dir) -> DataFrame:
    """Three lines per event: the call, a companion record, and a dropped or broken line."""
    us, k = F.col("us"), F.col("k")
    ms = F.lpad((F.floor(us / 1000) % 1000).cast("string"), 3, "0")
    stamp = F.concat(F.lit("msg=audit("), F.floor(us / 1000000).cast("string"), F.lit("."), ms, F.lit(":"), F.col("seq_id"), F.lit("):"))

    def part(name, value, quote=False):
        q = '"' if quote else ""
        return F.concat(F.lit(f"{name}={q}"), value, F.lit(q))

    call = F.concat_ws(
        " ", F.concat(F.lit("type=SYSCALL "), stamp),
        F.when(F.col("failed") == 1, "success=no").otherwise("success=yes"),
        part("ppid", F.col("ppid")), F.when(k % 31 != 0, part("pid", F.col("pid"))), part("auid", F.col("auid")),
        part("uid", F.col("uid")), part("gid", F.col("gid")), part("euid", F.col("euid")),
        part("comm", F.col("comm"), True), part("exe", F.col("exe"), True), part("key", F.col("key_tag"), True),
        part("SYSCALL", F.col("syscall_name")),
    )
    companion = F.concat(F.lit("type=PATH "), stamp, F.lit(' item=0 name="/etc/shadow"'))
    rest = F.when(k % 2 == 0, F.concat(F.lit("type=PROCTITLE "), stamp, F.lit(" proctitle=7375"))).otherwise(F.lit("garbage line"))
    file = F.when(F.col("user_id") % 50 == 7, F.lit("/corpus/misc/audit.log")).otherwise(F.concat(
        F.lit("/corpus/scenario_"), (F.col("user_id") % 7).cast("string"), F.lit("-"), (F.col("user_id") % 3).cast("string"), F.lit("/host"),
        (F.col("user_id") % 5).cast("string"), F.lit("/logs/log/audit/audit.log")))
    return V.raw_events(spark, sf_dir).select(
        file.alias("file"), F.col("seq_id").alias("_seq"), F.posexplode(F.array(call, companion, rest)).alias("_i", "value")
    ).select("value", "file", (F.col("_seq") * 4 + F.col("_i")).alias("line_no"))


def _part(name, value, quote=False):
    q = '"' if quote else ""
    return f"'{name}={q}' || {value} || '{q}'"


LINES = V.RAW + f""", stamped AS (
  SELECT *, 'msg=audit(' || (us // 1000000) || '.' || lpad(((us // 1000) % 1000)::VARCHAR, 3, '0') || ':' || seq_id || '):' AS stamp,
    CASE WHEN user_id % 50 = 7 THEN '/corpus/misc/audit.log' ELSE '/corpus/scenario_' || (user_id % 7) || '-' || (user_id % 3) || '/host' ||
      (user_id % 5) || '/logs/log/audit/audit.log' END AS file
  FROM raw_events
), lines AS (
  SELECT file, seq_id * 4 AS line_no, concat_ws(' ', 'type=SYSCALL ' || stamp,
      CASE WHEN failed = 1 THEN 'success=no' ELSE 'success=yes' END, {_part('ppid', 'ppid')},
      CASE WHEN k % 31 <> 0 THEN {_part('pid', 'pid')} END, {_part('auid', 'auid')}, {_part('uid', 'uid')}, {_part('gid', 'gid')},
      {_part('euid', 'euid')}, {_part('comm', 'comm', True)}, {_part('exe', 'exe', True)}, {_part('key', 'key_tag', True)},
      {_part('SYSCALL', 'syscall_name')}) AS value FROM stamped
  UNION ALL SELECT file, seq_id * 4 + 1, 'type=PATH ' || stamp || ' item=0 name="/etc/shadow"' FROM stamped
  UNION ALL SELECT file, seq_id * 4 + 2, CASE WHEN k % 2 = 0 THEN 'type=PROCTITLE ' || stamp || ' proctitle=7375' ELSE 'garbage line' END FROM stamped
), parsed AS (
  SELECT file, line_no, regexp_extract(value, '^type=(\\S+)', 1) AS record_type,
    regexp_extract(value, 'msg=audit\\(([\\d.]+):(\\d+)\\)', 1)::DOUBLE AS "timestamp",
    regexp_extract(value, 'msg=audit\\(([\\d.]+):(\\d+)\\)', 2)::BIGINT AS seq_id,
    {', '.join(f"try_cast(nullif(regexp_extract(value, '{chr(92)}b{f}=({chr(92)}d+)', 1), '') AS BIGINT) AS {f}" for f in audit.ID_FIELDS)},
    {', '.join(f"nullif(regexp_extract(value, '{chr(92)}b{f}={chr(34)}([^{chr(34)}]*){chr(34)}', 1), '') AS {f}" for f in audit.TEXT_FIELDS)},
    coalesce(nullif(regexp_extract(value, 'SYSCALL=(\\w+)', 1), ''), regexp_extract(value, '^type=(\\S+)', 1)) AS syscall_name,
    nullif(regexp_extract(value, 'key="?([^"\\s]+)"?', 1), '') AS key_tag,
    contains(value, 'success=yes') OR contains(value, 'res=success') AS success,
    1 - CAST(contains(value, 'success=yes') OR contains(value, 'res=success') AS INT) AS failed,
    CASE WHEN contains(file, 'scenario') THEN regexp_extract(file, '([^/]*scenario[^/]*)', 1) ELSE 'unknown' END AS scenario,
    coalesce(nullif(regexp_extract(file, '([^/]+)/logs/', 1), ''), 'unknown_host') AS host
  FROM lines WHERE regexp_matches(value, '^type=\\S+') AND regexp_matches(value, 'msg=audit\\([\\d.]+:\\d+\\)')
    AND regexp_extract(value, '^type=(\\S+)', 1) <> 'PROCTITLE'
)"""

STAMPED = LINES + """, firsts AS (
  SELECT file, seq_id, min(line_no) AS event_line, arg_min(coalesce(pid, -1), line_no) AS first_pid FROM parsed GROUP BY file, seq_id
), stamped2 AS (
  SELECT p.* EXCLUDE (pid), f.first_pid AS pid, f.event_line FROM parsed p JOIN firsts f USING (file, seq_id) WHERE f.first_pid >= 0
)"""

PROCS = STAMPED + """, procs AS (
  SELECT file, pid, count(*) AS n_events, max(scenario) AS scenario,
    coalesce(first(key_tag ORDER BY event_line, line_no) FILTER (key_tag IS NOT NULL AND key_tag NOT IN ('auditlog','(null)','user_commands','watch_home')), 'benign') AS technique,
    CAST(count(*) FILTER (key_tag IS NOT NULL AND key_tag NOT IN ('auditlog','(null)','user_commands','watch_home')) > 0 AS INT) AS label
  FROM stamped2 GROUP BY file, pid
)"""


def parsed(spark, sf_dir) -> DataFrame:
    return audit.tag_origin(audit.parse_lines(audit_lines(spark, sf_dir)), "feed")


def stamped(spark, sf_dir) -> DataFrame:
    return audit.stamp_event_pid(V.stored(spark, sf_dir, "records", parsed))


def processes(spark, sf_dir) -> DataFrame:
    """Checkpointed: every later step reads the process table several times and must not parse again."""
    return cut_lineage(audit.label_processes(stamped(spark, sf_dir), ["scenario"]))


@query("audit_parse", V.sql(LINES, "SELECT *, 'feed' AS source FROM parsed"))
def audit_parse(spark, sf_dir):
    return parsed(spark, sf_dir)


def scanned(spark, sf_dir) -> DataFrame:
    """The same lines written as a tree of audit.log files, scanned and parsed."""
    root = f"{application_dir(spark)}/tree-{uuid.uuid4().hex}"
    audit.write_audit_tree(audit_lines(spark, sf_dir), root)
    lines = audit.numbered_lines(spark, root).withColumn("file", F.substring_index("file", root.rsplit("/", 1)[-1], -1))
    return audit.tag_origin(audit.parse_lines(lines), "feed")


@query("audit_scan", V.sql(LINES + """, numbers AS (SELECT file, line_no, row_number() OVER (PARTITION BY file ORDER BY line_no) AS number FROM lines)""", """SELECT p.* REPLACE (n.number AS line_no), 'feed' AS source FROM parsed p JOIN numbers n USING (file, line_no)"""))
def audit_scan(spark, sf_dir):
    return scanned(spark, sf_dir)


SESSION_GAP_HOURS = 6
SESSION_FILES = 6
_SESSIONS = V.FEATURES.replace("), grouped AS (", f"""), starts AS (
  SELECT *, coalesce("timestamp" - lag("timestamp") OVER w > {SESSION_GAP_HOURS * 3600}, true)::INT AS is_start FROM clean WINDOW w AS (PARTITION BY source, scenario, host, pid ORDER BY "timestamp")
), sess AS (
  SELECT *, sum(is_start) OVER (PARTITION BY source, scenario, host, pid ORDER BY "timestamp") AS session FROM starts
), grouped AS (""").replace("FROM clean GROUP BY source, scenario, host, pid HAVING", "FROM sess GROUP BY source, scenario, host, pid, session HAVING").replace(
    "SELECT source, scenario, host, pid, greatest(", "SELECT source, scenario, host, pid, min(us) AS session_us, g.greatest(").replace("g.greatest(", "greatest(").replace(
    "SELECT g.source, g.scenario,", "SELECT g.session_us, g.ppid, g.source, g.scenario,")


@query("session_features", V.sql(_SESSIONS, "SELECT * EXCLUDE (parent_child_rarity) FROM features"))
def session_features(spark, sf_dir):
    """The roll-up on a stream: files that arrive in order, several micro-batches, a stop and a restart from the checkpoint."""
    folder = f"{application_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = cut_lineage(V.labeled_events(spark, sf_dir).drop("us", "user_id", "k", "event_type", "value"))
    low, high = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / SESSION_FILES + 1e-3
    for half in (range(SESSION_FILES // 2), range(SESSION_FILES // 2, SESSION_FILES)):
        for i in half:
            part = events.filter((F.col("timestamp") >= low + i * width) & (F.col("timestamp") < low + (i + 1) * width))
            part.coalesce(1).write.mode("append").parquet(f"{folder}/in")  # what arrived in one interval
        if half.stop == SESSION_FILES:  # an event far ahead closes the last sessions; its own stays open
            last = events.limit(1).withColumns({"timestamp": F.lit(high + 100 * 3600 * SESSION_GAP_HOURS), "pid": F.lit(-1).cast("bigint")})
            last.write.mode("append").parquet(f"{folder}/in")
        run_sessions(spark, events.schema, f"{folder}/in", f"{folder}/out", f"{folder}/state", f"{SESSION_GAP_HOURS} hours")
    found = spark.read.parquet(f"{folder}/out")
    return found.select(F.unix_micros("session_start").alias("session_us"), *[c for c in found.columns if c != "session_start"])


@query("scenario_family", V.sql(LINES, r"""SELECT regexp_replace(scenario, '-[\d_]+$', '') AS family, count(DISTINCT scenario) AS n_trials,
  count(*) AS n_records FROM parsed GROUP BY 1"""))
def scenario_families(spark, sf_dir):
    rec = parsed(spark, sf_dir).withColumn("family", audit.scenario_family(F.col("scenario")))
    return rec.groupBy("family").agg(F.count_distinct("scenario").alias("n_trials"), F.count(F.lit(1)).alias("n_records"))


@query("event_pid_stamp", V.sql(STAMPED, "SELECT file, line_no, seq_id, record_type, pid, event_line FROM stamped2"))
def event_pid_stamp(spark, sf_dir):
    return stamped(spark, sf_dir).select("file", "line_no", "seq_id", "record_type", "pid", "event_line")


@query("process_label", V.sql(PROCS, "SELECT file, pid, n_events, scenario, technique, label FROM procs"))
def process_label(spark, sf_dir):
    return processes(spark, sf_dir)


@query("labeled_records", V.sql(PROCS, """SELECT s.file, s.line_no, s.pid, p.label, p.technique FROM stamped2 s
  JOIN procs p ON s.file = p.file AND s.pid = p.pid WHERE p.n_events >= 3"""))
def labeled_records(spark, sf_dir):
    rec = cut_lineage(stamped(spark, sf_dir))
    procs = audit.label_processes(rec).filter(F.col("n_events") >= 3)
    return audit.label_records(rec, procs).select("file", "line_no", "pid", "label", "technique")


@query("extract_sample", V.sql(PROCS, f""", long AS (SELECT * FROM procs WHERE n_events >= 4
), capped AS (SELECT * FROM long WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY {V.hash_order_sql(42, 'file', 'pid::VARCHAR')}, file, pid) <= 60
  UNION ALL SELECT * FROM long WHERE label = 1 QUALIFY row_number() OVER (PARTITION BY technique ORDER BY {V.hash_order_sql(42, 'file', 'pid::VARCHAR')}, file, pid) <= 100
), drawn AS (SELECT * FROM capped WHERE label = 1 UNION ALL SELECT * FROM capped WHERE label = 0
  QUALIFY row_number() OVER (ORDER BY {V.hash_order_sql(42, 'file', 'pid::VARCHAR')}, file, pid) <= (SELECT floor(count(*) * 1.5) FROM capped WHERE label = 1))
SELECT s.file, s.line_no, s.pid, s.record_type, s.syscall_name, p.label, p.technique FROM stamped2 s JOIN drawn p ON s.file = p.file AND s.pid = p.pid"""))
def extract_sample(spark, sf_dir):
    """The extraction job as one plan: parse, stamp, label, minimum length, caps, ratio, then the records of the drawn processes."""
    rec = cut_lineage(stamped(spark, sf_dir))
    drawn = audit.draw_processes(audit.label_processes(rec, ["scenario"]), 4, 60, 100, 1.5, 42)
    return audit.label_records(rec, drawn).select("file", "line_no", "pid", "record_type", "syscall_name", "label", "technique")


@query("process_lengths", V.sql(PROCS, """SELECT label, count(*) AS n, median(n_events)::DOUBLE AS median_events,
  round(avg(n_events), 6) AS mean_events, max(n_events) AS max_events, round(avg(CAST(n_events = 2 AS INT)), 6) AS single_share,
  count(*) FILTER (n_events >= 4) AS n_viable FROM procs GROUP BY label"""))
def process_lengths(spark, sf_dir):
    """Length profile by class; one event of this feed is two records."""
    procs = processes(spark, sf_dir)
    sizes = procs.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("n_events"), 6).alias("mean_events"), F.max("n_events").alias("max_events"),
        F.round(F.avg((F.col("n_events") == 2).cast("int")), 6).alias("single_share"),
        F.count_if(F.col("n_events") >= 4).alias("n_viable"),
    )
    med = cumulative.wide_quantiles(cumulative.value_counts(procs, ["label"], "n_events"), ["label"], "n_events", {"median_events": 50})
    return sizes.join(med.withColumn("median_events", F.col("median_events").cast("double")), "label")


# --- cleaning and roll-up -------------------------------------------------------------------------------

_CLEAN_COLS = ["record_type", "timestamp", "seq_id", "pid", "ppid", "uid", "euid", "gid", "auid", "comm", "exe", "syscall_name", "failed",
               "source", "scenario", "host", "label", "technique", "line_no"]


@query("clean_defaults", V.sql(V.CLEAN, "SELECT " + ", ".join(f'"{c}"' for c in _CLEAN_COLS) + " FROM clean"))
def clean_defaults(spark, sf_dir):
    return V.labeled_events(spark, sf_dir).select(*_CLEAN_COLS)


_CSV_COLS = [c for c in _CLEAN_COLS if c not in ("timestamp",)]


@query("event_csv_scan", V.sql(V.RAW, "SELECT " + ", ".join(f'"{c}"' for c in _CSV_COLS) + " FROM raw_events"))
def event_csv_scan(spark, sf_dir):
    """Raw events written as CSV and read back with the declared schema; gaps stay gaps."""
    raw, wanted = V.raw_events(spark, sf_dir), S.event_schema()
    whole = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
    path = V.stored_path(spark, sf_dir, "events-csv")
    write_table(whole, path, "csv")
    return read_events(spark, path, "csv").select(*_CSV_COLS)


@query("core_null_audit", V.sql(V.RAW, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null FROM raw_events" for c in ["pid", "uid", "euid", "failed", "label"])))
def core_null_audit(spark, sf_dir):
    return clean.null_audit(V.raw_events(spark, sf_dir), ["pid", "uid", "euid", "failed", "label"])


@query("process_features", V.sql(V.FEATURES, "SELECT * FROM features"))
def features(spark, sf_dir):
    return V.build_features(spark, sf_dir)


@query("pair_rarity", V.sql(V.FEATURES, """SELECT parent, child, pairs,
  round(1.0::DOUBLE - pairs / greatest((SELECT sum(pairs) FROM pairs), 1)::DOUBLE, 6) AS rarity FROM pairs"""))
def pair_rarity(spark, sf_dir):
    pairs = process.pair_counts(V.labeled_events(spark, sf_dir))
    total = pairs.agg(F.sum("pairs").alias("t")).scalar()
    return pairs.withColumn("rarity", F.round(1.0 - F.col("pairs") / F.greatest(total, F.lit(1)), 6))


_PARENTS = """named AS (SELECT source, scenario, host, pid, ppid, "timestamp", child FROM clean WHERE child <> ''),
  owners AS (SELECT source, scenario, host, pid, first(child ORDER BY "timestamp", child) AS parent FROM named GROUP BY source, scenario, host, pid)"""


@query("pair_rarity_true_parent", V.sql(V.CLEAN + ", " + _PARENTS, """SELECT coalesce(o.parent, '__root__') AS parent, n.child, count(*) AS pairs
  FROM named n LEFT JOIN owners o ON o.source = n.source AND o.scenario = n.scenario AND o.host = n.host AND o.pid = n.ppid GROUP BY ALL"""))
def pair_rarity_true_parent(spark, sf_dir):
    """Corrected mode; in this feed parent ids name pids of the same user's first day."""
    return process.true_pair_counts(V.labeled_events(spark, sf_dir))


# --- sequences ------------------------------------------------------------------------------------------

VOCAB = V.CLEAN + """, vocab AS (
  SELECT syscall_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, syscall_name) + 1 AS id FROM clean GROUP BY syscall_name
)"""


@query("syscall_vocab", V.sql(VOCAB, "SELECT syscall_name, n, id FROM vocab"))
def syscall_vocab(spark, sf_dir):
    return sequence.build_vocabulary(V.labeled_events(spark, sf_dir))


_HALF = """, half_vocab AS (
  SELECT syscall_name, row_number() OVER (ORDER BY count(*) DESC, syscall_name) + 1 AS id FROM clean WHERE """ + V.hash_fraction_sql(5, "pid::VARCHAR", "syscall_name") + """ < 0.5 GROUP BY syscall_name
)"""


_TOKENS = V.CLEAN + _HALF + """, ranked AS (
  SELECT c.*, v.id, row_number() OVER (PARTITION BY source, scenario, host, pid ORDER BY "timestamp" DESC, seq_id DESC, line_no DESC) AS pos,
    count(*) OVER (PARTITION BY source, scenario, host, pid) AS n_events
  FROM clean c LEFT JOIN half_vocab v USING (syscall_name)
), toks AS (
  SELECT *, concat_ws(',', coalesce(id, 1), CASE WHEN uid = 0 THEN 0 WHEN uid < 1000 THEN 1 ELSE 2 END, failed,
    CAST(syscall_name = 'setuid' AS INT), CAST(syscall_name = 'execve' AS INT), CAST(syscall_name = 'openat' AS INT),
    CAST(syscall_name = 'connect' AS INT)) AS tok FROM ranked WHERE n_events >= 2
), sequences AS (
  SELECT source, scenario, host, pid, max(n_events) AS n_events, repeat('0,0,0,0,0,0,0;', (50 - least(max(n_events), 50))::INT)
    || string_agg(tok, ';' ORDER BY pos DESC) FILTER (pos <= 50) AS tokens, max(label) AS label FROM toks GROUP BY source, scenario, host, pid
)"""


def half_known(spark, sf_dir) -> DataFrame:
    """Sequences whose vocabulary comes from half of the (process, call) pairs; names outside it are unknown."""
    events = V.labeled_events(spark, sf_dir)
    vocabulary = sequence.build_vocabulary(events.filter(hash_fraction(5, "pid", "syscall_name") < 0.5))
    return sequence.encode_sequences(events, vocabulary)


def token_text() -> Column:
    return F.array_join(F.transform("tokens", lambda t: F.array_join(F.transform(t, lambda x: x.cast("string")), ",")), ";")


@query("sequence_tokens", V.sql(_TOKENS, "SELECT source, scenario, host, pid, n_events, tokens FROM sequences"))
def sequence_tokens(spark, sf_dir):
    """Token arrays as text."""
    return half_known(spark, sf_dir).select(*process.PROCESS_KEY, "n_events", token_text().alias("tokens"))


EXPORT_BLOCK = 1024


@query("sequence_export", V.sql(_TOKENS, """SELECT source, scenario, host, pid, label, n_events, tokens, 1::BIGINT AS n_same_place, (SELECT count(*) FROM sequences) AS places FROM sequences"""))
def sequence_export(spark, sf_dir):
    """Sequences written as tensor blocks with their meta rows and read back; every place in the tensor is taken once."""
    path = f"{application_dir(spark)}/tensors-{uuid.uuid4().hex}"
    write_tensors(half_known(spark, sf_dir), path, "tokens", (S.MAX_SEQUENCE, S.TOKEN_WIDTH), EXPORT_BLOCK)
    rows = read_tensors(spark, path)
    taken = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n_same_place"))
    places = taken.agg((F.max("row") - F.min("row") + 1).alias("n")).scalar()
    return rows.join(taken, "row").select(*process.PROCESS_KEY, "label", "n_events", token_text().alias("tokens"), "n_same_place", places.alias("places"))


@query("sequence_labels", V.sql(V.FEATURES, "SELECT source, scenario, host, pid, label, technique, seq_length AS n_events FROM features"))
def sequence_labels(spark, sf_dir):
    events = V.labeled_events(spark, sf_dir)
    seqs = sequence.encode_sequences(events, sequence.build_vocabulary(events))
    return seqs.select(*process.PROCESS_KEY, "label", "technique", "n_events")


@query("technique_exclusion", V.sql(V.FEATURES, """SELECT technique, label, count(*) AS n FROM features
  WHERE label = 0 OR technique IS NULL OR technique NOT IN ('T1078') GROUP BY technique, label"""))
def technique_exclusion(spark, sf_dir):
    kept = clean.exclude_techniques(V.feature_table(spark, sf_dir), ["T1078"])
    return kept.groupBy("technique", "label").agg(F.count(F.lit(1)).alias("n"))


_FILE_SPELLINGS = {"label": ["is_attack", "class"], "technique": ["attack_technique"], "seq_length": ["n_events"]}
_FILE_COLUMNS = [*S.FEATURES, "label", "source", "technique", "proc_name"]
_FILED = ", ".join(
    f"CASE WHEN pid % 3 <> 2 THEN {c} END AS {c}" if c in S.PARTIAL_FEATURES else f"nullif({c}, '') AS {c}" if c == "proc_name" else c for c in _FILE_COLUMNS)


@query("ingest_files", V.sql(V.FEATURES, f"""SELECT {_FILED}, (['plain', 'loud', 'partial'])[(pid % 3)::INT + 1] AS layout FROM features
  WHERE label = 0 OR technique IS NULL OR technique NOT IN ('T1078')"""))
def ingest_files(spark, sf_dir):
    """The feature table in files of three layouts (as declared; other names, case and order; features missing), ingested by name."""
    root = f"{application_dir(spark)}/registry-{uuid.uuid4().hex}"
    plain, other, partial = (V.feature_table(spark, sf_dir).filter(F.col("pid") % 3 == i) for i in range(3))
    loud = {"label": "IS_ATTACK", "technique": "Attack_Technique"}
    layouts = {
        "plain": plain.select(*_FILE_COLUMNS),
        "loud": other.select(*[F.col(c).alias(loud.get(c, c.upper())) for c in reversed(_FILE_COLUMNS)]),
        "partial": partial.drop(*S.PARTIAL_FEATURES).withColumnsRenamed({"label": "class", "seq_length": "n_events"}),
    }
    for name, table in layouts.items():
        write_table(table, f"{root}/layout_{name}", "csv")
    registry = Registry({"files": Dataset(root, exclude=("T1078",), spellings=_FILE_SPELLINGS, from_path={"layout": r"/layout_([a-z]+)/"})})
    return registry.ingest(spark, "files")[0]


@query("schema_compat", """WITH n AS (
  SELECT 'l_orderkey' AS feature, (SELECT count(l_orderkey) FROM lineitem) AS n_a, 0::BIGINT AS n_b UNION ALL
  SELECT 'l_quantity', (SELECT count(l_quantity) FROM lineitem), 0 UNION ALL SELECT 'o_totalprice', 0, (SELECT count(o_totalprice) FROM orders) UNION ALL
  SELECT 'nowhere', 0, 0 UNION ALL SELECT 'row_key', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM orders))
SELECT feature, n_a, n_b, n_a > 0 AS in_a, n_b > 0 AS in_b, CASE WHEN n_a > 0 AND n_b > 0 THEN 'Direct (native to both)'
  WHEN n_a > 0 THEN 'Unavailable in b' WHEN n_b > 0 THEN 'Unavailable in a' ELSE 'Not present in either' END AS status FROM n""")
def schema_compat(spark, sf_dir):
    a = V.table(spark, sf_dir, "lineitem").withColumn("row_key", F.col("l_orderkey"))
    b = V.table(spark, sf_dir, "orders").withColumns({"row_key": F.col("o_orderkey"), "l_quantity": F.lit(None).cast("double")})
    return clean.schema_compatibility(a, b, "a", "b", ["l_orderkey", "l_quantity", "o_totalprice", "nowhere", "row_key"])


_LEAK_COLUMNS = {
    "events": ["event_id", "user_id", "ts", "event_type", "value", "props"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"],
}


@query("identifier_leak", "WITH n AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n_values FROM {t}" for t, cs in _LEAK_COLUMNS.items() for c in cs)
       + ") SELECT feature, n_values, CAST(len(list_intersect(string_split(lower(feature), '_'), ['" + "','".join(S.IDENTIFIER_TOKENS) + "'])) > 0 AS INT) AS suspect FROM n")
def identifier_leak(spark, sf_dir):
    parts = [clean.identifier_leaks(V.table(spark, sf_dir, t).select(*cs)) for t, cs in _LEAK_COLUMNS.items()]
    return parts[0].unionByName(parts[1])
