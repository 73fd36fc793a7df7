"""Audit logs: text scan, line parsing, event and process assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import blank_to_null, flag
from hostlens.operators.joins import join_groups
from hostlens.operators.sampling import cap_per_stratum, ratio_sample
from hostlens.session import cut_lineage

ID_FIELDS = ["pid", "ppid", "uid", "euid", "auid", "gid"]
TEXT_FIELDS = ["comm", "exe", "name", "acct", "res"]
STAMP = r"msg=audit\((\d+\.?\d*|\.\d+):(\d{1,18})\)"
MARK = "="
# a field of a line: name=value; quoted values may be empty, ids are digits, the key may lack its quotes
TOKEN = "|".join([
    r"^type=\S+", r"msg=audit\((?:\d+\.?\d*|\.\d+):\d{1,18}", r"\b(?:" + "|".join(ID_FIELDS) + r")=\d+",
    r"\b(?:" + "|".join(TEXT_FIELDS) + r')="[^"]*"', r"SYSCALL=\w+", r'key="?[^"\s]+',
])
# one cheap test decides whether a line is a record at all: a wanted type, then a message stamp
RECORD_LINE = r"^\s*type=(?!(?:" + "|".join(S.SKIP_RECORD_TYPES) + r")(?:\s|$))\S.*" + STAMP


def scan_audit_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All `audit.log` lines under `folder` as (value, file, line_no).

    `line_no` rises with the position in a file whatever the split size: block start, then the running id
    of the scan task. It is a property of the scan, so write it out before any shuffle relies on it twice.
    """
    # the id restarts per task at a multiple of 2^33; blocks of one file are ordered by their byte offset
    return _scan(spark, folder).select("value", "file", (F.col("_block") * 2 + F.col("_within")).alias("line_no"))


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_within")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "audit.log").text(folder)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), within)


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All `audit.log` lines under `folder` as (value, file, line_no) with line_no the line's number in its file, from 1.

    A file may be cut into blocks that different tasks read: the lines of each block are counted, and a running sum over
    the blocks of a file, of which there are few, says how many lines stand before each.
    """
    lines = cut_lineage(_scan(spark, folder))
    blocks = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_within").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    placed = join_groups(lines, starts, ["file", "_block"], "_n", ["_within"])
    return placed.select("value", "file", (F.col("_before") + F.col("_within") - F.col("_first") + 1).alias("line_no"))


def write_audit_tree(lines: DataFrame, root: str) -> None:
    """Write (value, file, line_no) as text files at `root` + file, in the order of line_no.

    Spark writes a folder per file, and each is then renamed to its place: one metadata operation a file.
    """
    spark = lines.sparkSession
    names = [r["file"] for r in lines.select("file").distinct().sort("file").collect()]  # a row per file
    slots = spark.createDataFrame(list(enumerate(names)), "slot int, file string")
    staged = f"{root.rstrip('/')}/_staged"
    dealt = lines.join(F.broadcast(slots), "file").repartition("slot").sortWithinPartitions("slot", "line_no")
    dealt.select("value", "slot").write.partitionBy("slot").mode("overwrite").text(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for slot, name in enumerate(names):
        (part,) = [f.getPath() for f in fs.listStatus(path(f"{staged}/slot={slot}")) if f.getPath().getName().startswith("part-")]
        target = path(f"{root.rstrip('/')}{name}")
        fs.mkdirs(target.getParent())
        if not fs.rename(part, target):
            raise OSError(f"{target} could not be written")
    fs.delete(path(staged), True)


def scan_sources(spark: SparkSession, root: str, scenario_globs: list[str], selected: list[str] | None = None) -> DataFrame:
    """Several folder layouts read as one table, tagged with the scenario family of the folder name."""
    wanted = [g for g in scenario_globs if not selected or g in selected]
    if not wanted:
        raise ValueError("no source selected")
    out = None
    for glob in wanted:
        part = scan_audit_logs(spark, f"{root.rstrip('/')}/{glob}")
        folder = F.regexp_extract("file", _glob_pattern(glob), 1)
        part = part.withColumn("family", scenario_family(folder))
        out = part if out is None else out.unionByName(part)
    return out


def _glob_pattern(glob: str) -> str:
    *parents, leaf = glob.strip("/").split("/")
    tail = leaf.replace(".", r"\.").replace("*", "[^/]*")
    return "/".join([*parents, f"({tail})"]) + "/"


def scenario_family(name: Column) -> Column:
    """Folder name without its trailing trial numbers."""
    return F.regexp_replace(name, r"-[\d_]+$", "")


def scenario_of(path: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(path, r"(?i)(?:^|/)([^/]*scenario[^/]*)(?:/|$)", 1)), F.lit("unknown"))


def host_of(path: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(path, r"([^/]+)/logs(?:/|$)", 1)), F.lit("unknown_host"))


def parse_lines(lines: DataFrame, syscall_only: bool = False) -> DataFrame:
    """(value, file, line_no) to flat records; lines without type or message stamp are dropped.

    Only the two success marks make a record successful, so companion records count as failed; with
    `syscall_only` they count as not failed instead.
    """
    kept = lines.filter(F.col("value").rlike(RECORD_LINE))
    line = F.trim(F.replace("value", F.lit("\ufffd"), F.lit("")), F.lit(" \t\r\n\f\x0b"))
    carried = [c for c in lines.columns if c != "value"]
    # one pass cuts the line into its fields; every field is then a lookup of its first occurrence
    rec = kept.select(*carried, line.alias("_line")).select(
        *carried,
        F.regexp_extract_all("_line", F.lit(TOKEN), F.lit(0)).alias("_tokens"),
        (F.col("_line").contains("success=yes") | F.col("_line").contains("res=success")).alias("success"),
    ).select("*", F.transform("_tokens", lambda t: F.substring_index(t, MARK, 1)).alias("_names"))

    def first(name: str) -> Column:
        token = F.get("_tokens", F.array_position("_names", F.lit(name)).cast("int") - 1)
        return F.substring(token, len(name) + 2, F.length(token))

    def unquoted(name: str) -> Column:
        return blank_to_null(F.trim(first(name), F.lit('"')))

    stamp = F.substring_index(first("msg"), "(", -1)
    kind = first("type")
    failed = ~F.col("success") & (kind == "SYSCALL") if syscall_only else ~F.col("success")
    return rec.select(
        *carried,
        kind.alias("record_type"),
        F.substring_index(stamp, ":", 1).cast("double").alias("timestamp"),
        F.substring_index(stamp, ":", -1).cast("bigint").alias("seq_id"),
        *[first(f).try_cast("bigint").alias(f) for f in ID_FIELDS],
        *[unquoted(f).alias(f) for f in TEXT_FIELDS],
        F.coalesce(first("SYSCALL"), kind).alias("syscall_name"),
        unquoted("key").alias("key_tag"),
        "success",
        flag(failed).alias("failed"),
    )


def tag_origin(records: DataFrame, source: str, file: str = "file") -> DataFrame:
    return records.withColumns({
        "source": F.lit(source), "scenario": scenario_of(F.col(file)), "host": host_of(F.col(file)),
    })


def stamp_event_pid(records: DataFrame) -> DataFrame:
    """Every record gets the pid of the first record of its event; events that start without one go.

    Also adds `event_line`, where the event starts, so (event_line, line_no) orders a process.
    """
    first = F.min(F.struct("line_no", F.col("pid").alias("p")))
    events = records.groupBy("file", "seq_id").agg(first.alias("_first"), F.count(F.lit(1)).alias("_size"))
    events = events.select("file", "seq_id", "_size", F.col("_first.line_no").alias("event_line"), F.col("_first.p").alias("_pid"))
    stamped = join_groups(records, events, ["file", "seq_id"], "_size", ["line_no"])
    return stamped.withColumn("pid", F.col("_pid")).drop("_pid", "_size").filter(F.col("pid").isNotNull())


def label_processes(stamped: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per (file, pid): length, first usable key tag as technique, 0/1 label."""
    usable = F.col("key_tag").isNotNull() & ~F.col("key_tag").isin(S.SKIP_KEY_TAGS)
    tag = F.min(F.when(usable, F.struct("event_line", "line_no", "key_tag")))
    carried = [F.max(c).alias(c) for c in (keep or [])]  # constant per file
    return (
        stamped.groupBy("file", "pid")
        .agg(F.count(F.lit(1)).alias("n_events"), tag.alias("_tag"), *carried)
        .select("file", "pid", "n_events", *(keep or []),
                F.coalesce(F.col("_tag.key_tag"), F.lit("benign")).alias("technique"),
                F.col("_tag").isNotNull().cast("int").alias("label"))
    )


def draw_processes(processes: DataFrame, min_events: int, benign_cap: int, attack_cap: int, ratio: float | None, seed: int) -> DataFrame:
    """The processes of an extract: long enough, capped per scenario (benign) or technique (attack), then thinned to `ratio` benign per attack."""
    key = ["file", "pid"]
    long = processes.filter(F.col("n_events") >= min_events)
    benign = cap_per_stratum(long.filter("label = 0"), ["scenario"], key, benign_cap, seed)
    attack = cap_per_stratum(long.filter("label = 1"), ["technique"], key, attack_cap, seed)
    drawn = cut_lineage(benign.unionByName(attack))
    return drawn if ratio is None else ratio_sample(drawn, key, ratio, seed)


def label_records(stamped: DataFrame, processes: DataFrame) -> DataFrame:
    """Records of the given processes with the label and technique of their process."""
    picked = processes.select("file", "pid", "n_events", "label", "technique")
    sizes = stamped.groupBy("file", "pid").agg(F.count(F.lit(1)).alias("n_events"))
    return join_groups(stamped, picked, ["file", "pid"], "n_events", ["line_no"], "inner", sizes=sizes).drop("n_events")
