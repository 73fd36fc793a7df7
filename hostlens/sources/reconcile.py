"""One table from delimited files whose headers differ.

The first line of every file is read in tasks, files are grouped by header, and each group is scanned once with the column
names of its header; spellings are mapped in that scan's projection, and the groups are stacked. So the plan grows with the
number of different headers, not with the number of files. Names that a path holds become columns.

Defined cases: of several spellings in one header the first of `aliases` wins; a missing column is null and an unknown one
is dropped; blank fields are null, and so are fields that are no value of their type (`3.0` is a whole number); spellings are
compared without case, outer blanks or a byte order mark; a name that a header repeats means its first column; a short line
lacks its last fields; a quoted field may hold separators but no line break; empty files have no rows; no file at all is an
error.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.functions.columns import blank_to_null
from hostlens.sources.tensors import open_fs


def list_files(spark: SparkSession, pattern: str, suffix: str = "*") -> DataFrame:
    """Paths of all files of some size under a folder or pattern; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(pattern)
    return files.filter("length > 0").select("path")


def headers(files: DataFrame, separator: str = ",") -> DataFrame:
    """path, header: the column names of each file, read from its first line only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                fs, name = open_fs(path)
                line = b""
                with fs.open_input_stream(name) as f:
                    while b"\n" not in line and (more := f.read(1 << 14)):
                        line += more
                text = line.split(b"\n", 1)[0].decode("utf-8-sig", "replace").rstrip("\r")
                found.append(next(csv.reader([text], delimiter=separator), []))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.list_(pa.string()))], names=["path", "header"])

    return files.mapInArrow(run, "path string, header array<string>")


def _plain(name: str) -> str:
    return name.strip().lower()


def choose(header: list[str], wanted: list[str], aliases: dict[str, list[str]]) -> dict[str, int | None]:
    """For each wanted column, the place in the header of its first spelling that is there."""
    at: dict[str, int] = {}
    for i, name in enumerate(header):
        at.setdefault(_plain(name), i)
    return {w: next((at[_plain(a)] for a in [*aliases.get(w, []), w] if _plain(a) in at), None) for w in wanted}


def _literal(path: str) -> str:
    """A path for a reader that takes patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _from_path(pattern: str) -> Column:
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return blank_to_null(F.regexp_extract(path, pattern, 1))


def _typed(text: Column, to: T.DataType) -> Column:
    if isinstance(to, T.StringType):
        return blank_to_null(text)
    text = F.trim(text)
    if isinstance(to, T.IntegralType):
        number = text.try_cast("double")
        return F.coalesce(text.try_cast(to), F.when(number == F.rint(number), number.try_cast(to)))
    return text.try_cast(to)


def read_reconciled(spark: SparkSession, pattern: str, schema: T.StructType, aliases: dict[str, list[str]] | None = None,
                    from_path: dict[str, str] | None = None, suffix: str = "*.csv*", separator: str = ",") -> DataFrame:
    """`schema`'s columns from all files under `pattern`, then one string per entry of `from_path` (name: regex with a group)."""
    aliases, from_path = aliases or {}, from_path or {}
    for regex in from_path.values():
        if re.compile(regex).groups < 1:
            raise ValueError(f"{regex!r} has no group")
    groups = headers(list_files(spark, pattern, suffix), separator).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    found = sorted(groups.collect(), key=lambda r: r["paths"][0])  # the scans' path lists, which Spark keeps in the driver anyway
    if not found:
        raise FileNotFoundError(f"no file with a header under {pattern}")
    stacked = None
    for group in found:
        raw = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(group["header"]))])
        reader = spark.read.schema(raw).option("header", True).option("enforceSchema", True).option("sep", separator).option("quote", '"').option("escape", '"')
        scan = reader.csv([_literal(p) for p in group["paths"]])
        place = choose(group["header"], schema.names, aliases)
        columns = [
            (F.lit(None).cast(f.dataType) if place[f.name] is None else _typed(F.col(f"_c{place[f.name]}"), f.dataType)).alias(f.name) for f in schema]
        part = scan.select(*columns, *[_from_path(p).alias(n) for n, p in from_path.items()])
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked
