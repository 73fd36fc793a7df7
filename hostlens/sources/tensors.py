"""A table with one fixed-shape integer tensor a row, kept as numpy blocks with their meta rows and an index.

A task writes its rows as blocks of `block_rows`: `<block>.npy` holds the tensors, `<block>.parquet` the other columns in
the same order. Nothing is visible until the job commits: the driver numbers the blocks and renames one index over the old
one. Blocks of tasks that failed, or ran twice, are named by no index. The index has one small entry a block.

Reading gives a partition per some blocks in a row, up to `PARTITION_ROWS`, and a column `row`, the place of the row in the whole tensor, from 0.

Defined cases: a null tensor or one of another shape fails the write, since blocks have one shape; other columns may be
null; an empty table gives an index without blocks; `append` goes on behind the rows that are there.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "tensor_blocks"
INDEX = "index.json"
BLOCK_ROWS = 8192
ROW = "row"
READ_ROWS = 1024
PARTITION_ROWS = 32_768  # a reader is started once for so many rows, however small the blocks


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path, and the path inside it."""
    local = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), local) if local.startswith("/") else pafs.FileSystem.from_uri(path)


def read_index(path: str) -> dict | None:
    fs, root = open_fs(path)
    name = posixpath.join(root, INDEX)
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(name) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    blocks: list[tuple[str, int]]  # name, rows


@dataclass
class Blocks(InputPartition):
    parts: list[tuple[str, int]]  # name, first row


class TensorWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.path, self.column = options["path"], options["tensor"]
        self.shape = tuple(int(x) for x in options["shape"].split(","))
        self.block_rows = int(options.get("block_rows", BLOCK_ROWS))
        self.schema, self.overwrite = schema.json(), overwrite

    def tensors(self, batch: pa.RecordBatch) -> np.ndarray:
        column, n = batch.column(self.column), batch.num_rows
        for size in self.shape:
            inner = column.flatten()
            if column.null_count or len(inner) != n * size or (n and set(column.value_lengths().unique().to_pylist()) != {size}):
                raise ValueError(f"every {self.column} must have shape {self.shape}")
            column, n = inner, n * size
        if column.null_count:
            raise ValueError(f"{self.column} holds nulls")
        return column.to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, *self.shape)

    def write_block(self, tensors: list[np.ndarray], meta: list[pa.RecordBatch]) -> tuple[str, int]:
        name = f"block-{uuid.uuid4().hex}"
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        whole = np.concatenate(tensors)
        with fs.open_output_stream(posixpath.join(root, f"{name}.npy")) as out:
            head = io.BytesIO()
            np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(whole))
            out.write(head.getvalue())
            out.write(whole.data)
        beside = pa.Table.from_batches(meta)
        table = pa.Table.from_arrays([*beside.columns, pa.array(np.arange(len(whole)))], names=[*beside.column_names, ROW])
        pq.write_table(table, posixpath.join(root, f"{name}.parquet"), filesystem=fs)
        return name, len(whole)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, tensors, meta, held = [], [], [], 0
        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, self.block_rows - held)
                tensors.append(self.tensors(part))
                meta.append(part.select([c for c in part.schema.names if c != self.column]))
                at, held = at + part.num_rows, held + part.num_rows
                if held == self.block_rows:
                    done.append(self.write_block(tensors, meta))
                    tensors, meta, held = [], [], 0
        if held:
            done.append(self.write_block(tensors, meta))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        old = None if self.overwrite else read_index(self.path)
        said = {"schema": self.schema, "tensor": self.column, "shape": list(self.shape)}
        if old is not None and {k: old[k] for k in said} != said:
            raise ValueError("rows of another schema or shape cannot be appended")
        blocks = old["blocks"] if old else []
        first = sum(b["rows"] for b in blocks)
        for name, rows in (b for m in messages if m for b in m.blocks):
            blocks.append({"name": name, "rows": rows, "first": first})
            first += rows
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        draft = posixpath.join(root, f"_draft-{uuid.uuid4().hex}")
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps(said | {"blocks": blocks}).encode())
        fs.move(draft, posixpath.join(root, INDEX))

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        for name, _ in (b for m in messages if m for b in m.blocks):
            for end in ("npy", "parquet"):
                fs.delete_file(posixpath.join(root, f"{name}.{end}"))


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        index = read_index(options["path"])
        if index is None:
            raise FileNotFoundError(f"nothing is committed at {options['path']}")
        self.path, self.column, self.shape = options["path"], index["tensor"], tuple(index["shape"])
        self.names = [f.name for f in T.StructType.fromJson(json.loads(index["schema"]))]
        self.blocks: list[Blocks] = []
        room = 0
        for b in index["blocks"]:
            if room < b["rows"]:
                self.blocks.append(Blocks([]))
                room = PARTITION_ROWS
            self.blocks[-1].parts.append((b["name"], b["first"]))
            room -= b["rows"]

    def partitions(self) -> list[InputPartition]:
        return self.blocks

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an index without blocks
            return
        for name, first in partition.parts:
            yield from self.read_block(name, first)

    def read_block(self, name: str, first: int) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(self.path)
        with fs.open_input_stream(posixpath.join(root, f"{name}.npy")) as f:
            np.lib.format.read_magic(f)
            np.lib.format.read_array_header_1_0(f)
            width = int(np.prod(self.shape)) * 4
            with fs.open_input_file(posixpath.join(root, f"{name}.parquet")) as meta:
                for batch in pq.ParquetFile(meta).iter_batches(READ_ROWS):
                    flat = np.frombuffer(f.read(batch.num_rows * width), np.int32)
                    nested = pa.array(flat)
                    for size in reversed(self.shape):
                        nested = pa.ListArray.from_arrays(pa.array(np.arange(0, len(nested) + 1, size, dtype=np.int32)), nested)
                    columns = {c: nested if c == self.column else batch.column(c) for c in self.names}
                    columns[ROW] = pa.array(batch.column(ROW).to_numpy() + first)
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class TensorBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        index = read_index(self.options["path"])
        if index is None:
            raise FileNotFoundError(f"nothing is committed at {self.options['path']}")
        return T.StructType.fromJson(json.loads(index["schema"])).add(ROW, T.LongType())

    def reader(self, schema: T.StructType) -> TensorReader:
        return TensorReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> TensorWriter:
        return TensorWriter(schema, dict(self.options), overwrite)


def _qualified(spark: SparkSession, path: str) -> str:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toString()


def write_tensors(df: DataFrame, path: str, column: str, shape: tuple[int, ...], block_rows: int = BLOCK_ROWS, mode: str = "overwrite") -> None:
    """Write `df`, whose `column` holds nested integer arrays of `shape`; no task holds more than a block and a batch."""
    if ROW in df.columns:
        raise ValueError(f"a column may not be called {ROW!r}")
    spark = df.sparkSession
    spark.dataSource.register(TensorBlocks)
    options = {"path": _qualified(spark, path), "tensor": column, "shape": ",".join(map(str, shape)), "block_rows": str(block_rows)}
    df.write.format(FORMAT).mode(mode).options(**options).save()


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """The columns as they were written, and `row`."""
    spark.dataSource.register(TensorBlocks)
    return spark.read.format(FORMAT).option("path", _qualified(spark, path)).load()


def sweep_tensors(spark: SparkSession, path: str) -> int:
    """Delete the files of blocks that the index does not name; call it when no write is under way."""
    path = _qualified(spark, path)
    index = read_index(path)
    named = {b["name"] for b in index["blocks"]} if index else set()
    fs, root = open_fs(path)
    files = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    stale = [f.path for f in files if f.base_name.startswith("block-") and f.base_name.rsplit(".", 1)[0] not in named]
    for file in stale:
        fs.delete_file(file)
    return len(stale)
