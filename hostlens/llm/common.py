"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20  # text handled at once inside a task, however large an Arrow batch is


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """`name`, with underscores added until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns of `df`, also those with dots or quotes in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have at most `limit` bytes, or are a single row."""
    for batch in batches:
        lengths = [0 if v is None else v for v in pc.binary_length(batch.column(text)).to_pylist()]
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(lengths) > start:
            yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


# The finaliser constant of a 64-bit mixing function and an odd base of polynomial hashes.
MIX = np.uint64(0xD6E8FEB86659FD93)
BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base))
    p[:1] = 1
    return np.multiply.accumulate(p)


class RollingHash:
    """Fingerprints of any byte ranges of one buffer, each in constant time (arithmetic modulo 2**64)."""

    KEPT = 1 << 20  # powers that a worker keeps for its next buffers; larger buffers make their own
    _kept = None

    def __init__(self, data: np.ndarray, values: np.ndarray | None = None):
        n = len(data)
        cls = RollingHash
        bases = BASE, pow(BASE, -1, 1 << 64)
        if cls._kept is None:
            cls._kept = [_powers(b, cls.KEPT) for b in bases]
        powers, self.inverses = cls._kept if n <= cls.KEPT else [_powers(b, n) for b in bases]
        self.sums = np.zeros(n + 1, np.uint64)
        # bytes are spread over 64 bits first, else ranges with equal sums of neighbours would meet
        np.cumsum((BYTE_VALUES[data] if values is None else values) * powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverses[start])


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
