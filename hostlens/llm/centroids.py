"""Centroid clustering (Lloyd rounds) over integer vectors, pruned by zone maps along a Hilbert curve.

Vectors are turned into integers, `floor(256 * x)` per component, so that all distances, sums and means are exact and no
result depends on the layout of the data. They are sorted by their place on a Hilbert curve through the component space,
cut into blocks of `BLOCK` neighbours, and written once, each block with its box: the smallest and largest value per
component. In a round a block first compares its box with the centroids: one whose least distance to the box exceeds
another's largest distance cannot be nearest to any vector inside. What is left is compared with all vectors of the block
at once. A round reads the stored blocks, sends one row of counts and sums per task and centroid, and returns `K * 64`
sums to the driver; vectors are shuffled once, when they are sorted.

The curve only decides which vectors share a block, never a result. Copies of one vector have one place on it; the sort
goes on by a hash of the row's id and place, so they spread over as many tasks as they need.

Defined cases: vectors that are null, have another number of components than `DIMENSIONS`, hold a null or non-finite
component, or one whose integer is `2**27` or more in size (distances would not fit a long) take no part; a null id is an
id whose decimal form is empty; repeated rows count one by one; of equal hashes the smaller vector comes first as initial
centroid; ties in distance go to the smaller number; with fewer vectors than centroids each vector starts one; empty
clusters keep their centroid; an inertia that no long can hold is null; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.session import remove_dir, store

DIMENSIONS = 64
SCALE = 256
K = 40
ROUNDS = 5
SEED = "2:"
BLOCK = 256
LIMIT = 1 << 27
EXACT = 1 << 22  # below, sums of 64 squares are exact in doubles
CURVE_BITS = 4  # of each component
MAX_LONG = (1 << 63) - 1
INT = np.dtype("<i4")


def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """The place on the Hilbert curve of each row of `cells` (numbers below 2**bits) as bytes that sort like it."""
    x = np.ascontiguousarray(cells.T).astype(np.uint8)
    n = len(x)
    for bit in range(bits - 1, 0, -1):  # undo the rotations and reflections of ever smaller sub-cubes
        below = np.uint8((1 << bit) - 1)
        for i in range(n):
            on = (x[i] >> np.uint8(bit)) & np.uint8(1)
            swapped = np.where(on, np.uint8(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swapped)
            x[i] ^= swapped
    x = np.bitwise_xor.accumulate(x, axis=0)  # Gray code over all components
    flip = np.zeros(x.shape[1], np.uint8)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint8(bit)) & np.uint8(1), np.uint8((1 << bit) - 1), np.uint8(0))
    x ^= flip
    planes = np.concatenate([(x >> np.uint8(bit)) & np.uint8(1) for bit in range(bits - 1, -1, -1)])
    packed = np.packbits(planes, axis=0).T
    return [row.tobytes() for row in packed]


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integer vectors)."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == DIMENSIONS)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(flat.reshape(-1, DIMENSIONS) * SCALE)
        fits = (np.abs(scaled) < LIMIT).all(axis=1)  # false for null, NaN and infinite components
    return rows[fits], scaled[fits].astype(np.int64)


def keyed(vectors: DataFrame, low: float, high: float) -> DataFrame:
    """vec_id, vector (packed integers), place (on the curve) of the vectors that take part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column("embedding"))
            cells = np.clip((x - low) * ((1 << CURVE_BITS) / max(high - low, 1)), 0, (1 << CURVE_BITS) - 1)
            yield pa.record_batch({
                "vec_id": batch.column("vec_id").take(pa.array(rows)).cast(pa.int64()),
                "vector": pa.array([v.tobytes() for v in x.astype(INT)], pa.binary()),
                "place": pa.array(hilbert_keys(cells) if len(rows) else [], pa.binary()),
            })

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, vector binary, place binary")


def extent(vectors: DataFrame) -> tuple[float, float]:
    """Least and largest integer of all vectors: the range that the curve's cells divide."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = integers(batch.column("embedding"))
            if len(x):
                yield pa.record_batch({"low": [int(x.min())], "high": [int(x.max())]})

    low, high = vectors.select("embedding").mapInArrow(run, "low bigint, high bigint").agg(F.min("low"), F.max("high")).first()
    return (low or 0), (high or 0) + 1


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of neighbours on the curve: ids, vectors, low, high (the box)."""

    def pack(ids: list, data: bytes) -> tuple:
        x = np.frombuffer(data, INT).reshape(-1, DIMENSIONS)
        return ids, data, x.min(axis=0).tobytes(), x.max(axis=0).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[bytes] = []
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            held += batch.column("vector").to_pylist()
            whole = len(ids) - len(ids) % BLOCK
            for at in range(0, whole, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(pack(ids[at : at + BLOCK], b"".join(held[at : at + BLOCK])), schema)], schema=schema)
            ids, held = ids[whole:], held[whole:]
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(pack(ids, b"".join(held)), schema)], schema=schema)

    spread = F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("spread")  # of stored rows: the same in every attempt
    ordered = rows.select("vec_id", "vector", "place", spread).repartitionByRange("place", "spread").sortWithinPartitions("place", "spread")
    return ordered.select("vec_id", "vector").mapInArrow(run, "ids array<bigint>, vectors binary, low binary, high binary")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector in the box."""
    least = (np.maximum(low - centroids, 0) + np.maximum(centroids - high, 0)) ** 2
    most = np.maximum(np.abs(centroids - low), np.abs(centroids - high)) ** 2
    return np.flatnonzero(least.sum(axis=1) <= most.sum(axis=1).min())


def assign(x: np.ndarray, centroids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each vector, among the numbers `near`."""
    c = centroids[near]
    if max(np.abs(x).max(), np.abs(c).max()) < EXACT:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        d = (np.einsum("ij,ij->i", xf, xf)[:, None] + np.einsum("ij,ij->i", cf, cf) - 2 * (xf @ cf.T)).astype(np.int64)
    else:
        d = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
    best = d.argmin(axis=1)
    return near[best], d[np.arange(len(x)), best]


def opened(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple]:
    """(ids, vectors, clusters, distances) of each block of a batch."""
    for ids, data, low, high in zip(*[batch.column(c) for c in ("ids", "vectors", "low", "high")]):
        x = np.frombuffer(data.as_py(), INT).reshape(-1, DIMENSIONS).astype(np.int64)
        box = [np.frombuffer(b.as_py(), INT).astype(np.int64) for b in (low, high)]
        yield (ids, x, *assign(x, centroids, candidates(*box, centroids)))


def next_centroids(zones: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the means of the vectors nearest to each centroid."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), DIMENSIONS + 1), np.int64)  # of one task: counts, then sums
        for batch in batches:
            for _, x, cluster, _ in opened(batch, centroids):
                for c in np.unique(cluster):
                    mine = x[cluster == c]
                    total[c, 0] += len(mine)
                    total[c, 1:] += mine.sum(axis=0)
        some = np.flatnonzero(total[:, 0])
        yield pa.record_batch({"cluster": pa.array(some, pa.int32()), "total": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    each = zones.mapInArrow(run, "cluster int, total array<bigint>").select("cluster", F.posexplode("total").alias("at", "value"))
    sums = each.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # K * 65 rows
    found = {(r["cluster"], r["at"]): int(r["value"]) for r in sums}
    out = centroids.copy()
    for c in {c for c, _ in found}:
        out[c] = [found[c, i + 1] // found[c, 0] for i in range(DIMENSIONS)]
    return out


def assigned(zones: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, cluster, distance in opened(batch, centroids):
                yield pa.record_batch({"vec_id": ids.values, "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.int64())})

    return zones.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The `k` vectors with the smallest hash of their ids."""
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    top = rows.select(order.alias("hash"), "vector").sort("hash", "vector").limit(k).collect()
    return np.array([np.frombuffer(r["vector"], INT) for r in top], np.int64).reshape(-1, DIMENSIONS)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every vector; the final centroids). `vectors`: vec_id, embedding."""
    rows, path = store(keyed(vectors, *extent(vectors)))
    centroids = first_centroids(rows, k, seed)
    zones, _ = store(blocks(rows))
    remove_dir(vectors.sparkSession, path)
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(zones, centroids)
    return store(assigned(zones, centroids))[0], centroids


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`found` with the inertia of each cluster, of all, and the digest of each cluster's centroid."""
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row per centroid
    per = {r["cluster"]: int(r["s"]) for r in sums}
    fits = lambda n: n if n <= MAX_LONG else None
    digest = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    rows = [(c, fits(n), fits(sum(per.values())), digest[c]) for c, n in per.items()]
    facts = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    """One round in SQL: nearest centroid of each vector, then the floors of the means."""
    return f"""a{i} AS MATERIALIZED (
  SELECT n, arg_min(c, (d, c)) AS c FROM (SELECT v.n, z.c, list_sum(list_transform(v.x, lambda e, j: (e - z.x[j]) * (e - z.x[j])))::BIGINT AS d FROM v, c{i} z) GROUP BY n
), m{i} AS (
  SELECT c, list(floor_mean ORDER BY j) AS x FROM (
    SELECT c, j, ((s - ((s % k) + k) % k) // k)::BIGINT AS floor_mean FROM (SELECT a{i}.c, j, sum(v.x[j])::BIGINT AS s, count(*) AS k FROM a{i} JOIN v USING (n), range(1, {DIMENSIONS + 1}) t(j) GROUP BY ALL)) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))"""


def oracle() -> str:
    rounds = ", ".join(_round_sql(i) for i in range(ROUNDS))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('{SEED}' || vec_id) LIMIT {K}
), {rounds}, f AS (
  SELECT n, arg_min(c, (d, c)) AS c, min(d) AS distance
  FROM (SELECT v.n, z.c, list_sum(list_transform(v.x, lambda e, j: (e - z.x[j]) * (e - z.x[j])))::BIGINT AS d FROM v, c{ROUNDS} z) GROUP BY n
)
SELECT vec_id, f.c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(z.x, ',')) AS centroid_sha256
FROM f JOIN v USING (n) JOIN c{ROUNDS} z ON z.c = f.c"""
