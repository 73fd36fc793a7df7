"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt by hash into shards of about `SHARD_ROWS`. Each shard gets a graph: greedy searches from the
medoid propose neighbours for a point, and pruning with a relaxed distance keeps a proposal only if no kept neighbour is
closer to it by the factor alpha, so the kept edges are diverse. Queries are streamed past every shard; a beam search
follows the graph, and the best of all shards are merged. Nearness is the inner product: inside a shard all vectors get
one more component that makes their norms equal, which turns it into a distance; reported scores are inner products of
the original vectors in double precision.

Every row is indexed. Copies of a vector form one node that remembers its `k + 1` smallest ids, which is all that a
result of `k` can show, so copies neither blow up the graph nor get lost. Shards that are no larger than the beam are
compared whole.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a
null id; vectors of different lengths never meet; identical rows count once; ties go to the smaller id; fewer candidates
than k give fewer rows; an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.session import cut_lineage

SHARD_ROWS = 4096
DEGREE = 24
BUILD_BEAM = 40
QUERY_BEAM = 96
ALPHA = 1.2
QUERY_BLOCK = 512
MAX_TASKS = 1 << 16  # of a search; more shards than that share tasks, one after the other


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int, visited_out: bool = False):
    """Ids (rows of `points`) of the `beam` nearest found for each query, nearest first; all queries move in step.

    `edges` has one row per point, padded with -1. With `visited_out`, also a mask of the points that were compared.
    """
    n, b = len(points), len(queries)
    rows = np.arange(b)[:, None]
    norms = np.einsum("ij,ij->i", points, points)
    ids = np.full((b, beam), -1, np.int32)
    dist = np.full((b, beam), np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    ids[:, 0], open_[:, 0] = entry, True
    dist[:, 0] = norms[entry] - 2 * queries @ points[entry]
    seen = np.zeros((b, n), bool)
    seen[:, entry] = True
    while True:
        live = np.flatnonzero(open_.any(axis=1))
        if not len(live):
            return (ids, seen) if visited_out else ids
        at = open_[live].argmax(axis=1)  # beams are sorted, so this is the nearest open one
        open_[live, at] = False
        near = edges[ids[live, at]]
        r = live[:, None]
        new = (near >= 0) & ~seen[r, near]
        safe = np.where(near >= 0, near, 0)
        if new.any():
            seen[np.broadcast_to(r, near.shape)[new], near[new]] = True
            d = norms[safe] - 2 * np.einsum("bd,bkd->bk", queries[live], points[safe])
            d = np.where(new, d, np.inf).astype(np.float32)
            all_d = np.concatenate([dist[live], d], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            pick = rows[: len(live)]
            dist[live] = all_d[pick, order]
            ids[live] = np.concatenate([ids[live], np.where(new, near, -1)], axis=1)[pick, order]
            open_[live] = np.concatenate([open_[live], new], axis=1)[pick, order]


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse out-neighbours of the points `of`; candidates are padded with -1 and may repeat."""
    cand = np.sort(candidates, axis=1)
    gone = (cand < 0) | (cand == of[:, None])
    gone[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    vec = points[np.where(cand < 0, 0, cand)]
    own = ((vec - points[of][:, None]) ** 2).sum(axis=2)
    out = np.full((len(of), degree), -1, np.int32)
    rows = np.arange(len(of))
    for j in range(degree):
        d = np.where(gone, np.inf, own)
        best = d.argmin(axis=1)
        ok = np.isfinite(d[rows, best])
        if not ok.any():
            break
        out[ok, j] = cand[rows[ok], best[ok]]
        between = ((vec - vec[rows, best][:, None]) ** 2).sum(axis=2)
        gone |= (alpha * alpha * between <= own) | ~ok[:, None]
        gone[rows, best] = True
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 512) -> tuple[np.ndarray, int]:
    """(edges, entry point). Points are inserted in batches, twice: first plainly, then with the relaxed distance."""
    n, room = len(points), degree + degree // 2  # a list is only pruned when its room is used up
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    rng = np.random.default_rng(n)
    edges = np.full((n, room), -1, np.int32)
    edges[:, :8] = rng.integers(0, n, (n, 8), dtype=np.int32)
    edges[edges == np.arange(n)[:, None]] = -1
    for relaxed in (1.0, alpha):
        order = rng.permutation(n)
        for start in range(0, n, batch):
            of = order[start : start + batch]
            found = beam_search(points, edges, entry, points[of], beam)
            edges[of, :degree] = robust_prune(points, of, np.concatenate([found, edges[of]], axis=1), degree, relaxed)
            edges[of, degree:] = -1
            source = np.repeat(of, degree)
            target = edges[of, :degree].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            heads, first, count = np.unique(target, return_index=True, return_counts=True)
            both = np.full((len(heads), room + int(count.max(initial=0))), -1, np.int32)
            both[:, :room] = edges[heads]
            both[np.repeat(np.arange(len(heads)), count), room + np.arange(len(target)) - np.repeat(first, count)] = source
            both = -np.sort(-both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both = -np.sort(-both, axis=1)
            full = both[:, room] >= 0 if both.shape[1] > room else np.zeros(len(heads), bool)
            edges[heads] = both[:, :room]
            over = np.flatnonzero(full)
            for i in range(0, len(over), batch):
                h = heads[over[i : i + batch]]
                edges[h, :degree] = robust_prune(points, h, both[over[i : i + batch]], degree, relaxed)
                edges[h, degree:] = -1
    return edges, entry


def equal_norms(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component, so that all have the same norm and the nearest has the largest inner product."""
    sq = np.einsum("ij,ij->i", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(sq.max() - sq, 0))[:, None]], axis=1).astype(np.float32)


def usable(vec: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: dim, shard, node ids, vectors and edges as packed arrays. `vectors`: vec_id, embedding."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding").distinct()
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = rows.withColumn("_r", F.row_number().over(by_vector)).filter(F.col("_r") <= k + 1)
    nodes = nodes.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # at most k + 1
    nodes = cut_lineage(nodes.select("ids", "embedding", F.size("embedding").alias("dim")))
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    dealt = nodes.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("embedding"), "shards").cast("int"))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ids", key=lambda c: c.map(lambda x: x[0]))
        vec = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
        if len(vec) > QUERY_BEAM:
            edges, entry = build_graph(equal_norms(vec))
        else:
            edges, entry = np.zeros((0, 0), np.int32), -1
        ids = np.full((len(frame), k + 1), -1, np.int64)
        held = np.zeros(len(frame), np.int64)
        for i, x in enumerate(frame["ids"]):
            ids[i, : len(x)], held[i] = x, len(x)
        return pd.DataFrame({
            "dim": [key[0]], "shard": [key[1]], "entry": [entry], "held": [held.tobytes()], "ids": [ids.tobytes()],
            "vectors": [vec.tobytes()], "edges": [edges.tobytes()],
        })

    ddl = "dim int, shard int, entry int, held binary, ids binary, vectors binary, edges binary"
    return cut_lineage(dealt.groupBy("dim", "shard").applyInPandas(build, ddl))


@dataclass
class Shard:
    """One shard's graph, as a task holds it."""

    vec: np.ndarray
    points: np.ndarray
    edges: np.ndarray
    entry: int
    ids: np.ndarray
    held: np.ndarray

    @classmethod
    def load(cls, row: dict, k: int) -> Shard:
        vec = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        edges = np.frombuffer(row["edges"], np.int32)
        return cls(vec, equal_norms(vec), edges.reshape(len(vec), -1) if len(edges) else edges, row["entry"],
                   np.frombuffer(row["ids"], np.int64).reshape(-1, k + 1), np.frombuffer(row["held"], np.int64))

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        if self.entry < 0:  # no larger than the beam
            return np.broadcast_to(np.arange(len(self.vec)), (len(queries), len(self.vec)))
        flat = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        return beam_search(self.points, self.edges, self.entry, flat, beam)


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = QUERY_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of each query, without the query's own id.

    `queries`: vec_id, embedding. They are sent to every shard; a shard is sent once, however many queries there are.
    """
    asked = queries.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding").distinct()
    asked = asked.withColumn("dim", F.size("embedding"))
    shards = index.select(F.col("dim").alias("_d"), F.col("shard").alias("_s")).toDF("dim", "shard")
    sent = index.unionByName(asked.join(shards, "dim"), allowMissingColumns=True)
    parts = min(max(1, shards.count()), MAX_TASKS)
    names = index.columns
    # a shard, then its queries: a task holds one shard and reads the queries as a stream
    sent = sent.repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("entry").isNull(), "vec_id")

    def visit(shard: Shard, asked: pa.RecordBatch) -> pa.RecordBatch:
        q = asked.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(asked.num_rows, -1)
        found = shard.search(q, beam)
        score = np.where(found >= 0, np.einsum("qd,qkd->qk", q, shard.vec[np.maximum(found, 0)]), -np.inf)
        best = np.lexsort((shard.ids[np.maximum(found, 0), 0], -score), axis=1)[:, : k + 1]
        row = np.repeat(np.arange(len(q)), best.shape[1])
        node = found[row, best.ravel()]
        keep = node >= 0
        row, node, s = row[keep], node[keep], score[row, best.ravel()][keep]
        held = shard.held[node]
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(held)).astype(np.int32)), pa.array(shard.ids[node][np.arange(k + 1) < held[:, None]]))
        ids = asked.column("vec_id").to_numpy()[row]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(shard.ids[node, 0]), lists, pa.array(s)], names=["query_id", "node", "ids", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            heads = np.flatnonzero(batch.column("entry").is_valid().to_numpy(zero_copy_only=False))
            for start, end in pairwise([*([0] if not len(heads) or heads[0] else []), *heads.tolist(), batch.num_rows]):
                if batch.column("entry")[start].is_valid:
                    shard = Shard.load({c: batch.column(c)[start].as_py() for c in names}, k)
                    start += 1
                for at in range(start, end, QUERY_BLOCK):
                    yield visit(shard, batch.slice(at, min(QUERY_BLOCK, end - at)))

    hits = sent.mapInArrow(run, "query_id bigint, node bigint, ids array<bigint>, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    hits = hits.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= k + 1)
    each = hits.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """Index all vectors; ask for those whose id is divisible by `every`."""
    return search(build_index(vectors, k), vectors.filter(F.col("vec_id") % every == 0), k)
