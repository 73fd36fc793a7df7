"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of word shingles. Texts with the same word sequence form one class, compared once. MinHash bands
propose candidates: with 32 bands of 4 values a pair at the threshold is missed with probability 5e-8. Buckets are
linked to their smallest member only; the connected groups of these links are the candidate groups, so no bucket is
expanded into pairs. Inside a group, MinHash values are compared in steps; after each, a pair is dropped if the
posterior probability that its similarity reaches the threshold (uniform prior, binomial matches) is below `TOLERANCE`.
What remains is verified on the exact shingle sets. Groups that are too large for a task are cut into blocks, and each
pair of blocks is a task of bounded size; only link counts and a spanning forest of the links leave a task.

Defined cases: a null or empty text, or one without words, has no links and is its own class; a text of fewer than five
words is one shingle; repeated rows and copies are links of each other, and a class that holds several of them has the
smallest id of its component; a null id is the smallest of all; different texts of one id, or without an id, are
documents of their own, told apart by their hashes; very long texts count with all their shingles; an empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import columns, mix, slices, unused
from hostlens.llm.components import components
from hostlens.llm.shingles import THRESHOLD, minhashes, shingles
from hostlens.session import cut_lineage

BANDS, ROWS = 32, 4
STEP = 16  # MinHash values compared at a time
TOLERANCE = 1e-7
TASK_BYTES = 2 << 20  # text of a block
TASK_ROWS = 1024
NO_ID = -(2**63)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches of `n` values at which the posterior probability of reaching the threshold is not negligible.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), whose upper tail at t is the chance
    of at most m successes in n + 1 trials of probability t.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def candidate_pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left[i], right[j]), i before j where a row is on both sides, that survive all steps."""
    a_out, b_out = [], []
    rows = max(1, (1 << 20) // max(1, len(right)))
    for start in range(0, len(left), rows):
        a, b = (x.ravel() for x in np.meshgrid(left[start : start + rows], right, indexing="ij"))
        keep = a < b if left is right else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        matches = np.zeros(len(a), np.int32)
        for n in range(STEP, sig.shape[1] + 1, STEP):
            matches += (sig[a, n - STEP : n] == sig[b, n - STEP : n]).sum(axis=1)
            keep = matches >= least_matches(n, threshold, tolerance)
            a, b, matches = a[keep], b[keep], matches[keep]
        a_out.append(a)
        b_out.append(b)
    return np.concatenate(a_out), np.concatenate(b_out)


def verify(prints: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the exact similarity of each pair reaches the threshold."""
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = [np.unique(prints[offsets[i] : offsets[i + 1]]) for i in used]
    size = np.array([len(s) for s in sets])
    pa_, pb = place[: len(a)], place[len(a) :]
    if len(a) < 4 * len(used):
        inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(pa_, pb)])
    else:  # many pairs of few texts: count common shingles by products of 0/1 matrices
        value, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = often > 1
        number = np.cumsum(shared) - 1
        keep = shared[column]
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        count = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, int(shared.sum()), 4096):
            lo, hi = np.searchsorted(column, [first, first + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[row[lo:hi], column[lo:hi] - first] = 1
            count += part @ part.T
        inter = count[pa_, pb].astype(np.int64)
    return inter >= threshold * (size[pa_] + size[pb] - inter) - 1e-9


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each element's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def compare_task(frame: pd.DataFrame, threshold: float, tolerance: float) -> pd.DataFrame:
    """Links inside each group of a task, or between its two blocks: per node its linked documents and a smaller node."""
    frame = frame.sort_values(["grp", "doc", "hash"], kind="stable").reset_index(drop=True)
    prints, offsets, whole, _ = shingles(frame["text"].tolist())
    sig = minhashes(prints, offsets, BANDS * ROWS)
    fits = whole.view(np.int64) == frame["hash"].to_numpy()  # another row with the same id has another text
    first = ~frame.assign(fits=fits).duplicated(["grp", "doc", "hash", "fits"]).to_numpy()  # a repeated row is a copy, not a node
    weight = frame["copies"].to_numpy()
    block, grp = frame["block"].to_numpy(), frame["grp"].to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1], [True]]))
    links, root = np.zeros(len(frame), np.int64), np.arange(len(frame))
    for lo, hi in zip(cuts, cuts[1:]):
        mine = np.arange(lo, hi)[fits[lo:hi] & first[lo:hi]]
        i, j = frame["i"].iloc[lo], frame["j"].iloc[lo]
        left, right = (mine, mine) if i == j else (mine[block[mine] == i], mine[block[mine] == j])
        if i == j:
            right = left
        if not len(left) or not len(right):
            continue
        a, b = candidate_pairs(sig, left, right, threshold, tolerance)
        if not len(a):
            continue
        ok = verify(prints, offsets, a, b, threshold)
        a, b = a[ok], b[ok]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        root[lo:hi] = lo + forest(hi - lo, a - lo, b - lo)
    out = frame[["doc", "hash", "whole"]].assign(links=links, root_doc=frame["doc"].to_numpy()[root], root_hash=frame["hash"].to_numpy()[root])
    return out[links > 0]


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), hash, hash2 (of the word sequence; null without words), bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints, offsets, whole, second = shingles(batch.column("text").to_pylist())
            sig = minhashes(prints, offsets, BANDS * ROWS)
            bands = np.empty((len(whole), BANDS), np.uint64)
            for i in range(BANDS):
                h = np.full(len(whole), np.uint64(i + 1))
                for j in range(ROWS):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, i * ROWS + j])
                bands[:, i] = h
            none = pa.array(np.diff(offsets) == 0)
            null = pa.scalar(None, pa.int64())
            hashes = [pc.if_else(none, null, pa.array(x.view(np.int64))) for x in (whole, second)]
            flat = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *hashes, flat], names=["doc_id", "mark", "hash", "hash2", "bands"])

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return marked.mapInArrow(run, "doc_id bigint, mark bigint, hash bigint, hash2 bigint, bands array<bigint>")


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its connected group of links), n_links (documents, copies
    included, whose similarity reaches the threshold); and, for `keep_one`, mark, hash, hash2 of its text and whether that
    is the text its class is named by."""
    rows = cut_lineage(classes(docs).withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))))
    worded = rows.filter(F.col("hash").isNotNull())
    least = F.min(F.struct("doc", "mark")).alias("least")
    nodes = worded.groupBy("hash", "hash2").agg(least, F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    nodes = cut_lineage(nodes.select("hash", "hash2", "least.doc", "least.mark", "copies", "bands"))
    node = F.struct("doc", "hash").alias("node")

    placed = nodes.select(node, F.explode("bands").alias("band"))
    buckets = placed.groupBy("band").agg(F.min("node").alias("root"), F.max("node").alias("far")).filter("root <> far").drop("far")
    grouped = components(placed.join(buckets, "band").select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
    members = grouped.select(F.col("node.doc").alias("doc"), F.col("node.hash").alias("hash"), F.xxhash64("label").alias("grp"))
    members = members.join(nodes.select("doc", "hash", "mark", "copies"), ["doc", "hash"])
    often = worded.groupBy("doc", "mark").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    members = members.join(often, ["doc", "mark"], "left").withColumn("repeated", F.col("rows").isNotNull()).drop("rows")

    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("mark"), "text")
    met = members.join(texts, ["doc", "mark"])
    met = met.filter(~F.col("repeated")).unionByName(met.filter("repeated").dropDuplicates(["doc", "hash"])).drop("mark", "repeated")
    found = cut_lineage(met.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))))
    sizes = found.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    blocks = F.ceil(F.greatest(F.col("bytes") / TASK_BYTES, F.col("rows") / TASK_ROWS)).cast("int")
    sizes = sizes.select("grp", F.greatest(blocks, F.lit(1)).alias("blocks"))
    bins = max(1, math.ceil((found.agg(F.sum("size")).first()[0] or 0) / (2 * TASK_BYTES)))

    dealt = found.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("doc", "hash"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("*", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    small = F.col("blocks") == 1
    dealt = dealt.withColumn("task", F.when(small, F.pmod("grp", F.lit(bins))).otherwise(F.col("grp"))).withColumn("whole", small)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return compare_task(frame, threshold, tolerance)

    ddl = "doc bigint, hash bigint, whole boolean, links bigint, root_doc bigint, root_hash bigint"
    tasks = dealt.select("task", "whole", "i", "j", "grp", "block", "doc", "hash", "copies", "text").groupBy("task", "whole", "i", "j")
    linked = cut_lineage(tasks.applyInPandas(compare, ddl))

    root = F.struct(F.col("root_doc").alias("doc"), F.col("root_hash").alias("hash"))
    split = components(linked.filter("not whole").select(node.alias("a"), root.alias("b")))
    label = linked.filter("whole").select("doc", "hash", root.alias("label"))
    label = label.unionByName(split.select(F.col("node.doc").alias("doc"), F.col("node.hash").alias("hash"), "label"))
    counts = linked.groupBy("doc", "hash").agg(F.sum("links").alias("links"))
    known = nodes.select("hash", "hash2", "doc", "copies").join(counts, ["doc", "hash"], "left").join(label, ["doc", "hash"], "left")
    known = known.select(
        "hash", "hash2", F.coalesce("label", F.struct("doc", "hash")).alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
    )
    out = rows.select("doc_id", "doc", "mark", "hash", "hash2").join(known, ["hash", "hash2"], "left")
    own = F.col("label").isNull() | (F.col("label") == F.struct("doc", "hash"))
    class_id = F.nullif(F.coalesce("label.doc", "doc"), F.lit(NO_ID)).alias("class_id")
    return out.select("doc_id", class_id, F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), "mark", "hash", "hash2", own.alias("own"))


def keep_one(docs: DataFrame, result: DataFrame) -> DataFrame:
    """Of each class the one document with the smallest id and hash; each text without words is its own class. Of repeated
    rows (same id and text) one stays. Other columns of `docs` are carried, whatever their names."""
    id_, mark, rows = (unused(n, docs) for n in ("_id", "_mark", "_rows"))
    wordless = F.when(F.col("hash").isNull(), F.col("mark")).alias("wordless")
    texts = result.filter("own").groupBy("doc_id", "hash", "hash2", "mark").agg(F.count(F.lit(1)).alias("rows"))
    one = texts.groupBy("doc_id", "hash", "hash2", wordless).agg(F.min(F.struct("mark", "rows")).alias("one"))
    own = one.select(F.col("doc_id").alias(id_), F.col("one.mark").alias(mark), F.col("one.rows").alias(rows))
    kept = docs.join(own, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(mark)), "inner")
    single = kept.filter(F.col(rows) == 1)
    repeated = kept.filter(F.col(rows) > 1).dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).select(*columns(docs))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS h FROM w WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (h) WHERE a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE k >= 0.8::DOUBLE * (nx.c + ny.c - k) - 1e-9
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.node
)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM (SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY node)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x) USING (doc_id)"""
