"""Removal of repeated substrings by distributed prefix doubling on a sparse suffix array.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Ranking every position of the corpus
would move many times its size, so suffixes are first sampled by content: the anchor of a position is the smallest
fingerprint among the short strings that start in the first half of its window. Equal windows have their anchor at the
same distance, so nothing is lost, and an anchor stands for a run of up to `length / 2` positions.

Prefix doubling then ranks by pairs at growing offsets. (1) Spark sorts the anchors by the pair (name of a quarter
window, name of the quarter at that offset); an anchor whose pair is unique has no repeated window and leaves. (2) What
is left is ranked by all bytes that its positions need: a context that occurs again repeats at all its positions. (3)
The remaining contexts meet by rank, with one of each repeated context, and their positions are ranked by the pair of
half windows (h, h at offset h): the threshold is reached, and what is not unique is repeated. Names are 64-bit
fingerprints.

Copies inside one slice of a task are recognised there, and only one of them is sent to the sort, so a passage that a
third of all documents share is no hot key. A text is told apart by its id and 64 bits of its hash. A rank with more than `HOT` contexts is not gathered: its positions become
rows, one per name and slice, that are counted. Everything else that one task holds is bounded by a document or by `HOT`.

Defined cases: null text counts as empty; texts shorter than `length` keep everything; repeated rows cover each other
and lose all bytes if they are long enough; texts without an id, or with the same one, are texts of their own; matches never cross documents, overlapping ones count; very long texts are
read in overlapping parts; an empty table gives an empty result. Columns of the input that are not asked for are not
read. Where a cut goes through a character, `remaining` drops its other bytes.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import RollingHash, mix, slices, utf8
from hostlens.session import remove_dir, store

LENGTH = 200
GRAM = 16  # bytes of the fingerprints that choose anchors
SLICE = 1 << 20
HOT = 8192  # contexts of one rank that a task may gather: 4 MB at most
TASK_BYTES = 2 << 20  # a task needs about a hundred times as much
NO_ID = -(2**63)

# A place in one long: first position (31 bits), anchor distance (8), positions (8), known (1)
MAX_LENGTH = 500


def pack(first, distance, count, known):
    return ((first << 8 | distance) << 8 | count) << 1 | known


def unpack(place: np.ndarray):
    return place >> 17, place >> 9 & 255, place >> 1 & 255, place & 1


def anchors(data: np.ndarray, text_end: np.ndarray, length: int):
    """(anchor, first position, positions) of all windows of `length` bytes that stay inside a text.

    `text_end`, per byte, is where its text ends.
    """
    half = length // 2
    hashed = RollingHash(data)
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return hashed, none, none, none
    short = mix((hashed.sums[GRAM:] - hashed.sums[:-GRAM]) * hashed.inverses[: n - GRAM + 1])
    low = np.uint64(0xFFFFFFFF)
    best = (short & ~low) | np.arange(len(short), dtype=np.uint64)
    width = 1
    while width * 2 <= half:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < half:
        best = np.minimum(best[: len(best) - (half - width)], best[half - width :])
    at = np.arange(n - length + 1)
    at = at[at + length <= text_end[at]]
    anchor = (best[at] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(new)
    return hashed, anchor[starts], at[starts], np.diff(np.append(starts, len(at)))


def first_ranks(docs: DataFrame, length: int) -> DataFrame:
    """key, rank, context, doc, check, place of every anchor; `key` equals `rank` but for copies known from their own slice."""
    quarter, half = length // 4, length // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            texts = utf8(batch.column("text"))
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            check = batch.column("check").to_numpy(zero_copy_only=False)
            whole = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
            size = np.array([len(t) + 1 for t in texts])
            begin = np.cumsum(size) - size
            for start in range(0, len(whole), 2 * SLICE):
                part = whole[start : start + 2 * SLICE + length - 1]
                row = np.searchsorted(begin, np.arange(start, start + len(part)), "right") - 1
                hashed, anchor, first, count = anchors(part, begin[row] + size[row] - 1 - start, length)
                pair = mix(hashed(anchor, anchor + quarter) * np.uint64(0x9E3779B97F4A7C15) + hashed(anchor + quarter, anchor + half))
                context = mix(hashed(first, first + count - 1 + length) + (anchor - first).astype(np.uint64))
                _, one, back, often = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                known = often[back] > 1
                extra = known.copy()
                extra[one] = False
                mine = row[first]
                inside = first + start - begin[mine]
                place = pack(inside, anchor - first, count, known.astype(np.int64))
                key = np.where(extra, mix(context ^ mix(place.astype(np.uint64) ^ mix(doc[mine].view(np.uint64) ^ mix(check[mine].view(np.uint64))))), pair)
                columns = [key.view(np.int64), pair.view(np.int64), context.view(np.int64), doc[mine], check[mine], place]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "rank", "context", "doc", "check", "place"])

    return docs.mapInArrow(run, "key bigint, rank bigint, context bigint, doc bigint, check bigint, place bigint")


def repeated_ranks(docs: DataFrame, length: int) -> DataFrame:
    """The anchors whose half window occurs more than once."""
    ranked = first_ranks(docs, length).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return ranked.filter((F.col("n") > 1) | (F.col("place") % 2 == 1)).select("rank", "context", "doc", "check", "place")


def cut_contexts(dense: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """rank, hot, single, doc, check, place, bytes: the text that the positions of an anchor need."""
    entry = F.struct("rank", "hot", "single", "place")
    wanted = dense.groupBy("doc", "check").agg(F.collect_list(entry).alias("entries"))  # bounded by a text's anchors

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            out = {c: [] for c in ("rank", "hot", "single", "doc", "check", "place", "bytes")}
            for text, doc, check, entries in zip(utf8(batch.column("text")), *[batch.column(c).to_pylist() for c in ("doc", "check", "entries")]):
                for e in entries:
                    first, _, count, _ = unpack(e["place"])
                    for c in ("rank", "hot", "single", "place"):
                        out[c].append(e[c])
                    out["doc"].append(doc)
                    out["check"].append(check)
                    out["bytes"].append(text[first : first + count - 1 + length])
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    ddl = "rank bigint, hot boolean, single boolean, doc bigint, check bigint, place bigint, bytes binary"
    return docs.join(wanted, ["doc", "check"]).mapInArrow(run, ddl)


def window_names(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name of the pair of half windows, context number, offset) of every position of the contexts."""
    half = length // 2
    hashed = RollingHash(np.frombuffer(b"".join(contexts), np.uint8))
    size = np.array([len(c) for c in contexts])
    count = size - length + 1
    number = np.repeat(np.arange(len(contexts)), count)
    offset = np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(size) - size)[number] + offset
    return mix(hashed(at, at + half) * np.uint64(0x9E3779B97F4A7C15) + hashed(at + half, at + length)), number, offset


def runs(number: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context number, first, last) of runs of neighbouring offsets; the input is in order."""
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(number)) - 1
    return number[first], offset[first], offset[last] if len(number) else offset[:0]


SPAN = "doc bigint, check bigint, first bigint, last bigint"


def repeated_positions(contexts: DataFrame, length: int) -> DataFrame:
    """doc, check, first, last: runs of positions, in contexts that occur once, whose window occurs again."""
    cold = contexts.filter(~F.col("hot"))
    bins = max(1, math.ceil((cold.agg(F.sum(F.length("bytes"))).first()[0] or 0) / TASK_BYTES))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        names, number, offset = window_names(frame["bytes"].tolist(), length)
        _, back, often = np.unique(names, return_inverse=True, return_counts=True)
        keep = (often[back] > 1) & frame["single"].to_numpy()[number]
        number, first, last = runs(number[keep], offset[keep])
        begin, _, _, _ = unpack(frame["place"].to_numpy()[number])
        return pd.DataFrame({"doc": frame["doc"].to_numpy()[number], "check": frame["check"].to_numpy()[number], "first": begin + first, "last": begin + last})

    gathered = cold.groupBy(F.pmod("rank", F.lit(bins)).alias("bin")).applyInPandas(meet, SPAN)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each name of a slice, and the runs of positions whose name the slice repeats."""
        for batch in slices(batches, "bytes", SLICE):
            names, number, offset = window_names(batch.column("bytes").to_pylist(), length)
            begin, _, _, _ = unpack(batch.column("place").to_numpy())
            doc, check, single = batch.column("doc").to_numpy(), batch.column("check").to_numpy(), batch.column("single").to_numpy(zero_copy_only=False)
            _, one, back, often = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
            of, at, repeated = number[one], offset[one], often > 1
            keep = repeated[back] & single[number]
            run, first, last = runs(number[keep], offset[keep])
            none = np.zeros(len(run), bool)
            longs = [
                pa.concat_arrays([pa.array(names[one].view(np.int64)), pa.nulls(len(run), pa.int64())]),
                *[pa.array(np.concatenate([a, b]), pa.int64()) for a, b in (
                    (doc[of], doc[run]), (check[of], check[run]), (begin[of] + at, begin[run] + first), (begin[of] + at, begin[run] + last))],
            ]
            flags = [pa.array(np.concatenate([single[of] & ~repeated, ~none])), pa.array(np.concatenate([repeated, none]))]
            yield pa.RecordBatch.from_arrays([*longs, *flags], names=["name", "doc", "check", "first", "last", "open", "known"])

    rows, _ = store(contexts.filter("hot").mapInArrow(spread, f"name bigint, {SPAN}, open boolean, known boolean"))
    named = rows.filter("name is not null")
    again = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known")).filter("known or n > 1").select("name")
    counted = named.filter("open").join(again, "name").select("doc", "check", "first", "last")
    return gathered.unionByName(counted).unionByName(rows.filter("name is null").select("doc", "check", "first", "last"))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, check, first, last: runs of positions whose window occurs elsewhere. `docs`: doc, check, text."""
    spark = docs.sparkSession

    def keep(df: DataFrame) -> tuple[DataFrame, str]:
        out = store(df)
        gc.collect()
        spark._jvm.System.gc()  # lets Spark delete the shuffle files of finished steps
        return out

    found, found_path = keep(repeated_ranks(docs, length))
    place = F.struct("doc", "check", "place")
    alike = found.groupBy("rank", "context").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"))
    alike, alike_path = keep(alike)
    mixed = alike.groupBy("rank").agg(F.count_if(F.col("n") == 1).alias("alone"), F.count(F.lit(1)).alias("members")).filter("alone > 0")
    dense = alike.join(mixed, "rank").filter("members > 1").select(
        "rank", (F.col("members") > HOT).alias("hot"), (F.col("n") == 1).alias("single"), "one.doc", "one.check", "one.place"
    )
    contexts, context_path = keep(cut_contexts(dense, docs, length))
    part, _ = keep(repeated_positions(contexts, length))
    again = alike.filter("n > 1").select("rank", "context")
    code = F.col("place")
    first = F.shiftright(code, 17)
    whole = found.join(again, ["rank", "context"]).select(
        "doc", "check", first.alias("first"), (first + F.shiftright(code, 1).bitwiseAND(255) - 1).alias("last")
    )
    out, _ = keep(whole.unionByName(part).groupBy("doc", "check").agg(F.collect_list(F.struct("first", "last")).alias("runs")))
    for path in (found_path, alike_path, context_path):
        remove_dir(spark, path)
    return out


def covered(text: bytes, found: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs [start, end) that the windows at the given positions cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["first"], r["last"] + length) for r in found or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """`keep` columns (default: doc_id) with n_bytes, n_removed, n_spans, kept_sha256; `with_text` adds remaining."""
    if not 2 * GRAM <= length <= MAX_LENGTH:
        raise ValueError(f"length must be {2 * GRAM} to {MAX_LENGTH}")
    keep = ["doc_id"] if keep is None else keep
    ident = [F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("check")]
    found = spans(docs.select(*ident, "text"), length)
    hidden = {c: f"_k{i}" for i, c in enumerate(keep)}
    rows = docs.select(*ident, *[F.col(c).alias(hidden[c]) for c in keep if c != "text"], "text")
    joined = rows.join(found, ["doc", "check"], "left").drop("doc", "check")
    fields = [f for f in docs.select(*keep).schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 * SLICE):
            n_bytes, n_removed, n_spans, sums, rest = [], [], [], [], []
            for text, runs_ in zip(utf8(batch.column("text")), batch.column("runs").to_pylist()):
                gone = covered(text, runs_, length)
                at, left = 0, []
                for a, b in gone:
                    left.append(text[at:a])
                    at = b
                kept = b"".join([*left, text[at:]])
                n_bytes.append(len(text))
                n_removed.append(len(text) - len(kept))
                n_spans.append(len(gone))
                sums.append(hashlib.sha256(kept).hexdigest())
                rest.append("".join(x.decode("utf-8", "ignore") for x in [*left, text[at:]]))
            out = {c: batch.column("text" if c == "text" else hidden[c]) for c in keep}
            out |= {k: pa.array(v, pa.int64()) for k, v in (("n_bytes", n_bytes), ("n_removed", n_removed), ("n_spans", n_spans))}
            out["kept_sha256"] = pa.array(sums, pa.string())
            if with_text:
                out["remaining"] = pa.array(rest, pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"]
    return joined.mapInArrow(run, ", ".join(ddl + ["remaining string"] * with_text))
