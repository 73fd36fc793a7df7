"""Language identification by bit-sliced Bloom filters of n-grams.

Each slot of the filter holds a bitmask with one bit per language, in as many words as the languages need. A text is lower-cased, and each of its n-grams
(byte windows of UTF-8, over letters and blanks) reads its slots; the AND of their masks is the set of all languages
that contain the n-gram. Per language, the share of n-grams it contains is corrected for the filter's false positives,
`(share - f) / (1 - f)` with f the language's fill to the power of the number of hashes; the largest one decides.

The filters are fitted on at most `SAMPLE_ROWS` documents of at most `SAMPLE_BYTES` bytes per language (a documented
bound; the rows are the first by a hash of the id and the text, a repeated row counts once) in the `MAX_LANGUAGES` most
frequent languages, and hold at most `MAX_GRAMS` n-grams per language and `ALL_GRAMS` in all, so the model has a fixed
size and is broadcast. An n-gram belongs to a language if enough of its documents have it, and not far fewer than of any other
language, which keeps passages in a foreign language and mislabelled rows out.

Defined cases: a null text or one without any letter is `und` with score 0; a text without a single known n-gram gets
the most frequent language with score 0; ties go to the language that comes first in the order of names; very long
texts are read in pieces that share no n-gram and lose none; without any labelled row all texts are `und`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import slices

SAMPLE_ROWS = 1_000  # per language
BUCKETS = 64
SAMPLE_BYTES = 1 << 20  # of one sampled text
MAX_LANGUAGES = 1_024
MAX_GRAMS = 16_384  # per language
ALL_GRAMS = 1 << 19
MIN_SHARE = 0.02  # of a language's sampled documents that must have an n-gram
RELATIVE = 0.3  # of the highest such share among the languages
SLOT_BITS = 19
FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)  # one hash function each
SLICE = 1 << 20
UNKNOWN = "und"
MIN_SCORE = 0.1  # a text is rejected if its share of known n-grams is surely below
DOUBT = 1e-3  # the chance, by Hoeffding's bound, that it is not

SEPARATOR = 0x20
CLASSES = np.array([c if 0x61 <= c <= 0x7A or c >= 0x80 else SEPARATOR for c in range(256)], np.uint8)


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray  # bitmask per slot, in as many words as needed
    false_rate: np.ndarray  # per language


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams as 32-bit numbers, and where each text's begin (one more entry than texts).

    Runs of other characters than letters count as one blank, also before and after a text.
    """
    raw = np.frombuffer(b" " + b"\0 ".join(texts) + b"\0", np.uint8)
    close = raw == 0
    data = CLASSES[raw]
    blank = data == SEPARATOR
    keep = ~blank
    keep[0] = True
    keep[1:] |= ~blank[:-1]  # the first blank of a run stays
    ends = np.cumsum(keep)[np.cumsum([len(t) + 2 for t in texts]) - 1]
    data = data[keep]
    n = max(0, len(data) - 3)
    code = data[:n].astype(np.uint32)
    for i in (1, 2, 3):
        code |= data[i : n + i].astype(np.uint32) << np.uint32(8 * i)
    first = np.concatenate([[1], ends[:-1]]) - 1  # the blank before a text is its own, and so is the one behind it
    count = np.maximum(ends - first - 3, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    return code[np.arange(begin[-1]) + np.repeat(first - begin[:-1], count)], begin


def lowered(column: pa.Array) -> list[bytes]:
    return [t.lower().encode() for t in column.to_pylist()]


def long_grams(text: bytes) -> Iterator[np.ndarray]:
    """The n-grams of one text, as `grams` gives them, piece by piece: three bytes are kept for the next one."""
    kept = np.array([SEPARATOR], np.uint8)  # the blank before the text
    for start in range(0, len(text), SLICE):
        piece = text[start : start + SLICE] + (b"\0" if start + SLICE >= len(text) else b"")
        data = np.concatenate([kept[-1:], CLASSES[np.frombuffer(piece, np.uint8)]])
        blank = data == SEPARATOR
        kept = np.concatenate([kept, data[1:][~(blank[1:] & blank[:-1])]])
        code = kept[: max(0, len(kept) - 3)].astype(np.uint32)
        for i in (1, 2, 3):
            code |= kept[i : len(code) + i].astype(np.uint32) << np.uint32(8 * i)
        yield code
        kept = kept[-3:]


def places(codes: np.ndarray) -> Iterator[np.ndarray]:
    spread = codes ^ (codes >> np.uint32(15))
    for factor in FACTORS:
        yield (spread * factor) >> np.uint32(32 - SLOT_BITS)


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """text, lang of the first `rows` different documents of each language by a hash of id and text, for the most
    frequent languages; only ids, hashes and languages are sorted."""
    labelled = docs.filter(F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    mark = F.xxhash64("text").alias("_mark")
    ids = labelled.select("lang", "doc_id", mark).distinct()
    top = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).sort(F.desc("_n"), "lang").limit(MAX_LANGUAGES).select("lang")
    order = [F.xxhash64("doc_id", "_mark"), F.col("doc_id"), F.col("_mark")]
    spread = Window.partitionBy("lang", "_bucket").orderBy(*order)  # so that no task sees more than BUCKETS * rows of a language
    dealt = ids.join(F.broadcast(top), "lang").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_mark", F.lit("bucket")), F.lit(BUCKETS)))
    few = dealt.withColumn("_r", F.row_number().over(spread)).filter(F.col("_r") <= rows).drop("_r", "_bucket")
    picked = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_r") <= rows)
    keys = picked.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), F.col("_mark").alias("_key"))  # `rows` per language at most
    same = (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_key"))
    texts = labelled.select("lang", "doc_id", mark, "text").join(F.broadcast(keys), same, "left_semi")
    return texts.groupBy("lang", "doc_id", "_mark").agg(F.min("text").alias("text")).select("text", "lang")  # repeated rows count once


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on (doc_id, text, lang); `doc_id` only picks the sample."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            codes, begin = grams(lowered(batch.column("text")))
            names = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(names):
                once = [np.unique(codes[begin[i] : begin[i + 1]]) for i in np.flatnonzero(names == lang)]
                gram, n = np.unique(np.concatenate(once), return_counts=True)
                yield pa.record_batch({"lang": pa.array([lang] * len(gram), pa.string()), "gram": gram.astype(np.int64), "n": n.astype(np.int64)})

    picked = sample(labelled.select("doc_id", "text", "lang"), rows)
    sizes = {r["lang"]: r["n"] for r in picked.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    width = next((np.dtype(f"u{n}") for n in (1, 2, 4, 8) if 8 * n >= len(languages)), np.dtype("u8"))
    bits = 8 * width.itemsize
    slots, false_rate = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // bits))), width), np.zeros(len(languages))
    if languages:
        each = min(MAX_GRAMS, ALL_GRAMS // len(languages))
        found = picked.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint")
        size = picked.sparkSession.createDataFrame(list(sizes.items()), "lang string, _size long")  # a row per language
        share = found.groupBy("gram", "lang").agg(F.sum("n").alias("n")).join(F.broadcast(size), "lang")
        share = share.select("gram", "lang", (F.col("n") / F.col("_size")).alias("share")).filter(F.col("share") >= MIN_SHARE)
        per_gram = share.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("s"))  # a row per language
        kept = per_gram.select("gram", "top", F.inline("s")).filter(F.col("share") >= RELATIVE * F.col("top"))
        best = Window.partitionBy("lang").orderBy(F.desc("share"), "gram")
        kept = kept.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= each)
        held = kept.select("lang", "gram").toArrow()  # at most ALL_GRAMS rows
        names, gram = np.array(held.column("lang").to_pylist(), object), held.column("gram").to_numpy()
        for i, lang in enumerate(languages):
            for at in places(gram[names == lang].astype(np.uint32)):
                slots[np.unique(at), i // bits] |= width.type(1 << i % bits)
        fill = np.array([np.mean(slots[:, i // bits] >> width.type(i % bits) & width.type(1)) for i in range(len(languages))])
        false_rate = fill ** len(FACTORS)
    return Model(languages, slots, false_rate)


def masks(model: Model, codes: np.ndarray) -> np.ndarray:
    """Per n-gram, the set of all languages that contain it."""
    out = model.slots[next(at := places(codes))]
    for more in at:
        out &= model.slots[more]
    return out


def shares(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text and language, the corrected share of n-grams that the language contains; and the number of n-grams."""
    hits, total = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    bits, one = 8 * model.slots.dtype.itemsize, model.slots.dtype.type(1)

    def add(codes: np.ndarray, rows: np.ndarray, begin: np.ndarray) -> None:
        found = masks(model, codes)
        for i in range(len(model.languages)):
            hits[rows, i] += np.add.reduceat((found[:, i // bits] >> model.slots.dtype.type(i % bits)) & one, begin, dtype=np.int64)

    short = [t if len(t) <= SLICE else b"" for t in texts]
    codes, begin = grams(short)
    number = np.diff(begin)
    total += number
    some = np.flatnonzero(number)
    if len(some):
        add(codes, some, begin[some])
    for i in np.flatnonzero([len(t) > SLICE for t in texts]):
        total[i] = 0
        for codes in long_grams(texts[i]):
            if len(codes):
                total[i] += len(codes)
                add(codes, np.array([i]), np.array([0]))
    rate = hits / np.maximum(total, 1)[:, None]
    return np.clip((rate - model.false_rate) / np.maximum(1 - model.false_rate, 1e-9), 0, 1), total


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (default: doc_id) with lang_pred, score and n_grams; only the text decides. `keep` must not hold a
    column of these names."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of a fixed size
    keep = ["doc_id"] if keep is None else keep
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]), has_letter.alias("_read"))
    kept_schema = rows.select(*keep).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, limit=SLICE):
            known = batch.column("_read").to_numpy(zero_copy_only=False) & bool(m.languages)
            lang, score, number = np.full(len(known), UNKNOWN, object), np.zeros(len(known)), np.zeros(len(known), np.int64)
            if known.any():
                found, number[known] = shares(m, lowered(batch.column("text").filter(pa.array(known))))
                lang[known] = np.array(m.languages, object)[found.argmax(axis=1)]
                score[known] = found.max(axis=1)
            out = [batch.column(c) for c in keep] + [pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(number, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "lang_pred", "score", "n_grams"])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept_schema] + ["lang_pred string", "score double", "n_grams bigint"])
    return rows.mapInArrow(run, ddl)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no model sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fit on the documents outside the held-out fold, predict all."""
    return predict(docs, fit(docs.filter(~held_out())), keep)


def rejected(lang_pred: str = "lang_pred", score: str = "score", n_grams: str = "n_grams") -> Column:
    """Texts in no learned language: nothing to read, or so few n-grams that any language contains among so many that the
    share of these is below `MIN_SCORE` beyond doubt. The fewer n-grams a text has, the less it can show."""
    surely = F.col(score) + F.sqrt(F.lit(math.log(1 / DOUBT) / 2) / F.greatest(F.col(n_grams), F.lit(1)))
    return (F.col(lang_pred) == UNKNOWN) | (surely < MIN_SCORE)
