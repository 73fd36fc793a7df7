"""Quality scores by compression: zstandard dictionaries of good and of bad texts.

A text is compressed twice, piece by piece, once with a dictionary built from texts labelled 1 and once with one built
from texts labelled 0. The difference of the two compressed sizes over the text's own size says which of them it is
closer to; a logistic curve, fitted on labelled texts that went into neither dictionary, turns it into the probability
of label 1. Dividing by the plain size, not by the compressed ones, keeps a text of few repeated words, which any
dictionary shrinks to almost nothing, near zero.

The dictionaries and the curve are fitted on at most `SAMPLE_ROWS` different texts per label of at most `SAMPLE_BYTES`
each (documented bounds; the rows are the first by a hash of id and text, odd ranks make the dictionaries, even ranks
the curve), so the model has a fixed size. Every text is scored whole, in pieces, so a long one needs no more memory
than its own bytes.

Defined cases: a null or empty text has difference 0 and gets the curve's value there; a label other than 0 and 1, or a
document with both, teaches nothing; rows of one id are scored one by one; too few texts for a trained dictionary are
used as they are; with one label only, or none, all scores are the share of label 1 in the sample, or one half; an
empty table gives an empty result. Other columns of the input are carried, never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import slices, utf8

SAMPLE_ROWS = 1_600  # per label, for dictionaries and curve together
SAMPLE_BYTES = 1 << 15  # of one sampled text
DICTIONARY_BYTES = 32_000
PIECE = 1 << 10
LEVEL = 3
CUT = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def curve(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -500, 500)))


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train one."""
    parts = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content) if content else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)


def differences(model: Model, texts: Iterable[bytes]) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) / plain size of each text; 0 for an empty one."""
    good, bad = compressor(model.good), compressor(model.bad)
    return np.array([sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(t)) / max(len(t), 1) for t in texts], float)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the maximum-likelihood curve, slightly shrunk so that separable data have one too."""
    scale = float(np.abs(x).max()) or 1.0
    z, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    ridge = np.diag([1e-3, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 4 / max(float(np.abs(step).max()), 1e-12))  # damped, since the curve may be steep
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold whose labels are never read; a null id is in the others."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[int, bytes]]:
    """(label, text) of at most `rows` different texts per label, in the order of a hash.

    Only ids and hashes meet the labels; texts are read for the chosen rows alone. Labels and copies are reduced before
    the join, and the best rows are a top-k report.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_m"))
    known = known.filter("label = _m").select("doc_id", F.col("label").cast("int").alias("label"))
    mark = F.xxhash64("text").alias("_mark")
    marks = docs.filter((F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", mark).distinct()
    each = marks.join(known, "doc_id").groupBy("label", "_mark").agg(F.min("doc_id").alias("doc_id"))  # a text counts once
    order = [F.xxhash64("doc_id", "_mark"), F.col("doc_id"), F.col("_mark")]
    chosen = [tuple(r) for label in (0, 1) for r in each.filter(F.col("label") == label).select("doc_id", "_mark", "label").sort(*order).limit(rows).collect()]
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, _mark long, label int")  # 2 * rows at most
    texts = docs.select("doc_id", "text", mark).join(F.broadcast(wanted), ["doc_id", "_mark"])
    found = texts.groupBy("doc_id", "_mark", "label").agg(F.min("text").alias("text")).sort(*order, "label").collect()
    return [(r["label"], r["text"].encode()) for r in found]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """`docs`: doc_id, text; `labels`: doc_id, quality."""
    texts = labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), rows)
    y = np.array([label for label, _ in texts], float)
    if len(set(y)) < 2:
        share = min(max(float(y.mean()), 1e-9), 1 - 1e-9) if len(y) else 0.5
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    by_label = {k: [t for label, t in texts if label == k] for k in (0, 1)}
    model = Model(dictionary(by_label[1][::2]), dictionary(by_label[0][::2]), 0.0, 0.0)
    rest = [(label, t) for label, ts in by_label.items() for t in (ts[1::2] or ts)]
    x = differences(model, [t for _, t in rest])
    model.slope, model.offset = logistic(x, np.array([label for label, _ in rest], float))
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (default: doc_id) with `score`, the probability of label 1; only the text decides."""
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_scored"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_scored"):
            out = model.curve(differences(model, utf8(batch.column("_scored"))))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(out, pa.float64())], names=[*keep, "score"])

    schema = rows.drop("_scored").schema.add("score", "double")
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted outside the held-out fold, all documents scored."""
    model = fit(docs.filter(~held_out()), labels)
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
