"""From raw documents to tokens: the stages of a training-data pipeline, each one operator of `hostlens.llm`.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of `documents` and any
other columns of its input; the last one returns a row per document with its token digest. Between two stages the rows
are written as Parquet and read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm import bpe, decontaminate, jaccard, language, suffix
from hostlens.llm.common import table
from hostlens.session import store

VOCABULARY = "byte_bpe_50k.json"


def _carried(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with every column but the id and the text under a name that no operator uses, and these names."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification; documents in no learned language go.

    Null texts and texts without letters are in no language and go. Empty and short texts of letters have too few n-grams
    to tell and stay; long texts are read whole. Repeated rows and rows without an id are judged one by one. Ties go to
    the first language by name, which changes nothing here. Other columns are carried under any name.
    """
    model = language.fit(docs.filter(~language.held_out()).select("doc_id", "text", "lang"))
    rows, names = _carried(docs)
    found = language.predict(rows, model, rows.columns).filter(~language.rejected())
    return found.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join; of each connected group the document with the smallest id and hash stays.

    A null id is the smallest. Texts without words (null, empty) are only copies of themselves; of repeated rows one
    stays; texts of fewer than five words are one shingle; long texts count whole. Other columns are carried.
    """
    rows, names = _carried(docs)
    kept = jaccard.keep_one(rows, jaccard.join(rows))
    return kept.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup; bytes of strings that occur elsewhere go, `n_chars` follows the text.

    A null text stays null; texts shorter than a passage stay as they are, even empty; a repeated row that is long enough
    is a repetition and is emptied, no row goes. Long texts are treated whole. Other columns are carried.
    """
    rows, names = _carried(docs)
    found = suffix.remove_repeats(rows, keep=rows.columns, with_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("remaining"))
    out = {c: F.col(n) for c, n in names.items()} | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("remaining").cast("bigint")).otherwise(F.col(names["n_chars"]))
    return found.select(*[out[c].alias(c) for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination; documents that hold an item go.

    Texts without words (null, empty) are clean; of several rows of one id all go if one holds an item; an item without
    words matches nothing; long texts are searched whole. Other columns are carried.
    """
    return decontaminate.remove(docs, decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of what is left, a row per row.

    A null text counts as empty and has no tokens; long texts are encoded whole. Other columns are left out.
    """
    return bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("tokens", tokenize),
]

# Language models, suffix ranks and BPE cannot be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))[0]
    return STAGES[-1][1](spark, docs, sf_dir)
