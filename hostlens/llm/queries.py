"""The named queries of this subpackage: each applies one operator with production parameters to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from hostlens.llm import ann, bpe, centroids, chat, decontaminate, jaccard, language, licenses, prefixes, quality, sharding, suffix, tokens
from hostlens.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_chat_format(spark, sf_dir):
    return chat.place(chat.format_pairs(chat.neighbours(table(spark, sf_dir, "conversations"))))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = language.held_out().alias("held_out")
    return language.identify(docs).select("doc_id", held, "lang_pred", F.col("score"))


def op8_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_graph_search(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


def op11_prefix_trie(spark, sf_dir):
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_centroid_clustering(spark, sf_dir):
    return centroids.report(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op13_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_jaccard_join, op3_bpe, op4_token_counts, op5_chat_format, op6_decontaminate, op7_language_id, op8_license_scan, op9_graph_search,
    op10_sharding, op11_prefix_trie, op12_centroid_clustering, op13_quality_classifier, pipeline,
)}
ORACLES = {
    "op2_jaccard_join": jaccard.ORACLE, "op5_chat_format": chat.ORACLE, "op6_decontaminate": decontaminate.ORACLE, "op10_sharding": sharding.oracle(),
    "op11_prefix_trie": prefixes.ORACLE, "op12_centroid_clustering": centroids.oracle(),
}
