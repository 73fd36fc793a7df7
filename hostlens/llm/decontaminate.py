"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

All of it is DataFrame work. The words of a document are cut into windows as long as a benchmark item (in shingles of
five words); windows that share no shingle with any item of their size have similarity 0 and are not built. The 64-bit
SimHash of a window is split into eight blocks. If two fingerprints differ in at most `RADIUS` bits, some block differs
in at most `RADIUS // 8`, so an index that holds every block value within that distance of an item's returns all items
within the radius. What it returns is checked by Hamming distance and verified by the exact weighted similarity of the
shingles, sum of the smaller over sum of the larger counts.

Fingerprints are made of the shingles as a set, in which the k-th occurrence of a shingle is an element of its own: the
similarity of these sets is the weighted one, and a shingle that makes up much of a text weighs no more than its count.
At a similarity of 0.8 the fingerprints of equally many elements differ by 9.7 bits on average with a standard deviation
of 2.9; the radius lies five of these above, a pair at the threshold is missed with probability 3e-6 at most. A document
shorter than an item would be missed more often (1e-4 for 4 shingles of 5); it is found by the first elements of both
sets instead, which loses nothing. The documents are scanned once against broadcast item shingles; a benchmark of more than
`BROADCAST_ROWS` shingles is taken in blocks. Every later key contains the document, so a passage that very many
documents hold is spread like them.

Defined cases: null texts and texts without words are clean; a text or item of fewer than five words is one shingle; a
document shorter than an item is compared whole; rows of one id are reported once per item with their best window;
ties go to the first window; items without words match nothing; a null item id is an id like others; empty tables give an empty result. Other columns are
not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import unused
from hostlens.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
RADIUS = 24
BLOCKS = 8
BROADCAST_ROWS = 1_000_000
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LANES = 4  # 16-bit counters in a long


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def shingle_list(words: Column) -> Column:
    """Fingerprints of all shingles of a word list, in order."""
    n = F.greatest(F.size(words) - (WORDS - 1), F.least(F.size(words), F.lit(1)))
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WORDS)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<bigint>"))


def tagged(shingles: Column) -> Column:
    """A list as a set: the k-th occurrence of a value becomes a value of its own for k > 1."""
    numbered = F.transform(
        shingles, lambda h, i: F.when(F.array_position(shingles, h) == i + 1, h).otherwise(F.xxhash64(h, F.size(F.filter(F.slice(shingles, 1, i + 1), lambda x: x == h))))
    )
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), shingles).otherwise(numbered)


def simhash(windows: DataFrame, keys: list[str], shingles: str) -> DataFrame:
    """`keys` and `print`: per bit, whether more than half of the shingles have it; four counters share one sum."""
    each = windows.select(*keys, F.size(shingles).alias("_n"), F.explode(shingles).alias("_h"))
    sums = []
    for i in range(0, 64, LANES):
        lanes = [F.shiftleft(F.shiftrightunsigned("_h", i + j).bitwiseAND(1), 16 * j) for j in range(LANES)]
        sums.append(F.sum(reduce(lambda a, b: a.bitwiseOR(b), lanes)))
    counted = each.groupBy(*keys).agg(F.first("_n").alias("_n"), F.array(*sums).alias("_s"))
    on = f"(shiftrightunsigned(_s[int(b div {LANES})], 16 * (b % {LANES})) & 65535L) * 2 > _n"  # a lambda keeps the plan small
    return counted.select(*keys, F.expr(f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if({on}, shiftleft(1L, b), 0L))").alias("print"))


def block(value: Column, i: int) -> Column:
    return F.shiftrightunsigned(value, 8 * i).bitwiseAND(0xFF)


def item_index(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with size, shingles, their set and its fingerprint; index rows: size, block, value, item_id)."""
    clean = items.select("item_id", shingle_list(words_of(F.col("text"))).alias("shingles")).distinct()
    clean = clean.withColumn("size", F.size("shingles")).filter("size > 0").withColumn("wanted", tagged(F.col("shingles")))
    clean = clean.withColumn("_k", F.xxhash64(F.col("item_id").isNull(), "item_id", "shingles"))
    full = cut_lineage(clean.join(simhash(clean, ["size", "_k"], "wanted"), ["size", "_k"]).drop("_k"))
    near = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda m: F.bit_count(m) <= RADIUS // BLOCKS)
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), block(F.col("print"), i).alias("value")) for i in range(BLOCKS)])
    index = full.select("size", "item_id", "print", F.inline(blocks)).withColumn("mask", F.explode(near))
    value = F.col("value").bitwiseXOR(F.col("mask").cast("bigint")).alias("value")
    return full, cut_lineage(index.select("size", "item_id", F.col("print").alias("item_print"), "block", value))


def hits(docs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """Places of documents that hold a shingle of an item, with the words that the windows around them need."""
    listed = docs.select("doc_id", F.xxhash64("text").alias("mark"), words_of(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    shifted = [F.col("w")] + [F.slice("w", F.lit(j + 1), F.greatest(F.col("n_words"), F.lit(0))) for j in range(1, WORDS)]
    runs = F.arrays_zip(*[c.alias(f"w{j}") for j, c in enumerate(shifted)])
    each = listed.select("doc_id", "mark", "w", "n_words", F.posexplode(runs).alias("pos", "run"))
    each = each.select("doc_id", "mark", "w", "n_words", "pos", *[F.col("run")[f"w{j}"].alias(f"w{j}") for j in range(WORDS)])
    each = each.filter(F.col(f"w{WORDS - 1}").isNotNull() | ((F.col("pos") == 0) & (F.col("n_words") < WORDS)))
    each = each.withColumn("shingle", F.xxhash64(*[F.col(f"w{j}") for j in range(WORDS)]))
    parts = max(1, math.ceil(rows / BROADCAST_ROWS))
    found = []
    for part in range(parts):
        mine = known if parts == 1 else known.filter(F.pmod("shingle", F.lit(parts)) == part)
        hit = each.join(F.broadcast(mine), "shingle")
        first = F.greatest(F.col("pos") - F.col("size") + 1, F.lit(0))
        around = F.slice("w", first + 1, 2 * F.col("size") + WORDS - 2)
        shingles_in_doc = F.greatest(F.col("n_words") - (WORDS - 1), F.lit(1))
        found.append(hit.select("doc_id", "mark", "size", "pos", first.alias("first"), around.alias("around"), shingles_in_doc.alias("n")))
    return reduce(DataFrame.unionByName, found)


def windows(found: DataFrame) -> DataFrame:
    """Each window with a hit once: it belongs to the first of its hits."""
    order = Window.partitionBy("doc_id", "mark", "size").orderBy("pos")
    low = F.greatest(F.coalesce(F.lag("pos").over(order) + 1, F.lit(0)), F.col("first"))
    ranged = found.withColumn("low", low).withColumn("high", F.least("pos", F.greatest(F.col("n") - F.col("size"), F.lit(0)))).filter("low <= high")
    ranged = ranged.withColumn("around", shingle_list(F.col("around")))
    each = ranged.select("doc_id", "mark", "size", "first", "around", F.explode(F.sequence("low", "high")).alias("start"))
    return each.select("doc_id", "mark", "size", "start", F.slice("around", F.col("start") - F.col("first") + 1, F.col("size")).alias("shingles"))


def short_pairs(short: DataFrame, full: DataFrame, keys: list[str], threshold: float, small: bool) -> DataFrame:
    """`keys`, held and item_id of documents shorter than an item that can reach the threshold.

    Two sets of m and n elements with that similarity share `t / (1 + t) * (m + n)`; so, in any one order, one of the
    first elements that are left beside these. An item's part is that for the shortest document.
    """
    least = lambda n: F.ceil(n - F.lit(1e-9))
    held, size = F.size("held"), F.col("size")
    mine = F.slice(F.array_sort("held"), F.lit(1), (held - least((held + size) * (threshold / (1 + threshold))) + 1).cast("int"))
    probes = short.filter((held < size) & (held >= least(size * threshold))).select(*keys, "held", F.explode(mine).alias("shingle"))
    first = F.slice(F.array_sort("wanted"), F.lit(1), (size - least(size * threshold) + 1).cast("int"))
    wanted = full.select("size", "item_id", F.explode(first).alias("shingle"))
    return probes.join(F.broadcast(wanted) if small else wanted, ["size", "shingle"]).select(*keys, "held", "item_id")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity (of the best window), first_word (where it starts), n_windows (that reach the threshold).

    Items, their index, the windows and their fingerprints are written between the steps, so that each has a small plan
    and windows are cut once.
    """
    full, index = item_index(items.select("item_id", "text"))
    known = full.select("size", F.explode("shingles").alias("shingle")).distinct()
    rows = known.count()
    keys = ["doc_id", "mark", "size", "start"]
    cut = windows(hits(docs.select("doc_id", "text"), known, rows))
    cut = cut_lineage(cut.withColumn("held", tagged(F.col("shingles"))).drop("shingles"))
    prints = cut_lineage(simhash(cut.filter(F.size("held") == F.col("size")), [*keys, "held"], "held"))
    split = F.array(*[F.struct(F.lit(i).alias("block"), block(F.col("print"), i).alias("value")) for i in range(BLOCKS)])
    probes = prints.select(*keys, "held", "print", F.inline(split))
    small = rows <= BROADCAST_ROWS // 1000
    met = probes.join(F.broadcast(index) if small else index, ["size", "block", "value"])
    close = met.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    pairs = cut_lineage(close.select(*keys, "held", "item_id").unionByName(short_pairs(cut, full, keys, threshold, small)).distinct())
    texts = full.select(F.col("item_id").alias("_item"), F.col("size").alias("item_size"), "wanted")
    sized = pairs.join(F.broadcast(texts) if small else texts, F.col("item_id").eqNullSafe(F.col("_item"))).filter("size = item_size")
    common = F.size(F.array_intersect("held", "wanted"))
    similarity = common / (F.size("held") + F.size("wanted") - common)
    sure = sized.withColumn("similarity", similarity).filter(F.col("similarity") >= F.lit(threshold))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    out = sure.groupBy("doc_id", "item_id").agg(best.alias("best"), F.count(F.lit(1)).alias("n_windows"))
    return out.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("bigint").alias("first_word"), "n_windows")


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    key = unused("_id", docs)
    ids = found.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")


ORACLE = f"""
WITH dw AS (
  SELECT doc_id, md5(text) AS mark, list_filter(string_split_regex(lower(text), '{SEPARATORS}'), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)
), iw AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '{SEPARATORS}'), lambda x: x <> '') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)
), d AS (
  SELECT doc_id, mark, greatest(len(w) - 4, 1) AS n, unnest(range(greatest(len(w) - 4, 1))) AS pos, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS h
  FROM dw WHERE len(w) > 0
), i AS (
  SELECT item_id, greatest(len(w) - 4, 1) AS size, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS h
  FROM iw WHERE len(w) > 0
), ic AS (
  SELECT item_id, size, h, count(*) AS c FROM i GROUP BY ALL
), starts AS (
  SELECT DISTINCT doc_id, mark, n, item_id, size, unnest(range(greatest(pos - size + 1, 0), least(pos, greatest(n - size, 0)) + 1)) AS start
  FROM d JOIN ic USING (h)
), wc AS (
  SELECT s.doc_id, s.mark, s.item_id, s.size, s.start, d.h, count(*) AS c
  FROM starts s JOIN d ON d.doc_id = s.doc_id AND d.mark = s.mark AND d.pos >= s.start AND d.pos < s.start + s.size GROUP BY ALL
), j AS (
  SELECT wc.doc_id, wc.mark, wc.item_id, wc.start, sum(least(wc.c, coalesce(ic.c, 0))) AS common, sum(wc.c) + any_value(wc.size) AS total
  FROM wc LEFT JOIN ic ON ic.item_id = wc.item_id AND ic.h = wc.h GROUP BY ALL
), sim AS (
  SELECT *, common::DOUBLE / (total - common)::DOUBLE AS similarity FROM j
)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start, (-similarity, start))::BIGINT AS first_word, count(*) AS n_windows
FROM sim WHERE similarity >= {THRESHOLD} GROUP BY doc_id, item_id"""
