"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is rendered once as
the prompt, what follows becomes a pair of completions in which only the trained role is unmasked.

A message is (turn, role, text); a side is the ordered bag of its messages. The prompt of a pair ends before the first
message, in the order (turn, role, text), that the two sides do not hold equally often. Where turn numbers are unique
in a conversation this is the longest common prefix of turns. It needs two aggregations with map-side combining and
one join that spreads a pair over its messages, so neither a very long conversation nor one with very many copies is
gathered in one task. `place` orders the segments of each part and tells where they stand in its text; `assemble`, which
builds whole strings, is for conversations that fit in a row.

Defined cases: a null role or text counts as empty, a null turn comes before all others; a message that is repeated
counts as often as it stands there; a pair with only one side has an empty prompt; pairs whose sides are equal have
empty completions; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.session import cut_lineage

TRAINED_ROLE = "assistant"
KEY = ["turn", "role", "text"]


def render(role: Column, text: Column) -> Column:
    """One message in the chat format."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_pairs(messages: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """Rendered segments of every pair.

    `messages`: pair_id, chosen (boolean), turn, role, text. Returns pair_id, part (prompt, chosen, rejected), turn,
    role, text, copies, rendered, trained: the segments of the prompt once, those of each completion with `trained`
    true where the loss counts.
    """
    clean = messages.select("pair_id", F.col("chosen").alias("_c"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    both = clean.groupBy("pair_id", *KEY).agg(F.count_if("_c").alias("n_c"), F.count_if(~F.col("_c")).alias("n_r"))
    order = F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text")
    first = both.filter("n_c <> n_r").groupBy("pair_id").agg(F.min(order).alias("_first")).withColumnRenamed("pair_id", "_pair")
    joined = both.join(first, F.col("pair_id").eqNullSafe(F.col("_pair")), "left")
    shared = F.col("_first").isNull() | (order < F.col("_first"))
    parts = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("n_c").alias("copies")))).otherwise(
        F.array(F.struct(F.lit("chosen").alias("part"), F.col("n_c").alias("copies")), F.struct(F.lit("rejected").alias("part"), F.col("n_r").alias("copies")))
    )
    out = joined.select("pair_id", *KEY, F.inline(parts)).filter("copies > 0")
    trained = (F.col("part") != "prompt") & (F.col("role") == F.lit(trained_role))
    return out.select("pair_id", "part", *KEY, "copies", render(F.col("role"), F.col("text")).alias("rendered"), trained.alias("trained"))


def assemble(segments: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected as strings, and for each completion its trained spans (start, length)."""
    piece = F.struct("turn", "role", "text", F.expr("repeat(rendered, int(copies))").alias("r"), "trained")
    parts = segments.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["r"])).alias("at"),
        F.when(x["trained"], F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), F.length(x["r"]).alias("length")))).otherwise(acc["spans"]).alias("spans"),
    )
    done = parts.select("pair_id", "part", F.array_join(F.transform("p", lambda x: x["r"]), "").alias("t"), F.aggregate("p", begin, step)["spans"].alias("s"))
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    text = lambda part: F.coalesce(pick(part, "t"), F.lit("")).alias(part)
    return done.groupBy("pair_id").agg(text("prompt"), text("chosen"), text("rejected"), pick("chosen", "s").alias("chosen_spans"), pick("rejected", "s").alias("rejected_spans"))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Preference pairs of a table without preferences: conversation 2k is chosen, 2k + 1 rejected."""
    even = F.pmod("conv_id", F.lit(2)) == 0
    return conversations.select(F.floor(F.col("conv_id") / 2).cast("bigint").alias("pair_id"), F.coalesce(even, F.lit(True)).alias("chosen"), "turn", "role", "text")


def place(segments: DataFrame) -> DataFrame:
    """`segments` with `place`, how many messages of its part stand before it, and `start`, how many characters; the
    `copies` of a segment follow one another from there. So the part's text and the mask spans (start, copies * n_chars of
    trained segments) can be read off without building it.

    Rows are sorted into ranges by (pair, part, turn, role, text), so a pair of any size is cut into many tasks. At most
    one part lies across the border between two ranges: what it needs from earlier ranges, at most two rows a border, is
    broadcast.
    """
    spark = segments.sparkSession
    sized = segments.withColumn("n_chars", F.length("rendered").cast("bigint"))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(sized.repartitionByRange(n, "pair_id", "part", *KEY).withColumn("_range", F.spark_partition_id()))
    group = ["pair_id", "part"]
    measures = {"place": F.col("copies"), "start": F.col("copies") * F.col("n_chars")}
    totals = ranged.groupBy(*group, "_range").agg(*[F.sum(c).alias(f"_{m}") for m, c in measures.items()])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    across = totals.withColumn("_n", F.count(F.lit(1)).over(whole)).filter("_n > 1").select(
        F.col("pair_id").alias("_pair"), F.col("part").alias("_of"), F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_{m}") for m in measures])
    same = F.col("pair_id").eqNullSafe(F.col("_pair")) & (F.col("part") == F.col("_of")) & (F.col("_range") == F.col("_at"))
    inside = Window.partitionBy(*group, "_range").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.withColumns({m: F.coalesce(F.sum(c).over(inside), F.lit(0)) for m, c in measures.items()})
    out = counted.join(F.broadcast(across), same, "left")
    return out.select(*group, *[(F.col(m) + F.coalesce(f"_{m}", F.lit(0))).alias(m) for m in measures], "copies", "n_chars", "turn", "role", "trained", "rendered")


ORACLE = """
WITH m AS (
  SELECT floor(conv_id / 2)::BIGINT AS pair_id, coalesce(conv_id % 2 = 0, true) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
), b AS (
  SELECT pair_id, turn, role, text, count(*) FILTER (c) AS n_c, count(*) FILTER (NOT c) AS n_r FROM m GROUP BY ALL
), f AS (
  SELECT *, min(CASE WHEN n_c <> n_r THEN (coalesce(turn, -9223372036854775808), role, text) END) OVER (PARTITION BY pair_id) AS cut FROM b
), g AS (
  SELECT pair_id, turn, role, text, 'prompt' AS part, n_c AS copies FROM f WHERE cut IS NULL OR (coalesce(turn, -9223372036854775808), role, text) < cut
  UNION ALL SELECT pair_id, turn, role, text, 'chosen', n_c FROM f WHERE (coalesce(turn, -9223372036854775808), role, text) >= cut AND n_c > 0
  UNION ALL SELECT pair_id, turn, role, text, 'rejected', n_r FROM f WHERE (coalesce(turn, -9223372036854775808), role, text) >= cut AND n_r > 0
), r AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, part <> 'prompt' AND role = 'assistant' AS trained FROM g
)
SELECT pair_id, part, coalesce(sum(copies) OVER w, 0)::BIGINT AS place, coalesce(sum(copies * length(rendered)) OVER w, 0)::BIGINT AS start,
  copies, length(rendered)::BIGINT AS n_chars, turn, role, trained, rendered
FROM r WINDOW w AS (PARTITION BY pair_id, part ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
