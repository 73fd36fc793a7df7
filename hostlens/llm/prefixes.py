"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

The turns of a conversation, in order, are cut into blocks of `WIDTH` positions; a block is one row with a turn id per
position and the key of the node that the blocks before it lead to. `GROUP BY node, ROLLUP (t1, ..., t4)` then makes all
prefixes that end inside a block at once, `grouping_id` tells their depth, and longer conversations go on in the rows of
their next blocks, all in the same aggregation: its number of jobs does not depend on the length of a conversation.

A turn id is the MD5 of role and text with the number of the text's code points. A node's key is the XOR of two 64-bit
hashes of (position, turn id) over its turns, so a block finds the key of its start by a running XOR, and a node that of
its parent by leaving out its last turn; nothing has to be looked up, and 128 bits tell nodes apart.

Sums over subtrees need no walk down the tree. A conversation owns the nodes of which it is the smallest member; these
are the last ones of its path, and each node has one owner. So the tokens saved in a node's subtree are, summed over its
members, the code points from that node down to the last node that the member does not own, and its childless nodes are
the members that own a childless end. Both are sums over members, which a second ROLLUP takes.

Numbers of turns come from a sort by (conversation, turn, turn id) over all tasks: rows get a place within their part of
the sort and each part an offset, so a conversation of any length is spread over tasks. Counts of hot nodes are
combined before the shuffle, hot parents reach their children by `joins.join_groups`, and the ids that end in one node
are joined up in ranges of `RANGE` numbers before one task hashes the ranges of that node in order.

Defined cases: a null role or text is empty; a null turn comes first; turns of one number are ordered by their turn id;
repeated rows are turns of their own; rows with a null conversation id take no part; a conversation without any turn
left ends at the root; very long texts only enter as their MD5 and length; an empty table has no nodes. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.operators.joins import join_groups
from hostlens.session import store

WIDTH = 4  # positions of a block
RUN = 1024  # blocks of one running XOR
RANGE = 4096  # conversation ids joined up at once
HEAD_EVERY = 100
HEAD_TURNS = 6  # a head has fewer turns
ROOT_ENDS = hashlib.sha256(b"").hexdigest()
POSITIONS = [f"t{i}" for i in range(1, WIDTH + 1)]


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of MD5 and 4 of length."""
    size = F.lpad(F.hex(F.length(text)), 8, "0")
    return F.unhex(F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), size))


def code_points(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("bigint")


def step(position: Column, turn: Column, lane: int) -> Column:
    """What a turn at a position adds to the key of a path; nothing if there is none."""
    return F.when(turn.isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.lit(lane), position.cast("bigint"), turn))


def xor(*columns: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), turn: the turns of each conversation in order, stored; and conv_id, n of each."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.filter("conv_id is not null").select("conv_id", F.col("turn").alias("number"), turn_id(text("role"), text("text")).alias("turn"))
    counted, _ = store(rows.groupBy("conv_id", "number", "turn").agg(F.count(F.lit(1)).alias("copies")))  # repeated rows come back below
    order = ["conv_id", "number", "turn"]
    parts, _ = store(counted.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part", "conv_id").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part that the conversation reaches
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("part", "conv_id").orderBy("number", "turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(offsets, ["part", "conv_id"]).withColumn("first", F.col("offset") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return placed.select("conv_id", "first", "turn", each.alias("copy")).select("conv_id", (F.col("first") + F.col("copy")).alias("at"), "turn")


def head_length(conv_id: str = "conv_id") -> Column:
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % HEAD_TURNS).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, at, turn of the conversations whose first turns are those of the first one of their hundred, and one row
    with place 0 per conversation, so that those without turns stay."""
    head_of = (F.col("conv_id") - F.col("conv_id") % HEAD_EVERY).alias("base")
    firsts = turns.filter((F.col("conv_id") % HEAD_EVERY == 0) & (F.col("at") < HEAD_TURNS))
    heads = firsts.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "turn"))).alias("head"))  # five turns at most
    each = turns.groupBy("conv_id").agg(F.max("at").alias("n")).select("conv_id", "n", head_of).join(heads, "base", "left")
    each, _ = store(each.select("conv_id", "n", F.coalesce(F.slice("head", F.lit(1), head_length()), F.array().cast("array<struct<at:bigint,turn:binary>>")).alias("head")))
    given = each.select("conv_id", F.inline(F.array_append("head", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("binary").alias("turn")))))
    own = turns.filter(F.col("at") > head_length())
    shifts = each.select("conv_id", "n", F.size("head").alias("taken"))
    own = join_groups(own, shifts, ["conv_id"], "n", ["at"])
    return given.unionByName(own.select("conv_id", (F.col("at") - head_length() + F.col("taken")).alias("at"), "turn"))


def blocks(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: block, k1, k2 and chars (key and code points of the path before it), t1 to t4,
    `last` (it is the conversation's last block)."""
    cut = F.greatest((F.col("at") - 1).cast("bigint"), F.lit(0))
    slots = turns.withColumn("block", F.floor(cut / WIDTH).cast("bigint")).withColumn("slot", F.when(F.col("at") > 0, cut % WIDTH))
    picks = [F.max(F.when(F.col("slot") == i, F.col("turn"))).alias(t) for i, t in enumerate(POSITIONS)]
    rows = slots.groupBy("conv_id", "block").agg(*picks)
    at = lambda i: F.col("block") * WIDTH + i
    for lane in (1, 2):
        rows = rows.withColumn(f"x{lane}", xor(*[step(at(i + 1), F.col(t), lane) for i, t in enumerate(POSITIONS)]))
    length = reduce(lambda a, b: a + b, [F.coalesce(code_points(F.col(t)), F.lit(0)) for t in POSITIONS])
    rows, _ = store(rows.withColumn("size", length).withColumn("run", F.floor(F.col("block") / RUN)))
    sums = [F.expr("bit_xor(x1)").alias("x1"), F.expr("bit_xor(x2)").alias("x2"), F.sum("size").alias("size"), F.max("block").alias("top")]
    runs = rows.groupBy("conv_id", "run").agg(*sums)  # a row for `RUN` blocks
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    runs = runs.select("conv_id", "run", F.max("top").over(whole).alias("top"),
                       *[F.coalesce(F.expr(f"bit_xor(x{i})").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)], F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("b"))
    inside = Window.partitionBy("conv_id", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(runs, ["conv_id", "run"])
    keys = [F.col(f"b{i}").bitwiseXOR(F.coalesce(F.expr(f"bit_xor(x{i})").over(inside), F.lit(0))).alias(f"k{i}") for i in (1, 2)]
    chars = (F.col("b") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("chars")
    return store(joined.select("conv_id", "block", *keys, chars, *POSITIONS, (F.col("block") == F.col("top")).alias("last"), "size"))[0]


def rolled(rows: DataFrame, aggregates: str) -> DataFrame:
    """All prefixes that end inside a block, by one ROLLUP: depth, key (k1, k2), parent's key (p1, p2), above (code points
    of the path without its last turn), length (of the last text), and `aggregates`; `level` is at hand in them as the
    number of turns in this block."""
    groups = rows.sparkSession.sql(
        f"""SELECT block, k1, k2, chars, {', '.join(POSITIONS)}, {WIDTH} - bit_count(grouping_id()) AS level, {aggregates}
        FROM {{rows}} GROUP BY block, k1, k2, chars, ROLLUP ({', '.join(POSITIONS)})""", rows=rows)
    last = F.element_at(F.array(*POSITIONS), F.greatest("level", F.lit(1)))
    real = groups.filter(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull()))
    at = lambda i: F.col("block") * WIDTH + i
    key = lambda lane, less: xor(F.col(f"k{lane}"), *[F.when(F.col("level") - less > i, step(at(i + 1), F.col(t), lane)).otherwise(0) for i, t in enumerate(POSITIONS)])
    so_far = [F.when(F.col("level") - 1 > i, code_points(F.col(t))).otherwise(0) for i, t in enumerate(POSITIONS)]
    out = real.withColumns({
        "depth": F.col("block") * WIDTH + F.col("level"), "n1": key(1, 0), "n2": key(2, 0), "p1": key(1, 1), "p2": key(2, 1),
        "above": reduce(lambda a, b: a + b, so_far, F.col("chars")),
    })
    return out.drop("block", "k1", "k2", "chars", *POSITIONS)


def ends(rows: DataFrame) -> DataFrame:
    """n1, n2, depth, ends_sha256 of the nodes in which conversations end."""
    turns = reduce(lambda a, b: a + b, [F.col(t).isNotNull().cast("bigint") for t in POSITIONS])
    at = lambda i: F.col("block") * WIDTH + i
    key = lambda lane: xor(F.col(f"k{lane}"), *[step(at(i + 1), F.col(t), lane) for i, t in enumerate(POSITIONS)])
    finals = rows.filter("last").select("conv_id", (F.col("block") * WIDTH + turns).alias("depth"), key(1).alias("n1"), key(2).alias("n2"))
    node = ["depth", "n1", "n2"]
    ranges = finals.groupBy(*node, F.floor(F.col("conv_id") / RANGE).cast("bigint").alias("range")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))  # `RANGE` ids at most
    joined = ranges.select(*node, "range", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None  # of one node at a time
        for batch in batches:
            out = []
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*node, "ids")]):
                if key == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*node, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, digest.hexdigest())], names=[*node, "ends_sha256"])

    dealt = joined.repartition(*node).sortWithinPartitions(*node, "range").select(*node, "ids")
    return dealt.mapInArrow(run, "depth bigint, n1 bigint, n2 bigint, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie over the turns of `rebuilt`, or of any conversations of that form: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = blocks(turns)
    node = ["depth", "n1", "n2"]
    plain, _ = store(rolled(rows, "min(conv_id) AS conv_id, count(*) AS n_convs"))
    children = plain.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = plain.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes, _ = store(nodes)
    # the nodes a conversation owns: code points above the first one, and whether the last one is childless
    owned = nodes.groupBy("conv_id").agg(F.min("above").alias("shared"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("size").alias("total"))
    per = sizes.join(owned, "conv_id", "left").select("conv_id", "n_blocks", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    members = join_groups(rows, per, ["conv_id"], "n_blocks", ["block"])
    before = [F.col("chars")]
    for t in POSITIONS[:-1]:
        before.append(before[-1] + F.coalesce(code_points(F.col(t)), F.lit(0)))
    gains = {f"g{i}": F.greatest(F.col("shared") - b, F.lit(0)) for i, b in enumerate([before[0], *before])}
    members = members.withColumns(gains)
    summed = rolled(members, ", ".join(["sum(leaf) AS n_leaves", *[f"sum(g{i}) AS g{i}" for i in range(WIDTH + 1)]]))
    saved = F.element_at(F.array(*gains), (F.col("level") + 1).cast("int"))
    sums = summed.select(*node, F.col("n_leaves").cast("bigint").alias("n_leaves"), saved.cast("bigint").alias("saved_tokens"))
    full = nodes.join(sums, node).join(ends(rows), node, "left")
    up = nodes.select(F.col("depth").alias("up"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    linked = join_groups(full.withColumn("up", F.col("depth") - 1), up, ["up", "p1", "p2"], "n", node, unmatched=F.col("up") < 0)
    return linked.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(ROOT_ENDS)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations. `conversations`: conv_id, turn, role, text."""
    return trie(rebuilt(store(ordered_turns(conversations))[0]))


ORACLE = f"""
WITH bits AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS v FROM range(256) r(i))
), convs AS (
  SELECT conv_id, conv_id - conv_id % {HEAD_EVERY} AS base, (xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a >> 8, t[xor(a % 256, b) + 1]))) % {HEAD_TURNS})::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), bits
), msgs AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, length(coalesce(text, '')) AS chars, turn FROM conversations
), paths AS (
  SELECT conv_id, list({{'m': m, 'chars': chars}} ORDER BY turn NULLS FIRST, m) AS p FROM msgs GROUP BY conv_id
), full_paths AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(b.p[:h], []), coalesce(o.p[h + 1:], [])) AS p FROM convs c LEFT JOIN paths b ON b.conv_id = c.base JOIN paths o ON o.conv_id = c.conv_id
), members AS MATERIALIZED (
  SELECT conv_id, d, md5(array_to_string(list_transform(p[:d], lambda x: x.m), ' ')) AS node, md5(array_to_string(list_transform(p[:d - 1], lambda x: x.m), ' ')) AS up,
    CASE WHEN d > 0 THEN p[d].chars ELSE 0 END AS chars, d = len(p) AS is_end
  FROM full_paths, unnest(range(len(p) + 1)) t(d)
), nodes AS MATERIALIZED (
  SELECT d, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM members GROUP BY d, node
), kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT DISTINCT a.d, a.node, b.d AS d2, b.node AS node2 FROM members a JOIN members b ON b.conv_id = a.conv_id AND b.d >= a.d
), subtree AS (
  SELECT below.d, below.node, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
  FROM below JOIN nodes n ON n.d = d2 AND n.node = node2 LEFT JOIN kids k ON k.d = d2 AND k.node = node2 GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree s USING (d, node) LEFT JOIN kids k USING (d, node) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.up AND n.d > 0"""
