"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a step from its name). The
shards take turns; at its turn a shard claims the first slot of its permutation that is still free. The filled table
gives every shard `slots // shards` slots or one more, and adding or removing a shard moves few keys. The table has
`slots` rows whatever the data, so it is broadcast; a row is placed by one hash and one probe, with no shuffle, and a
hot source does not matter because the key is the row's own id.

Defined cases: a null key is placed as its own key value (all rows with null go to one slot); equal keys share a
slot; an empty table gives an empty result; columns of the input named like the results are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 32
SLOTS = 4099  # a prime; over 100 slots a shard keep the shares within 1 %
NULL_KEY = "\\N"


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], slots: int) -> list[int]:
    """Index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and there must be one at least")
    if slots < len(shards) or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, no smaller than the number of shards")
    at = [_number(f"offset|{name}") % slots for name in shards]
    step = [_number(f"skip|{name}") % (slots - 1) + 1 for name in shards]
    owner = [-1] * slots
    for turn in range(slots):
        s = turn % len(shards)
        while owner[at[s]] >= 0:
            at[s] = (at[s] + step[s]) % slots
        owner[at[s]] = s
    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard): `slots` rows."""
    return spark.createDataFrame(list(enumerate(fill_table(shards, slots))), "slot bigint, shard int")


def slot_of(key: Column, slots: int) -> Column:
    hexed = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(NULL_KEY))), 1, 15)
    return F.conv(hexed, 16, 10).cast("bigint") % F.lit(slots)


def place(df: DataFrame, key: str, shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """`df` with its `slot` and `shard`."""
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else shards
    lookup = lookup_table(df.sparkSession, names, slots)
    return df.withColumn("slot", slot_of(F.col(key), slots)).drop("shard").join(F.broadcast(lookup), "slot")


def shard_sizes(placed: DataFrame) -> DataFrame:
    """Rows per shard."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))


def oracle(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The same placement of `documents` in SQL: the table is filled by a recursive query, one turn a row."""
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE names AS (
  SELECT i, {number.format("'offset|shard-' || i")} % {slots} AS o, {number.format("'skip|shard-' || i")} % {slots - 1} + 1 AS k
  FROM range({shards}) t(i)
), pref AS (
  SELECT list(o ORDER BY i) AS o, list(k ORDER BY i) AS k FROM names
), fill AS (
  SELECT 0::BIGINT AS turn, NULL::BIGINT AS slot, list_transform(range({slots}), lambda x: -1) AS owner
  UNION ALL
  SELECT turn + 1, slot, list_concat(list_concat(owner[1:slot], [turn % {shards}]), owner[slot + 2:]) FROM (
    SELECT turn, owner, list_filter(list_transform(range({slots}), lambda j: (o[turn % {shards} + 1] + j * k[turn % {shards} + 1]) % {slots}),
                                    lambda s: owner[s + 1] < 0)[1] AS slot
    FROM fill, pref WHERE turn < {slots})
), own AS (
  SELECT slot, ((turn - 1) % {shards})::INT AS shard FROM fill WHERE turn > 0
)
SELECT doc_id, slot, shard
FROM (SELECT doc_id, {number.format(f"coalesce(doc_id::VARCHAR, '{NULL_KEY}')")} % {slots} AS slot FROM documents) JOIN own USING (slot)"""
