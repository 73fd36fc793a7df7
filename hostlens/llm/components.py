"""Connected components of an edge table, by alternating large and small stars.

Both steps are a group-by with map-side combining and a join that Spark may split where a node is hot; the edge table is
written to the shared folder after each round, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.session import remove_dir, store


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of its neighbours and itself. Edges are (a, b), a > b."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect every node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    joined = edges.join(least, F.col("a") == F.col("u"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for each node with an edge. `edges` has two columns a, b of one
    type that can be ordered; loops, repeated edges and either direction are allowed."""
    spark = edges.sparkSession
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now, path = store(edges.filter("a <> b").select(a.alias("a"), b.alias("b")).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        nxt, nxt_path = store(_small_star(_large_star(now).distinct()).distinct())
        remove_dir(spark, path)
        now, path, before, seen = nxt, nxt_path, seen, mark(nxt)
        if seen == before:
            break
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
