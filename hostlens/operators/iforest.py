"""Isolation forest: small random trees grown in tasks, scored over a broadcast node table.

A tree only ever sees about `sample` rows, picked by hash, so growing is bounded whatever the data size, and
the model is at most 2 * trees * sample nodes.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.functions.columns import hash_hex, hex_prefix

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks carry these helpers along, workers need no package

NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, size long, depth int"
EULER = 0.5772156649015329


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n > 2, 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0), 0.0)
    return np.where(n == 2, 1.0, out)


def grow(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    """Nodes of one tree: random feature among those that vary, cut uniform between its bounds."""
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, len(rows), depth])
        if parent is not None:
            nodes[parent][side] = me
        if depth >= limit or len(rows) <= 1:
            continue
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        varying = np.flatnonzero(hi > lo)
        if varying.size == 0:
            continue
        f = int(rng.choice(varying))
        cut = float(rng.uniform(lo[f], hi[f]))
        nodes[me][2], nodes[me][3] = f, cut
        below = x[rows, f] < cut
        todo.append((rows[below], depth + 1, me, 4))
        todo.append((rows[~below], depth + 1, me, 5))
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForestModel:
    nodes: DataFrame
    features: list[str]
    trees: int
    sample: int

    def save(self, path: str) -> None:
        meta = self.nodes.sparkSession.createDataFrame([(self.features, self.trees, self.sample)], "features array<string>, trees int, sample int")
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        meta.write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> IsolationForestModel:
        m = spark.read.parquet(f"{path}/meta").first()
        return IsolationForestModel(spark.read.parquet(f"{path}/nodes"), list(m["features"]), m["trees"], m["sample"])

    def score(self, df: DataFrame, out: str = "proba") -> DataFrame:
        """Anomaly score 2^(-mean path / expected path): near 1 is odd, below 0.5 is ordinary."""
        bound = 4 * self.trees * max(self.sample, 2)
        if self.nodes.count() > bound:
            raise ValueError("more nodes than the forest's own bound")
        pdf = self.nodes.toPandas()
        forest = []
        for _, t in pdf.sort_values(["tree", "node"]).groupby("tree"):
            leaf_path = t["depth"].to_numpy() + expected_path(t["size"].to_numpy())
            forest.append((t["feature"].to_numpy(), t["cut"].to_numpy(), t["left"].to_numpy(), t["right"].to_numpy(), leaf_path, int(t["depth"].max()),
                           int(t.loc[t["node"] == 0, "size"].iloc[0])))
        norm = float(expected_path(np.mean([t[6] for t in forest])))
        shared = df.sparkSession.sparkContext.broadcast(forest)

        @F.pandas_udf("double")
        def anomaly(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for feature, cut, left, right, path, depth, _ in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth):
                    f = feature[at]
                    inner = f >= 0
                    go_left = inner & (x[rows, np.maximum(f, 0)] < cut[at])
                    at = np.where(go_left, left[at], np.where(inner, right[at], at))
                total += path[at]
            return pd.Series(np.power(2.0, -(total / len(shared.value)) / max(norm, 1e-12)))

        return df.withColumn(out, anomaly(*[F.col(c).cast("double") for c in self.features]))


def fit(df: DataFrame, features: list[str], row_key: list[str], trees: int = 400, sample: int = 512, seed: int = 42,
        label: str | None = None) -> IsolationForestModel:
    """Grow the forest. With `label` only rows labelled 0 are used (novelty mode).

    Rows are dealt into disjoint sets of about `sample` by hash, one tree per set; small tables are dealt
    again with another seed until there are enough sets. Nothing is sorted and only sampled rows are shuffled.
    """
    base = df.filter(F.col(label) == 0) if label else df
    n = base.count()
    if n == 0:
        raise ValueError("no rows to fit")
    sets = max(1, n // sample)
    rounds = -(-trees // sets)
    dealt = base.select(*row_key, *features).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    slot = hex_prefix(hash_hex(seed, "_round", *row_key), 12) % sets
    dealt = dealt.withColumn("tree", (F.col("_round") * sets + slot).cast("int")).filter(F.col("tree") < trees)
    cols = list(features)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(row_key)[cols].to_numpy(dtype=float)
        return pd.DataFrame(grow(int(key[0]), x, seed), columns=["tree", "node", "feature", "cut", "left", "right", "size", "depth"])

    nodes = dealt.select("tree", *row_key, *cols).groupBy("tree").applyInPandas(build, NODE_SCHEMA)
    return IsolationForestModel(nodes, cols, trees, sample)
