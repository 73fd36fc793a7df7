"""Detectors as Spark ML estimators, and what they need around them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import hash_fraction
from hostlens.operators import clean, iforest
from hostlens.operators.splits import vector_key, weighted

# --- fixed values: production settings ---------------------------------------------------------------

RF = {"numTrees": 300, "maxDepth": 12, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt", "seed": 42}
GBT = {"maxIter": 400, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 5, "seed": 42}
MLP = {"hidden": [256, 128, 64, 32], "maxIter": 50, "blockSize": 512, "stepSize": 0.001, "solver": "l-bfgs", "seed": 42}
IFOREST = {"trees": 400, "sample": 512, "seed": 42, "novelty": False}

GRIDS = {
    "rf": {"maxDepth": [4, 8, 12, 20, 30], "numTrees": [100, 300, 500]},
    "gbt": {"maxDepth": [3, 6, 9], "stepSize": [0.01, 0.05, 0.1, 0.2]},
    "mlp": {"stepSize": [0.01, 0.001, 0.0001]},
    "iforest": {"trees": [50, 100, 200, 400], "sample": [64, 128, 256, 512]},
}

# --- end of fixed values -----------------------------------------------------------------------------

VECTOR = "features"
ASSEMBLED = "_raw_features"


def prepare(df: DataFrame, features: list[str], row_key: str | None = None, label: str = "label", log: bool = True) -> DataFrame:
    """Adds `vector` (group key on the real values), then imputes and log-scales the features."""
    keyed = vector_key(df, features)
    if row_key and row_key != "row_id":
        keyed = keyed.withColumn("row_id", F.col(row_key))
    out = clean.impute(keyed, features)
    if log:
        out = clean.log1p_continuous(out, features)
    return out.withColumn("label", F.col(label).cast("double"))


def upsample_minority(df: DataFrame, label: str = "label", row_key: str = "row_id", seed: int = S.CV_SEED) -> DataFrame:
    """Repeat minority rows until the classes are about even; no row is dropped."""
    n = {int(r[label]): r["count"] for r in df.groupBy(label).count().collect()}
    if len(n) < 2:
        return df
    minor = min(n, key=n.get)
    ratio = max(n.values()) / n[minor]
    whole, part = int(ratio), ratio - int(ratio)
    extra = (hash_fraction(seed, row_key) < part).cast("int")
    copies = F.when(F.col(label) == minor, F.lit(whole) + extra).otherwise(F.lit(1))
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds the features as one vector. Stored with the rows, it spares every pass of a fit from putting them together anew."""
    return VectorAssembler(inputCols=features, outputCol=ASSEMBLED).transform(df)


def has_assembled(df: DataFrame, features: list[str]) -> bool:
    """Whether `df` holds the vector of just these features, by the names that the column carries."""
    if ASSEMBLED not in df.columns:
        return False
    attrs = df.schema[ASSEMBLED].metadata.get("ml_attr", {}).get("attrs", {})
    return [a["name"] for a in sorted((a for kind in attrs.values() for a in kind), key=lambda a: a["idx"])] == list(features)


def fit_stages(train: DataFrame, features: list[str], stages: list) -> PipelineModel:
    """The assembler and the fitted stages after it; a vector stored with the rows is taken as it is."""
    assembler = VectorAssembler(inputCols=features, outputCol=ASSEMBLED)
    if not has_assembled(train, features):
        return Pipeline(stages=[assembler, *stages]).fit(train.drop(ASSEMBLED))
    return PipelineModel([assembler, *Pipeline(stages=stages).fit(train.select(ASSEMBLED, *[c for c in ("label", "weight") if c in train.columns])).stages])


@dataclass
class Fitted:
    """A fitted detector: `score` adds `proba`, higher means more suspicious."""

    kind: str
    model: object
    features: list[str]
    bounds: tuple[float, float] | None = None

    def score(self, df: DataFrame) -> DataFrame:
        if self.kind == "iforest":
            lo, hi = self.bounds
            raw = self.model.score(df, "_raw")
            return raw.withColumn("proba", (F.col("_raw") - F.lit(lo)) / F.lit(hi - lo + 1e-12)).drop("_raw")
        stored = has_assembled(df, self.features)
        model = PipelineModel(self.model.stages[1:]) if stored else self.model
        out = model.transform(df if stored else df.drop(ASSEMBLED)).withColumn("proba", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))
        return out.drop("rawPrediction", "probability", "prediction", VECTOR, *([] if stored else [ASSEMBLED]))

    def importances(self) -> list[tuple[str, float]]:
        v = self.model.stages[-1].featureImportances.toArray()
        return [(f, float(x)) for f, x in zip(self.features, v)]

    def save(self, path: str) -> None:
        if self.kind == "iforest":
            self.model.save(path)
            bounds = self.model.nodes.sparkSession.createDataFrame([self.bounds], "low double, high double")
            bounds.write.mode("overwrite").parquet(f"{path}/bounds")
        else:
            self.model.write().overwrite().save(path)


def load_detector(spark: SparkSession, path: str, kind: str, features: list[str]) -> Fitted:
    """A model of any family, as `Fitted.save` wrote it."""
    if kind == "iforest":
        low, high = spark.read.parquet(f"{path}/bounds").first()
        return Fitted(kind, iforest.IsolationForestModel.load(spark, path), features, (low, high))
    return Fitted(kind, PipelineModel.load(path), features)


def _forest(train: DataFrame, features: list[str], p: dict) -> Fitted:
    forest = RandomForestClassifier(featuresCol=ASSEMBLED, labelCol="label", weightCol="weight", **{**RF, **p})
    return Fitted("rf", fit_stages(weighted(train), features, [forest]), features)


def _boosted(train: DataFrame, features: list[str], p: dict) -> Fitted:
    """Positives weigh negatives / positives, as for an imbalanced booster."""
    n = {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}
    ratio = n.get(0, 0) / n[1] if n.get(1) else 1.0
    weighed = train.withColumn("weight", F.when(F.col("label") == 1, F.lit(ratio)).otherwise(F.lit(1.0)))
    booster = GBTClassifier(featuresCol=ASSEMBLED, labelCol="label", weightCol="weight", **{**GBT, **p})
    return Fitted("gbt", fit_stages(weighed, features, [booster]), features)


def _perceptron(train: DataFrame, features: list[str], p: dict) -> Fitted:
    """Scaled inputs and even classes; Spark's network has no dropout, batch norm or weights."""
    opts = {**MLP, **p}
    layers = [len(features), *opts.pop("hidden"), 2]
    stages = [
        StandardScaler(inputCol=ASSEMBLED, outputCol=VECTOR, withMean=True, withStd=True),
        MultilayerPerceptronClassifier(labelCol="label", layers=layers, **opts),
    ]
    return Fitted("mlp", fit_stages(upsample_minority(train), features, stages), features)


def _isolation(train: DataFrame, features: list[str], p: dict) -> Fitted:
    """Labels pick the rows only in novelty mode; scores are scaled to the training range."""
    opts = {**IFOREST, **p}
    novelty = opts.pop("novelty")
    model = iforest.fit(train, features, ["row_id"], label="label" if novelty else None, **opts)
    # the nodes are small and are read twice, so hold them as one bounded local table
    model.nodes = train.sparkSession.createDataFrame(model.nodes.toPandas(), iforest.NODE_SCHEMA)
    lo, hi = model.score(train, "_raw").agg(F.min("_raw"), F.max("_raw")).first()
    return Fitted("iforest", model, features, (float(lo), float(hi)))


FITTERS: dict[str, Callable[[DataFrame, list[str], dict], Fitted]] = {
    "rf": _forest, "gbt": _boosted, "mlp": _perceptron, "iforest": _isolation,
}


@dataclass(frozen=True)
class Detector:
    """A model family with its settings."""

    kind: str
    params: dict = field(default_factory=dict)

    def fit(self, train: DataFrame, features: list[str]) -> Fitted:
        if self.kind not in FITTERS:
            raise ValueError(f"unknown model {self.kind!r}; known: {sorted(FITTERS)}")
        return FITTERS[self.kind](train, features, self.params)
