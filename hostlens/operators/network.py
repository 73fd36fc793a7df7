"""Dense networks over one stored table: the networks of all (repeat, fold) members are trained together.

A step is one job: each task sends one vector per member (gradient, layer statistics, loss) for its rows of the step's
batch, the vectors are added up in two levels, and the driver, which holds the weights only, takes an Adam step and
broadcasts them anew. Rows are dealt to batches by a hash and written in folders of (held, batch), so a step reads its own
files and no others. The number of jobs is that of steps, whatever the number of members.

After each hidden layer come rectifier, batch norm and dropout. Batch norm uses blocks of at most `BLOCK` rows inside a
task, and running means of all blocks for scoring; dropout is drawn by seed, step, member and block. Loss is weighted by
class (balanced over the training rows). Training of a member ends when the area under the ROC curve of the held-out
groups has not risen for `patience` epochs; the weights of its best epoch are kept.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.functions.columns import hash_fraction
from hostlens.operators.trees import Member, spread, trained_on
from hostlens.session import application_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks carry these helpers along, workers need no package

BLOCK = 512  # rows of one batch norm
ROWS_A_TASK = 50_000  # of all batches together
BINS = 4096  # of the scores that decide when to stop
FAN = 64  # vectors of a member that one task adds up without a level between
EPS = 1e-3
FADE = 0.9  # of the running layer statistics
BETA = (0.9, 0.999)


@dataclass(frozen=True)
class Spec:
    """Shape and training of a network; a batch is one `steps`-th of the rows."""

    hidden: tuple[int, ...] = (256, 128, 64, 32)
    dropout: float = 0.3
    rate: float = 0.001
    epochs: int = 50
    steps: int = 8
    patience: int = 5
    held: float = 0.15  # share of groups that decide when to stop
    batch_norm: bool = True
    weighted: bool = True
    seed: int = 42


@dataclass
class Net:
    """Weights as one vector, running (mean, variance) of each layer, input scaling, class weights."""

    weights: np.ndarray
    running: list[tuple[np.ndarray, np.ndarray]]
    center: np.ndarray
    scale: np.ndarray
    classes: tuple[float, float] = (1.0, 1.0)
    epochs: int = 0  # until the best one
    history: list[float] = field(default_factory=list)


def keep_memory() -> None:
    """Called once a task: having freed one large array, the allocator keeps a block's arrays of a MB for the next block
    instead of handing them back and faulting them in anew."""
    np.empty(30 << 20, np.uint8)


def shapes(inputs: int, spec: Spec) -> list[tuple[int, ...]]:
    """Of each layer weights and offsets, with batch norm also its gain and shift; last the output."""
    sides = [inputs, *spec.hidden]
    out = []
    for a, b in zip(sides, spec.hidden):
        out += [(a, b), (b,), (b,), (b,)] if spec.batch_norm else [(a, b), (b,)]
    return [*out, (sides[-1], 1), (1,)]


def opened(vector: np.ndarray, sizes: list[tuple[int, ...]]) -> list[np.ndarray]:
    ends = np.cumsum([math.prod(s) for s in sizes])
    return [part.reshape(s) for part, s in zip(np.split(vector[: ends[-1]], ends[:-1]), sizes)]


def fresh(inputs: int, spec: Spec, member: Member) -> np.ndarray:
    rng = np.random.default_rng((spec.seed, member.config, member.repeat, member.fold + 1))
    width = 4 if spec.batch_norm else 2
    parts = []
    for i, s in enumerate(shapes(inputs, spec)):
        gain = i < width * len(spec.hidden) and i % width == 2
        parts.append(rng.normal(0, math.sqrt(2 / s[0]), s).ravel() if len(s) == 2 else np.full(s, float(gain)))
    return np.concatenate(parts)


def forward(parts: list[np.ndarray], x: np.ndarray, spec: Spec, running: list | None = None, rng: np.random.Generator | None = None) -> tuple:
    """(logit, inputs of the output layer, what each layer remembers). Without `running` the block's own statistics hold."""
    width = 4 if spec.batch_norm else 2
    seen = []
    for i in range(len(spec.hidden)):
        w, b, *norm = parts[i * width : (i + 1) * width]
        out = x @ w  # the arrays of a layer are as large as caches, so each is changed in place where it can be
        out += b
        np.maximum(out, 0, out=out)
        layer = {"x": x, "on": out > 0}
        if norm:
            mean = running[i][0] if running is not None else out.mean(axis=0)
            out -= mean
            var = running[i][1] if running is not None else (out * out).mean(axis=0)
            out /= np.sqrt(var + EPS)
            layer |= {"mean": mean, "var": var, "unit": out}
            out = out * norm[0]
            out += norm[1]
        if rng is not None and spec.dropout > 0:
            layer["kept"] = (rng.random(out.shape) >= spec.dropout) / (1 - spec.dropout)
            out *= layer["kept"]
        seen.append(layer)
        x = out
    return (x @ parts[-2] + parts[-1])[:, 0], x, seen


def gradient(parts: list[np.ndarray], x: np.ndarray, label: np.ndarray, weight: np.ndarray, spec: Spec, rng: np.random.Generator | None = None) -> tuple:
    """(gradient of each part, summed loss, (mean, variance) of each layer) of one block."""
    logit, last, seen = forward(parts, x, spec, rng=rng)
    loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum())
    slope = (weight * (sigmoid(logit) - label))[:, None]
    grads = [slope.sum(axis=0), last.T @ slope]  # from the output back, each layer's in reverse
    back = slope @ parts[-2].T
    width = 4 if spec.batch_norm else 2
    for i, layer in reversed(list(enumerate(seen))):
        if "kept" in layer:
            back *= layer["kept"]
        if spec.batch_norm:
            unit = layer["unit"]
            grads += [back.sum(axis=0), (back * unit).sum(axis=0)]
            to_unit = back * parts[i * width + 2]
            along = unit * (to_unit * unit).mean(axis=0)
            back = to_unit - to_unit.mean(axis=0)
            back -= along
            back /= np.sqrt(layer["var"] + EPS)
        back *= layer["on"]
        grads += [back.sum(axis=0), layer["x"].T @ back]
        if i:
            back = back @ parts[i * width].T
    return grads[::-1], loss, [(s["mean"], s["var"]) for s in seen if "mean" in s]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def lay_out(df: DataFrame, features: list[str], keep: list[str], spec: Spec) -> DataFrame:
    """`keep` columns, label, row, x (the features, 0 where null or NaN), written once by (held, batch). Whole groups
    (`vector`) are held."""
    spark = df.sparkSession
    df = spread(df, ROWS_A_TASK)
    number = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
    held = F.coalesce(hash_fraction(spec.seed, "vector") < spec.held, F.lit(False)).cast("int").alias("held")
    row = F.xxhash64("row_id")
    rows = df.select(*keep, F.col("label").cast("int").alias("label"), row.alias("row"), F.array(*map(number, features)).alias("x"), held,
                     F.pmod(F.xxhash64(row, F.lit(spec.seed)), F.lit(spec.steps)).cast("int").alias("batch"))
    path = f"{application_dir(spark)}/{uuid.uuid4().hex}"
    rows.write.partitionBy("held", "batch").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def facts(table: DataFrame, members: list[Member], features: int, spec: Spec) -> list[Net]:
    """Untrained networks: input scaling by mean and deviation of the training rows, class weights without held rows."""
    repeats = sorted({m.repeat for m in members if m.fold >= 0})
    folds = F.array(F.struct(F.lit(-1).alias("repeat"), F.lit(-1).alias("fold")), *[F.struct(F.lit(r).alias("repeat"), F.col(f"fold_{r}").alias("fold")) for r in repeats])
    free = F.col("held") == 0
    moments = [f(F.get("x", F.lit(i))) for i in range(features) for f in (F.sum, lambda c: F.sum(c * c))]
    got = table.select("label", "held", "x", F.inline(folds)).groupBy("repeat", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(free & (F.col("label") == 0)).alias("n0"), F.count_if(free & (F.col("label") == 1)).alias("n1"), F.array(*moments).alias("m"))
    sums = {(r["repeat"], r["fold"]): np.array([r["n"], r["n0"], r["n1"], *r["m"]], float) for r in got.collect()}  # a row per fold
    nets = []
    for member in members:
        total = sums.get((-1, -1), np.zeros(3 + 2 * features)) - (sums.get((member.repeat, member.fold), 0.0) if member.fold >= 0 else 0.0)
        n, neg, pos = total[:3]
        center = total[3::2] / max(n, 1)
        spread = np.sqrt(np.maximum(total[4::2] / max(n, 1) - center**2, 0))
        classes = tuple((neg + pos) / (2 * c) if c else 1.0 for c in (neg, pos)) if spec.weighted else (1.0, 1.0)
        layers = [(np.zeros(u), np.ones(u)) for u in spec.hidden] if spec.batch_norm else []
        nets.append(Net(fresh(len(member.features), spec, member), layers, center, np.where(spread > 1e-9, spread, 1.0), classes))
    return nets


def inputs(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def scaled(x: np.ndarray, member: Member, net: Net) -> np.ndarray:
    at = list(member.features)
    return ((x - net.center) / net.scale)[:, at]


def summed(rows: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """The sum over all tasks of what `run` yields for a member, always added up in the same order."""
    ddl = "p int, member int, v binary"

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(run(batches))
        if found:
            yield pa.record_batch({"member": pa.array([m for m, _ in found], pa.int32()), "v": pa.array([v.tobytes() for _, v in found], pa.binary())})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("p")
        total = sum(np.frombuffer(v) for v in frame["v"])
        return pd.DataFrame({"p": frame["p"].iloc[:1], "member": frame["member"].iloc[:1], "v": [total.tobytes()]})

    sent = rows.mapInArrow(partial, "member int, v binary").select(F.spark_partition_id().alias("p"), "member", "v")
    tasks = rows.rdd.getNumPartitions()
    if tasks > FAN:
        sent = sent.groupBy("member", F.floor(F.col("p") / math.isqrt(tasks))).applyInPandas(lambda f: add(f), ddl)
    return {r["member"]: np.frombuffer(r["v"]) for r in sent.groupBy("member").applyInPandas(lambda f: add(f), ddl).collect()}  # a row per member


def gradients(rows: DataFrame, members: list[Member], nets: dict[int, Net], spec: Spec, step: int) -> dict[int, np.ndarray]:
    """Of each member in `nets`: gradient, layer statistics times rows, loss and number of rows, one job for all."""
    shared = rows.sparkSession.sparkContext.broadcast((members, nets, spec))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        members, nets, spec = shared.value
        keep_memory()
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, label = inputs(batch), batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            row = batch.column("row").to_numpy(zero_copy_only=False)
            for m, net in nets.items():
                mine = np.flatnonzero(trained_on(batch, members[m]))
                if not len(mine):
                    continue
                parts = opened(net.weights, shapes(len(members[m].features), spec))
                values = scaled(x[mine], members[m], net)
                weight = np.where(label[mine] == 1, net.classes[1], net.classes[0])
                for at in np.array_split(np.arange(len(mine)), -(-len(mine) // BLOCK)):
                    rng = np.random.default_rng((spec.seed, step, m, int(row[mine[at[0]]]) & 0xFFFFFFFF))
                    grads, loss, stats = gradient(parts, values[at], label[mine[at]], weight[at], spec, rng)
                    sent = np.concatenate([*[g.ravel() for g in grads], *[s * len(at) for pair in stats for s in pair], [loss, len(at)]])
                    total[m] = total[m] + sent if m in total else sent
        yield from total.items()

    out = summed(rows, run)
    shared.destroy()
    return out


def areas(rows: DataFrame, members: list[Member], nets: dict[int, Net], spec: Spec) -> dict[int, float]:
    """Area under the ROC curve of each member's held-out rows, scores cut to `BINS` steps; NaN where a class is absent."""
    shared = rows.sparkSession.sparkContext.broadcast((members, nets, spec))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        members, nets, spec = shared.value
        keep_memory()
        total = {m: np.zeros(2 * BINS) for m in nets}
        for batch in batches:
            x, label = inputs(batch), batch.column("label").to_numpy(zero_copy_only=False)
            for m, net in nets.items():
                mine = np.flatnonzero(trained_on(batch, members[m]))
                cell = np.minimum((probabilities(x[mine], members[m], net, spec) * BINS).astype(int), BINS - 1)
                total[m] += np.bincount(cell + BINS * (label[mine] == 1), minlength=2 * BINS)
        yield from total.items()

    out = {}
    for m, hist in summed(rows, run).items():
        neg, pos = hist[:BINS], hist[BINS:]
        pairs = neg.sum() * pos.sum()
        out[m] = float((pos * (np.cumsum(neg) - neg / 2)).sum() / pairs) if pairs else math.nan
    shared.destroy()
    return out


def probabilities(x: np.ndarray, member: Member, net: Net, spec: Spec) -> np.ndarray:
    parts = opened(net.weights, shapes(len(member.features), spec))
    blocks = [scaled(x[at : at + BLOCK], member, net) for at in range(0, len(x), BLOCK)]
    return np.concatenate([np.zeros(0), *[sigmoid(forward(parts, b, spec, running=net.running)[0]) for b in blocks]])


def fit(table: DataFrame, members: list[Member], features: int, spec: Spec) -> list[Net]:
    """The trained network of each member; `table` comes from `lay_out`."""
    nets = facts(table, members, features, spec)
    moving = [(np.zeros_like(n.weights), np.zeros_like(n.weights)) for n in nets]
    best: list[tuple[float, np.ndarray, list]] = [(-math.inf, n.weights, n.running) for n in nets]
    columns = ["label", "row", "x", *[f"fold_{r}" for r in sorted({m.repeat for m in members if m.fold >= 0})]]
    batches = [table.filter((F.col("held") == 0) & (F.col("batch") == b)).select(*columns) for b in range(spec.steps)]
    watched = table.filter("held = 1").select(*columns)
    open_, step = list(range(len(members))), 0
    for epoch in range(spec.epochs):
        for b in np.random.default_rng((spec.seed, epoch)).permutation(spec.steps):
            step += 1
            for m, v in gradients(batches[b], members, {m: nets[m] for m in open_}, spec, step).items():
                take_step(nets[m], moving[m], v, spec, step)
        found = areas(watched, members, {m: nets[m] for m in open_}, spec)
        for m in list(open_):
            area = found.get(m, math.nan)
            nets[m].history.append(area)
            if math.isnan(area) or area > best[m][0]:  # without both classes nothing can be compared: the last epoch counts
                best[m] = (best[m][0] if math.isnan(area) else area, nets[m].weights, list(nets[m].running))
                nets[m].epochs = epoch + 1
            elif epoch + 1 - nets[m].epochs >= spec.patience:
                open_.remove(m)
        if not open_:
            break
    for net, (_, weights, running) in zip(nets, best):
        net.weights, net.running = weights, running
    return nets


def take_step(net: Net, moving: tuple[np.ndarray, np.ndarray], sent: np.ndarray, spec: Spec, step: int) -> None:
    """Adam on the mean gradient of a batch; layer statistics move towards the batch's."""
    size, n = len(net.weights), sent[-1]
    slope = sent[:size] / n
    for old, new, beta in zip(moving, (slope, slope * slope), BETA):
        old *= beta
        old += (1 - beta) * new
    first, second = (old / (1 - beta**step) for old, beta in zip(moving, BETA))
    net.weights = net.weights - spec.rate * first / (np.sqrt(second) + 1e-7)
    at, fade = size, FADE if step > 1 else 0.0
    for i, (mean, var) in enumerate(net.running):
        now = [sent[at + k * len(mean) : at + (k + 1) * len(mean)] / n for k in (0, 1)]
        net.running[i] = (fade * mean + (1 - fade) * now[0], fade * var + (1 - fade) * now[1])
        at += 2 * len(mean)


def member_scores(table: DataFrame, members: list[Member], nets: list[Net], spec: Spec, keep: list[str], held: bool) -> DataFrame:
    """config, repeat, fold, `keep`, label, proba of each member: the rows of the fold it did not see, or, with `held`,
    the rows that decided when it stopped."""
    shared = table.sparkSession.sparkContext.broadcast((members, nets, spec))
    kept = [*keep, "label"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, nets, spec = shared.value
        keep_memory()
        for batch in batches:
            x = inputs(batch)
            for member, net in zip(members, nets):
                train = trained_on(batch, member)
                mine = np.flatnonzero(train if held or member.fold < 0 else ~train)
                if not len(mine):
                    continue
                tags = [pa.array(np.full(len(mine), v), pa.int32()) for v in (member.config, member.repeat, member.fold)]
                rows = batch.take(pa.array(mine))
                proba = pa.array(probabilities(x[mine], member, net, spec), pa.float64())
                yield pa.RecordBatch.from_arrays([*tags, *[rows.column(c) for c in kept], proba], names=["config", "repeat", "fold", *kept, "proba"])

    schema = table.sparkSession.createDataFrame([], "config int, repeat int, fold int").schema
    for f in table.select(*kept).schema:
        schema = schema.add(f)
    return (table.filter("held = 1") if held else table).mapInArrow(run, schema.add("proba", "double"))
