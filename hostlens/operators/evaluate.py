"""Leak-free evaluation: grouped folds, cutoffs from inner splits, pooled scores, transfer and ablation.

Fits run from a small driver thread pool, each one a distributed Spark ML job. Test scores and inner
validation scores of all folds land in two tables; every cutoff, cap and metric is then a grouped query.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import hash_fraction
from hostlens.operators import cascade, clean, metrics, network, summaries, trees
from hostlens.operators.joins import KEY, join_lookup, together
from hostlens.operators.models import ASSEMBLED, GRIDS, Detector, Fitted, assemble
from hostlens.operators.splits import group_split, row_budget_split, stratified_folds
from hostlens.session import cut_lineage

INNER_SEED = 0
INNER = "inner_draw"
KEPT = ["row_id", "label", "technique"]
Augment = Callable[[DataFrame, DataFrame], DataFrame]


def parallel(jobs: list[Callable], workers: int = 4) -> list:
    spark_job = [inheritable_thread_target(j) for j in jobs]
    with ThreadPool(min(workers, max(1, len(jobs)))) as pool:
        return pool.map(lambda j: j(), spark_job)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def assign_folds(df: DataFrame, k: int, seed: int, repeats: int, features: list[str] | None = None) -> DataFrame:
    """Prepared rows with a `fold_<r>` column per repeat and the draw of the inner split, written once; repeats never copy rows.

    With `features` their vector is written too, for fits by Spark's learners.
    """
    folds = stratified_folds(df, "vector", "label", k, seed, repeats, ["row_id"]).withColumn(INNER, hash_fraction(INNER_SEED, "vector"))
    return cut_lineage(assemble(folds, features) if features else folds)


def fold_facts(ready: DataFrame, repeats: int, k: int) -> DataFrame:
    """(repeat, fold, n, n_pos, degenerate): one row per fold; degenerate where its training part has one class only."""
    each = F.array(*[F.struct(F.lit(r).alias("repeat"), F.col(f"fold_{r}").alias("fold")) for r in range(repeats)])
    part = ready.select("label", F.inline(each)).groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("n_pos"))
    grid = ready.sparkSession.createDataFrame([(r, f) for r in range(repeats) for f in range(k)], "repeat int, fold int")
    full = grid.join(part, ["repeat", "fold"], "left").fillna(0, ["n", "n_pos"])
    whole = full.groupBy("repeat").agg(F.sum("n").alias("_n"), F.sum("n_pos").alias("_p"))  # one row per repeat
    rest, pos = F.col("_n") - F.col("n"), F.col("_p") - F.col("n_pos")
    return full.join(whole, "repeat").select("repeat", "fold", "n", "n_pos", ((pos == 0) | (pos == rest)).cast("int").alias("degenerate"))


def usable_folds(ready: DataFrame, repeats: int, k: int) -> list[tuple[int, int]]:
    """(repeat, fold) of the folds that `fold_facts` does not flag and that test something."""
    usable = [(x["repeat"], x["fold"]) for x in fold_facts(ready, repeats, k).filter("degenerate = 0 and n > 0").sort("repeat", "fold").collect()]
    if not usable:
        raise ValueError("every training fold has one class only")
    return usable


def inner_share(detector: Detector) -> float:
    return 0.85 if detector.kind == "mlp" else 0.8


def _kept(df: DataFrame) -> list[str]:
    return [c for c in KEPT if c in df.columns]


def fit_with_cutoff_scores(train: DataFrame, features: list[str], detector: Detector, inner_share: float) -> tuple[Fitted, DataFrame]:
    """The model on all of `train`, and the scores its cutoff is to be chosen on.

    Those come from a second model that did not see the scored groups; the isolation forest, which never
    learns from labels, is calibrated on its own training rows.
    """
    if detector.kind == "iforest":
        fitted = detector.fit(train, features)
        return fitted, fitted.score(train).select("label", "proba")
    if INNER in train.columns:  # drawn once, instead of a hash of each row in every pass of a fit
        split = train.withColumn("in_fit", (F.col(INNER) < inner_share).cast("int"))
    else:
        split = group_split(train, "vector", inner_share, INNER_SEED)
    inner = detector.fit(split.filter("in_fit = 1"), features)
    return detector.fit(train, features), inner.score(split.filter("in_fit = 0")).select("label", "proba")


def cross_validate(df: DataFrame, features: list[str], detector: Detector, repeats: int = 15, k: int = 5, seed: int = S.CV_SEED,
                   augment: tuple[Augment, list[str]] | None = None, folds_ready: bool = False, workers: int = 4) -> tuple[DataFrame, DataFrame, list]:
    """(test scores, cutoff scores, fitted models) over all (repeat, fold).

    Folds whose training part has one class only, or that test nothing, are left out; `fold_facts` flags them.
    `df` comes from `models.prepare`. `augment` is (function(train, apply) -> table, new columns); it is
    fitted on the training part of each fold, once, and applied row by row.
    """
    ready = df if folds_ready else assign_folds(df, k, seed, repeats, None if detector.kind == "iforest" or augment else features)

    def one(r: int, f: int):
        col = F.col(f"fold_{r}")
        rows, cols = ready, list(features)
        if augment is not None:
            make, added = augment
            plain = ready.drop(ASSEMBLED)
            rows, cols = make(plain.filter(col != f), plain), cols + added
        train, test = rows.filter(col != f), rows.filter(col == f)
        fitted, cutoff = fit_with_cutoff_scores(train, cols, detector, inner_share(detector))
        tag = {"repeat": F.lit(r), "fold": F.lit(f)}
        return fitted.score(test).select(*_kept(test), "proba").withColumns(tag), cutoff.withColumns(tag), fitted

    usable = usable_folds(ready, repeats, k)
    done = parallel([lambda r=r, f=f: one(r, f) for r, f in usable], workers)
    tests, cutoffs, fitted = zip(*done)
    return cut_lineage(union(list(tests))), cut_lineage(union(list(cutoffs))), list(fitted)


def decide(tests: DataFrame, cutoffs: DataFrame, caps: list[float | None] = (S.MAX_FPR,)) -> DataFrame:
    """Test rows with `max_fpr`, `threshold` and `pred`, one copy per cap."""
    by = ["repeat", "fold"]
    found = metrics.best_thresholds(cutoffs, by, "label", "proba", list(caps)).select(*by, "max_fpr", "threshold")
    return join_lookup(tests, found, by, how="left").withColumns({
        "threshold": F.coalesce("threshold", F.lit(metrics.DEFAULT_CUT)),
    }).withColumn("pred", (F.col("proba") >= F.col("threshold")).cast("int"))


def scores(decided: DataFrame, by: list[str]) -> DataFrame:
    counts = metrics.score(decided, by, "label", "pred").drop("tn", "fp", "fn", "tp", "accuracy", "fnr")
    areas = metrics.auroc(decided, by, "label", "proba").select(together(by), "auroc")
    return counts.withColumn(KEY, F.struct(*by)).join(areas, KEY).drop(KEY)


def repeated_cv(df: DataFrame, features: list[str], detector: Detector, repeats: int = 15, k: int = 5, seed: int = S.CV_SEED,
                max_fpr: float | None = S.MAX_FPR, pooled: bool = True, augment: tuple[Augment, list[str]] | None = None, folds_ready: bool = False) -> DataFrame:
    """One row of scores per repeat (all test folds pooled), or per (repeat, fold)."""
    ready = df if folds_ready else assign_folds(df, k, seed, repeats, None if detector.kind == "iforest" or augment else features)
    tests, cutoffs, _ = cross_validate(ready, features, detector, repeats, k, seed, augment, folds_ready=True)
    out = scores(decide(tests, cutoffs, [max_fpr]), ["repeat"] if pooled else ["repeat", "fold"]).withColumn("model", F.lit(detector.kind))
    if pooled:
        return out
    return fold_facts(ready, repeats, k).select("repeat", "fold", "degenerate").join(out, ["repeat", "fold"], "left")


def fixed_cut_cv(df: DataFrame, features: list[str], detector: Detector, repeats: int, k: int, cut: float = 0.5, seed: int = S.CV_SEED) -> DataFrame:
    """Per-fold scores at a fixed cutoff."""
    tests, _, _ = cross_validate(df, features, detector, repeats, k, seed)
    return scores(tests.withColumn("pred", (F.col("proba") >= cut).cast("int")), ["repeat", "fold"])


def out_of_fold(df: DataFrame, features: list[str], detectors: dict[str, Detector], k: int = 5, seed: int = S.CV_SEED) -> DataFrame:
    """Each row's score and vote from every model, all on the same folds; no vote (-1) in folds that `fold_facts` flags.

    The rows of a fold pass through all of its models at once, so nothing is joined by row.
    """
    ready = assign_folds(df, k, seed, 1, features)
    usable = usable_folds(ready, 1, k)
    fitted, cuts = {}, {}
    for name, det in detectors.items():
        done = parallel([lambda f=f, det=det: fit_with_cutoff_scores(ready.filter(F.col("fold_0") != f), features, det, inner_share(det)) for _, f in usable])
        fitted[name] = {f: model for (_, f), (model, _) in zip(usable, done)}
        scored = cut_lineage(union([c.withColumn("fold", F.lit(f)) for (_, f), (_, c) in zip(usable, done)]))
        cuts[name] = metrics.best_thresholds(scored, ["fold"], "label", "proba", [S.MAX_FPR]).select("fold", "threshold")
    kept = ["row_id", *features, "fold", "true_label", *[c for c in ("technique", "proc_name") if c in ready.columns]]
    held = ready.withColumns({"fold": F.col("fold_0"), "true_label": F.col("label").cast("int")}).select(*kept, ASSEMBLED)

    def scored_fold(f: int | None) -> DataFrame:
        rows = held.filter(~F.col("fold").isin([f for _, f in usable])) if f is None else held.filter(F.col("fold") == f)
        for name in detectors:
            rows = (rows.withColumn("proba", F.lit(None).cast("double")) if f is None else fitted[name][f].score(rows)).withColumnRenamed("proba", f"proba_{name}")
        return rows.drop(ASSEMBLED)

    base = union([scored_fold(f) for f in [*[f for _, f in usable], *([None] if len(usable) < k else [])]])
    for name in detectors:
        base = join_lookup(base, cuts[name], ["fold"])
        vote = (F.col(f"proba_{name}") >= F.coalesce("threshold", F.lit(metrics.DEFAULT_CUT))).cast("int")
        base = base.withColumn(f"pred_{name}", F.coalesce(vote, F.lit(-1))).drop("threshold")
    return base.select(*kept, *[f"{c}_{name}" for name in detectors for c in ("pred", "proba")])


def cap_sweep(df: DataFrame, features: list[str], detector: Detector, caps: list[float | None], repeats: int, k: int) -> DataFrame:
    """Operating curve: every model is fitted once, every cap reads the same scores."""
    tests, cutoffs, _ = cross_validate(df, features, detector, repeats, k)
    per = scores(decide(tests, cutoffs, caps), ["max_fpr", "repeat"])
    out = metrics.summarize(per, ["max_fpr"], ["f1", "precision", "recall", "fpr", "auroc"])
    return out.select(F.col("max_fpr").alias("max_fpr_cap"), "f1_mean", "f1_std", "precision_mean", "recall_mean",
                      F.col("fpr_mean").alias("actual_fpr_mean"), "auroc_mean")


def grid_sweep(df: DataFrame, features: list[str], kind: str, grid: dict[str, list] | None, fixed: dict, repeats: int, k: int) -> DataFrame:
    """Mean and deviation of the scores for every combination of the grid (default: the family's own), on one fold table."""
    grid = GRIDS[kind] if grid is None else grid
    ready = assign_folds(df, k, S.CV_SEED, repeats, features)
    outs = []
    for combo in itertools.product(*grid.values()):
        setting = dict(zip(grid, combo))
        tests, cutoffs, _ = cross_validate(ready, features, Detector(kind, {**fixed, **setting}), repeats, k, folds_ready=True)
        row = metrics.summarize(scores(decide(tests, cutoffs), ["repeat"]), [], ["f1", "auroc", "fpr"])
        outs.append(row.withColumns({n: F.lit(v) for n, v in setting.items()}))
    return union(outs).select(*grid, "f1_mean", "f1_std", "auroc_mean", "auroc_std", "fpr_mean")


def compare_configs(df: DataFrame, features: list[str], arms: dict[str, Detector], repeats: int, k: int) -> DataFrame:
    """Per-repeat scores of several detectors on the same folds, tagged `arm`."""
    ready = assign_folds(df, k, S.CV_SEED, repeats, features)
    outs = []
    for name, det in arms.items():
        tests, cutoffs, _ = cross_validate(ready, features, det, repeats, k, folds_ready=True)
        outs.append(scores(decide(tests, cutoffs), ["repeat"]).withColumn("arm", F.lit(name)))
    return union(outs)


def grown_together(df: DataFrame, sets: dict[int, list[str]], features: list[str], growth: trees.Growth, repeats: int, k: int, seed: int = S.CV_SEED) -> DataFrame:
    """Held-out scores (config, repeat, fold, row_id, label, proba) of one model for each feature set and usable fold; all
    are grown together over one binned table."""
    ready = assign_folds(df, k, seed, repeats)
    usable = usable_folds(ready, repeats, k)
    table = trees.bin_table(ready, features, ["row_id", *[f"fold_{r}" for r in range(repeats)]])
    place = {f: i for i, f in enumerate(features)}
    members = [trees.Member(c, tuple(place[f] for f in cols), r, f) for c, cols in sets.items() for r, f in usable]
    return cut_lineage(trees.held_out_scores(table, members, trees.grow(table, members, growth, trees.TABLE_BYTES), growth, ["row_id"]))


def trained_together(df: DataFrame, features: list[str], spec: network.Spec, repeats: int, k: int, seed: int = S.CV_SEED) -> tuple[DataFrame, DataFrame]:
    """(test scores, cutoff scores) of the weighted networks of all usable folds; cutoffs are chosen on the held-out groups."""
    ready = assign_folds(df, k, seed, repeats)
    usable = usable_folds(ready, repeats, k)
    table = network.lay_out(ready, features, ["row_id", *[f"fold_{r}" for r in range(repeats)]], spec)
    members = [trees.Member(0, tuple(range(len(features))), r, f) for r, f in usable]
    nets = network.fit(table, members, len(features), spec)
    tests, cutoffs = (cut_lineage(network.member_scores(table, members, nets, spec, ["row_id"], held)) for held in (False, True))
    return tests, cutoffs


def set_scores(tests: DataFrame, cut: float = 0.5) -> DataFrame:
    """Mean and deviation over the repeats of each config's pooled scores at a fixed cutoff."""
    per = scores(tests.withColumn("pred", (F.col("proba") >= cut).cast("int")), ["config", "repeat"])
    return metrics.summarize(per, ["config"], ["f1", "auroc"])


def ablation_sets(features: list[str], drop: list[str] | None = None) -> dict[int, list[str]]:
    """Config 0 has all features, config i + 1 lacks the i-th of them."""
    return {0: list(features)} | {i + 1: [f for f in features if f != out] for i, out in enumerate(features) if out in (drop or features)}


def feature_ablation(summary: DataFrame, features: list[str]) -> DataFrame:
    """Scores without each feature in turn, against all of them: a report over `set_scores` of `ablation_sets`."""
    names = summary.sparkSession.createDataFrame([(i + 1, f) for i, f in enumerate(features)], "config int, feature string")
    base = summary.filter("config = 0").select(F.struct("f1_mean", "auroc_mean")).scalar()
    out = summary.join(F.broadcast(names), "config").select(
        "feature", F.col("f1_mean").alias("f1_without"), F.col("auroc_mean").alias("auc_without"),
        (F.col("f1_mean") - base["f1_mean"]).alias("delta_f1"), (F.col("auroc_mean") - base["auroc_mean"]).alias("delta_auc"))
    return summaries.ablation_tags(out).orderBy("delta_f1", "feature")


def reduced_comparison(df: DataFrame, features: list[str], summary: DataFrame, growth: trees.Growth, repeats: int, k: int) -> DataFrame:
    """All features against only those that the ablation found important (all if it found none)."""
    important = {r["feature"] for r in feature_ablation(summary, features).filter("tag = 'important'").collect()}  # a row per feature
    kept = [f for f in features if f in important] or list(features)
    full = summary.filter("config = 0")
    reduced = full if len(kept) == len(features) else set_scores(grown_together(df, {0: kept}, features, growth, repeats, k))
    cols = ["f1_mean", "f1_std", "auroc_mean", "auroc_std"]
    return union([t.select(F.lit(name).alias("feature_set"), F.lit(n).alias("n_features"), *cols) for name, n, t in (("full", len(features), full), ("reduced", len(kept), reduced))])


def importances(df: DataFrame, features: list[str], detector: Detector, repeats: int, k: int) -> DataFrame:
    """Mean importance of each feature over leak-free folds."""
    _, _, fitted = cross_validate(df, features, detector, repeats, k)
    rows = [x for m in fitted for x in m.importances()]
    long = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return long.groupBy("feature").agg(F.avg("importance").alias("importance"))


# --- cascades -------------------------------------------------------------------------------------------


def stage_scores(df: DataFrame, features: list[str], first: Detector, second: dict[str, Detector], repeats: int, k: int,
                 low: float = S.BAND_LOW, high: float = S.BAND_HIGH, seed: int = S.CV_SEED) -> DataFrame:
    """Stage-1 score of every test row, stage-2 scores of the rows in the band only, and the stage-1 cutoff.

    The cutoff is the best one on the stage-1 training scores.
    """
    ready = assign_folds(df, k, seed, repeats, features)

    def one(r: int, f: int):
        col = F.col(f"fold_{r}")
        train, test = ready.filter(col != f), ready.filter(col == f)
        stage1 = first.fit(train, features)
        scored = stage1.score(test).withColumnRenamed("proba", "proba_1")
        tag = {"repeat": F.lit(r), "fold": F.lit(f)}
        for name, det in second.items():  # a branch is evaluated where its test holds, so stage 1 is scored once for both sides
            unsure = F.when(F.col("proba_1").between(low, high), F.col("proba"))
            scored = det.fit(train, features).score(scored).withColumn(f"proba_{name}", unsure).drop("proba")
        keep = [*_kept(test), "proba_1", *[f"proba_{n}" for n in second]]
        return scored.select(*keep).withColumns(tag), stage1.score(train).select("label", "proba").withColumns(tag)

    usable = [(x["repeat"], x["fold"]) for x in fold_facts(ready, repeats, k).filter("degenerate = 0 and n > 0").sort("repeat", "fold").collect()]
    tests, trains = zip(*parallel([lambda r=r, f=f: one(r, f) for r, f in usable]))
    by = ["repeat", "fold"]
    cuts = metrics.best_thresholds(cut_lineage(union(list(trains))), by, "label", "proba", [S.MAX_FPR]).select(*by, "threshold")
    return cut_lineage(join_lookup(cut_lineage(union(list(tests))), cuts, by))


def cascade_cv(stages: DataFrame, second: str, weighted: bool, low: float = S.BAND_LOW, high: float = S.BAND_HIGH) -> DataFrame:
    """Per-fold scores of one cascade over stored stage scores."""
    rows = cascade.blend(stages, "proba_1", f"proba_{second}", low, high, weighted)
    return cascade.score_folds(rows, ["repeat", "fold"], "label")


# --- transfer -------------------------------------------------------------------------------------------


def cross_dataset(datasets: dict[str, DataFrame], features: list[str], detector: Detector, repeats: int, seed: int = S.CV_SEED,
                  recalibrate: float | None = None) -> DataFrame:
    """Train on one dataset, test on all of another, both ways, `repeats` times.

    In-sample scores come from a held-out fifth of the groups. With `recalibrate` that share of the target
    rows (whole groups) picks a new cutoff, which is then scored on the rest.
    """
    stored = {n: cut_lineage(d) for n, d in datasets.items()}

    def scored(tests: DataFrame, cut: float, prefix: str) -> DataFrame:
        decided = tests.withColumn("pred", (F.col("proba") >= cut).cast("int"))
        counts = metrics.score(decided, [], "label", "pred").withColumn("_k", F.lit(0))
        both = counts.join(metrics.auroc(decided.withColumn("_k", F.lit(0)), ["_k"], "label", "proba"), "_k")
        return both.select(*[F.col(m).alias(f"{prefix}_{m}") for m in ("precision", "recall", "f1", "fpr", "auroc")])

    def one(a: str, b: str, r: int) -> DataFrame:
        run = Detector(detector.kind, {**detector.params, "seed": seed + r})
        split = group_split(stored[a], "vector", 0.8, seed + r, "in_train")
        train, held = split.filter("in_train = 1"), split.filter("in_train = 0")
        part, cut_scores = fit_with_cutoff_scores(train, features, run, 0.8)
        full, full_scores = fit_with_cutoff_scores(stored[a], features, run, 0.8)
        cut = metrics.best_cut(full_scores, "label", "proba", S.MAX_FPR)
        target = cut_lineage(full.score(stored[b]).select("row_id", "vector", "label", "proba"))
        cols = [scored(cut_lineage(part.score(held).select("label", "proba")), metrics.best_cut(cut_scores, "label", "proba", S.MAX_FPR), "insample"),
                scored(target, cut, "crossdataset")]
        if recalibrate:
            slices = row_budget_split(target, "vector", recalibrate, seed + r, ["row_id"])
            recut = metrics.best_cut(slices.filter("in_calibration = 1"), "label", "proba", S.MAX_FPR)
            cols.append(scored(slices.filter("in_calibration = 0"), recut, "recalibrated"))
        row = {}
        for c in cols:  # one row each
            row.update(c.first().asDict())
        row.update(train_dataset=a, test_dataset=b, repeat=r, model=detector.kind, n_shared_features=len(features),
                   f1_drop=row["insample_f1"] - row["crossdataset_f1"])
        return row

    names = list(stored)
    jobs = [lambda a=a, b=b, r=r: one(a, b, r) for a in names for b in names if a != b for r in range(repeats)]
    rows = parallel(jobs)
    spark = next(iter(stored.values())).sparkSession
    keys = ["model", "train_dataset", "test_dataset", "repeat", "n_shared_features"]
    nums = [c for c in rows[0] if c not in keys]
    schema = "model string, train_dataset string, test_dataset string, repeat int, n_shared_features int, " + ", ".join(f"{c} double" for c in nums)
    return spark.createDataFrame([tuple(r[c] for c in [*keys, *nums]) for r in rows], schema)


# --- feature experiments --------------------------------------------------------------------------------


def relative_augment(base: list[str], min_support: int = 30) -> tuple[Augment, list[str]]:
    """Per-name z-scores as extra features, learnt from the training part only."""
    def make(train: DataFrame, apply_to: DataFrame) -> DataFrame:
        return clean.impute(clean.relative_z(train, apply_to, base, ["row_id"], min_support=min_support), [f"{b}_relz" for b in base])

    return make, [f"{b}_relz" for b in base]


def missingness_cv(df: DataFrame, features: list[str], hidden: list[str], masked, detector: Detector, repeats: int, k: int) -> DataFrame:
    """Per-repeat scores of the three masking arms; folds follow the unmasked vectors in all of them."""
    flag = "features_available"
    outs = []
    for arm, table in clean.masked_arms(df, hidden, masked, flag).items():
        cols = [*features, flag] if flag in table.columns else list(features)
        tests, cutoffs, _ = cross_validate(table, cols, detector, repeats, k)
        outs.append(scores(decide(tests, cutoffs), ["repeat"]).withColumn("arm", F.lit(arm)))
    return union(outs)
