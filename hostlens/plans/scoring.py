"""Queries: confusion, ranking, thresholds, errors and cascades on the out-of-fold table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import hash_fraction
from hostlens.operators import cascade, errors, metrics, summaries
from hostlens.plans import views as V
from hostlens.plans.catalogue import query
from hostlens.plans.splitting import rounded
from hostlens.session import application_dir, cut_lineage
from hostlens.sources.tables import read_sweeps, write_table

FEATS = V.WIDE_FEATURES


def oof(spark, sf_dir):
    return V.oof_table(spark, sf_dir)


def scored(spark, sf_dir):
    """Both models' votes on rows where both voted, long form."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("pred"), F.col(f"proba_{m}").alias("proba")) for m in ("xgb", "cnn")])
    return oof(spark, sf_dir).filter("pred_cnn >= 0").select("row_id", "fold", "true_label", F.inline(rows))


LONG = V.OOF + """, long AS (SELECT row_id, fold, true_label, 'xgb' AS model, pred_xgb AS pred, proba_xgb AS proba FROM oof WHERE pred_cnn >= 0
  UNION ALL SELECT row_id, fold, true_label, 'cnn', pred_cnn, proba_cnn FROM oof WHERE pred_cnn >= 0)"""

_CELLS = """count(*) FILTER (true_label = 0 AND pred = 0) AS tn, count(*) FILTER (true_label = 0 AND pred = 1) AS fp,
  count(*) FILTER (true_label = 1 AND pred = 0) AS fn, count(*) FILTER (true_label = 1 AND pred = 1) AS tp"""


def ratio(a, b, zero="0"):
    return f"round(coalesce(({a})::DOUBLE / nullif({b}, 0), {zero}), 6)"


_RATES = f"""{ratio('tp', 'tp + fp')} AS "precision", {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
  {ratio('fp', 'fp + tn')} AS fpr, {ratio('fn', 'tp + fn')} AS fnr, {ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy"""
RATE_COLS = ["precision", "recall", "f1", "fpr", "fnr", "accuracy"]


@query("confusion", V.sql(LONG, f", c AS (SELECT model, {_CELLS} FROM long GROUP BY model) SELECT *, {_RATES}, tn + fp + fn + tp AS n_total FROM c"))
def confusion(spark, sf_dir):
    return rounded(metrics.score(scored(spark, sf_dir), ["model"], "true_label", "pred"), *RATE_COLS)


def _auroc_sql(by):
    part = f"PARTITION BY {by}" if by else ""
    return f""", ranks AS (SELECT {by}, true_label, rank() OVER ({part} ORDER BY proba) + (count(*) OVER (PARTITION BY {by}, proba) - 1) / 2.0::DOUBLE AS r FROM long
), auc AS (SELECT {by}, (sum(r) FILTER (true_label = 1) - count(*) FILTER (true_label = 1) * (count(*) FILTER (true_label = 1) + 1) / 2.0::DOUBLE)
    / (count(*) FILTER (true_label = 1)::DOUBLE * count(*) FILTER (true_label = 0)) AS auroc FROM ranks GROUP BY {by})"""


@query("auroc", V.sql(LONG, _auroc_sql("model, fold") + " SELECT model, fold, round(auroc, 6) AS auroc FROM auc"))
def auroc(spark, sf_dir):
    return rounded(metrics.auroc(scored(spark, sf_dir), ["model", "fold"], "true_label", "proba"), "auroc")


def _points(source, by):
    return f"""pts0 AS (SELECT {by}, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {by}) AS n_pos, sum(neg) OVER (PARTITION BY {by}) AS n_neg
  FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)
), pts AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS prec, tp / n_pos::DOUBLE AS rec, coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + n_pos - tp, 0), 0) AS f1,
  fp / n_neg::DOUBLE AS fpr FROM pts0)"""


def _axis(by):
    return f"axis AS (SELECT {by}, proba AS score, count(*) FILTER (true_label = 1) AS pos, count(*) FILTER (true_label = 0) AS neg FROM long GROUP BY {by}, proba)"


def _picked(by, caps):
    rows = ", ".join(f"({'NULL' if c is None else c}::DOUBLE)" for c in caps)
    return f"""chosen AS (SELECT p.*, c.cap FROM pts p, (VALUES {rows}) c(cap)
  QUALIFY row_number() OVER (PARTITION BY {by}, c.cap ORDER BY CASE WHEN c.cap IS NULL OR fpr <= c.cap THEN 0 ELSE 1 END,
    CASE WHEN c.cap IS NULL OR fpr <= c.cap THEN -f1 ELSE fpr END, score DESC) = 1)"""


_PICK = 'cap AS max_fpr, score AS threshold, round(f1, 6) AS f1, round(prec, 6) AS "precision", round(rec, 6) AS recall, round(fpr, 6) AS fpr'


@query("best_threshold", V.sql(LONG, f", {_axis('model')}, {_points('axis', 'model')}, {_picked('model', [0.05])} SELECT model, {_PICK} FROM chosen"))
def best_threshold(spark, sf_dir):
    out = metrics.best_thresholds(scored(spark, sf_dir), ["model"], "true_label", "proba", [S.MAX_FPR])
    return rounded(out, "f1", "precision", "recall", "fpr")


@query("pr_curve_best", V.sql(LONG, f", {_axis('model')}, {_points('axis', 'model')}, {_picked('model', [None])} SELECT model, {_PICK} FROM chosen"))
def pr_curve_best(spark, sf_dir):
    out = metrics.best_thresholds(scored(spark, sf_dir), ["model"], "true_label", "proba", [None])
    return rounded(out, "f1", "precision", "recall", "fpr")


@query("pr_curve", V.sql(LONG, f""", {_axis('model')}, {_points('axis', 'model')} SELECT model, score, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, tp::BIGINT AS tp, fp::BIGINT AS fp,
  round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr FROM pts"""))
def pr_curve(spark, sf_dir):
    out = metrics.operating_points(metrics.score_axis(scored(spark, sf_dir), ["model"], "true_label", "proba"), ["model"])
    return rounded(out, "f1", "precision", "recall", "fpr")


CAPS = [0.01, 0.02, 0.05, 0.1, 0.2, 1.0]


@query("cap_sweep", V.sql(LONG, f", {_axis('model, fold')}, {_points('axis', 'model, fold')}, {_picked('model, fold', CAPS)} SELECT model, fold, {_PICK} FROM chosen"))
def cap_sweep(spark, sf_dir):
    """Scores exist once, every cap is read off the same axis."""
    out = metrics.best_thresholds(scored(spark, sf_dir), ["model", "fold"], "true_label", "proba", CAPS)
    return rounded(out, "f1", "precision", "recall", "fpr")


RUNS = LONG + _auroc_sql("model, fold") + f""", cells AS (SELECT model, fold, {_CELLS} FROM long GROUP BY model, fold
), runs AS (SELECT model, fold, {_RATES.replace('round(', '(').replace(', 6)', ')')}, auroc FROM cells JOIN auc USING (model, fold))"""


def runs(spark, sf_dir):
    """One row of scores per (model, fold): the result table the verdicts work on."""
    rows = scored(spark, sf_dir)
    rates = metrics.score(rows, ["model", "fold"], "true_label", "pred")
    return rates.join(metrics.auroc(rows, ["model", "fold"], "true_label", "proba"), ["model", "fold"])


@query("repeat_summary", V.sql(RUNS, "SELECT model, count(*) AS n_runs, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std, "
                               "round(avg(auroc), 6) AS auroc_mean, round(stddev_samp(auroc), 6) AS auroc_std FROM runs GROUP BY model"))
def repeat_summary(spark, sf_dir):
    out = metrics.summarize(runs(spark, sf_dir), ["model"], ["f1", "auroc"])
    return rounded(out, "f1_mean", "f1_std", "auroc_mean", "auroc_std")


@query("median_fold", V.sql(RUNS, """, med AS (SELECT model, median(auroc) AS m FROM runs GROUP BY model)
SELECT model, arg_min(fold, (abs(auroc - m), fold)) AS median_fold, round(max(m), 6) AS median FROM runs JOIN med USING (model) GROUP BY model"""))
def median_fold(spark, sf_dir):
    return rounded(metrics.median_fold(runs(spark, sf_dir), ["model"]), "median")


# --- errors ---------------------------------------------------------------------------------------------


@query("outcome_labels", V.sql(V.OOF, """SELECT row_id, CAST(pred_xgb = true_label AS INT) AS correct_xgb,
  CASE WHEN true_label = 1 THEN CASE WHEN pred_xgb = 1 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN pred_xgb = 1 THEN 'FP' ELSE 'TN' END END AS errtype_xgb FROM oof"""))
def outcome_labels(spark, sf_dir):
    return metrics.with_outcomes(oof(spark, sf_dir), ["xgb"]).select("row_id", "correct_xgb", "errtype_xgb")


@query("technique_fn_rate", V.sql(V.OOF, """SELECT technique, count(*) FILTER (pred_xgb <> 1) AS fn, count(*) FILTER (pred_xgb = 1) AS tp, count(*) AS total,
  round(count(*) FILTER (pred_xgb <> 1) / count(*)::DOUBLE, 6) AS fn_rate, round(count(*) FILTER (pred_xgb = 1) / count(*)::DOUBLE, 6) AS detection_rate
  FROM oof WHERE true_label = 1 GROUP BY technique"""))
def technique_fn_rate(spark, sf_dir):
    return rounded(errors.technique_breakdown(oof(spark, sf_dir), "xgb"), "fn_rate", "detection_rate")


@query("benign_fp", V.sql(V.OOF, """SELECT 'xgb' AS model, count(*) AS n_benign, count(*) FILTER (pred_xgb = 1) AS n_fp, round(avg(CAST(pred_xgb = 1 AS INT)), 6) AS fp_rate
  FROM oof WHERE true_label = 0 UNION ALL SELECT 'cnn', count(*), count(*) FILTER (pred_cnn = 1), round(avg(CAST(pred_cnn = 1 AS INT)), 6) FROM oof WHERE true_label = 0"""))
def benign_fp(spark, sf_dir):
    return rounded(errors.benign_false_positives(oof(spark, sf_dir), ["xgb", "cnn"]), "fp_rate")


OOF_MELTED = V.OOF + ", melted AS (" + V.melted_sql("oof", "row_id, true_label, pred_xgb, pred_cnn", FEATS) + ")"


@query("fn_tp_features", V.sql(OOF_MELTED, """, m AS (SELECT feature, count(*) FILTER (pred_xgb = 0) AS n_fn, count(*) FILTER (pred_xgb = 1) AS n_tp,
  avg(value) FILTER (pred_xgb = 0) AS f, avg(value) FILTER (pred_xgb = 1) AS t FROM melted WHERE true_label = 1 GROUP BY feature)
SELECT feature, n_fn, n_tp, round(f, 5) AS fn_mean, round(t, 5) AS tp_mean, round(f / nullif(t, 0), 6) AS fn_over_tp, round(abs(f / nullif(t, 0) - 1), 6) AS abs_dev_from_1 FROM m"""))
def fn_tp_features(spark, sf_dir):
    out = errors.missed_vs_caught(oof(spark, sf_dir), FEATS, "xgb")
    return out.withColumns({"fn_mean": F.round("fn_mean", 5), "tp_mean": F.round("tp_mean", 5), "fn_over_tp": F.round("fn_over_tp", 6),
                            "abs_dev_from_1": F.round("abs_dev_from_1", 6)})


@query("fp_tn_effect", V.sql(OOF_MELTED, """, m AS (SELECT feature, count(*) FILTER (pred_xgb = 1) AS n_fp, count(*) FILTER (pred_xgb = 0) AS n_tn,
  avg(value) FILTER (pred_xgb = 1) AS f, avg(value) FILTER (pred_xgb = 0) AS t, var_samp(value) FILTER (pred_xgb = 1) AS vf, var_samp(value) FILTER (pred_xgb = 0) AS vt
  FROM melted WHERE true_label = 0 GROUP BY feature)
SELECT feature, n_fp, n_tn, round(f, 5) AS fp_mean, round(t, 5) AS tn_mean, round((f - t) / sqrt((vf + vt) / 2), 6) AS cohens_d FROM m"""))
def fp_tn_effect(spark, sf_dir):
    out = errors.false_alarm_effect(oof(spark, sf_dir), FEATS, "xgb")
    return out.withColumns({"fp_mean": F.round("fp_mean", 5), "tn_mean": F.round("tn_mean", 5), "cohens_d": F.round("cohens_d", 6)})


@query("model_disagreement", V.sql(OOF_MELTED, """SELECT 'xgb' AS model_a, 'cnn' AS model_b, feature,
  count(*) FILTER (pred_xgb <> true_label AND pred_cnn = true_label) AS n_a_wrong_b_right, count(*) FILTER (pred_xgb = true_label AND pred_cnn <> true_label) AS n_a_right_b_wrong,
  round(avg(value) FILTER (pred_xgb <> true_label AND pred_cnn = true_label), 5) AS a_wrong_b_right_mean,
  round(avg(value) FILTER (pred_xgb = true_label AND pred_cnn <> true_label), 5) AS a_right_b_wrong_mean FROM melted GROUP BY feature"""))
def model_disagreement(spark, sf_dir):
    out = errors.disagreement(oof(spark, sf_dir), FEATS, [("xgb", "cnn")])
    return out.withColumns({c: F.round(c, 5) for c in ("a_wrong_b_right_mean", "a_right_b_wrong_mean")})


_MISSES = """, misses AS (SELECT row_id, fold, proc_name FROM oof WHERE true_label = 1 AND pred_xgb = 1 AND pred_cnn = 0),
  support AS (SELECT t.fold, proc_name, count(*) AS train_support, avg(true_label) AS rate FROM oof JOIN (SELECT DISTINCT fold FROM oof) t ON t.fold <> oof.fold GROUP BY t.fold, proc_name)"""


@query("oof_scan", V.sql(V.OOF, """SELECT row_id, quantity, price, discount, tax, fold, true_label, technique, pred_xgb, proba_xgb, pred_cnn, proba_cnn FROM oof"""))
def oof_scan(spark, sf_dir):
    """The out-of-fold table read from its files with its declared types."""
    oof(spark, sf_dir)
    return spark.read.schema(S.oof_schema(FEATS, ["xgb", "cnn"])).parquet(V.stored_path(spark, sf_dir, "oof"))


@query("new_misses", V.sql(V.OOF, _MISSES + " SELECT row_id, fold, proc_name, coalesce(train_support, 0) AS train_support, round(rate, 6) AS train_attack_rate FROM misses LEFT JOIN support USING (fold, proc_name)"))
def new_misses(spark, sf_dir):
    rows = oof(spark, sf_dir)
    misses = errors.newly_missed(rows, "pred_xgb", "pred_cnn").select("row_id", "fold", "proc_name")
    out = errors.explain_misses(misses, rows, ["row_id"], label="true_label")
    return rounded(out, "train_attack_rate")


@query("mixed_group_names", V.sql(V.OOF, _MISSES + """, grouped AS (SELECT *, quantity::INT AS grp FROM oof),
mixed AS (SELECT grp, count(*) AS group_size FROM grouped GROUP BY grp HAVING count(DISTINCT true_label) > 1 AND count(*) >= 100),
tested AS (SELECT DISTINCT grp, fold FROM grouped), named AS (SELECT grp, proc_name, count(*) AS n_rows FROM grouped GROUP BY grp, proc_name)
SELECT n.grp, n.proc_name, n.n_rows, m.group_size, t.fold, coalesce(s.train_support, 0) AS train_support, CAST(coalesce(s.train_support, 0) >= 30 AS INT) AS above_min_support
FROM named n JOIN mixed m USING (grp) JOIN tested t USING (grp) LEFT JOIN support s ON s.proc_name = n.proc_name AND s.fold = t.fold"""))
def mixed_group_names(spark, sf_dir):
    rows = oof(spark, sf_dir).withColumn("grp", F.col("quantity").cast("int"))
    return errors.mixed_group_names(rows, "grp", label="true_label")


# --- cascades -------------------------------------------------------------------------------------------

_TRAIN_AXIS = """axis0 AS (SELECT fold, proba_xgb AS score, count(*) FILTER (true_label = 1) AS pos, count(*) FILTER (true_label = 0) AS neg FROM oof GROUP BY ALL
), axis AS (SELECT t.fold, score, sum(pos) AS pos, sum(neg) AS neg FROM axis0 a JOIN (VALUES (0), (1), (2), (3), (4)) t(fold) ON a.fold <> t.fold GROUP BY t.fold, score)"""
CUTS = V.OOF + f", {_TRAIN_AXIS}, {_points('axis', 'fold')}, {_picked('fold', [0.05])}, cuts AS (SELECT fold, score AS threshold FROM chosen)"


def cuts(spark, sf_dir):
    return metrics.fold_thresholds(oof(spark, sf_dir), "true_label", "proba_xgb", [S.MAX_FPR], 5)


def _blend_sql(name, second, weighted, low="0.3::DOUBLE", high="0.7::DOUBLE", source="oof", extra=""):
    w = f"least(greatest(1 - abs(proba_xgb - ({high} + {low}) / 2) / (({high} - {low}) / 2), 0), 1)" if weighted else "0.5::DOUBLE"
    return (f"{name} AS (SELECT row_id, true_label, fold{extra}, CASE WHEN proba_xgb BETWEEN {low} AND {high} THEN {w} END AS w, "
            f"CAST(proba_xgb BETWEEN {low} AND {high} AS INT) AS routed, CASE WHEN proba_xgb BETWEEN {low} AND {high} THEN (1 - {w}) * proba_xgb + {w} * {second} ELSE proba_xgb END AS final FROM {source})")


def _fold_scores_sql(name, by="fold", cut="cuts", extra=""):
    join = f"JOIN {cut} USING (fold)" if cut else ""
    return f"""(WITH long AS (SELECT {by}, true_label, final AS proba, CAST(final >= threshold AS INT) AS pred, routed, w, threshold FROM {name} {join})
  {_auroc_sql(by)}, c AS (SELECT {by}, {_CELLS}, avg(routed) AS routed, avg(w) AS w, max(threshold) AS threshold, count(*) AS n_total FROM long GROUP BY {by})
  SELECT {by}, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {ratio('tp', 'tp + fp')} AS "precision", {ratio('tp', 'tp + fn')} AS recall, {ratio('fp', 'fp + tn')} AS fpr,
    {ratio('fn', 'tp + fn')} AS fnr, round(100 * routed, 6) AS pct_routed, round(coalesce(w, 0), 6) AS avg_stage2_weight, threshold, 0 AS degenerate, n_total,
    round(auroc, 6) AS auroc{extra} FROM c JOIN auc USING ({by}))"""


CASCADE_COLS = ["f1", "precision", "recall", "fpr", "fnr", "pct_routed", "avg_stage2_weight", "auroc"]


def _cascade(spark, sf_dir, weighted):
    rows = cascade.blend(oof(spark, sf_dir), "proba_xgb", "proba_cnn", weighted=weighted)
    return rounded(cascade.score_folds(cascade.with_cut(rows, cuts(spark, sf_dir), ["fold"]), ["fold"]), *CASCADE_COLS)


@query("fold_cutoffs", V.sql(CUTS, "SELECT fold, threshold FROM cuts"))
def fold_cutoffs(spark, sf_dir):
    return cuts(spark, sf_dir).select("fold", "threshold")


@query("cascade_flat", V.sql(CUTS, ", " + _blend_sql("b", "proba_cnn", False) + " SELECT * FROM " + _fold_scores_sql("b")))
def cascade_flat(spark, sf_dir):
    return _cascade(spark, sf_dir, False)


@query("cascade_weighted", V.sql(CUTS, ", " + _blend_sql("b", "proba_cnn", True) + " SELECT * FROM " + _fold_scores_sql("b")))
def cascade_weighted(spark, sf_dir):
    return _cascade(spark, sf_dir, True)


@query("blend_ab", V.sql(CUTS, f""", {_blend_sql('flat', 'proba_cnn', False)}, {_blend_sql('wtd', 'proba_cnn', True)}
SELECT * FROM {_fold_scores_sql('flat', extra=", 'flat' AS variant")} UNION ALL SELECT * FROM {_fold_scores_sql('wtd', extra=", 'weighted' AS variant")}"""))
def blend_ab(spark, sf_dir):
    rows = cascade.with_cut(oof(spark, sf_dir), cuts(spark, sf_dir), ["fold"])
    out = cascade.compare_variants({
        "flat": cascade.blend(rows, "proba_xgb", "proba_cnn"), "weighted": cascade.blend(rows, "proba_xgb", "proba_cnn", weighted=True)}, ["fold"])
    return rounded(out, *CASCADE_COLS)


_THIRD = f"round({V.hash_fraction_sql(4, 'row_id')} * 0.7::DOUBLE + true_label * 0.25::DOUBLE, 3)"


@query("stage2_ab", V.sql(CUTS, f""", {_blend_sql('first', 'proba_cnn', True)}, {_blend_sql('second', _THIRD, True)}
SELECT * FROM {_fold_scores_sql('first', extra=", 'cnn' AS variant")} UNION ALL SELECT * FROM {_fold_scores_sql('second', extra=", 'rf' AS variant")}"""))
def stage2_ab(spark, sf_dir):
    rows = cascade.with_cut(oof(spark, sf_dir), cuts(spark, sf_dir), ["fold"])
    rows = rows.withColumn("proba_rf", F.round(hash_fraction(4, "row_id") * 0.7 + F.col("true_label") * 0.25, 3))
    out = cascade.compare_variants({m: cascade.blend(rows, "proba_xgb", f"proba_{m}", weighted=True) for m in ("cnn", "rf")}, ["fold"])
    return rounded(out, *CASCADE_COLS)


WIDTHS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3]


@query("band_sweep", V.sql(CUTS, f""", spread AS (SELECT oof.*, half_width FROM oof, (VALUES {', '.join(f'({w}::DOUBLE)' for w in WIDTHS)}) h(half_width)),
{_blend_sql('b', 'proba_cnn', True, '(0.5::DOUBLE - half_width)', '(0.5::DOUBLE + half_width)', 'spread', ', half_width')}
SELECT * FROM {_fold_scores_sql('b', 'half_width, fold')}"""))
def band_sweep(spark, sf_dir):
    rows = cascade.with_cut(oof(spark, sf_dir), cuts(spark, sf_dir), ["fold"])
    return rounded(cascade.band_sweep(rows, "proba_xgb", "proba_cnn", WIDTHS, ["fold"]), *CASCADE_COLS)


# --- verdicts over result tables ------------------------------------------------------------------------


@query("candidate_verdict", V.sql(RUNS, """, a AS (SELECT avg(f1) FILTER (model = 'xgb') AS pm, stddev_samp(f1) FILTER (model = 'xgb') AS ps, avg(f1) FILTER (model = 'cnn') AS cm,
  stddev_samp(f1) FILTER (model = 'cnn') AS cs FROM runs), b AS (SELECT *, cm - pm AS delta, abs(cm - pm) / sqrt(ps * ps + cs * cs) AS sn FROM a)
SELECT round(pm, 6) AS production_mean, round(ps, 6) AS production_std, round(cm, 6) AS candidate_mean, round(cs, 6) AS candidate_std, round(delta, 6) AS delta,
  round(sn, 3) AS signal_to_noise, CASE WHEN delta > 0.01 AND sn > 1 THEN 'candidate better' WHEN sn < 1 THEN 'no real difference' ELSE 'candidate worse' END AS verdict FROM b"""))
def candidate_verdict(spark, sf_dir):
    out = summaries.candidate_verdict(runs(spark, sf_dir), "xgb", "cnn", arm="model")
    out = rounded(out, "production_mean", "production_std", "candidate_mean", "candidate_std", "delta")
    return out.withColumn("signal_to_noise", F.round("signal_to_noise", 3))


_ARMS = {"A_full_info": ("proba_xgb", 0.5), "B_masked_no_flag": ("proba_cnn", 0.45), "C_masked_with_flag": ("proba_xgb", 0.55)}
ARMS = V.OOF + ", arms AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS arm, fold, true_label, CAST({p} >= {t} AS INT) AS pred FROM oof" for n, (p, t) in _ARMS.items()
) + f"), cells AS (SELECT arm, fold, {_CELLS} FROM arms GROUP BY arm, fold), arm_runs AS (SELECT arm, fold AS repeat, (2 * tp)::DOUBLE / (2 * tp + fp + fn) AS f1, fp::DOUBLE / (fp + tn) AS fpr FROM cells)"


def arm_runs(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(n).alias("arm"), (F.col(p) >= t).cast("int").alias("pred")) for n, (p, t) in _ARMS.items()])
    long = oof(spark, sf_dir).select("fold", "true_label", F.inline(rows))
    return metrics.score(long, ["arm", "fold"], "true_label", "pred").withColumnRenamed("fold", "repeat")


@query("arm_verdict", V.sql(ARMS, """, m AS (SELECT avg(f1) FILTER (arm = 'A_full_info') AS a, avg(f1) FILTER (arm = 'B_masked_no_flag') AS b, avg(f1) FILTER (arm = 'C_masked_with_flag') AS c FROM arm_runs)
SELECT round(a, 6) AS full_mean, round(b, 6) AS masked_mean, round(c, 6) AS flagged_mean, round(a - b, 6) AS gap, round((c - b) / (a - b), 5) AS recovered,
  CASE WHEN c - b > 0.01 AND (c - b) / (a - b) > 0.3 THEN 'flag helps' WHEN abs(c - b) < 0.01 THEN 'flag does not help' ELSE 'ambiguous' END AS verdict FROM m"""))
def arm_verdict(spark, sf_dir):
    out = summaries.arm_verdict(arm_runs(spark, sf_dir), *_ARMS)
    return rounded(out, "full_mean", "masked_mean", "flagged_mean", "gap").withColumn("recovered", F.round("recovered", 5))


@query("repeat_comparison", V.sql(ARMS, """, p AS (SELECT repeat, max(f1) FILTER (arm = 'A_full_info') AS f1_production, max(f1) FILTER (arm = 'C_masked_with_flag') AS f1_augmented,
  max(fpr) FILTER (arm = 'A_full_info') AS fpr_production, max(fpr) FILTER (arm = 'C_masked_with_flag') AS fpr_augmented FROM arm_runs WHERE repeat IN (1, 3) GROUP BY repeat)
SELECT repeat, round(f1_production, 6) AS f1_production, round(f1_augmented, 6) AS f1_augmented, round(fpr_production, 6) AS fpr_production, round(fpr_augmented, 6) AS fpr_augmented,
  round(f1_augmented - f1_production, 6) AS f1_delta, round(fpr_augmented - fpr_production, 6) AS fpr_delta FROM p"""))
def repeat_comparison(spark, sf_dir):
    out = summaries.compare_repeats(arm_runs(spark, sf_dir), "A_full_info", "C_masked_with_flag", [1, 3])
    return rounded(out, *[c for c in out.columns if c != "repeat"])


CURVES = LONG + f""", {_axis('model, fold')}, {_points('axis', 'model, fold')}, {_picked('model, fold', CAPS)} {_auroc_sql('model, fold')}
, curves AS (SELECT 'wide' AS dataset, model, cap AS max_fpr_cap, avg(f1) AS f1_mean, avg(fpr) AS actual_fpr_mean, avg(auroc) AS auroc_mean FROM chosen JOIN auc USING (model, fold) GROUP BY ALL)"""


def curves(spark, sf_dir):
    rows = scored(spark, sf_dir)
    swept = metrics.best_thresholds(rows, ["model", "fold"], "true_label", "proba", CAPS)
    both = swept.join(metrics.auroc(rows, ["model", "fold"], "true_label", "proba"), ["model", "fold"])
    return both.groupBy(F.lit("wide").alias("dataset"), "model", F.col("max_fpr").alias("max_fpr_cap")).agg(
        F.avg("f1").alias("f1_mean"), F.avg("fpr").alias("actual_fpr_mean"), F.avg("auroc").alias("auroc_mean"))


_CURVE_SUMMARY = V.sql(CURVES, """, best AS (SELECT * FROM curves QUALIFY row_number() OVER (PARTITION BY dataset, model ORDER BY round(f1_mean, 9) DESC, max_fpr_cap) = 1
), near AS (SELECT * FROM curves WHERE max_fpr_cap = 0.05)
SELECT dataset, model, b.max_fpr_cap AS best_cap, round(b.f1_mean, 6) AS best_f1_mean, round(b.actual_fpr_mean, 6) AS best_actual_fpr_mean,
  round(r.f1_mean, 6) AS f1_at_reference, round(b.f1_mean - r.f1_mean, 6) AS gap_vs_best_f1, round(b.auroc_mean, 6) AS auroc_mean,
  CASE WHEN b.auroc_mean < 0.6 THEN 'not discriminative' WHEN b.f1_mean - r.f1_mean < 0.01 THEN 'reference holds' ELSE 'reference suboptimal' END AS verdict
FROM best b JOIN near r USING (dataset, model)""")


@query("curve_summary", _CURVE_SUMMARY)
def curve_summary(spark, sf_dir):
    return _summed_up(curves(spark, sf_dir))


def _summed_up(rows):
    return rounded(summaries.curve_summary(rows), "best_f1_mean", "best_actual_fpr_mean", "f1_at_reference", "gap_vs_best_f1", "auroc_mean")


SWEEP_COLUMNS = "max_fpr_cap double, f1_mean double, actual_fpr_mean double, auroc_mean double"
SWEEP_SPELLINGS = {"max_fpr_cap": ["max_fpr"], "f1_mean": ["f1"], "actual_fpr_mean": ["fpr_mean", "fpr"], "auroc_mean": ["auroc"]}


@query("sweep_files", _CURVE_SUMMARY)
def sweep_files(spark, sf_dir):
    """The curves written as sweep files with three spellings of the header, read back and summed up."""
    rows, root = cut_lineage(curves(spark, sf_dir)), f"{application_dir(spark)}/sweeps-{uuid.uuid4().hex}"
    names = [f.split()[0] for f in SWEEP_COLUMNS.split(", ")]
    wide, narrow = F.col("max_fpr_cap") > 0.05, F.col("max_fpr_cap") <= 0.05
    files = {
        "wide_cnn_operating_curve.csv": (F.col("model") == "cnn", names, names),
        "wide_xgb_low_caps.csv": ((F.col("model") == "xgb") & narrow, names[::-1], ["AUROC", "FPR", "F1", "Max_FPR"]),
        "wide_xgb_high_caps.csv": ((F.col("model") == "xgb") & wide, ["model", *names], ["arm", "max_fpr", " f1_mean ", "fpr_mean", "auroc_mean"]),
    }
    for name, (kept, columns, header) in files.items():
        write_table(rows.filter(kept).select(*columns).toDF(*header), f"{root}/{name}", "csv")
    return _summed_up(read_sweeps(spark, root, SWEEP_COLUMNS, SWEEP_SPELLINGS))


_SIDES = V.OOF + """, sides AS (SELECT 'early' AS train_dataset, 'late' AS test_dataset, fold, "year" < 1998 AS inside, true_label, pred_xgb AS pred FROM oof
  UNION ALL SELECT 'late', 'early', fold, "year" >= 1998, true_label, pred_xgb FROM oof
), f AS (SELECT train_dataset, test_dataset, fold, inside, 2.0::DOUBLE * count(*) FILTER (true_label = 1 AND pred = 1) / (count(*) FILTER (true_label = 1) + count(*) FILTER (pred = 1)) AS f1 FROM sides GROUP BY ALL
), p AS (SELECT train_dataset, test_dataset, fold, max(f1) FILTER (inside) AS i, max(f1) FILTER (NOT inside) AS x FROM f GROUP BY ALL)"""


@query("stability", V.sql(_SIDES, """SELECT train_dataset, test_dataset, count(*) AS n_runs, round(avg(i), 6) AS insample_f1_mean, round(stddev_samp(i), 6) AS insample_f1_std,
  round(avg(x), 6) AS crossdataset_f1_mean, round(stddev_samp(x), 6) AS crossdataset_f1_std, round(avg(i) - avg(x), 6) AS f1_drop FROM p GROUP BY ALL"""))
def stability(spark, sf_dir):
    rows = F.array(
        F.struct(F.lit("early").alias("train_dataset"), F.lit("late").alias("test_dataset"), (F.col("year") < 1998).alias("inside")),
        F.struct(F.lit("late").alias("train_dataset"), F.lit("early").alias("test_dataset"), (F.col("year") >= 1998).alias("inside")))
    long = oof(spark, sf_dir).select("fold", "true_label", "pred_xgb", F.inline(rows))
    f1 = metrics.score(long, ["train_dataset", "test_dataset", "fold", "inside"], "true_label", "pred_xgb")
    per = f1.groupBy("train_dataset", "test_dataset", "fold").agg(
        F.max(F.when(F.col("inside"), F.col("f1"))).alias("insample_f1"), F.max(F.when(~F.col("inside"), F.col("f1"))).alias("crossdataset_f1"))
    out = summaries.transfer_stability(per, ["insample_f1", "crossdataset_f1"])
    return rounded(out, "insample_f1_mean", "insample_f1_std", "crossdataset_f1_mean", "crossdataset_f1_std", "f1_drop")


_IMP = V.MELTED + """, imp AS (SELECT feature, abs(coalesce(nullif(corr(value, label), 'nan'::DOUBLE), 0)) AS importance FROM melted GROUP BY feature
), dom(feature, domain_rank) AS (VALUES """ + ", ".join(f"('{f}', {i})" for i, f in enumerate(S.DOMAIN_ORDER, 1)) + """)
, ranked AS (SELECT feature, importance, row_number() OVER (ORDER BY round(importance, 9) DESC, feature) AS model_rank FROM imp)"""


def importance_by_correlation(spark, sf_dir):
    """|r| with the label stands in for a model's importance, so SQL can check the ranking."""
    from hostlens.operators.profile import label_correlation
    from hostlens.plans.profiling import melted

    return label_correlation(melted(spark, sf_dir)).select("feature", F.abs(F.coalesce(F.nanvl("label_corr_r", F.lit(0.0)), F.lit(0.0))).alias("importance"))


@query("rank_gap", V.sql(_IMP, """SELECT feature, round(importance, 6) AS importance, coalesce(domain_rank, 99) AS domain_rank, model_rank, abs(model_rank - coalesce(domain_rank, 99)) AS rank_diff,
  CAST(abs(model_rank - coalesce(domain_rank, 99)) > 5 AS INT) AS discrepant FROM ranked LEFT JOIN dom USING (feature)"""))
def rank_gap(spark, sf_dir):
    out = rounded(summaries.rank_gaps(importance_by_correlation(spark, sf_dir)), "importance")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("model_rank", "rank_diff")})


@query("ablation_tags", V.sql(_IMP, """, d AS (SELECT feature, round(0.02::DOUBLE - importance, 9) AS delta_f1 FROM imp)
SELECT feature, round(delta_f1, 6) AS delta_f1, CASE WHEN delta_f1 < -0.005 THEN 'important' WHEN delta_f1 > 0.005 THEN 'hurts' ELSE 'neutral' END AS tag FROM d"""))
def ablation_tags(spark, sf_dir):
    deltas = importance_by_correlation(spark, sf_dir).select("feature", F.round(0.02 - F.col("importance"), 9).alias("delta_f1"))
    return rounded(summaries.ablation_tags(deltas), "delta_f1")
