"""Queries: contradicting rows, their description, stored replies and the evaluation of those replies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import hash_fraction, melt
from hostlens.operators import metrics, summaries, triage
from hostlens.plans import views as V
from hostlens.plans.catalogue import query
from hostlens.plans.profiling import features, melted
from hostlens.plans.scoring import oof, ratio
from hostlens.plans.splitting import rounded
from hostlens.session import application_dir, cut_lineage
from hostlens.sources.batches import read_batches, write_batches
from hostlens.sources.tables import pending, resolve_alias, write_table

FEATS = V.WIDE_FEATURES
NOTES = "Known weak spots: none recorded for this dataset."
GLOSS = {"quantity": "units moved", "price": "total charged", "discount": "share taken off", "tax": "share added"}
MAX_CASES = 400

CONTRA = V.OOF + """, contra AS (SELECT *, CASE WHEN pred_xgb = 0 THEN 'xgb_benign_cnn_malicious' ELSE 'xgb_malicious_cnn_benign' END AS disagreement_direction
  FROM oof WHERE proba_xgb BETWEEN 0.3 AND 0.7 AND pred_xgb <> pred_cnn AND pred_xgb >= 0 AND pred_cnn >= 0)"""
CASES = CONTRA + f""", picked AS (SELECT *, row_number() OVER (PARTITION BY disagreement_direction, technique ORDER BY {V.hash_order_sql(42, 'row_id')}, row_id) AS r,
    count(*) OVER (PARTITION BY disagreement_direction, technique) AS n, count(*) OVER () AS total FROM contra
), cases AS (SELECT * FROM picked WHERE r <= CASE WHEN total <= {MAX_CASES} THEN n ELSE least(n, greatest(1, round_even({MAX_CASES}::DOUBLE * n / total, 0))) END
  QUALIFY row_number() OVER (ORDER BY {V.hash_order_sql(43, 'row_id')}, row_id) <= {MAX_CASES})"""


@query("contradictions", V.sql(CONTRA, "SELECT row_id, fold, technique, pred_xgb, pred_cnn, proba_xgb, proba_cnn, disagreement_direction FROM contra"))
def contradictions(spark, sf_dir):
    cols = ["row_id", "fold", "technique", "pred_xgb", "pred_cnn", "proba_xgb", "proba_cnn", "disagreement_direction"]
    return triage.contradictions(oof(spark, sf_dir)).select(*cols)


@query("case_cap", V.sql(CASES, "SELECT row_id, disagreement_direction, technique FROM cases"))
def case_cap(spark, sf_dir):
    return triage.triage_cases(oof(spark, sf_dir), MAX_CASES).select("row_id", "disagreement_direction", "technique")


# --- percentiles and context ----------------------------------------------------------------------------

_POINTS = "[" + ", ".join(f"{p / 100}" for p in range(1, 100)) + "]"
BREAKS = V.MELTED + f", breaks AS (SELECT feature, label, quantile_cont(value, {_POINTS}) AS bp FROM melted GROUP BY feature, label)"


@query("percentile_table", V.sql(BREAKS, "SELECT feature, label, CAST(unnest(range(1, 100)) AS INT) AS pct, round(unnest(bp), 6) AS q FROM breaks"))
def percentile_table(spark, sf_dir):
    return rounded(triage.percentile_points(melted(spark, sf_dir)), "q")


def _tables(df, names, label="label"):
    return triage.percentile_arrays(triage.percentile_points(melt(df, [label], names), label), label)


def _ranks_sql(melted_cte, ids):
    return f"""vs AS (SELECT {ids}, m.feature, m.value, b.bp AS bb, a.bp AS ab FROM {melted_cte} m JOIN breaks b ON b.feature = m.feature AND b.label = 0
    JOIN breaks a ON a.feature = m.feature AND a.label = 1
), raw_ranks AS (SELECT *, CAST(round_even((len(list_filter(bb, lambda x: x < value)) + len(list_filter(bb, lambda x: x <= value))) / 2.0::DOUBLE, 0) AS INT) AS rb,
    CAST(round_even((len(list_filter(ab, lambda x: x < value)) + len(list_filter(ab, lambda x: x <= value))) / 2.0::DOUBLE, 0) AS INT) AS ra FROM vs
), ranks AS (SELECT * EXCLUDE (rb, ra, bb, ab), CASE WHEN rb <= 0 THEN 0 WHEN rb >= 99 THEN 100 ELSE rb END AS rb, CASE WHEN ra <= 0 THEN 0 WHEN ra >= 99 THEN 100 ELSE ra END AS ra FROM raw_ranks
), texts AS (SELECT *, CASE rb WHEN 0 THEN 'p1-' WHEN 100 THEN 'p99+' ELSE 'p' || rb END AS tb, CASE ra WHEN 0 THEN 'p1-' WHEN 100 THEN 'p99+' ELSE 'p' || ra END AS ta FROM ranks)"""


_IDS = ["source", "scenario", "host", "pid"]
FEATURE_MELTED = V.FEATURES + ", melted AS (" + V.melted_sql("features", "label, " + ", ".join(_IDS), V.PROFILE_FEATURES) + \
    f"), breaks AS (SELECT feature, label, quantile_cont(value, {_POINTS}) AS bp FROM melted GROUP BY feature, label), " + _ranks_sql("melted", ", ".join(_IDS))


def _ranked(spark, sf_dir):
    table = features(spark, sf_dir)
    return triage.attach_ranks(table, V.PROFILE_FEATURES, _tables(table, V.PROFILE_FEATURES))


@query("percentile_label", V.sql(FEATURE_MELTED, f"SELECT {', '.join(_IDS)}, feature, tb AS vs_benign, ta AS vs_attack FROM texts"))
def percentile_label(spark, sf_dir):
    long = _ranked(spark, sf_dir).select(*_IDS, F.explode("ranked").alias("c"))
    return long.select(*_IDS, F.col("c.name").alias("feature"), triage.rank_text(F.col("c.benign")).alias("vs_benign"), triage.rank_text(F.col("c.attack")).alias("vs_attack"))


_ORDER_CASE = "CASE feature " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(V.PROFILE_FEATURES)) + " END"


@query("notable_deviations", V.sql(FEATURE_MELTED, f""", ordered AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_IDS)} ORDER BY abs(rb - 50) DESC, {_ORDER_CASE}) AS r FROM texts)
SELECT {', '.join(_IDS)}, string_agg(feature, ',' ORDER BY r) AS notable FROM ordered WHERE r <= 5 GROUP BY ALL"""))
def notable_deviations(spark, sf_dir):
    top = triage.most_unusual(F.col("ranked"), 5)
    return _ranked(spark, sf_dir).select(*_IDS, F.array_join(F.transform(top, lambda c: c["name"]), ",").alias("notable"))


_GLOSS_CASE = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{g}'" for f, g in GLOSS.items()) + " END"
_FEAT_CASE = "CASE feature " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(FEATS)) + " END"
CONTEXT = CONTRA + ", melted AS (" + V.melted_sql("contra", "row_id", FEATS) + f"""), base AS ({V.melted_sql('wide', 'label', FEATS)}
), breaks AS (SELECT feature, label, quantile_cont(value, {_POINTS}) AS bp FROM base GROUP BY feature, label), {_ranks_sql('melted', 'row_id')}
, ordered AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(rb - 50) DESC, {_FEAT_CASE}) AS r FROM texts
), body AS (SELECT row_id, string_agg('  ' || printf('%-22s', feature) || ' ' || printf('%-8s', CASE WHEN value = round_even(value, 0) THEN value::BIGINT::VARCHAR ELSE printf('%.4g', value) END)
    || ' ' || printf('%-6s', tb) || ' ' || printf('%-6s', ta) || ' ' || {_GLOSS_CASE}, chr(10) ORDER BY r) AS lines, string_agg(feature, ', ' ORDER BY r) AS names FROM ordered GROUP BY row_id)"""


@query("context_text", V.sql(CONTEXT, f"""SELECT row_id, '=== RECORD UNDER REVIEW ===' || chr(10)
  || printf('Model votes:  XGBoost -> %s (p_malicious=%.2f)   |   CNN -> %s (p_malicious=%.2f)', CASE pred_xgb WHEN 1 THEN 'MALICIOUS' ELSE 'BENIGN' END, proba_xgb,
     CASE pred_cnn WHEN 1 THEN 'MALICIOUS' ELSE 'BENIGN' END, proba_cnn) || chr(10) || chr(10)
  || 'Behavioural features, top 4 most unusual vs benign (value | pctile vs benign pop | pctile vs attack pop | meaning)' || chr(10) || lines || chr(10) || chr(10)
  || 'Most-deviating features, in order (first = most extreme):' || chr(10) || '  ' || names || chr(10) || chr(10) || '{NOTES}' AS context FROM contra JOIN body USING (row_id)"""))
def context_text(spark, sf_dir):
    """Every contradicting row is described."""
    rows = oof(spark, sf_dir)
    cases = triage.contradictions(rows)
    tables = _tables(rows, FEATS, "true_label")
    return triage.context_text(cases, FEATS, tables, NOTES, GLOSS).select("row_id", "context")


# --- replies --------------------------------------------------------------------------------------------


def raw_replies(spark, sf_dir):
    return V.stored(spark, sf_dir, "replies", build_replies)


def build_replies(spark, sf_dir):
    """Two attempts per contradicting row as text, some broken on purpose; a tenth of the rows has none."""
    number = F.floor(hash_fraction(11, "row_id") * 10).cast("int")
    says = F.when(hash_fraction(12, "row_id") < 0.3 + 0.4 * F.col("true_label"), "MALICIOUS").otherwise("BENIGN")
    surety = F.concat(F.lit("0."), F.lpad(F.floor(hash_fraction(13, "row_id") * 100).cast("string"), 2, "0"))
    # each is a column of its own: as expressions they would be worked out again in every branch below
    rows = triage.contradictions(oof(spark, sf_dir)).select("row_id", number.alias("kind"), says.alias("verdict"), surety.alias("conf")).filter("kind < 9")
    kind, verdict, conf = F.col("kind"), F.col("verdict"), F.col("conf")
    names = F.element_at(F.array(F.lit('["price"]'), F.lit('["tax", "discount"]'), F.lit("[]")), (kind % 3 + 1).cast("int"))
    rows = rows.withColumns({"keys": names, "side": F.when(kind % 2 == 0, "xgb").otherwise("cnn")})
    keys, side = F.col("keys"), F.col("side")

    def reply(v, c, k, steps='["a", "b", "c"]', extra=""):
        return F.concat(F.lit('{"verdict": "'), v, F.lit('", "confidence": '), c, F.lit(f', "rationale_steps": {steps}, "key_features": '), k,
                        F.lit(', "agrees_with": "'), side, F.lit(f'"{extra}}}'))

    good = F.col("good")
    broken = (
        F.when(kind == 0, F.substring(good, 1, 40)).when(kind == 1, reply(F.lit("MAYBE"), conf, keys)).when(kind == 2, reply(verdict, F.lit("1.7"), keys))
        .when(kind == 3, reply(verdict, conf, F.lit('["nowhere"]'))).when(kind == 5, reply(verdict, conf, keys, extra=', "more": 1'))
        .when(kind == 6, reply(verdict, conf, keys, steps='["a", "b"]'))
    )
    rows = rows.withColumn("good", reply(verdict, conf, keys)).withColumn("broken", broken)
    first = F.coalesce("broken", F.when(kind == 4, F.concat(F.lit("Sure:\n"), good, F.lit("\nDone."))).otherwise(good))
    second = F.when(kind.isin(0, 1, 5), good).when(kind.isin(2, 3, 6), F.col("broken"))
    both = rows.select("row_id", F.posexplode(F.array(first, second)).alias("_i", "raw"))
    return both.filter(F.col("raw").isNotNull()).select("row_id", (F.col("_i") + 1).alias("attempt"), "raw")


def _reply_sql(v="verdict", c="conf", k="keys", steps='["a", "b", "c"]', extra=""):
    return (f"""'{{"verdict": "' || {v} || '", "confidence": ' || {c} || ', "rationale_steps": {steps}, "key_features": ' || {k} || ', "agrees_with": "' || side || '"{extra}}}'""")


REPLIES = CONTRA + f""", kinds AS (SELECT row_id, floor({V.hash_fraction_sql(11, 'row_id')} * 10)::INT AS kind,
    CASE WHEN {V.hash_fraction_sql(12, 'row_id')} < 0.3 + 0.4 * true_label THEN 'MALICIOUS' ELSE 'BENIGN' END AS verdict,
    '0.' || lpad(floor({V.hash_fraction_sql(13, 'row_id')} * 100)::INT::VARCHAR, 2, '0') AS conf FROM contra
), parts AS (SELECT *, (['["price"]', '["tax", "discount"]', '[]'])[kind % 3 + 1] AS keys, CASE WHEN kind % 2 = 0 THEN 'xgb' ELSE 'cnn' END AS side FROM kinds WHERE kind < 9
), goods AS (SELECT *, {_reply_sql()} AS good FROM parts
), brokens AS (SELECT *, CASE kind WHEN 0 THEN substr(good, 1, 40) WHEN 1 THEN {_reply_sql(v="'MAYBE'")} WHEN 2 THEN {_reply_sql(c="'1.7'")}
    WHEN 3 THEN {_reply_sql(k="'" + '["nowhere"]' + "'")} WHEN 5 THEN {_reply_sql(extra=', "more": 1')} WHEN 6 THEN {_reply_sql(steps='["a", "b"]')} END AS broken FROM goods
), replies AS (SELECT row_id, 1 AS attempt, coalesce(broken, CASE WHEN kind = 4 THEN 'Sure:' || chr(10) || good || chr(10) || 'Done.' ELSE good END) AS raw FROM brokens
  UNION ALL SELECT row_id, 2, CASE WHEN kind IN (0, 1, 5) THEN good ELSE broken END FROM brokens WHERE kind IN (0, 1, 2, 3, 5, 6)
), docs AS (SELECT *, CASE WHEN json_valid(regexp_extract(raw, '(?s)\\{{.*\\}}', 0)) THEN regexp_extract(raw, '(?s)\\{{.*\\}}', 0) END AS js FROM replies
), checked AS (SELECT *, coalesce(list_sort(json_keys(js)) = ['agrees_with', 'confidence', 'key_features', 'rationale_steps', 'verdict']
    AND json_extract_string(js, '$.verdict') IN ('MALICIOUS', 'BENIGN') AND json_type(js, '$.confidence') IN ('DOUBLE', 'UBIGINT')
    AND json_extract_string(js, '$.confidence')::DOUBLE BETWEEN 0 AND 1 AND json_array_length(js, '$.rationale_steps') BETWEEN 3 AND 6
    AND json_array_length(js, '$.key_features') <= 5
    AND len(list_filter(json_extract_string(js, '$.key_features[*]'), lambda x: x NOT IN ('quantity', 'price', 'discount', 'tax'))) = 0
    AND json_extract_string(js, '$.agrees_with') IN ('xgb', 'cnn', 'neither'), false) AS valid FROM docs
), resolved AS (SELECT row_id, CASE WHEN bool_or(valid AND attempt = 1) THEN 'ok' WHEN bool_or(valid) THEN 'repaired' ELSE 'parse_error' END AS parse_status,
    coalesce(first(js ORDER BY attempt) FILTER (valid)) AS js, coalesce(first(raw ORDER BY attempt) FILTER (valid), last(raw ORDER BY attempt)) AS raw FROM checked GROUP BY row_id
), arb AS (SELECT c.row_id, c.fold, c.true_label, c.technique, c.pred_xgb, c.pred_cnn, c.proba_xgb, c.proba_cnn, c.disagreement_direction,
    json_extract_string(js, '$.verdict') AS llm_verdict, CASE json_extract_string(js, '$.verdict') WHEN 'MALICIOUS' THEN 1 WHEN 'BENIGN' THEN 0 ELSE -1 END AS llm_pred,
    json_extract_string(js, '$.confidence')::DOUBLE AS llm_confidence, json_extract_string(js, '$.agrees_with') AS llm_agrees_with,
    coalesce(parse_status, 'call_error') AS parse_status, coalesce(json_extract(js, '$.rationale_steps')::VARCHAR, '[]') AS rationale_steps,
    coalesce(json_extract(js, '$.key_features')::VARCHAR, '[]') AS key_features, r.raw FROM contra c LEFT JOIN resolved r USING (row_id)
), usable AS (SELECT * FROM arb WHERE parse_status NOT IN ('parse_error', 'call_error'))"""


def arbitration(spark, sf_dir):
    return V.stored(spark, sf_dir, "arbitration", build_arbitration)


def build_arbitration(spark, sf_dir):
    resolved = triage.resolve_replies(raw_replies(spark, sf_dir), FEATS)
    return triage.arbitration_table(triage.contradictions(oof(spark, sf_dir)), resolved)


@query("reply_parse", V.sql(REPLIES, "SELECT row_id, parse_status, json_extract_string(js, '$.verdict') AS verdict, json_extract_string(js, '$.confidence')::DOUBLE AS confidence, raw FROM resolved"))
def reply_parse(spark, sf_dir):
    out = triage.resolve_replies(raw_replies(spark, sf_dir), FEATS)
    return out.select("row_id", "parse_status", F.col("reply.verdict").alias("verdict"), F.col("reply.confidence").alias("confidence"), "raw")


@query("arbitration_table", V.sql(REPLIES, "SELECT * FROM arb"))
def arbitration_table(spark, sf_dir):
    return build_arbitration(spark, sf_dir)


@query("arbitration_scan", V.sql(REPLIES, "SELECT * FROM arb"))
def arbitration_scan(spark, sf_dir):
    """The arbitration table read from its files with its declared types."""
    arbitration(spark, sf_dir)
    return spark.read.schema(S.arbitration_schema()).parquet(V.stored_path(spark, sf_dir, "arbitration"))


@query("resume_antijoin", V.sql(CONTRA, f"SELECT row_id FROM contra WHERE NOT {V.hash_fraction_sql(14, 'row_id')} < 0.6"))
def resume_antijoin(spark, sf_dir):
    todo = triage.contradictions(oof(spark, sf_dir)).select("row_id")
    return pending(todo, todo.filter(hash_fraction(14, "row_id") < 0.6), ["row_id"])


class Stopped(Exception):
    """A run that ends early."""


@query("resumable_batches", V.sql(CONTRA, "SELECT row_id, label, proba_xgb FROM (SELECT row_id, true_label AS label, proba_xgb FROM contra)"))
def resumable_batches(spark, sf_dir):
    """The contradictions written in batches by three runs: one stops before a commit, one behind a commit, one ends."""
    todo = cut_lineage(triage.contradictions(oof(spark, sf_dir)).select("row_id", F.col("true_label").alias("label"), "proba_xgb"))
    path = f"{application_dir(spark)}/batches-{uuid.uuid4().hex}"

    def stop_at(where):
        def stop(step, batch):
            if (step, batch) == where:
                raise Stopped(where)

        return stop

    for where in (("staged", 1), ("committed", 2), None):
        try:
            write_batches(todo, path, ["row_id"], 4, stop=stop_at(where))
        except Stopped:
            continue
    return read_batches(spark, path)


def _strategy(name, vote):
    tp, hit = f"count(*) FILTER (true_label = 1 AND v = 1)", "count(*) FILTER (true_label = v)"
    return f"""SELECT '{name}' AS strategy, count(*) AS n, {ratio(hit, 'count(*)')} AS accuracy, {ratio(tp, 'count(*) FILTER (v = 1)')} AS "precision",
  {ratio(tp, 'count(*) FILTER (true_label = 1)')} AS recall, {ratio('2 * ' + tp, 'count(*) FILTER (v = 1) + count(*) FILTER (true_label = 1)')} AS f1
  FROM (SELECT true_label, {vote} AS v FROM usable)"""


@query("arbitration_accuracy", V.sql(REPLIES, " UNION ALL ".join(_strategy(n, v) for n, v in {
    "llm": "llm_pred", "always_xgb": "pred_xgb", "always_cnn": "pred_cnn",
    "trust_more_confident": "CASE WHEN abs(proba_xgb - 0.5) >= abs(proba_cnn - 0.5) THEN pred_xgb ELSE pred_cnn END",
    "blend_at_0.5": "CAST(0.5 * proba_xgb + 0.5 * proba_cnn >= 0.5 AS INT)",
    "majority_class": "(SELECT round_even(avg(true_label), 0)::INT FROM usable)"}.items())))
def arbitration_accuracy(spark, sf_dir):
    return rounded(triage.arbitration_accuracy(arbitration(spark, sf_dir)), "accuracy", "precision", "recall", "f1")


EFFECT = REPLIES + f""", o AS (SELECT oof.row_id, oof.fold, oof.true_label, CAST(CASE WHEN oof.proba_xgb BETWEEN 0.3 AND 0.7 THEN 0.5 * oof.proba_xgb + 0.5 * oof.proba_cnn ELSE oof.proba_xgb END >= 0.5 AS INT) AS base,
  CASE WHEN arb.llm_pred IN (0, 1) THEN arb.llm_pred END AS vote FROM oof LEFT JOIN arb USING (row_id)
), l AS (SELECT 'cascade@0.5thr' AS variant, fold, true_label, base AS pred FROM o UNION ALL SELECT 'cascade+llm', fold, true_label, coalesce(vote, base) FROM o
), effect AS (SELECT variant, coalesce(fold::VARCHAR, 'pooled') AS fold,
  2.0::DOUBLE * count(*) FILTER (true_label = 1 AND pred = 1) / (count(*) FILTER (true_label = 1) + count(*) FILTER (pred = 1)) AS f1,
  count(*) FILTER (true_label = 1 AND pred = 1) / (count(*) FILTER (true_label = 1))::DOUBLE AS recall,
  count(*) FILTER (true_label = 0 AND pred = 1) / (count(*) FILTER (true_label = 0))::DOUBLE AS fpr FROM l GROUP BY GROUPING SETS ((variant, fold), (variant)))"""


@query("override_effect", V.sql(EFFECT, "SELECT variant, fold, round(f1, 6) AS f1, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM effect"))
def override_effect(spark, sf_dir):
    return rounded(triage.override_effect(arbitration(spark, sf_dir), oof(spark, sf_dir)), "f1", "recall", "fpr")


@query("override_delta", V.sql(EFFECT, ", p AS (SELECT * FROM effect WHERE fold = 'pooled') SELECT " + ", ".join(
    f"round(max({m}) FILTER (variant = 'cascade+llm') - max({m}) FILTER (variant <> 'cascade+llm'), 6) AS delta_{m}" for m in ("f1", "recall", "fpr")) + " FROM p"))
def override_delta(spark, sf_dir):
    effect = triage.override_effect(arbitration(spark, sf_dir), oof(spark, sf_dir))
    return rounded(triage.override_delta(effect), "delta_f1", "delta_recall", "delta_fpr")


BINS = REPLIES + """, bins AS (SELECT CAST(greatest(ceil(llm_confidence * 10), 1) AS INT) AS bin, count(*) AS n, avg(llm_confidence) AS mc, avg(CAST(llm_pred = true_label AS INT)) AS acc
  FROM usable WHERE llm_confidence IS NOT NULL GROUP BY 1)"""


def _judged(spark, sf_dir):
    arb = triage.valid_replies(arbitration(spark, sf_dir))
    return arb.withColumn("correct", (F.col("llm_pred") == F.col("true_label")).cast("int"))


@query("calibration_error", V.sql(BINS, "SELECT sum(n)::BIGINT AS n, round(sum(n * abs(acc - mc)) / sum(n), 6) AS ece FROM bins"))
def calibration_error(spark, sf_dir):
    return rounded(metrics.calibration_error(_judged(spark, sf_dir), [], "llm_confidence", "correct"), "ece")


@query("calibration_bins", V.sql(BINS, "SELECT bin, n, round(mc, 6) AS mean_confidence, round(acc, 6) AS accuracy FROM bins"))
def calibration_bins(spark, sf_dir):
    return rounded(metrics.calibration_bins(_judged(spark, sf_dir), [], "llm_confidence", "correct"), "mean_confidence", "accuracy")


@query("key_feature_overlap", V.sql(REPLIES, """, named AS (SELECT json_extract_string(key_features, '$[*]') AS f FROM usable)
SELECT count(*) AS n, count(*) FILTER (len(list_intersect(f, ['price', 'quantity'])) > 0) AS hits, round(avg(CAST(len(list_intersect(f, ['price', 'quantity'])) > 0 AS INT)), 6) AS overlap
FROM named WHERE len(f) > 0"""))
def key_feature_overlap(spark, sf_dir):
    return rounded(triage.key_feature_overlap(arbitration(spark, sf_dir), ["price", "quantity"]), "overlap")


def _long(section, key, source, values):
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {key} AS \"key\", '{m}' AS metric, round(({e})::DOUBLE, 6) AS value FROM {source}" for m, e in values.items())


_STRATEGIES = {
    "llm": "llm_pred", "always_xgb": "pred_xgb", "always_cnn": "pred_cnn",
    "trust_more_confident": "CASE WHEN abs(proba_xgb - 0.5) >= abs(proba_cnn - 0.5) THEN pred_xgb ELSE pred_cnn END",
    "blend_at_0.5": "CAST(0.5 * proba_xgb + 0.5 * proba_cnn >= 0.5 AS INT)", "majority_class": "(SELECT round_even(avg(true_label), 0)::INT FROM usable)"}
REPORT = EFFECT + BINS.removeprefix(REPLIES) + ", acc AS (" + " UNION ALL ".join(_strategy(n, v) for n, v in _STRATEGIES.items()) + """
), pooled AS (SELECT """ + ", ".join(f"max({m}) FILTER (variant = 'cascade+llm') - max({m}) FILTER (variant <> 'cascade+llm') AS delta_{m}" for m in ("f1", "recall", "fpr")) + """ FROM effect WHERE fold = 'pooled'
), named AS (SELECT json_extract_string(key_features, '$[*]') AS f FROM usable)"""


@query("triage_report", V.sql(REPORT, " UNION ALL ".join([
    _long("accuracy", "strategy", "acc", {m: f'"{m}"' for m in ("n", "accuracy", "precision", "recall", "f1")}),
    _long("effect", "variant || '/' || fold", "effect", {m: m for m in ("f1", "recall", "fpr")}),
    _long("delta", "'pooled'", "pooled", {f"delta_{m}": f"delta_{m}" for m in ("f1", "recall", "fpr")}),
    _long("reasoning", "'all'", "bins", {"ece": "sum(n * abs(acc - mc)) / sum(n)"}),
    _long("reasoning", "'all'", "named WHERE len(f) > 0", {"key_feature_overlap": "avg(CAST(len(list_intersect(f, ['price', 'quantity'])) > 0 AS INT))"}),
    _long("reasoning", "'all'", "arb", {
        "parse_error_rate": "avg(CAST(parse_status = 'parse_error' AS INT))", "call_error_rate": "avg(CAST(parse_status = 'call_error' AS INT))",
        "failure_rate": "avg(CAST(parse_status IN ('parse_error', 'call_error') AS INT))"})])))
def triage_report(spark, sf_dir):
    """The evaluation report as one written table, read back."""
    report = triage.evaluation_report(arbitration(spark, sf_dir), oof(spark, sf_dir), ["price", "quantity"])
    path = f"{application_dir(spark)}/report-{uuid.uuid4().hex}"
    write_table(report, path, "parquet")
    return rounded(spark.read.parquet(path), "value")


@query("reply_rates", V.sql(REPLIES, """SELECT disagreement_direction, count(*) AS n, round(avg(CAST(parse_status = 'parse_error' AS INT)), 6) AS parse_failure_rate,
  round(avg(CAST(parse_status = 'call_error' AS INT)), 6) AS call_failure_rate, round(avg(CAST(parse_status IN ('parse_error', 'call_error') AS INT)), 6) AS failure_rate,
  count(*) FILTER (parse_status IN ('ok', 'repaired') AND llm_pred = 1) AS n_malicious, count(*) FILTER (parse_status IN ('ok', 'repaired') AND llm_pred = 0) AS n_benign,
  count(*) FILTER (parse_status IN ('ok', 'repaired') AND (llm_agrees_with = 'xgb' OR llm_pred = pred_xgb)) AS n_with_xgb,
  count(*) FILTER (parse_status IN ('ok', 'repaired') AND (llm_agrees_with = 'cnn' OR llm_pred = pred_cnn)) AS n_with_cnn FROM arb GROUP BY disagreement_direction"""))
def reply_rates(spark, sf_dir):
    return rounded(triage.reply_rates(arbitration(spark, sf_dir), ["disagreement_direction"]), "parse_failure_rate", "call_failure_rate", "failure_rate")


_LABELS = "CASE WHEN upper(trim({0})) IN ('1', '1.0', 'ATTACK', 'TRUE', 'MALICIOUS', 'POS') THEN 1 WHEN upper(trim({0})) IN ('0', '0.0', 'BENIGN', 'FALSE', 'NORMAL', 'NEG') THEN 0 END"


@query("condition_summary", V.sql(REPLIES, f""", d AS (SELECT 'verdict' AS "condition", row_id, llm_verdict AS decision, pred_cnn, true_label FROM usable
  UNION ALL SELECT 'number', row_id, llm_pred || '.0', pred_cnn, true_label FROM usable)
SELECT "condition", count(*) AS n, round(avg(CAST({_LABELS.format('decision')} = true_label AS INT)), 6) AS accuracy,
  round(avg(CAST({_LABELS.format('decision')} = pred_cnn AS INT)), 6) AS agreement FROM d GROUP BY "condition\""""))
def condition_summary(spark, sf_dir):
    """Two spellings of the same decisions, with padded keys and differing column names."""
    arb = arbitration(spark, sf_dir)
    padded = F.concat(F.lit(" "), F.col("row_id"), F.lit(" ")).alias("row_id")
    a = arb.select(F.lit("verdict").alias("condition"), padded, "parse_status", F.col("llm_verdict").alias("decision"), F.col("pred_cnn").cast("string"))
    b = arb.select(F.lit("number").alias("condition"), padded, "parse_status", F.concat(F.col("llm_pred").cast("string"), F.lit(".0")).alias("arbitration"),
                   F.col("pred_cnn").cast("string").alias("cnn"))
    names = {"decision": ["arbitration", "decision", "prediction", "llm_pred"], "model_vote": ["cnn_prediction", "cnn_pred", "pred_cnn", "cnn"]}
    both = None
    for part in (a, b):
        for to, candidates in names.items():
            part = resolve_alias(part, candidates, to)
        both = part if both is None else both.unionByName(part)
    truth = oof(spark, sf_dir).select("row_id", F.col("true_label").cast("string").alias("true_label"))
    return rounded(summaries.condition_summary(both, truth), "accuracy", "agreement")


