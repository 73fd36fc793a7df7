"""Rows on which two detectors contradict: selection, description, stored replies and their evaluation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import div
from hostlens.operators.cumulative import quantile_points, value_counts
from hostlens.operators.joins import join_lookup
from hostlens.operators.metrics import calibration_error, confusion_counts, rates, score_counts
from hostlens.operators.sampling import case_cap
from hostlens.sources.tables import summary_rows

FAILED = ["parse_error", "call_error"]

# --- selection ------------------------------------------------------------------------------------------


def contradictions(oof: DataFrame, low: float = S.BAND_LOW, high: float = S.BAND_HIGH) -> DataFrame:
    """Rows in the unsure band on which both models have a vote and the votes differ."""
    a, b = F.col("pred_xgb"), F.col("pred_cnn")
    picked = oof.filter(F.col("proba_xgb").between(low, high) & (a != b) & (a >= 0) & (b >= 0))
    return picked.withColumn("disagreement_direction", F.when(a == 0, "xgb_benign_cnn_malicious").otherwise("xgb_malicious_cnn_benign"))


def triage_cases(oof: DataFrame, max_cases: int, seed: int = S.CV_SEED) -> DataFrame:
    return case_cap(contradictions(oof), ["disagreement_direction", "technique"], "row_id", max_cases, seed)


# --- description ----------------------------------------------------------------------------------------

PERCENTS = list(range(1, 100))


def percentile_points(melted: DataFrame, label: str = "label") -> DataFrame:
    """p1..p99 of every feature in each class, exact, missing values counted as 0."""
    filled = melted.withColumn("value", F.coalesce("value", F.lit(0.0)))
    return quantile_points(value_counts(filled, ["feature", label], "value"), ["feature", label], "value", PERCENTS)


def percentile_arrays(points: DataFrame, label: str = "label") -> DataFrame:
    """(feature, benign, attack): 99 ascending breakpoints each, zeros for a class without rows."""
    def side(cls: int) -> Column:
        pts = F.array_sort(F.collect_list(F.when(F.col(label) == cls, F.struct("pct", "q"))))
        return F.when(F.size(pts) > 0, F.transform(pts, lambda p: p["q"])).otherwise(F.array_repeat(F.lit(0.0), 99))

    return points.groupBy("feature").agg(side(0).alias("benign"), side(1).alias("attack"))


def percentile_rank(value: Column, breakpoints: Column) -> Column:
    """0..100: midway between the breakpoints below and up to the value, so ties land mid-block."""
    lo = F.size(F.filter(breakpoints, lambda b: b < value))
    hi = F.size(F.filter(breakpoints, lambda b: b <= value))
    rank = F.rint((lo + hi) / 2).cast("int")
    return F.when(rank <= 0, 0).when(rank >= 99, 100).otherwise(rank)


def rank_text(rank: Column) -> Column:
    return F.when(rank == 0, "p1-").when(rank == 100, "p99+").otherwise(F.concat(F.lit("p"), rank.cast("string")))


def attach_ranks(df: DataFrame, features: list[str], tables: DataFrame) -> DataFrame:
    """`ranked`: one struct per feature in feature order (index, name, value, rank vs benign, rank vs attack).

    The table has two arrays of 99 numbers per feature, so it rides along with the tasks; a batch of rows finds its places
    by binary search.
    """
    points = {r["feature"]: [np.sort(np.array(r[side], float)) for side in ("benign", "attack")] for r in tables.collect()}  # a row per feature
    sides = [points.get(f) for f in features]

    @F.arrow_udf("array<int>")
    def ranks(values: pa.Array) -> pa.Array:
        cells = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(sides))
        out, known = np.zeros((len(values), len(sides), 2), np.int32), np.zeros((len(values), len(sides), 2), bool)
        for i, breakpoints in enumerate(sides):
            for j, b in enumerate(breakpoints or []):
                rank = np.rint((np.searchsorted(b, cells[:, i], "left") + np.searchsorted(b, cells[:, i], "right")) / 2).astype(np.int32)
                out[:, i, j], known[:, i, j] = np.where(rank >= 99, 100, rank), True
        ends = np.arange(0, out.size + 1, 2 * len(sides), dtype=np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel(), mask=~known.ravel()))

    value = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    out = df.withColumn("_ranks", ranks(F.array(*value.values())))
    return out.withColumn("ranked", F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(f).alias("name"), value[f].alias("v"), F.get("_ranks", F.lit(2 * i)).alias("benign"),
                 F.get("_ranks", F.lit(2 * i + 1)).alias("attack")) for i, f in enumerate(features)])).drop("_ranks")


def most_unusual(ranked: Column, k: int) -> Column:
    """The k cells furthest from the benign median, ties in feature order."""
    keyed = F.transform(ranked, lambda c: F.struct((-F.abs(c["benign"] - 50)).alias("d"), c["i"].alias("i"), c.alias("cell")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["cell"]), 1, k)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out a single time; within a lambda nothing else is shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def four_digits(v: Column) -> Column:
    """Whole numbers plain, others at four significant digits, scientific from 10000 and below 0.0001."""
    whole = v.cast("decimal(38,0)").cast("string")
    return F.when(v == F.rint(v), whole).otherwise(_once(F.floor(F.log10(F.abs(v))).cast("int"), lambda exp: _once(_near(v, exp), lambda near: _four_text(near, exp))))


def _near(v: Column, exp: Column) -> Column:
    """`v` at four significant digits."""
    size = F.abs(v)
    unit = F.pow(F.lit(10.0), (exp - 3).cast("double"))
    # dropping the whole part first is exact, so a value just off a tie is not mistaken for one; the last digit decides a tie
    steps = F.pow(F.lit(10.0), (3 - exp).cast("double"))
    split = F.signum(v) * (F.floor(size) + F.rint((size - F.floor(size)) * steps) / steps)
    return F.when(exp == 3, F.signum(v) * F.rint(size)).when(exp.between(0, 2), split).otherwise(F.rint(v / unit) * unit)


def _four_text(near: Column, exp: Column) -> Column:
    shifted = F.abs(near) >= F.pow(F.lit(10.0), (exp + 1).cast("double"))

    def trimmed(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    def text(exp: Column) -> Column:
        plain = trimmed(near.cast("decimal(30,8)").cast("string"))
        mantissa = trimmed(F.round(near / F.pow(F.lit(10.0), exp.cast("double")), 3).cast("decimal(10,3)").cast("string"))
        sign = F.when(exp < 0, "-").otherwise("+")
        scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exp).cast("string"), 2, "0"))
        return F.when((exp < -4) | (exp >= 4), scientific).otherwise(plain)

    return _once(F.when(shifted, exp + 1).otherwise(exp), text)


def two_decimals(v: Column) -> Column:
    """A number from 0 on as `%.2f` prints it: rounded by its exact binary value, real ties to the even digit."""
    high = v * 134217729.0 - (v * 134217729.0 - v)  # v = high + rest, and each times 200 is exact
    twice = v * 200.0
    error = (high * 200.0 - twice) + (v - high) * 200.0
    low = F.floor(v * 100.0)
    over = (twice - (low * 2 + 1)) + error
    cents = F.when(over > 0, low + 1).when(over < 0, low).otherwise(low + low % 2).cast("bigint")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _padded(c: Column, width: int) -> Column:
    return F.rpad(c, F.greatest(F.lit(width), F.length(c)), F.lit(" "))


def context_text(df: DataFrame, features: list[str], tables: DataFrame, notes: str = "", gloss: dict[str, str] | None = None,
                 top: int = 8, first: int = 5) -> DataFrame:
    """A readable description of each case. Only votes and features are shown, never the technique."""
    gloss = gloss or S.FEATURE_GLOSS
    meaning = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(gloss.get(f, "")))])
    out = attach_ranks(df, features, tables).withColumns({"_short": most_unusual(F.col("ranked"), top), "_gloss": meaning})

    def vote(m: str) -> Column:
        return F.when(F.col(f"pred_{m}") == 1, "MALICIOUS").otherwise("BENIGN")

    def line(c: Column) -> Column:
        return F.concat(
            F.lit("  "), _padded(c["name"], 22), F.lit(" "), _padded(four_digits(c["v"]), 8), F.lit(" "), _padded(rank_text(c["benign"]), 6),
            F.lit(" "), _padded(rank_text(c["attack"]), 6), F.lit(" "), F.element_at(F.col("_gloss"), c["name"]))

    header = F.format_string(
        S.CASE_VOTES,
        vote("xgb"), two_decimals(F.col("proba_xgb")), vote("cnn"), two_decimals(F.col("proba_cnn")))
    title = F.format_string(S.CASE_TITLE, F.size("_short"))
    names = F.array_join(F.transform(F.slice("_short", 1, first), lambda c: c["name"]), ", ")
    text = F.concat_ws(
        "\n", F.lit(S.CASE_HEAD), header, F.lit(""), title, F.array_join(F.transform("_short", line), "\n"), F.lit(""),
        F.lit(S.CASE_ORDER), F.concat(F.lit("  "), names), F.lit(""), F.lit(notes))
    return out.withColumn("context", text).drop("_short", "_gloss", "ranked")


# --- replies --------------------------------------------------------------------------------------------


# the document's keys are sorted in its shape; `confidence` is any number, `key_features` may be empty
REPLY_KINDS = {"confidence": r"(?:BIGINT|DOUBLE|DECIMAL\([\d,]+\))", "rationale_steps": "ARRAY<STRING>", "key_features": "ARRAY<(?:STRING|VOID)>"}
REPLY_SHAPE = "^OBJECT<" + ", ".join(f"{k}: {REPLY_KINDS.get(k, 'STRING')}" for k in sorted(S.REPLY_KEYS)) + ">$"


def parse_replies(replies: DataFrame, features: list[str], out: str = "reply") -> DataFrame:
    """Adds the reply struct where the outermost {...} of `raw` is a valid reply, else NULL.

    Each reply is parsed once; the shape of the whole document tells its keys and their types together.
    """
    staged = replies.withColumn("_doc", F.try_parse_json(F.regexp_extract("raw", r"(?s)\{.*\}", 0))).withColumns({
        "_shape": F.schema_of_variant("_doc"), "_rep": F.try_variant_get("_doc", "$", f"struct<{S.REPLY_JSON}>"),
    })
    r = F.col("_rep")
    known = F.array(*[F.lit(f) for f in features])
    valid = (
        F.col("_shape").rlike(REPLY_SHAPE)
        & r["verdict"].isin("MALICIOUS", "BENIGN")
        & r["confidence"].between(0.0, 1.0)
        & F.size(r["rationale_steps"]).between(3, 6)
        & (F.size(r["key_features"]) <= 5)
        & F.forall(r["key_features"], lambda k: F.array_contains(known, k))
        & r["agrees_with"].isin("xgb", "cnn", "neither")
    )
    return staged.select(*replies.columns, F.when(F.coalesce(valid, F.lit(False)), r).alias(out))


def resolve_replies(replies: DataFrame, features: list[str]) -> DataFrame:
    """One row per case from up to two attempts: ok, repaired by the second, or parse_error."""
    parsed = parse_replies(replies, features, "_r")
    first, second = F.col("attempt") == 1, F.col("attempt") == 2
    both = parsed.groupBy("row_id").agg(
        F.max(F.when(first, F.struct(F.col("_r"), F.col("raw")))).alias("a"), F.max(F.when(second, F.struct(F.col("_r"), F.col("raw")))).alias("b"))
    a, b = F.col("a._r"), F.col("b._r")
    status = F.when(a.isNotNull(), "ok").when(b.isNotNull(), "repaired").otherwise("parse_error")
    reply = F.coalesce(a, b)
    raw = F.when(a.isNotNull(), F.col("a.raw")).otherwise(F.coalesce(F.col("b.raw"), F.col("a.raw")))
    return both.select("row_id", status.alias("parse_status"), reply.alias("reply"), raw.alias("raw"))


def arbitration_table(cases: DataFrame, resolved: DataFrame) -> DataFrame:
    """Cases with their reply flattened; a case without any reply is a call error."""
    joined = cases.join(resolved, "row_id", "left")
    verdict = F.col("reply.verdict")
    empty = F.lit("[]")
    return joined.select(
        "row_id", "fold", "true_label", "technique", "pred_xgb", "pred_cnn", "proba_xgb", "proba_cnn", "disagreement_direction",
        verdict.alias("llm_verdict"), F.when(verdict == "MALICIOUS", 1).when(verdict == "BENIGN", 0).otherwise(-1).alias("llm_pred"),
        F.col("reply.confidence").alias("llm_confidence"), F.col("reply.agrees_with").alias("llm_agrees_with"),
        F.coalesce("parse_status", F.lit("call_error")).alias("parse_status"),
        F.coalesce(F.to_json("reply.rationale_steps"), empty).alias("rationale_steps"),
        F.coalesce(F.to_json("reply.key_features"), empty).alias("key_features"), "raw",
    )


def to_label(text: Column) -> Column:
    """Free-form label to 1, 0 or NULL."""
    t = F.upper(F.trim(text.cast("string")))
    return (
        F.when(t.isin("1", "1.0", "ATTACK", "TRUE", "MALICIOUS", "POS"), 1)
        .when(t.isin("0", "0.0", "BENIGN", "FALSE", "NORMAL", "NEG"), 0)
        .otherwise(t.try_cast("double").try_cast("int"))
    )


# --- evaluation -----------------------------------------------------------------------------------------


def valid_replies(arb: DataFrame) -> DataFrame:
    return arb.filter(~F.col("parse_status").isin(FAILED))


def arbitration_accuracy(arb: DataFrame) -> DataFrame:
    """Replies against five simple strategies on the same cases."""
    px, pc = F.col("proba_xgb"), F.col("proba_cnn")
    surer = F.when(F.abs(px - 0.5) >= F.abs(pc - 0.5), F.col("pred_xgb")).otherwise(F.col("pred_cnn"))
    usable = valid_replies(arb)
    majority = usable.agg(F.rint(F.avg("true_label")).cast("int").alias("m")).scalar()
    votes = {
        "llm": F.col("llm_pred"), "always_xgb": F.col("pred_xgb"), "always_cnn": F.col("pred_cnn"), "trust_more_confident": surer,
        "blend_at_0.5": (0.5 * px + 0.5 * pc >= 0.5).cast("int"), "majority_class": majority,
    }
    rows = F.array(*[F.struct(F.lit(n).alias("strategy"), v.cast("int").alias("vote")) for n, v in votes.items()])
    long = usable.select("true_label", F.inline(rows))
    counts = long.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), *confusion_counts("true_label", "vote"))
    c = F.col
    r = rates(c("tp"), c("fp"), c("fn"), c("tn"))
    # a vote of -1 matches no cell, so accuracy divides by all rows
    return counts.select("strategy", "n", div(c("tp") + c("tn"), c("n")).alias("accuracy"), r["precision"].alias("precision"),
                         div(c("tp"), c("tp") + c("fn"), 0.0).alias("recall"), r["f1"].alias("f1"))


def override_effect(arb: DataFrame, oof: DataFrame, low: float = S.BAND_LOW, high: float = S.BAND_HIGH) -> DataFrame:
    """Scores of the flat cascade at 0.5 with and without valid replies overriding it, per fold and pooled."""
    px, pc = F.col("proba_xgb"), F.col("proba_cnn")
    final = F.when(px.between(low, high), 0.5 * px + 0.5 * pc).otherwise(px)
    replies = arb.filter(F.col("llm_pred").isin(0, 1)).select("row_id", "llm_pred")
    both = join_lookup(oof.select("row_id", "fold", "true_label", (final >= 0.5).cast("int").alias("base")), replies, ["row_id"])
    rows = F.array(
        F.struct(F.lit("cascade@0.5thr").alias("variant"), F.col("base").alias("vote")),
        F.struct(F.lit("cascade+llm").alias("variant"), F.coalesce("llm_pred", "base").alias("vote")))
    long = both.select("fold", "true_label", F.inline(rows))
    long = long.withColumn("fold", F.col("fold").cast("string"))
    counts = long.groupingSets([["variant", "fold"], ["variant"]], "variant", "fold").agg(*confusion_counts("true_label", "vote"))
    return score_counts(counts.withColumn("fold", F.coalesce("fold", F.lit("pooled")))).select("variant", "fold", "f1", "recall", "fpr")


def override_delta(effect: DataFrame) -> DataFrame:
    pooled = effect.filter(F.col("fold") == "pooled")
    with_replies = F.col("variant") == "cascade+llm"
    return pooled.agg(*[
        (F.max(F.when(with_replies, F.col(m))) - F.max(F.when(~with_replies, F.col(m)))).alias(f"delta_{m}") for m in ("f1", "recall", "fpr")])


def key_feature_overlap(arb: DataFrame, discriminators: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of replies with key features that name at least one known discriminator."""
    by = by or []
    feats = F.from_json("key_features", "array<string>")
    named = valid_replies(arb).withColumn("_f", feats).filter(F.size("_f") > 0)
    hit = F.arrays_overlap("_f", F.array(*[F.lit(d) for d in discriminators])).cast("int")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("overlap")]
    return named.groupBy(*by).agg(*aggs) if by else named.agg(*aggs)


def reply_rates(arb: DataFrame, by: list[str]) -> DataFrame:
    """Failure rates, and how the usable replies vote and agree."""
    ok = ~F.col("parse_status").isin(FAILED)

    def follows(m: str) -> Column:
        return ok & ((F.col("llm_agrees_with") == m) | (F.col("llm_pred") == F.col(f"pred_{m}")))

    return arb.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("parse_status") == "parse_error").cast("int")).alias("parse_failure_rate"),
        F.avg((F.col("parse_status") == "call_error").cast("int")).alias("call_failure_rate"),
        F.avg((~ok).cast("int")).alias("failure_rate"),
        F.count_if(ok & (F.col("llm_pred") == 1)).alias("n_malicious"), F.count_if(ok & (F.col("llm_pred") == 0)).alias("n_benign"),
        F.count_if(follows("xgb")).alias("n_with_xgb"), F.count_if(follows("cnn")).alias("n_with_cnn"),
    )


def evaluation_report(arb: DataFrame, oof: DataFrame, discriminators: list[str]) -> DataFrame:
    """section, key, metric, value: the whole evaluation of stored replies as one table, written by one job.

    Sections: accuracy (a key per strategy), effect (per variant and fold), delta (pooled), reasoning. Without replies the
    accuracy section is empty and the figures of reasoning are null.
    """
    judged = valid_replies(arb).withColumn("_correct", (F.col("llm_pred") == F.col("true_label")).cast("int"))
    effect = override_effect(arb, oof)
    status = arb.agg(*[
        F.avg(F.col("parse_status").isin(kinds).cast("int")).alias(name)
        for name, kinds in (("parse_error_rate", ["parse_error"]), ("call_error_rate", ["call_error"]), ("failure_rate", FAILED))])
    parts = [
        ("accuracy", F.col("strategy"), arbitration_accuracy(arb), ["n", "accuracy", "precision", "recall", "f1"]),
        ("effect", F.concat_ws("/", "variant", "fold"), effect, ["f1", "recall", "fpr"]),
        ("delta", F.lit("pooled"), override_delta(effect), ["delta_f1", "delta_recall", "delta_fpr"]),
        ("reasoning", F.lit("all"), calibration_error(judged, [], "llm_confidence", "_correct"), ["ece"]),
        ("reasoning", F.lit("all"), key_feature_overlap(arb, discriminators).withColumnRenamed("overlap", "key_feature_overlap"), ["key_feature_overlap"]),
        ("reasoning", F.lit("all"), status, ["parse_error_rate", "call_error_rate", "failure_rate"]),
    ]
    long = [summary_rows(df.withColumns({"section": F.lit(section), "key": key}), ["section", "key"], values) for section, key, df, values in parts]
    return reduce(DataFrame.unionByName, long)
