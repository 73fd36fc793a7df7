"""Queries: class profiles, rank tests, correlations, drift between two datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens import schemas as S
from hostlens.functions.columns import melt
from hostlens.operators import profile
from hostlens.plans import views as V
from hostlens.plans.catalogue import query
from hostlens.plans.splitting import rounded


def r6(*cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def features(spark, sf_dir):
    return V.feature_table(spark, sf_dir)


def melted(spark, sf_dir):
    return melt(features(spark, sf_dir), ["label", "source", "pid"], V.PROFILE_FEATURES)


def wide_melted(spark, sf_dir):
    """Two datasets in one: the shipments before and from 1998."""
    return melt(V.wide_table(spark, sf_dir), ["row_id", "label", "year"], V.WIDE_FEATURES)


GAPPY_FEATURES = [*V.WIDE_FEATURES, "seen_quantity"]


def gappy_table(spark, sf_dir):
    """The wide table with one more feature that is missing in some rows."""
    return V.wide_table(spark, sf_dir).withColumn("seen_quantity", F.when(F.col("quantity") <= 48, F.col("quantity")))


WIDE_MELTED = V.WIDE + ", melted AS (" + V.melted_sql("wide", 'row_id, label, "year"', V.WIDE_FEATURES) + ")"
GAPPY = V.WIDE + ", gappy AS (SELECT *, CASE WHEN quantity <= 48 THEN quantity END AS seen_quantity FROM wide)"
GAPPY_MELTED = GAPPY + ", melted AS (" + V.melted_sql("gappy", 'row_id, label, "year"', GAPPY_FEATURES) + ")"
EARLY = '"year" < 1998'


@query("class_balance", V.sql(V.FEATURES, "SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM features)::DOUBLE, 6) AS rate FROM features GROUP BY label"))
def class_balance(spark, sf_dir):
    return rounded(profile.class_balance(features(spark, sf_dir)), "rate")


@query("class_by_source_pivot", V.sql(V.WIDE, "SELECT source, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS attack FROM wide GROUP BY source"))
def class_by_source_pivot(spark, sf_dir):
    return profile.class_by_source(V.wide_table(spark, sf_dir))


@query("top_techniques", V.sql(V.WIDE, "SELECT technique, count(*) AS n FROM wide WHERE label = 1 GROUP BY technique ORDER BY n DESC, technique LIMIT 4"))
def top_techniques(spark, sf_dir):
    return profile.top_techniques(V.wide_table(spark, sf_dir), 4)


_MOMENTS = """moments AS (SELECT feature, count(value) FILTER (label = 0) AS benign_n, avg(value) FILTER (label = 0) AS benign_mean,
  var_samp(value) FILTER (label = 0) AS benign_variance, count(value) FILTER (label = 1) AS attack_n, avg(value) FILTER (label = 1) AS attack_mean,
  var_samp(value) FILTER (label = 1) AS attack_variance, quantile_cont(value, 0.5) FILTER (label = 0) AS benign_median,
  quantile_cont(value, 0.5) FILTER (label = 1) AS attack_median FROM melted GROUP BY feature
  HAVING count(value) FILTER (label = 0) >= 5 AND count(value) FILTER (label = 1) >= 5)"""


@query("feature_profile", V.sql(V.MELTED + ", " + _MOMENTS, f"""SELECT feature, benign_n, attack_n, {r6('benign_mean', 'attack_mean', 'benign_median', 'attack_median')},
  round(benign_variance, 4) AS benign_variance, round(attack_variance, 4) AS attack_variance,
  round(CASE WHEN benign_mean > 0.0001 THEN attack_mean / benign_mean END, 6) AS mean_ratio FROM moments"""))
def feature_profile(spark, sf_dir):
    out = profile.feature_profile(melted(spark, sf_dir))
    out = rounded(out, "benign_mean", "attack_mean", "benign_median", "attack_median", "mean_ratio")
    return out.withColumns({c: F.round(c, 4) for c in ("benign_variance", "attack_variance")})


@query("effect_size", V.sql(V.MELTED + ", " + _MOMENTS, """, d AS (SELECT feature, sqrt(((attack_n - 1) * attack_variance + (benign_n - 1) * benign_variance)
    / (attack_n + benign_n - 2)) AS pooled, attack_mean - benign_mean AS gap FROM moments
), e AS (SELECT feature, CASE WHEN pooled = 0 THEN 0 ELSE gap / pooled END AS d FROM d)
SELECT feature, round(d, 6) AS cohens_d, CASE WHEN abs(d) >= 0.8 THEN 'large' WHEN abs(d) >= 0.5 THEN 'medium' WHEN abs(d) >= 0.2 THEN 'small'
  ELSE 'negligible' END AS effect_size FROM e"""))
def effect_size(spark, sf_dir):
    return rounded(profile.effect_sizes(melted(spark, sf_dir)), "cohens_d")


def _mann_whitney_sql(ctes: str) -> str:
    return V.sql(ctes, """, ranked AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value) AS r, count(*) OVER (PARTITION BY feature, value) AS t
    FROM melted WHERE value IS NOT NULL
), sums AS (SELECT feature, count(*) FILTER (label = 1)::DOUBLE AS n1, count(*) FILTER (label = 0)::DOUBLE AS n2,
    sum(r + (t - 1) / 2.0::DOUBLE) FILTER (label = 1) AS rs, sum(t::DOUBLE * t - 1) AS ties FROM ranked GROUP BY feature
), u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM sums)
SELECT feature, round(u, 1) AS u_statistic, round(u / (n1 * n2), 6) AS u_share,
  round(CASE WHEN sd > 0 THEN (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5::DOUBLE) / sd ELSE 0 END, 5) AS z,
  CAST(sd > 0 AND (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5::DOUBLE) / sd > 1.959963984540054 AS INT) AS significant FROM u""")


def _mann_whitney(df):
    out = profile.mann_whitney(df)
    return out.select("feature", F.round("u_statistic", 1).alias("u_statistic"), F.round("u_share", 6).alias("u_share"), F.round("z", 5).alias("z"), "significant")


@query("mann_whitney", _mann_whitney_sql(V.MELTED))
def mann_whitney(spark, sf_dir):
    return _mann_whitney(melted(spark, sf_dir))


@query("mann_whitney_wide", _mann_whitney_sql(WIDE_MELTED))
def mann_whitney_wide(spark, sf_dir):
    return _mann_whitney(wide_melted(spark, sf_dir))


@query("label_correlation", V.sql(GAPPY_MELTED, """, med AS (SELECT feature, quantile_cont(value, 0.5) AS m FROM melted GROUP BY feature)
SELECT feature, round(corr(coalesce(value, m), label), 6) AS label_corr_r FROM melted JOIN med USING (feature) GROUP BY feature"""))
def label_correlation(spark, sf_dir):
    return rounded(profile.label_correlation(melt(gappy_table(spark, sf_dir), ["row_id", "label", "year"], GAPPY_FEATURES)), "label_corr_r")


CORR_FEATURES = V.PROFILE_FEATURES


def _pairs_sql(source, names):
    return " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, nullif(corr({a}, {b}), 'nan'::DOUBLE) AS r FROM {source}"
                              for i, a in enumerate(names) for b in names[i + 1:])


@query("corr_pairs", V.sql(V.FEATURES, ", p AS (" + _pairs_sql("features", CORR_FEATURES) + ") SELECT feature_a, feature_b, round(r, 6) AS r, CAST(coalesce(abs(r) > 0.7, false) AS INT) AS strong FROM p"))
def corr_pairs(spark, sf_dir):
    return rounded(profile.correlation_pairs(features(spark, sf_dir), CORR_FEATURES), "r")


@query("corr_pairs_nullable", V.sql(GAPPY, ", p AS (" + _pairs_sql("gappy", GAPPY_FEATURES) + ") SELECT feature_a, feature_b, round(r, 6) AS r, CAST(coalesce(abs(r) > 0.7, false) AS INT) AS strong FROM p"))
def corr_pairs_nullable(spark, sf_dir):
    return rounded(profile.correlation_pairs(gappy_table(spark, sf_dir), GAPPY_FEATURES), "r")


@query("top_correlate", V.sql(V.FEATURES, ", p AS (" + _pairs_sql("features", CORR_FEATURES) + """), both_ways AS (
  SELECT feature_a AS feature, feature_b AS partner, r FROM p UNION ALL SELECT feature_b, feature_a, r FROM p)
SELECT feature, partner, round(r, 6) AS r FROM both_ways WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature ORDER BY abs(r) DESC, partner) = 1"""))
def top_correlate(spark, sf_dir):
    return rounded(profile.top_correlates(profile.correlation_pairs(features(spark, sf_dir), CORR_FEATURES)), "r")


@query("spearman", V.sql(V.WIDE, """, ranked AS (SELECT rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS ry FROM wide)
SELECT count(*) AS n_rows, round(corr(rx, ry), 6) AS rho FROM ranked"""))
def spearman(spark, sf_dir):
    return rounded(profile.spearman(V.wide_table(spark, sf_dir), "quantity", "price"), "rho").withColumn("n_rows", F.col("n_rows").cast("bigint"))


_KS = f"""counts AS (SELECT feature, value, count(*) FILTER ({EARLY}) AS a, count(*) FILTER (NOT {EARLY}) AS b FROM melted WHERE value IS NOT NULL GROUP BY feature, value
), cums AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS n1, sum(b) OVER (PARTITION BY feature) AS n2 FROM counts
  WINDOW w AS (PARTITION BY feature ORDER BY value)
), ks AS (SELECT feature, max(abs(ca / n1::DOUBLE - cb / n2::DOUBLE)) AS d, max(n1)::DOUBLE AS n1, max(n2)::DOUBLE AS n2 FROM cums GROUP BY feature
), ksp AS (SELECT *, d * d * (n1 * n2 / (n1 + n2)) AS l2, CASE WHEN d * d * (n1 * n2 / (n1 + n2)) < 0.04 THEN 1.0::DOUBLE ELSE least(greatest(
    list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * (d * d * (n1 * n2 / (n1 + n2)))))),
    0.0::DOUBLE), 1.0::DOUBLE) END AS p FROM ks)"""


@query("ks_two_sample", V.sql(WIDE_MELTED + ", " + _KS, "SELECT feature, round(d, 6) AS ks_statistic, n1::BIGINT AS n1, n2::BIGINT AS n2, round(p, 6) AS ks_p_value FROM ksp"))
def ks_two_sample(spark, sf_dir):
    return rounded(profile.ks_two_sample(wide_melted(spark, sf_dir), F.col("year") < 1998), "ks_statistic", "ks_p_value")


def _skew(cond):
    m = f"(avg(value) FILTER ({cond}))"
    return (f"(avg(value * value * value) FILTER ({cond}) - 3 * {m} * avg(value * value) FILTER ({cond}) + 2 * {m} * {m} * {m}) "
            f"/ pow(var_pop(value) FILTER ({cond}), 1.5)")


@query("drift_stats", V.sql(WIDE_MELTED + ", " + _KS, f""", m AS (SELECT feature, count(value) FILTER ({EARLY}) AS a_n, count(value) FILTER (NOT {EARLY}) AS b_n,
  avg(value) FILTER ({EARLY}) AS a_mean, avg(value) FILTER (NOT {EARLY}) AS b_mean, var_samp(value) FILTER ({EARLY}) AS a_variance,
  var_samp(value) FILTER (NOT {EARLY}) AS b_variance, {_skew(EARLY)} AS a_skew, {_skew('NOT ' + EARLY)} AS b_skew FROM melted GROUP BY feature)
SELECT feature, a_n, b_n, round(a_mean, 4) AS a_mean, round(b_mean, 4) AS b_mean, round(a_variance, 2) AS a_variance, round(b_variance, 2) AS b_variance,
  round(a_skew, 4) AS a_skew, round(b_skew, 4) AS b_skew, round(d, 6) AS ks_statistic, round(p, 6) AS ks_p_value, round(a_mean / b_mean, 6) AS mean_ratio,
  CAST(p < 0.05 AS INT) AS differ FROM m JOIN ksp USING (feature)"""))
def drift_stats(spark, sf_dir):
    out = profile.drift_stats(wide_melted(spark, sf_dir), F.col("year") < 1998)
    places = {"a_mean": 4, "b_mean": 4, "a_variance": 2, "b_variance": 2, "a_skew": 4, "b_skew": 4, "ks_statistic": 6, "ks_p_value": 6, "mean_ratio": 6}
    return out.withColumns({c: F.round(c, p) for c, p in places.items()})


_REMEDY = V.MELTED + """, gaps AS (SELECT feature, abs(avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0)) / nullif(stddev_pop(value), 0) AS g,
    abs(avg(ln(1 + greatest(value, 0))) FILTER (label = 1) - avg(ln(1 + greatest(value, 0))) FILTER (label = 0)) / nullif(stddev_pop(ln(1 + greatest(value, 0))), 0) AS gl,
    quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM melted GROUP BY feature
), full_gaps AS (SELECT feature, coalesce(g, 0) AS g, coalesce(gl, 0) AS gl, med, iqr FROM gaps
), best AS (SELECT *, CASE WHEN round(gl, 9) < round(g, 9) THEN 'log1p' ELSE 'none' END AS best_remedy,
    CASE WHEN round(gl, 9) < round(g, 9) THEN gl ELSE g END AS after FROM full_gaps)"""


@query("scaling_remedy", V.sql(_REMEDY, """SELECT feature, round(g, 6) AS gap_none, round(gl, 6) AS gap_log1p, round(g, 6) AS gap_zscore, round(g, 6) AS gap_robust,
  round(med, 6) AS median, round(iqr, 6) AS iqr, best_remedy, round(after, 6) AS gap_after_best,
  round(CASE WHEN g > 0 THEN 100 * (g - after) / g ELSE 0 END, 4) AS gap_reduction_pct FROM best"""))
def scaling_remedy(spark, sf_dir):
    """The two classes play the two datasets, which differ far more than the shipment years do."""
    out = profile.scaling_remedies(melted(spark, sf_dir), F.col("label") == 1)
    out = rounded(out, "gap_none", "gap_log1p", "gap_zscore", "gap_robust", "median", "iqr", "gap_after_best")
    return out.withColumn("gap_reduction_pct", F.round("gap_reduction_pct", 4))


@query("remedy_vote", V.sql(_REMEDY, """, v AS (SELECT best_remedy, count(*) AS n_features FROM best GROUP BY best_remedy)
SELECT best_remedy, n_features, CAST(best_remedy = (SELECT best_remedy FROM v ORDER BY n_features DESC, best_remedy DESC LIMIT 1) AS INT) AS winner FROM v"""))
def remedy_vote(spark, sf_dir):
    return profile.remedy_vote(profile.scaling_remedies(melted(spark, sf_dir), F.col("label") == 1))


@query("histogram", V.sql(WIDE_MELTED, """, top AS (SELECT feature, quantile_cont(value, 0.99) AS top FROM melted GROUP BY feature
), clipped AS (SELECT feature, label, least(greatest(value, 0), top) AS value FROM melted JOIN top USING (feature) WHERE value IS NOT NULL
), edges AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM clipped GROUP BY feature
), binned AS (SELECT feature, label, CAST(least(floor((value - lo) / ((hi - lo) / 40)), 39) AS INT) AS bin, (hi - lo) / 40 AS width FROM clipped JOIN edges USING (feature))
SELECT feature, label, bin, count(*) AS n, round(max(width), 9) AS width,
  round(count(*) / sum(count(*)) OVER (PARTITION BY feature, label)::DOUBLE / max(width), 12) AS density FROM binned GROUP BY feature, label, bin"""))
def histogram(spark, sf_dir):
    out = profile.histogram(wide_melted(spark, sf_dir), "label")
    return out.withColumns({"width": F.round("width", 9), "density": F.round("density", 12)})


@query("binary_rates", V.sql(V.FEATURES, " UNION ALL ".join(f"SELECT label, '{f}' AS feature, round(avg({f}), 6) AS rate FROM features GROUP BY label" for f in S.BINARY_FEATURES)))
def binary_rates(spark, sf_dir):
    return rounded(profile.binary_rates(features(spark, sf_dir), S.BINARY_FEATURES, "label"), "rate")
