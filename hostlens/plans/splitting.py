"""Queries: caps, draws, folds, splits, duplicate groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.functions.columns import hash_fraction, hash_hex
from hostlens.operators import clean, duplicates, sampling, splits
from hostlens.plans import views as V
from hostlens.plans.catalogue import query

ROW = ["row_id"]


def ordered(seed, *keys):
    return V.hash_order_sql(seed, *keys)


VECTOR_SQL = "md5(concat_ws('|', " + ", ".join(f"{c}::DECIMAL(38,4)::VARCHAR" for c in V.GROUP_FEATURES) + "))"
VEC = V.WIDE + f", vec AS (SELECT *, {VECTOR_SQL} AS vector FROM wide)"


def vectors(spark, sf_dir):
    return splits.vector_key(V.wide_table(spark, sf_dir), V.GROUP_FEATURES)


# --- exact draws ----------------------------------------------------------------------------------------


@query("cap_per_stratum", V.sql(V.WIDE, f"""SELECT row_id, technique, source FROM wide
  QUALIFY row_number() OVER (PARTITION BY technique, source ORDER BY {ordered(43, 'row_id')}, row_id) <= 1000"""))
def cap_per_stratum(spark, sf_dir):
    return sampling.cap_per_stratum(V.wide_table(spark, sf_dir), ["technique", "source"], ROW, 1000, 43).select("row_id", "technique", "source")


@query("ratio_sample", V.sql(V.WIDE, f""", sizes AS (SELECT floor(count(*) FILTER (label = 1) * 0.5) AS target FROM wide)
SELECT row_id, label FROM wide WHERE label = 1 UNION ALL
SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (ORDER BY {ordered(42, 'row_id')}, row_id) AS r FROM wide WHERE label = 0)
WHERE r <= (SELECT target FROM sizes)"""))
def ratio_sample(spark, sf_dir):
    return sampling.ratio_sample(V.wide_table(spark, sf_dir), ROW, 0.5, 42).select("row_id", "label")


def _proportional(target: str, seed: int) -> str:
    return f""", strata AS (SELECT technique, count(*) AS n FROM wide WHERE label = 1 GROUP BY technique
), goal AS (SELECT {target} AS target, (SELECT sum(n) FROM strata) AS avail, (SELECT max(technique) FROM strata) AS last
), shares AS (SELECT technique, n, CASE WHEN avail <= target THEN n WHEN technique = last THEN NULL
    ELSE least(round_even(target * n / avail::DOUBLE, 0), n) END AS q FROM strata, goal
), quotas AS (SELECT technique, n, coalesce(q, least(n, (SELECT target FROM goal) - (SELECT coalesce(sum(q), 0) FROM shares))) AS quota FROM shares
), picked AS (SELECT w.row_id, w.label, w.technique, quota, row_number() OVER (PARTITION BY w.technique ORDER BY {ordered(seed, 'row_id')}, row_id) AS r
  FROM wide w JOIN quotas USING (technique) WHERE label = 1)"""


@query("target_rate_sample", V.sql(V.WIDE, _proportional("(SELECT round_even(count(*) FILTER (label = 0) * 0.2::DOUBLE / 0.8::DOUBLE, 0) FROM wide)", 44) + """
SELECT row_id, label, technique FROM picked WHERE r <= quota UNION ALL SELECT row_id, label, technique FROM wide WHERE label = 0"""))
def target_rate_sample(spark, sf_dir):
    return sampling.target_rate_sample(V.wide_table(spark, sf_dir), ROW, 0.2, 44).select("row_id", "label", "technique")


@query("target_size_sample", V.sql(V.WIDE, _proportional("(SELECT floor(count(*) * 0.8::DOUBLE) - count(*) FILTER (label = 0) FROM wide)", 45) + """
SELECT row_id, label, technique FROM picked WHERE r <= quota UNION ALL SELECT row_id, label, technique FROM wide WHERE label = 0"""))
def target_size_sample(spark, sf_dir):
    wide = V.wide_table(spark, sf_dir)
    return sampling.target_size_sample(wide, ROW, int(wide.count() * 0.8), 45).select("row_id", "label", "technique")


@query("benign_shrink_sample", V.sql(V.WIDE, f""", goal AS (SELECT round_even(count(*) FILTER (label = 1) * (1 - 0.6::DOUBLE) / 0.6::DOUBLE, 0) AS keep FROM wide)
SELECT row_id, label FROM wide WHERE label = 1 UNION ALL
SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (ORDER BY {ordered(46, 'row_id')}, row_id) AS r FROM wide WHERE label = 0)
WHERE r <= (SELECT keep FROM goal)"""))
def benign_shrink_sample(spark, sf_dir):
    """Target rate above what the attacks can fill, so the benign side shrinks."""
    return sampling.target_rate_sample(V.wide_table(spark, sf_dir), ROW, 0.6, 46).select("row_id", "label")


@query("stratified_split", V.sql(V.WIDE, f"""SELECT row_id, label, CAST(r <= round_even(0.2::DOUBLE * n, 0) AS INT) AS in_test FROM (
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {ordered(47, 'row_id')}, row_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM wide)"""))
def stratified_split(spark, sf_dir):
    return sampling.split_lowest(V.wide_table(spark, sf_dir).select("row_id", "label"), ["label"], ROW, 47, 0.2)


@query("calibration_slice", V.sql(V.WIDE, f"""SELECT row_id, label FROM wide QUALIFY row_number() OVER (ORDER BY {ordered(48, 'row_id')}, row_id) <= 2000"""))
def calibration_slice(spark, sf_dir):
    return sampling.sample_n(V.wide_table(spark, sf_dir), ROW, 2000, 48).select("row_id", "label")


@query("calibration_rest", V.sql(V.WIDE, f"""SELECT technique, count(*) AS n FROM (
  SELECT technique, row_number() OVER (ORDER BY {ordered(48, 'row_id')}, row_id) AS r FROM wide) WHERE r > 2000 GROUP BY technique"""))
def calibration_rest(spark, sf_dir):
    """Evaluation rows = all rows minus the calibration slice."""
    wide = V.wide_table(spark, sf_dir)
    rest = wide.join(sampling.sample_n(wide, ROW, 2000, 48).select("row_id"), "row_id", "left_anti")
    return rest.groupBy("technique").agg(F.count(F.lit(1)).alias("n"))


# --- folds and splits -----------------------------------------------------------------------------------

FOLD_SQL = "CAST(('0x' || substr(md5(concat_ws('|', (42 + r.repeat)::VARCHAR, vector)), 1, 8))::BIGINT % 5 AS INT)"
FOLDS = VEC + f", folds AS (SELECT v.*, r.repeat, {FOLD_SQL} AS fold FROM vec v, (VALUES (0), (1), (2)) r(repeat))"


def folds(spark, sf_dir):
    return splits.hash_folds(vectors(spark, sf_dir), "vector", 5, 42, 3)


@query("fold_assign", V.sql(FOLDS, "SELECT row_id, vector, repeat, fold FROM folds"))
def fold_assign(spark, sf_dir):
    return folds(spark, sf_dir).select("row_id", "vector", "repeat", "fold")


@query("fold_assign_balanced", V.sql(VEC, """, groups AS (SELECT vector, count(*) AS n, sum(label) AS n1 FROM vec GROUP BY vector
), turns AS (SELECT vector, (row_number() OVER (PARTITION BY n1 * 2 > n ORDER BY n DESC, md5(concat_ws('|', '42', vector))) - 1) % 10 AS lap FROM groups)
SELECT row_id, CAST(CASE WHEN lap < 5 THEN lap ELSE 9 - lap END AS INT) AS fold FROM vec JOIN turns USING (vector)"""))
def fold_assign_balanced(spark, sf_dir):
    return splits.balanced_folds(vectors(spark, sf_dir), "vector", "label", 5, 42, ROW).select("row_id", "fold")


@query("group_shuffle_split", V.sql(VEC, f"SELECT row_id, CAST({V.hash_fraction_sql(0, 'vector')} < 0.8 AS INT) AS in_fit FROM vec"))
def group_shuffle_split(spark, sf_dir):
    return splits.group_split(vectors(spark, sf_dir), "vector", 0.8, 0).select("row_id", "in_fit")


@query("row_budget_split", V.sql(VEC, """, groups AS (SELECT vector, count(*) AS n FROM vec GROUP BY vector
), runs AS (SELECT vector, coalesce(sum(n) OVER (ORDER BY md5(concat_ws('|', '9', vector)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM groups)
SELECT row_id, CAST(before < (SELECT round_even(0.1::DOUBLE * count(*), 0) FROM vec) AS INT) AS in_calibration FROM vec JOIN runs USING (vector)"""))
def row_budget_split(spark, sf_dir):
    return splits.row_budget_split(vectors(spark, sf_dir), "vector", 0.1, 9, ROW).select("row_id", "in_calibration")


@query("fold_leak_check", V.sql(FOLDS, """SELECT repeat, count(*) AS n_groups, sum(CAST(nf > 1 AS INT))::BIGINT AS n_leaking
  FROM (SELECT repeat, vector, count(DISTINCT fold) AS nf FROM folds GROUP BY ALL) GROUP BY repeat"""))
def fold_leak_check(spark, sf_dir):
    return splits.fold_leaks(folds(spark, sf_dir), "vector", by=["repeat"])


@query("degenerate_folds", V.sql(FOLDS, """SELECT repeat, fold, count(*) AS n, sum(CAST(technique = 'T5' AS INT))::BIGINT AS n_pos,
  CAST(sum(CAST(technique = 'T5' AS INT)) IN (0, count(*)) AS INT) AS degenerate FROM folds GROUP BY repeat, fold"""))
def degenerate_folds(spark, sf_dir):
    rare = folds(spark, sf_dir).withColumn("label", (F.col("technique") == "T5").cast("int"))
    return splits.degenerate_folds(rare)


@query("class_weights", V.sql(V.WIDE, """SELECT label, count(*) AS n, round((SELECT count(*) FROM wide) / (2.0::DOUBLE * count(*)), 6) AS weight,
  round((SELECT count(*) FILTER (label = 0) / (count(*) FILTER (label = 1))::DOUBLE FROM wide), 6) AS neg_per_pos FROM wide GROUP BY label"""))
def class_weights(spark, sf_dir):
    w = splits.class_weights(V.wide_table(spark, sf_dir))
    return w.withColumns({"weight": F.round("weight", 6), "neg_per_pos": F.round("neg_per_pos", 6)})


# --- duplicate vectors ----------------------------------------------------------------------------------


@query("duplication", V.sql(VEC, """SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_vectors, sum(n - 1)::BIGINT AS n_duplicates, round(avg(n), 6) AS mean_copies,
  max(n) AS max_copies FROM (SELECT vector, count(*) AS n FROM vec GROUP BY vector)"""))
def duplication(spark, sf_dir):
    return duplicates.duplication(vectors(spark, sf_dir), "vector").withColumn("mean_copies", F.round("mean_copies", 6))


_GROUPS = VEC + """, groups AS (SELECT vector, count(*) AS n, count(*) FILTER (label = 0) AS n_benign, count(*) FILTER (label = 1) AS n_attack,
  CAST(count(DISTINCT label) > 1 AS INT) AS mixed FROM vec GROUP BY vector)"""


@query("mixed_groups", V.sql(_GROUPS, """SELECT count(*) AS n_groups, sum(mixed)::BIGINT AS n_mixed, sum(n * mixed)::BIGINT AS rows_in_mixed,
  round(sum(n * mixed) / sum(n)::DOUBLE, 6) AS share_in_mixed FROM groups"""))
def mixed_groups(spark, sf_dir):
    return duplicates.mixed_summary(vectors(spark, sf_dir), "vector").withColumn("share_in_mixed", F.round("share_in_mixed", 6))


@query("mixed_metadata", V.sql(_GROUPS, """, melted AS (SELECT vector, 'technique' AS "column", technique AS value FROM vec UNION ALL SELECT vector, 'proc_name', proc_name FROM vec),
distincts AS (SELECT vector, "column", value, row_number() OVER (PARTITION BY vector, "column" ORDER BY value) AS r FROM (SELECT DISTINCT * FROM melted))
SELECT g.vector, "column", n, n_benign, n_attack, count(*) AS n_distinct, string_agg(value, ',' ORDER BY value) FILTER (r <= 5) AS sample
FROM distincts d JOIN groups g ON g.vector = d.vector WHERE mixed = 1 GROUP BY ALL"""))
def mixed_metadata(spark, sf_dir):
    return duplicates.mixed_metadata(vectors(spark, sf_dir), "vector", ["technique", "proc_name"])


@query("mixed_rows", V.sql(_GROUPS, "SELECT row_id, mixed FROM vec JOIN groups USING (vector)"))
def mixed_rows(spark, sf_dir):
    return duplicates.mark_mixed(vectors(spark, sf_dir), "vector", ROW).select("row_id", "mixed")


@query("fold_composition", V.sql(FOLDS, """, big AS (SELECT vector, count(*) AS group_size, max(label) AS group_label FROM vec GROUP BY vector ORDER BY 2 DESC, 1 LIMIT 10)
SELECT f.vector, repeat, fold, count(*) AS n_in_fold, group_size, group_label, round(count(*) / group_size::DOUBLE, 6) AS share,
  CAST(group_size > 15 AND count(*) / group_size::DOUBLE > 0.9 AS INT) AS concentrated
FROM folds f JOIN big b ON f.vector = b.vector GROUP BY f.vector, repeat, fold, group_size, group_label"""))
def fold_composition(spark, sf_dir):
    return duplicates.fold_composition(folds(spark, sf_dir), "vector", 10, 15).withColumn("share", F.round("share", 6))


@query("mixed_exposure", V.sql(FOLDS, """SELECT repeat, fold, sum(n)::BIGINT AS n, sum(CASE WHEN m > 1 THEN n ELSE 0 END)::BIGINT AS n_mixed FROM (
  SELECT repeat, fold, vector, count(*) AS n, count(DISTINCT label) AS m FROM folds GROUP BY ALL) GROUP BY repeat, fold"""))
def mixed_exposure(spark, sf_dir):
    return duplicates.mixed_exposure(folds(spark, sf_dir), "vector")


# --- feature transforms ---------------------------------------------------------------------------------


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("log1p_impute", V.sql(V.WIDE, """SELECT row_id, round(ln(1 + greatest(CASE WHEN quantity > 40 THEN 0 ELSE quantity END, 0)), 6) AS quantity,
  round(ln(1 + price), 6) AS price, tax FROM wide"""))
def log1p_impute(spark, sf_dir):
    """Quantities above 40 play the missing and NaN values."""
    gaps = V.wide_table(spark, sf_dir).withColumn("quantity", F.when(F.col("quantity") > 45, None).when(F.col("quantity") > 40, float("nan"))
                                                  .otherwise(F.col("quantity")))
    out = clean.log1p_continuous(clean.impute(gaps, ["quantity", "price", "tax"]), ["quantity", "price", "tax"], ["tax"])
    return rounded(out, "quantity", "price").select("row_id", "quantity", "price", "tax")


@query("standard_scale", V.sql(V.WIDE, f""", fit AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(price) AS mp, stddev_pop(price) AS sp FROM wide
  WHERE {V.hash_fraction_sql(0, 'row_id')} < 0.8)
SELECT row_id, round((quantity - mq) / sq, 6) AS quantity, round((price - mp) / sp, 6) AS price FROM wide, fit WHERE {V.hash_fraction_sql(0, 'row_id')} >= 0.8"""))
def standard_scale(spark, sf_dir):
    both = splits.group_split(V.wide_table(spark, sf_dir), "row_id", 0.8, 0)
    out = clean.standard_scale(both.filter("in_fit = 1"), both.filter("in_fit = 0"), ["quantity", "price"])
    return rounded(out, "quantity", "price").select("row_id", "quantity", "price")


@query("availability_flag", V.sql(V.WIDE, """SELECT row_id, quantity, 0.0::DOUBLE AS is_suid_exec, 0.0::DOUBLE AS parent_child_rarity,
  0.0::DOUBLE AS features_available FROM wide"""))
def availability_flag(spark, sf_dir):
    out = clean.with_availability(V.wide_table(spark, sf_dir), ["quantity", "is_suid_exec", "parent_child_rarity"], False)
    return out.select("row_id", "quantity", "is_suid_exec", "parent_child_rarity", "features_available")


@query("masked_arms", V.sql(V.WIDE, f""", m AS (SELECT *, {V.hash_fraction_sql(42, 'row_id')} < 0.5 AS masked FROM wide)
SELECT 'A_full_info' AS arm, round(sum(discount), 4) AS discount, round(sum(tax), 4) AS tax, count(*) AS n, NULL::DOUBLE AS flagged FROM m
UNION ALL SELECT 'B_masked_no_flag', round(sum(CASE WHEN masked THEN 0 ELSE discount END), 4), round(sum(CASE WHEN masked THEN 0 ELSE tax END), 4), count(*), NULL FROM m
UNION ALL SELECT 'C_masked_with_flag', round(sum(CASE WHEN masked THEN 0 ELSE discount END), 4), round(sum(CASE WHEN masked THEN 0 ELSE tax END), 4), count(*),
  sum(CASE WHEN masked THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) FROM m"""))
def masked_arms(spark, sf_dir):
    wide = V.wide_table(spark, sf_dir)
    arms = clean.masked_arms(wide, ["discount", "tax"], hash_fraction(42, "row_id") < 0.5)
    out = None
    for name, df in arms.items():
        flagged = F.sum("features_available") if "features_available" in df.columns else F.lit(None).cast("double")
        part = df.agg(F.round(F.sum("discount"), 4).alias("discount"), F.round(F.sum("tax"), 4).alias("tax"), F.count(F.lit(1)).alias("n"),
                      flagged.alias("flagged")).withColumn("arm", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("relative_z", V.sql(V.WIDE, f""", fit AS (SELECT * FROM wide WHERE {V.hash_fraction_sql(0, 'row_id')} < 0.5
), overall AS (SELECT avg(quantity) AS gm, stddev_samp(quantity) AS gs FROM fit
), named AS (SELECT proc_name, avg(quantity) AS m, stddev_samp(quantity) AS s FROM fit GROUP BY proc_name HAVING count(*) >= 30)
SELECT row_id, round((quantity - coalesce(m, gm)) / coalesce(nullif(s, 0), gs), 6) AS quantity_relz
FROM wide LEFT JOIN named USING (proc_name), overall"""))
def relative_z(spark, sf_dir):
    wide = V.wide_table(spark, sf_dir)
    fit = splits.group_split(wide, "row_id", 0.5, 0).filter("in_fit = 1")
    out = clean.relative_z(fit, wide, ["quantity"], row_key=ROW, min_support=30)
    return rounded(out, "quantity_relz").select("row_id", "quantity_relz")


@query("minmax_from_train", V.sql(V.WIDE, """, fit AS (SELECT min(price) AS lo, max(price) AS hi FROM wide WHERE "year" < 1998)
SELECT row_id, round((price - lo) / (hi - lo + 1e-12::DOUBLE), 6) AS score FROM wide, fit WHERE "year" >= 1998"""))
def minmax_from_train(spark, sf_dir):
    wide = V.wide_table(spark, sf_dir)
    out = clean.minmax_from_train(wide.filter("year < 1998"), wide.filter("year >= 1998"), "price", "score")
    return rounded(out, "score").select("row_id", "score")


@query("shuffled_export", V.sql(V.WIDE, f"SELECT row_id, {ordered(42, 'row_id')} AS position FROM wide"))
def shuffled_export(spark, sf_dir):
    """Rows in seeded random order; a range-partitioned sort, needed for exports only."""
    return V.wide_table(spark, sf_dir).select("row_id", hash_hex(42, "row_id").alias("position")).orderBy("position", "row_id")
