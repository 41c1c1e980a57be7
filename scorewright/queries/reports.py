"""Summaries, statistics, error categories, agreement and streams over scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions.special import erfc_sql
from scorewright.functions.text import cost_usd
from scorewright.operators import report as P
from scorewright.operators import resample as B
from scorewright.operators import taxonomy as X
from scorewright.operators.match import match_distinct
from scorewright.plans.bridges import ANSWERS, GT, LEDGER, NUTRITION, RESPONSES, SCORES, rows, twin
from scorewright.plans.selection import unlabelled
from scorewright.queries import fields as Q
from scorewright.queries.registry import query
from scorewright.sources.tables import stored
from scorewright.streaming import chunks as C

R = Q.R
SCORED, LISTED, SCALARS = Q.SCORED, Q.LISTED, Q.SCALARS
# Scores under all prompt conditions, and under all perturbations of a fifth of the records.
CONDITIONS = """cond AS (SELECT image_id, model_key, condition, score FROM scores UNION ALL SELECT image_id, model_key, 'vi_one', round(score * 0.9, 6) FROM scores UNION ALL SELECT image_id, model_key, 'en_zero', round(score * 0.8, 6) FROM scores WHERE model_key <> 'click'),
worn AS (SELECT image_id, model_key, condition, score FROM scores UNION ALL
  SELECT image_id, model_key, concat(kind, '_s', CAST(s AS string)), round(score / (1 + s), 6) FROM scores CROSS JOIN (SELECT 'blur' AS kind UNION ALL SELECT 'glare' UNION ALL SELECT 'rotation') k CROSS JOIN (SELECT 1 AS s UNION ALL SELECT 2 UNION ALL SELECT 3) l WHERE CAST(image_id AS bigint) % 5 = 0)"""
CORRECT = "paired AS (SELECT image_id, model_key, CAST(correct AS INT) AS correct, CASE WHEN CAST(image_id AS bigint) % 10 = 0 THEN 'small' ELSE 'large' END AS field FROM scores)"


@query(twin("SELECT model_key, condition, field, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(DISTINCT image_id) AS n_images FROM field_scores GROUP BY ALL", *SCORED))
def g1_model_field_summary(spark, sf_dir):
    d = P.model_field_summary(Q.field_scores(spark, sf_dir))
    return d.select("model_key", "condition", "field", R("precision").alias("precision"), R("recall").alias("recall"), R("f1").alias("f1"), "n_images")


VALID = f"valid AS (SELECT i.*, r.content IS NOT NULL AND {Q.STAGE} <> 'failed' AS json_valid FROM image_scores i JOIN responses r ON i.image_id = r.image_id AND i.model_key = r.model_key)"


def valid(spark, sf_dir):
    from scorewright.operators.parse import parse

    read = parse(rows(spark, sf_dir, "responses", ANSWERS, RESPONSES)).select("image_id", "model_key", (F.col("content").isNotNull() & ~F.col("parse_failed")).alias("json_valid"))
    return Q.image_scores(spark, sf_dir).join(read, ["image_id", "model_key"])


@query(twin("SELECT model_key, condition, round(avg(macro_field_f1), 6) AS macro_field_f1, round(avg(macro_field_f1_strict), 6) AS macro_field_f1_strict, avg(pairing_accuracy) AS pairing_accuracy, round(avg(json_valid::INT), 6) AS json_validity, count(DISTINCT image_id) AS n_images FROM valid GROUP BY ALL", *SCORED, RESPONSES, VALID))
def g2_model_summary(spark, sf_dir):
    d = P.model_summary(valid(spark, sf_dir))
    return d.select("model_key", "condition", R("macro_field_f1").alias("macro_field_f1"), R("macro_field_f1_strict").alias("macro_field_f1_strict"), "pairing_accuracy", R("json_validity").alias("json_validity"), "n_images")


@query(twin("SELECT l_orderkey % 4 AS model, round(avg(n_correct / n), 6) AS value_accuracy, round(avg(1 - n_errors / n), 6) AS pairing_accuracy FROM nut GROUP BY ALL", NUTRITION, Q.NUTRITION_SCORED))
def g3_nutrition_summary(spark, sf_dir):
    d = Q.nutrition(spark, sf_dir).groupBy((F.col("l_orderkey") % 4).alias("model"))
    return d.agg(R(F.avg("value_accuracy")).alias("value_accuracy"), R(F.avg("pairing_accuracy")).alias("pairing_accuracy"))


@query(twin("SELECT model_key, round(z, 6) AS vi_zero, round(o, 6) AS vi_one, round(e, 6) AS en_zero, round(o - z, 6) AS shot_effect, round(e - z, 6) AS language_effect FROM (SELECT model_key, avg(score) FILTER (WHERE condition = 'vi_zero') AS z, avg(score) FILTER (WHERE condition = 'vi_one') AS o, avg(score) FILTER (WHERE condition = 'en_zero') AS e FROM cond GROUP BY ALL) WHERE z IS NOT NULL AND o IS NOT NULL AND e IS NOT NULL", SCORES, CONDITIONS))
def g4_prompt_effects(spark, sf_dir):
    d = P.prompt_effects(rows(spark, sf_dir, "cond", SCORES, CONDITIONS))
    return d.select("model_key", *(R(c).alias(c) for c in ("vi_zero", "vi_one", "en_zero", "shot_effect", "language_effect")))


@query(twin("SELECT kind, model_key, severity, round(avg(score), 4) AS mean, count(DISTINCT image_id) AS n_images FROM (SELECT regexp_extract(condition, '^(\\w+)_s(\\d)', 1) AS kind, model_key, regexp_extract(condition, '^(\\w+)_s(\\d)', 2)::INT AS severity, score, image_id FROM worn WHERE regexp_matches(condition, '_s\\d') UNION ALL SELECT k.kind, model_key, 0, score, image_id FROM worn, (SELECT unnest(['blur', 'glare', 'rotation']) AS kind) k WHERE condition = 'vi_zero' AND CAST(image_id AS bigint) % 5 = 0) GROUP BY ALL", SCORES, CONDITIONS))
def g5_degradation_curve(spark, sf_dir):
    d = P.degradation_curve(rows(spark, sf_dir, "worn", SCORES, CONDITIONS))
    return d.select("kind", "model_key", "severity", F.round("mean", 4).alias("mean"), "n_images")


CATEGORY = """errors AS (SELECT *, CASE WHEN diacritic_only THEN 'diacritics' WHEN trim(pred) = '' AND trim(truth) <> '' THEN 'missing_field' WHEN trim(truth) = '' AND trim(pred) <> '' THEN 'hallucination'
  WHEN field = 'net_weight' AND abs(pn - gn) <= greatest(0.05 * abs(gn), 0.05) AND pu IS DISTINCT FROM gu THEN 'wrong_unit' WHEN trim(truth) <> '' AND similarity < 20 THEN 'hallucination' ELSE 'wrong_value' END AS category FROM scalars WHERE NOT lenient)"""


def errors(spark, sf_dir):
    return X.incorrect_scalars(Q.scalars(spark, sf_dir, then=_categorised))


def counted_errors(spark, sf_dir):
    """errors() without ids: each different (model_key, field, pred, truth) once, with the number n of such rows. Answers
    meet their truth once, in the count, and only what is counted is matched."""
    d = Q.scalar_rows(spark, sf_dir).groupBy("model_key", "field", "pred", "truth").agg(F.count("*").alias("n"))
    return X.incorrect_scalars(match_distinct(stored(spark, d, "counted"), then=_categorised))


def _categorised(d):
    """Categories of different (field, pred, truth), of which those that are no errors have none."""
    category = X.scalar_category(*map(F.col, ("field", "pred", "truth", "similarity", "diacritic_only")))
    return d.withColumn("category", F.when(~F.col("lenient"), category))


@query(twin("SELECT model_key, category, n, round(n / sum(n) OVER (PARTITION BY model_key), 6) AS share FROM (SELECT model_key, category, count(*) AS n FROM errors GROUP BY ALL)", *SCALARS, CATEGORY))
def g6_taxonomy_crosstab(spark, sf_dir):
    return P.crosstab(counted_errors(spark, sf_dir), "n").select("model_key", "category", "n", R("share").alias("share"))


def ledger(spark, sf_dir):
    return rows(spark, sf_dir, "ledger", LEDGER).withColumn("cost_usd", cost_usd("input_tokens", "output_tokens", "price_in", "price_out"))


COST = "cost AS (SELECT model_key, sum(input_tokens / 1e6 * price_in + output_tokens / 1e6 * price_out) AS cost_usd FROM ledger GROUP BY ALL)"


@query(twin("SELECT model_key, round(cost_usd, 4) AS cost_usd FROM cost", LEDGER, COST))
def g7_cost_by_model(spark, sf_dir):
    return P.cost_by_model(ledger(spark, sf_dir)).select("model_key", F.round("cost_usd", 4).alias("cost_usd"))


RATED = "rated AS (SELECT concat(l_returnflag, l_linestatus) AS model_key, round(avg(l_discount), 6) AS macro_field_f1 FROM lineitem GROUP BY ALL UNION ALL SELECT 'free', 0.5 FROM region WHERE r_regionkey = 0)"


@query(twin("SELECT r.model_key, round(macro_field_f1, 4) AS macro_field_f1, round(coalesce(cost_usd, 0.0), 2) AS cost_usd FROM rated r LEFT JOIN cost c ON r.model_key = c.model_key", LEDGER, COST, RATED))
def g8_cost_effectiveness(spark, sf_dir):
    d = P.cost_effectiveness(rows(spark, sf_dir, "rated", RATED), P.cost_by_model(ledger(spark, sf_dir)))
    return d.select("model_key", F.round("macro_field_f1", 4).alias("macro_field_f1"), "cost_usd")


@query(twin("SELECT model_key, round(avg(score), 6) AS macro, CAST(rank() OVER (ORDER BY avg(score) DESC) AS INT) AS place FROM scores GROUP BY model_key", SCORES))
def g9_leaderboard(spark, sf_dir):
    from pyspark.sql import Window

    means = rows(spark, sf_dir, "scores", SCORES).groupBy("model_key").agg(F.avg("score").alias("m"))  # one row per model
    return means.select("model_key", R("m").alias("macro"), F.rank().over(Window.orderBy(F.desc("m"))).alias("place"))


@query(twin("SELECT model_key, " + ", ".join(f"round(avg(f1) FILTER (WHERE field = '{f}'), 6) AS {f}" for f in P.FIELDS) + " FROM field_scores GROUP BY model_key", *SCORED))
def g10_field_matrix(spark, sf_dir):
    d = Q.field_scores(spark, sf_dir).groupBy("model_key").pivot("field", list(P.FIELDS)).agg(F.avg("f1"))
    return d.select("model_key", *(R(f).alias(f) for f in P.FIELDS)).orderBy("model_key")


@query(twin("SELECT round(avg(macro_field_f1), 6) AS lenient, round(avg(macro_field_f1_strict), 6) AS strict, avg(pairing_accuracy) AS pairing FROM image_scores WHERE model_key = 'm1' AND CAST(image_id AS bigint) % 7 = 0", *SCORED))
def g11_paired_agreement(spark, sf_dir):
    d = Q.image_scores(spark, sf_dir).where("model_key = 'm1' AND CAST(image_id AS bigint) % 7 = 0")
    return d.agg(R(F.avg("macro_field_f1")).alias("lenient"), R(F.avg("macro_field_f1_strict")).alias("strict"), F.avg("pairing_accuracy").alias("pairing"))


@query(twin("SELECT field, model_key, count(*) FILTER (WHERE f1 >= 0.999) AS n_exact, count(*) AS n FROM field_scores GROUP BY ALL", *SCORED))
def g12_exact_match(spark, sf_dir):
    return Q.field_scores(spark, sf_dir).groupBy("field", "model_key").agg(F.count_if(P.exact("f1")).alias("n_exact"), F.count("*").alias("n"))


@query(twin("SELECT count(*) AS n, count(*) FILTER (WHERE category = 'hallucination') AS n_low_confidence FROM errors", *SCALARS, CATEGORY))
def g13_low_confidence(spark, sf_dir):
    return errors(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(X.low_confidence("category")).alias("n_low_confidence"))


UNIFORM = "('0x' || substr(md5('42#' || b || '#' || k), 1, 13))::UBIGINT / 4503599627370496.0"
BOOT = f"""ranked AS (SELECT model_key, condition, score, row_number() OVER (PARTITION BY model_key, condition ORDER BY image_id) - 1 AS k FROM scores),
sizes AS (SELECT model_key, condition, count(*) AS n, avg(score) AS mean FROM scores GROUP BY ALL),
draws AS (SELECT model_key, condition, b, floor({UNIFORM} * n)::BIGINT AS k FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, unnest(range(0, 100)) AS b FROM sizes))),
means AS (SELECT d.model_key, d.condition, b, avg(score) AS m FROM draws d JOIN ranked r ON d.model_key = r.model_key AND d.condition = r.condition AND d.k = r.k GROUP BY ALL),
ci AS (SELECT model_key, condition, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY ALL)"""


@query(twin("SELECT s.model_key, s.condition, n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM sizes s JOIN ci c ON s.model_key = c.model_key AND s.condition = c.condition", SCORES, BOOT))
def h1_bootstrap_ci(spark, sf_dir):
    d = P.bootstrap(rows(spark, sf_dir, "scores", SCORES), ["model_key", "condition"], "image_id", "score", resamples=100)
    return d.select("model_key", "condition", "n", R("mean").alias("mean"), R("lo").alias("lo"), R("hi").alias("hi"))


@query()
def h2_bootstrap_draws(spark, sf_dir):
    return B.bootstrap_parity(rows(spark, sf_dir, "scores", SCORES), ["model_key", "condition"], "image_id", "score", resamples=10_000)


@query(twin("SELECT s.model_key, s.condition, n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM sizes s JOIN ci c ON s.model_key = c.model_key AND s.condition = c.condition", *SCORED, B.histogram_sql("image_scores", "model_key, condition", "macro_field_f1")))
def h1_histogram_bootstrap(spark, sf_dir):
    """10,000 resamples, drawn for each distinct value of a group instead of each row."""
    d = B.histogram_bootstrap(Q.image_scores(spark, sf_dir), ["model_key", "condition"], "macro_field_f1")
    return d.select("model_key", "condition", "n", R("mean").alias("mean"), R("lo").alias("lo"), R("hi").alias("hi"))


@query(twin("SELECT s.model_key, rank() OVER (ORDER BY round(mean, 9) DESC)::INT AS place, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM sizes s JOIN ci c ON s.model_key = c.model_key", *SCORED, B.histogram_sql("image_scores", "model_key", "macro_field_f1")))
def g9_leaderboard_ranked(spark, sf_dir):
    """Models by their mean with an interval of 10,000 resamples."""
    d = B.ranked_intervals(Q.image_scores(spark, sf_dir))
    return d.select("model_key", "place", R("mean").alias("mean"), R("lo").alias("lo"), R("hi").alias("hi"))


MCNEMAR = """tab AS (SELECT a.field, a.model_key AS group_a, b.model_key AS group_b, count(*) AS n, count(*) FILTER (WHERE a.correct = 1 AND b.correct = 0) AS a_only, count(*) FILTER (WHERE a.correct = 0 AND b.correct = 1) AS b_only,
  count(*) FILTER (WHERE a.correct = 1 AND b.correct = 1) AS both_correct, count(*) FILTER (WHERE a.correct = 0 AND b.correct = 0) AS both_wrong
  FROM paired a JOIN paired b ON a.image_id = b.image_id AND a.field = b.field AND a.model_key < b.model_key GROUP BY ALL)"""


def tested(spark, sf_dir):
    return P.mcnemar_table(rows(spark, sf_dir, "paired", SCORES, CORRECT), ["field"])


@query(twin("SELECT * FROM tab", SCORES, CORRECT, MCNEMAR))
def h3_mcnemar_table(spark, sf_dir):
    return tested(spark, sf_dir)


BINOMIAL = "list_sum(list_transform(range(0, least(a_only, b_only) + 1), lambda k: exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) - m * ln(2.0))))"
EXACT = f"ex AS (SELECT field, group_a, group_b, a_only, b_only, least(1.0, 2 * {BINOMIAL}) AS p_value FROM (SELECT *, a_only + b_only AS m FROM tab WHERE a_only + b_only < 25))"


@query(twin("SELECT field, group_a, group_b, a_only, b_only, round(p_value, 6) AS p_value FROM ex", SCORES, CORRECT, MCNEMAR, EXACT))
def h4_mcnemar_exact(spark, sf_dir):
    return P.mcnemar_test(tested(spark, sf_dir)).where("exact").select("field", "group_a", "group_b", "a_only", "b_only", R("p_value").alias("p_value"))


@query(twin("SELECT field, group_a, group_b, round(max(least(1.0, (m - r + 1) * p)) OVER (PARTITION BY field ORDER BY r), 6) AS p_holm, max(least(1.0, (m - r + 1) * p)) OVER (PARTITION BY field ORDER BY r) < 0.05 AS significant FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY p, group_a, group_b) AS r, count(*) OVER (PARTITION BY field) AS m FROM (SELECT field, group_a, group_b, round(p_value, 9) AS p FROM ex))", SCORES, CORRECT, MCNEMAR, EXACT))
def h5_holm(spark, sf_dir):
    tests = P.mcnemar_test(tested(spark, sf_dir)).where("exact").select("field", "group_a", "group_b", F.round("p_value", 9).alias("p_value"))
    return P.holm(tests, ["field"]).select("field", "group_a", "group_b", R("p_holm").alias("p_holm"), "significant")


def _all(tab: str) -> str:
    """Every test of a table of pairs: exact under 25 discordant pairs, else by the tail of chi-square."""
    return f"""tests AS (SELECT field, group_a, group_b, a_only, b_only, a_only + b_only < 25 AS exact, CASE WHEN a_only + b_only < 25 THEN least(1.0, 2 * {BINOMIAL}) ELSE {erfc_sql("r")} END AS p
  FROM (SELECT *, a_only + b_only AS m, sqrt(power(abs(a_only - b_only) - 1, 2) / greatest(a_only + b_only, 1) / 2.0) AS r FROM {tab})),
holm AS (SELECT *, max(q) OVER (PARTITION BY field ORDER BY k) AS p_holm FROM (SELECT *, least(1.0, (count(*) OVER (PARTITION BY field) - k + 1) * round(p, 12)) AS q FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY round(p, 12), group_a, group_b) AS k FROM tests)))"""


def _stepped(tests):
    return P.holm(tests.withColumn("p_value", F.round("p_value", 12)), ["field"])


@query(twin("SELECT field, group_a, group_b, exact, round(p, 9) AS p_value FROM tests", SCORES, CORRECT, MCNEMAR, _all("tab")))
def h4_mcnemar_all(spark, sf_dir):
    """Every pair of models in every stratum, whatever the number of discordant pairs."""
    return P.mcnemar_test(tested(spark, sf_dir)).select("field", "group_a", "group_b", "exact", F.round("p_value", 9).alias("p_value"))


@query(twin("SELECT field, group_a, group_b, exact, round(p_holm, 9) AS p_holm, p_holm < 0.05 AS significant FROM holm", SCORES, CORRECT, MCNEMAR, _all("tab")))
def h5_holm_all(spark, sf_dir):
    return _stepped(P.mcnemar_test(tested(spark, sf_dir))).select("field", "group_a", "group_b", "exact", F.round("p_holm", 9).alias("p_holm"), "significant")


@query()
def h8_holm_all(spark, sf_dir):
    """Stepped down over every test of a stratum, exact or not; the twins of h4 and h5 hold exact tests only."""
    return P.holm(P.mcnemar_test(tested(spark, sf_dir)), ["field"]).select("field", "group_a", "group_b", "exact", "p_value", "p_holm", "significant")


@query(twin("SELECT field, group_a, group_b, a_only, b_only, exact, round(p, 9) AS p_value, round(p_holm, 9) AS p_holm, p_holm < 0.05 AS significant FROM holm", *SCORED, "paired AS (SELECT image_id, model_key, field, (f1 >= 0.999)::INT AS correct FROM field_scores)", MCNEMAR, _all("tab")))
def h6_mcnemar_of_fields(spark, sf_dir):
    """Exact matches of each field between models, all tests of a field stepped down together."""
    binary = Q.field_scores(spark, sf_dir, whole_ids=True).select("image_id", "model_key", "field", P.exact("f1").alias("correct"))
    d = _stepped(P.mcnemar_test(P.mcnemar_table(binary, ["field"])))
    return d.select("field", "group_a", "group_b", "a_only", "b_only", "exact", F.round("p_value", 9).alias("p_value"), F.round("p_holm", 9).alias("p_holm"), "significant")


@query()
def h6_mcnemar_by_field(spark, sf_dir):
    """Per field: exact matches of the scored tables, paired tests between models, stepped down within the field."""
    binary = Q.field_scores(spark, sf_dir, whole_ids=True).select("image_id", "model_key", "field", P.exact("f1").alias("correct"))
    return P.holm(P.mcnemar_test(P.mcnemar_table(binary, ["field"])), ["field"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def h7_duplicate_guard(spark, sf_dir):
    return P.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query(twin("SELECT image_id, model_key, field, round(similarity / 100, 6) AS score FROM scalars WHERE NOT lenient", *SCALARS))
def i1_incorrect_fields(spark, sf_dir):
    return X.incorrect_scalars(Q.scalars(spark, sf_dir)).select("image_id", "model_key", "field", R("score").alias("score"))


@query(twin(f"SELECT e.image_id, e.model_key, field, CASE WHEN {Q.STAGE} = 'failed' THEN 'malformed_json' WHEN finish_reason = 'length' THEN 'output_truncated' ELSE category END AS category FROM errors e JOIN responses r ON e.image_id = r.image_id AND e.model_key = r.model_key", *SCALARS, CATEGORY, RESPONSES))
def i2_classify(spark, sf_dir):
    from scorewright.operators.parse import structural_issues

    read = structural_issues(Q.coerced(spark, sf_dir)).select("image_id", "model_key", "json_valid", "structural_issues")
    d = errors(spark, sf_dir).join(read, ["image_id", "model_key"])
    none = F.lit(None).cast("string")
    return d.select("image_id", "model_key", "field", X.classify(F.col("json_valid"), F.col("structural_issues"), F.lit("scalar"), F.col("category"), none, none).alias("category"))


@query(twin("SELECT image_id, model_key, field, category FROM errors", *SCALARS, CATEGORY))
def i3_scalar_categories(spark, sf_dir):
    return errors(spark, sf_dir).select("image_id", "model_key", "field", "category")


@query(twin("SELECT image_id, model_key, CASE WHEN n_pred = 0 AND n_truth > 0 THEN 'missing_field' WHEN n_truth = 0 AND n_pred > 0 THEN 'hallucination' WHEN precision < recall THEN 'hallucination' ELSE 'wrong_value' END AS category FROM listed WHERE f1 < 1", *LISTED))
def i4_list_categories(spark, sf_dir):
    d = Q.listed(spark, sf_dir).where("f1 < 1")
    return d.select("image_id", "model_key", X.list_category(F.lit("ingredient"), *map(F.col, ("n_pred", "n_truth", "precision", "recall"))).alias("category"))


@query(twin("SELECT l_orderkey, CASE WHEN n_errors > 0 THEN 'pairing_error' ELSE 'wrong_value' END AS category FROM nut WHERE n_correct < n", NUTRITION, Q.NUTRITION_SCORED))
def i5_nutrition_categories(spark, sf_dir):
    d = Q.nutrition(spark, sf_dir).where("name_f1 < 1 OR pairing_accuracy < 1 OR value_accuracy < 1")
    return d.select("l_orderkey", X.nutrition_category(*map(F.col, ("n_pred", "n_truth", "pairing_accuracy", "value_accuracy", "name_precision", "name_recall"))).alias("category"))


@query(twin("SELECT category, category = 'hallucination' AS low_confidence, count(*) AS n FROM errors GROUP BY ALL", *SCALARS, CATEGORY))
def i6_low_confidence(spark, sf_dir):
    return counted_errors(spark, sf_dir).withColumn("low_confidence", X.low_confidence("category")).groupBy("category", "low_confidence").agg(F.sum("n").alias("n"))


@query(twin("SELECT image_id, model_key, field, category FROM errors ORDER BY md5('42#' || model_key || '#' || image_id || '#' || field), model_key, image_id, field LIMIT 300", *SCALARS, CATEGORY))
def i7_error_sample(spark, sf_dir):
    d = P.hash_sample(errors(spark, sf_dir), 300, 42, "model_key", "image_id", "field")
    return d.orderBy("model_key", "image_id", "field").select("image_id", "model_key", "field", "category")


def control(spark, sf_dir):
    """A second annotation of some records, and of some that the first doesn't have."""
    d = rows(spark, sf_dir, "answers", ANSWERS).where("model_key = 'm1' AND p_partkey % 7 = 0").withColumn("model_key", F.lit("control_annotator")).withColumn("condition", F.lit("agreement"))
    return d.withColumn("image_id", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("x"), F.col("image_id"))).otherwise(F.col("image_id")))


@query(twin("SELECT image_id, field, lenient, strict FROM scalars WHERE model_key = 'm1' AND CAST(image_id AS bigint) % 7 = 0 AND CAST(image_id AS bigint) % 5 > 0", *SCALARS))
def j1_label_agreement(spark, sf_dir):
    from scorewright.operators import match, score

    d = match.match_scalars(score.scalar_rows(control(spark, sf_dir), rows(spark, sf_dir, "gt", GT)))
    return d.select("image_id", "field", "lenient", "strict")


@query("SELECT 'x' || lpad(p_partkey::VARCHAR, 6, '0') AS image_id FROM part WHERE p_partkey % 35 = 0")
def j2_control_without_primary(spark, sf_dir):
    return unlabelled(control(spark, sf_dir), rows(spark, sf_dir, "gt", GT)).select("image_id")


@query(twin("SELECT image_id, list_sort(list_intersect(string_split(product_name, ' '), string_split(lower(p_type), ' '))) AS shared FROM gt WHERE list_has_any(string_split(product_name, ' '), string_split(lower(p_type), ' '))", GT))
def j3_label_conflicts(spark, sf_dir):
    d = rows(spark, sf_dir, "gt", GT).select("image_id", F.split("product_name", " ").alias("ingredient"), F.split(F.lower("p_type"), " ").alias("additive"))
    return X.label_conflicts(d)


@query(twin("SELECT image_id FROM gt WHERE p_partkey % 9 = 0 OR expiry_date <> '' AND p_partkey % 4 = 0", GT))
def j4_dates_in_warnings(spark, sf_dir):
    said = F.expr("CASE WHEN p_partkey % 9 = 0 THEN array('Keep dry.', mfg_date) WHEN p_partkey % 4 = 0 THEN array('see \"best before\" on pack') ELSE array('Keep dry.') END")
    return X.dates_in_warnings(rows(spark, sf_dir, "gt", GT).withColumn("warning", said))


CHUNKS = """chunks AS (SELECT CAST(conv_id AS string) AS response_id, CAST(turn AS bigint) AS seq, CASE WHEN conv_id % 3 = 0 AND turn = 2 THEN repeat(concat('unit ', CAST(conv_id AS string), ' again; '), 6) ELSE text END AS delta,
  CASE WHEN role = 'assistant' THEN 'stop' END AS finish_reason, CAST(10 + turn AS bigint) AS prompt_tokens, CAST(CASE WHEN turn = 1 AND conv_id % 2 = 0 THEN 7 END AS bigint) AS completion_tokens, conv_id, turn FROM conversations)"""


def chunks(spark, sf_dir):
    return rows(spark, sf_dir, "chunks", CHUNKS).drop("conv_id", "turn")


@query(twin("SELECT response_id, md5(string_agg(delta, '' ORDER BY seq)) AS content, arg_max(finish_reason, seq) FILTER (WHERE finish_reason IS NOT NULL) AS finish_reason, coalesce(arg_max(completion_tokens, seq) FILTER (WHERE completion_tokens IS NOT NULL), count(*) FILTER (WHERE delta <> '')) AS output_tokens FROM chunks GROUP BY response_id", CHUNKS))
def k1_assemble_stream(spark, sf_dir):
    d = C.assemble(chunks(spark, sf_dir), guard=False)
    return d.select("response_id", F.md5(F.encode("content", "utf-8")).alias("content"), "finish_reason", "output_tokens")


@query(twin("""SELECT response_id, md5(string_agg(delta, '' ORDER BY seq) FILTER (WHERE stop IS NULL OR seq <= stop)) AS content, CASE WHEN max(stop) IS NOT NULL THEN 'loop_cutoff' ELSE arg_max(finish_reason, seq) FILTER (WHERE finish_reason IS NOT NULL) END AS finish_reason
FROM (SELECT *, min(CASE WHEN looped THEN seq END) OVER (PARTITION BY response_id) AS stop FROM
  (SELECT *, coalesce(list_bool_or(list_transform(range(8, least(200, length(tail) // 5) + 1), lambda p: right(tail, (5 * p)::INT) = repeat(right(tail, p::INT), 5))), false) AS looped FROM
    (SELECT *, right(string_agg(delta, '') OVER (PARTITION BY response_id ORDER BY seq), 800) AS tail FROM chunks))) GROUP BY response_id""", CHUNKS))
def k2_loop_guard(spark, sf_dir):
    return C.assemble(chunks(spark, sf_dir)).select("response_id", F.md5(F.encode("content", "utf-8")).alias("content"), "finish_reason")


@query(twin("SELECT image_id, model_key, condition, content IS NOT NULL AND v <> 11 AS json_valid FROM responses WHERE error IS NULL", ANSWERS, RESPONSES))
def k3_score_incrementally(spark, sf_dir):
    """Answers that arrive in files are scored by a stream and upserted; failed ones come a second time and stay out."""
    from scorewright.operators.parse import parse
    from scorewright.sources import versioned
    from scorewright.sources.tables import scratch

    d = rows(spark, sf_dir, "responses", ANSWERS, RESPONSES).select("image_id", "model_key", "condition", "content", "error")
    source, path, keys = scratch(spark, "arriving"), scratch(spark, "scores"), ["image_id", "model_key", "condition"]
    for part in ("model_key = 'm0'", "model_key <> 'm0'"):
        d.where(part).write.mode("append").parquet(source)
    score = lambda batch: parse(batch.where("error IS NULL")).select(*keys, (F.col("content").isNotNull() & ~F.col("parse_failed")).alias("json_valid"))
    stream = spark.readStream.schema(d.schema).parquet(source)
    C.score_incrementally(stream, score, path, scratch(spark, "progress"), keys).awaitTermination()
    return versioned.read(spark, path).select(*keys, "json_valid")


@query(twin("SELECT model_key, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(input_tokens / 1e6 * price_in + output_tokens / 1e6 * price_out), 4) AS cost_usd FROM ledger GROUP BY model_key", LEDGER))
def k4_running_spend(spark, sf_dir):
    d = C.running_spend(ledger(spark, sf_dir))
    return d.select("model_key", "input_tokens", "output_tokens", F.round("cost_usd", 4).alias("cost_usd"))


def _timed(d):
    """Chunks with the time at which they came, a second apart."""
    return d.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))


def _arriving(d, files: int):
    """The rows of d in several files of a new folder, and their schema."""
    from scorewright.sources.tables import scratch

    path = scratch(d.sparkSession, "arriving")
    d.repartition(files).write.parquet(path)
    return path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema)


K1_SQL = "SELECT response_id, md5(string_agg(delta, '' ORDER BY seq)) AS content, arg_max(finish_reason, seq) FILTER (WHERE finish_reason IS NOT NULL) AS finish_reason, coalesce(arg_max(completion_tokens, seq) FILTER (WHERE completion_tokens IS NOT NULL), count(*) FILTER (WHERE delta <> '')) AS output_tokens FROM chunks GROUP BY response_id"


@query(twin(K1_SQL, CHUNKS))
def k1_assemble_streamed(spark, sf_dir):
    """Chunks that arrive in files, in any order, through the stateful stream."""
    d = C.assemble_files(*_arriving(_timed(chunks(spark, sf_dir)), 3), guard=False)
    return d.select("response_id", F.md5(F.encode("content", "utf-8")).alias("content"), "finish_reason", "output_tokens")


@query(twin("""SELECT response_id, md5(string_agg(delta, '' ORDER BY seq) FILTER (WHERE stop IS NULL OR seq <= stop)) AS content, CASE WHEN max(stop) IS NOT NULL THEN 'loop_cutoff' ELSE arg_max(finish_reason, seq) FILTER (WHERE finish_reason IS NOT NULL) END AS finish_reason
FROM (SELECT *, min(CASE WHEN looped THEN seq END) OVER (PARTITION BY response_id) AS stop FROM
  (SELECT *, coalesce(list_bool_or(list_transform(range(8, least(200, length(tail) // 5) + 1), lambda p: right(tail, (5 * p)::INT) = repeat(right(tail, p::INT), 5))), false) AS looped FROM
    (SELECT *, right(string_agg(delta, '') OVER (PARTITION BY response_id ORDER BY seq), 800) AS tail FROM chunks))) GROUP BY response_id""", CHUNKS))
def k2_loop_guard_streamed(spark, sf_dir):
    d = C.assemble_files(*_arriving(_timed(chunks(spark, sf_dir)), 3))
    return d.select("response_id", F.md5(F.encode("content", "utf-8")).alias("content"), "finish_reason")


@query(twin("SELECT model_key, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(input_tokens / 1e6 * price_in + output_tokens / 1e6 * price_out), 2) AS cost_usd FROM ledger GROUP BY model_key", LEDGER))
def k4_spend_streamed(spark, sf_dir):
    """Totals by model as ledger files land."""
    d = C.spend_of_files(spark, *_arriving(ledger(spark, sf_dir).select("model_key", "input_tokens", "output_tokens", "cost_usd"), 4))
    return d.select("model_key", "input_tokens", "output_tokens", F.round("cost_usd", 2).alias("cost_usd"))

