"""Whole records: raw answers read, coerced and scored in all nine fields, and what is reported on them."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from scorewright.operators import report as P
from scorewright.operators import score as S
from scorewright.operators import taxonomy as X
from scorewright.operators.match import match_lists, match_nutrition, once_each
from scorewright.plans.bridges import ANSWERS, GT, rows
from scorewright.plans.selection import unlabelled
from scorewright.queries import duck as D
from scorewright.queries.registry import query
from scorewright.sources.tables import stored

R = lambda c: F.round(c, 6)
KEYS = ["image_id", "model_key", "condition"]

# LIST[...] and <<name|value>> stand for the engines' arrays and structs.
FOOD = """food AS (SELECT g.*, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, lower(t) AS w3, p_size FROM (
  SELECT gt.product_name, gt.origin, gt.net_weight, gt.mfg_date, gt.expiry_date, gt.image_id, gt.p_partkey, part.p_name, part.p_type AS t, part.p_size FROM gt JOIN part ON gt.p_partkey = part.p_partkey) g)"""
TRUTH = """truth AS (SELECT image_id, p_partkey, product_name, origin, net_weight, mfg_date, expiry_date, LIST[w1, w2, w3] AS ingredient,
  LIST['Lecithin', concat('E', CAST(100 + p_partkey % 50 AS string))] AS additive,
  CASE WHEN p_partkey % 4 = 0 THEN LIST['Keep dry.', 'Keep cool and dark.'] ELSE LIST['Keep dry.'] END AS warning,
  CASE WHEN p_partkey % 6 = 5 THEN NOPAIRS ELSE LIST[<<'Năng lượng'|concat(CAST(p_size * 10 AS string), ' kcal')>>, <<'Chất béo'|concat(CAST(p_size + 1 AS string), ' g')>>, <<'Natri'|concat(CAST(p_size + 100 AS string), ' mg')>>] END AS nutrition
  FROM food)"""
SAID = """said AS (SELECT a.image_id, a.model_key, a.condition, a.v, a.p_partkey, a.product_name, a.origin, a.net_weight, a.mfg_date, a.expiry_date,
  CASE v WHEN 1 THEN LIST[w3, w2, w1] WHEN 2 THEN LIST[w2, w1] WHEN 3 THEN NONE WHEN 4 THEN LIST[w1, w2, w3, 'sugar'] WHEN 5 THEN LIST[concat(w1, 'x'), w2, w3] ELSE LIST[w1, w2, w3] END AS ingredient,
  CASE v WHEN 6 THEN LIST['Lecithin'] WHEN 7 THEN LIST['lecithin.', 'E999'] WHEN 8 THEN NONE ELSE LIST['Lecithin', concat('E', CAST(100 + a.p_partkey % 50 AS string))] END AS additive,
  CASE WHEN v IN (4, 9) AND a.p_partkey % 4 = 0 THEN LIST['Keep dry. Keep cool and dark.'] WHEN v = 10 THEN LIST['Store cold'] WHEN v = 0 THEN LIST['Keep dry.', 'Keep cool and dark.']
       WHEN a.p_partkey % 4 = 0 THEN LIST['Keep dry.', 'Keep cool and dark.'] ELSE LIST['Keep dry.'] END AS warning,
  CASE WHEN v = 8 OR a.p_partkey % 6 = 5 AND v <> 6 THEN NOPAIRS
       WHEN v = 1 THEN LIST[<<'Sodium'|concat(CAST(p_size + 100 AS string), ' mg')>>, <<'Energy'|concat(CAST(p_size * 10 AS string), ' kcal')>>, <<'Fat'|concat(CAST(p_size + 1 AS string), ' g')>>]
       WHEN v = 2 THEN LIST[<<'Năng lượng'|concat(CAST(p_size * 10 AS string), ' kcal')>>, <<'Chất béo'|concat(CAST(p_size + 100 AS string), ' mg')>>, <<'Natri'|concat(CAST(p_size + 1 AS string), ' g')>>]
       WHEN v = 4 THEN LIST[<<'Natri'|concat(CAST(p_size + 100 AS string), 'mg')>>, <<'Nang lượng.'|concat(CAST(p_size * 10 AS string), ' calo')>>, <<'Chat béo'|'none'>>]
       WHEN v = 5 THEN LIST[<<'Natri'|concat(CAST(p_size + 100 AS string), ' mg')>>, <<'Năng lượng'|concat(CAST(p_size * 12 AS string), ' kcal')>>]
       ELSE LIST[<<'Năng lượng'|concat(CAST(p_size * 10 AS string), ' kcal')>>, <<'Chất béo'|concat(CAST(p_size + 1 AS string), ' g')>>, <<'Natri'|concat(CAST(p_size + 100 AS string), ' mg')>>] END AS nutrition,
  CASE WHEN v = 11 THEN 'refused' WHEN v = 3 AND a.p_partkey % 2 = 0 THEN 'failed' WHEN v = 10 THEN 'cut' ELSE 'ok' END AS status
  FROM answers a JOIN food f ON a.image_id = f.image_id)"""


def _spark(text: str) -> str:
    text = text.replace("<<", "named_struct('name', ").replace("|", ", 'value', ").replace(">>", ")")
    text = text.replace("NOPAIRS", "CAST(array() AS array<struct<name:string,value:string>>)").replace("NONE", "CAST(array() AS array<string>)")
    return text.replace("LIST[", "array(").replace("]", ")")


def _duck(text: str) -> str:
    text = text.replace("<<", "{'name': ").replace("|", ", 'value': ").replace(">>", "}")
    return text.replace("NOPAIRS", "[]::STRUCT(name VARCHAR, value VARCHAR)[]").replace("NONE", "[]::VARCHAR[]").replace("LIST[", "[")


BASE = (GT, ANSWERS, FOOD, TRUTH, SAID)


def twin(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join([*map(_duck, BASE), *parts]) + "\n" + select


def truth(spark, sf_dir, whole_ids=True):
    return rows(spark, sf_dir, "truth", *map(_spark, BASE[:4]), whole_ids=whole_ids)


def said(spark, sf_dir):
    return rows(spark, sf_dir, "said", *map(_spark, BASE), whole_ids=True)


def responses(spark, sf_dir):
    """Raw answers: JSON of all nine fields, some cut off, some refused, some without content."""
    d = said(spark, sf_dir)
    whole = F.to_json(F.struct(*S.FIELDS))
    content = F.when(F.col("status") == "ok", whole).when(F.col("status") == "cut", F.expr("substring(j, 1, length(j) - 1)")).when(F.col("status") == "refused", "I cannot read this label.")
    d = d.withColumn("j", whole).withColumn("content", content)
    return d.select(*KEYS, "content", F.when(F.col("status") == "failed", "402 insufficient credits").alias("error"), F.when(F.col("status") == "cut", "length").otherwise("stop").alias("finish_reason"))


def scored(spark, sf_dir):
    return S.score_records(S.read_answers(responses(spark, sf_dir)), truth(spark, sf_dir))


def images(spark, sf_dir):
    """The headline metrics of each record, stored. The greatest of a text, such as of api_error, would sort all rows."""
    return stored(spark, S.image_table(scored(spark, sf_dir)).select(*KEYS, "macro_field_f1", "pairing_accuracy"), "images")


# --- the DuckDB twin of the scorer

_GONE = "status IN ('refused', 'failed')"
ANSWERED = "seen AS (SELECT image_id, model_key, condition, status, " + ", ".join(f"CASE WHEN {_GONE} THEN {e} ELSE {f} END AS {f}" for f, e in [*((f, "''") for f in S.SCALARS), *((f, "[]") for f in S.LISTS), ("nutrition", "[]")]) + " FROM said)"
_field = lambda f: f"{{'field': '{f}', 'pred': s.{f}, 'truth': t.{f}}}"
SCALARS = f"""x AS (SELECT s.image_id, s.model_key, s.condition, unnest([{", ".join(map(_field, S.SCALARS))}], recursive := true) FROM seen s JOIN truth t ON s.image_id = t.image_id),
n AS (SELECT *, {D.norm('pred')} AS np, {D.norm('truth')} AS ng, {D.tokens(D.norm('pred'))} AS a, {D.tokens(D.norm('truth'))} AS b,
    {D.number('pred')} AS pn, {D.number('truth')} AS gn, {D.unit_after('pred')} AS pu, {D.unit_after('truth')} AS gu, {D.date('pred')} AS pd, {D.date('truth')} AS gd FROM x),
sc AS (SELECT *, coalesce((field = 'net_weight' AND abs(pn - gn) <= greatest(0.05 * abs(gn), 0.05) AND (pu IS NULL OR gu IS NULL OR pu = gu)) OR (field IN ('mfg_date', 'expiry_date') AND pd = gd AND gd <> ''), false) OR np = ng AS strict, {D.ratio('a', 'b')} AS raw FROM n),
scalars AS (SELECT *, strict OR raw >= 90 AS lenient, CASE WHEN strict THEN 100.0 ELSE raw END AS similarity, NOT strict AND ng <> '' AND {D.strip('np')} = {D.strip('ng')} AS diacritic_only FROM sc)"""
PERMS = "perms AS (SELECT unnest([" + ", ".join(str(list(p)) for p in permutations(range(4))) + "]) AS perm)"


def _solved(name: str, pairs: str, threshold: int) -> str:
    """name: pairs (r, n, m, i, j, sim, ...) of the best total assignment of at most 4 x 4 items, at the threshold or above."""
    return f"""{name}_t AS (SELECT r, perm, round(sum(sim) FILTER (WHERE perm[i + 1] = j), 6) AS total FROM {pairs}, perms GROUP BY r, perm),
{name}_b AS (SELECT r, arg_min(perm, (-coalesce(total, 0), perm)) AS perm FROM {name}_t GROUP BY r),
{name} AS (SELECT p.* FROM {pairs} p JOIN {name}_b b ON p.r = b.r WHERE b.perm[i + 1] = j AND sim >= {threshold})"""


LISTED = f"""lx AS (SELECT image_id || '/' || model_key || '/' || field AS r, * FROM (SELECT s.image_id, s.model_key, s.condition, unnest([{", ".join(map(_field, S.LISTS))}], recursive := true) FROM seen s JOIN truth t ON s.image_id = t.image_id)),
lp AS (SELECT r, i - 1 AS i, j - 1 AS j, {D.ratio('a', 'b')} AS sim FROM (SELECT *, {D.tokens(D.norm('pred[i]'))} AS a, {D.tokens(D.norm('truth[j]'))} AS b
  FROM (SELECT *, unnest(range(1, len(truth) + 1)) AS j FROM (SELECT *, unnest(range(1, len(pred) + 1)) AS i FROM lx)))),
{PERMS},
{_solved('lh', 'lp', 80)},
lu AS (SELECT lx.*, coalesce(h.tp, 0) AS tp, list_filter(pred, lambda x, k: NOT list_contains(coalesce(h.ii, []), k - 1)) AS lpred, list_filter(truth, lambda x, k: NOT list_contains(coalesce(h.jj, []), k - 1)) AS ltruth
  FROM lx LEFT JOIN (SELECT r, count(*) AS tp, list(i) AS ii, list(j) AS jj FROM lh GROUP BY r) h ON lx.r = h.r),
k1 AS (SELECT r, bool_or({D.ratio('a', 'b')} >= 80) AS hit FROM (SELECT r, {D.tokens(D.norm('o'))} AS a, {D.tokens(D.norm("array_to_string(ltruth, ' ')"))} AS b FROM (SELECT *, unnest(lpred) AS o FROM lu WHERE len(ltruth) > 1)) GROUP BY r),
k2 AS (SELECT r, bool_or({D.ratio('a', 'b')} >= 80) AS hit FROM (SELECT r, {D.tokens(D.norm('o'))} AS a, {D.tokens(D.norm("array_to_string(lpred, ' ')"))} AS b FROM (SELECT *, unnest(ltruth) AS o FROM lu WHERE len(lpred) > 1)) GROUP BY r),
le AS (SELECT lu.*, len(pred) AS n_pred, len(truth) AS n_truth, CASE WHEN k1.hit THEN 1 WHEN k2.hit THEN len(lpred) ELSE 0 END AS extra_pred, CASE WHEN k1.hit THEN len(ltruth) WHEN k2.hit THEN 1 ELSE 0 END AS extra_truth
  FROM lu LEFT JOIN k1 ON lu.r = k1.r LEFT JOIN k2 ON lu.r = k2.r),
lr AS (SELECT *, CASE WHEN n_pred = 0 THEN 1.0 ELSE (tp + extra_pred) / n_pred END AS precision, CASE WHEN n_truth = 0 THEN 1.0 ELSE (tp + extra_truth) / n_truth END AS recall FROM le),
listed AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM lr)"""
_fits = "coalesce(CASE WHEN gn IS NULL THEN np = ng ELSE abs(pn - gn) <= greatest(0.05 * abs(gn), 0.05) AND (pu IS NULL OR gu IS NULL OR pu = gu) END, false)"
NUTRITION = f"""nx AS (SELECT s.image_id || '/' || s.model_key AS r, s.image_id, s.model_key, s.condition, s.nutrition AS pred, t.nutrition AS truth FROM seen s JOIN truth t ON s.image_id = t.image_id),
nq AS (SELECT r, i - 1 AS i, j - 1 AS j, pred[i].name AS pname, truth[j].name AS gname, pred[i].value AS pv, truth[j].value AS gv FROM (SELECT *, unnest(range(1, len(truth) + 1)) AS j FROM (SELECT *, unnest(range(1, len(pred) + 1)) AS i FROM nx))),
nv AS (SELECT *, {D.tokens(D.norm('pname'))} AS a, {D.tokens(D.norm('gname'))} AS b, {D.nutrient('pname')} = {D.nutrient('gname')} AS same, {D.number('pv')} AS pn, {D.number('gv')} AS gn, {D.unit_after('pv')} AS pu, {D.unit_after('gv')} AS gu, {D.norm('pv')} AS np, {D.norm('gv')} AS ng FROM nq),
np_ AS (SELECT r, i, j, CASE WHEN same THEN 100.0 ELSE {D.ratio('a', 'b')} END AS sim, {_fits} AS fits FROM nv),
{_solved('nh', 'np_', 75)},
nc AS (SELECT h.r, count(*) AS n_matched, count(*) FILTER (WHERE fits) AS n_correct, count(*) FILTER (WHERE NOT fits AND o.n > 0) AS n_errors
  FROM nh h LEFT JOIN (SELECT a.r, a.i, b.j, count(*) FILTER (WHERE a.fits AND a.j <> b.j) AS n FROM np_ a JOIN np_ b ON a.r = b.r AND a.i = b.i GROUP BY ALL) o ON h.r = o.r AND h.i = o.i AND h.j = o.j GROUP BY h.r),
ne AS (SELECT nx.*, len(pred) AS n_pred, len(truth) AS n_truth, coalesce(n_matched, 0) AS n_matched, coalesce(n_correct, 0) AS n_correct, coalesce(n_errors, 0) AS n_errors FROM nx LEFT JOIN nc ON nx.r = nc.r),
nr AS (SELECT *, CASE WHEN n_pred = 0 THEN 1.0 ELSE n_matched / n_pred END AS precision, CASE WHEN n_truth = 0 THEN 1.0 ELSE n_matched / n_truth END AS recall,
  CASE WHEN n_matched > 0 THEN n_correct / n_matched WHEN n_truth = 0 THEN 1.0 ELSE 0.0 END AS value_accuracy, CASE WHEN n_truth = 0 THEN 1.0 ELSE 1 - n_errors / n_truth END AS pairing_accuracy FROM ne),
nut AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM nr)"""
_join = "array_to_string(list_transform({0}, lambda e: e.name || '=' || e.value), '; ')"
ISSUES = """flags AS (SELECT image_id, model_key, status, status NOT IN ('refused', 'failed') AS json_valid, CASE WHEN status = 'failed' THEN '402 insufficient credits' END AS api_error,
  concat_ws('; ', CASE WHEN status = 'cut' THEN 'output_truncated' END, CASE status WHEN 'failed' THEN 'api_error' WHEN 'refused' THEN 'json_parse_failed' WHEN 'cut' THEN 'json_repair_used' END,
    CASE WHEN status IN ('refused', 'failed') THEN 'root: expected object, got NoneType; using empty record; ' || array_to_string(list_transform(['product_name', 'origin', 'net_weight', 'mfg_date', 'expiry_date', 'ingredient', 'additive', 'warning', 'nutrition'], lambda f: f || ': missing from output; defaulted'), '; ') END) AS issues,
  CASE status WHEN 'failed' THEN 11 WHEN 'refused' THEN 11 WHEN 'cut' THEN 2 ELSE 0 END AS n_issues FROM said)"""
FIELDS = f"""all_fields AS (
  SELECT image_id, model_key, condition, field, 'scalar' AS field_type, pred AS pred_value, truth AS gt_value, lenient::INT::DOUBLE AS precision, lenient::INT::DOUBLE AS recall, lenient::INT::DOUBLE AS f1, strict::INT::DOUBLE AS strict_f1, similarity, diacritic_only, NULL::DOUBLE AS pairing_accuracy, NULL::DOUBLE AS value_accuracy, NULL AS n_pred, NULL AS n_truth, pn, gn, pu, gu FROM scalars
  UNION ALL SELECT image_id, model_key, condition, field, 'list', array_to_string(pred, ' | '), array_to_string(truth, ' | '), precision, recall, f1, NULL, NULL, NULL, NULL, NULL, n_pred, n_truth, NULL, NULL, NULL, NULL FROM listed
  UNION ALL SELECT image_id, model_key, condition, 'nutrition', 'nutrition', {_join.format('pred')}, {_join.format('truth')}, precision, recall, f1, NULL, NULL, NULL, pairing_accuracy, value_accuracy, n_pred, n_truth, NULL, NULL, NULL, NULL FROM nut),
field_scores AS (SELECT a.*, status, json_valid, api_error, issues, n_issues FROM all_fields a JOIN flags f ON a.image_id = f.image_id AND a.model_key = f.model_key),
image_scores AS (SELECT image_id, model_key, condition, avg(f1) AS macro_field_f1, avg(coalesce(strict_f1, f1)) AS macro_field_f1_strict, max(pairing_accuracy) AS pairing_accuracy, bool_and(json_valid) AS json_valid, max(api_error) AS api_error, max(n_issues)::INT AS n_structural_issues FROM field_scores GROUP BY ALL)"""
SCORED = (ANSWERED, SCALARS, LISTED, NUTRITION, ISSUES, FIELDS)
ERRORS = """errors AS (SELECT *, CASE WHEN field_type = 'scalar' THEN similarity / 100 ELSE f1 END AS score, CASE WHEN NOT json_valid THEN 'malformed_json' WHEN status = 'cut' THEN 'output_truncated'
  WHEN field_type = 'scalar' THEN CASE WHEN diacritic_only THEN 'diacritics' WHEN trim(pred_value) = '' AND trim(gt_value) <> '' THEN 'missing_field' WHEN trim(gt_value) = '' AND trim(pred_value) <> '' THEN 'hallucination'
    WHEN field = 'net_weight' AND abs(pn - gn) <= greatest(0.05 * abs(gn), 0.05) AND pu IS DISTINCT FROM gu THEN 'wrong_unit' WHEN trim(gt_value) <> '' AND similarity < 20 THEN 'hallucination' ELSE 'wrong_value' END
  WHEN n_pred = 0 AND n_truth > 0 THEN 'missing_field' WHEN n_truth = 0 AND n_pred > 0 THEN 'hallucination'
  WHEN field_type = 'list' THEN CASE WHEN field = 'additive' AND recall < 1 THEN 'missing_additive' WHEN precision < recall THEN 'hallucination' ELSE 'wrong_value' END
  ELSE CASE WHEN pairing_accuracy < 1 THEN 'pairing_error' WHEN value_accuracy < 1 THEN 'wrong_value' WHEN precision < recall THEN 'hallucination' WHEN recall < 1 THEN 'missing_field' ELSE 'wrong_value' END END AS error_category
  FROM field_scores WHERE CASE WHEN field_type = 'scalar' THEN f1 = 0 WHEN field_type = 'list' THEN f1 < 1 ELSE f1 < 1 OR pairing_accuracy < 1 OR value_accuracy < 1 END)"""


@query(twin("SELECT image_id, model_key, field, extra_pred::INT AS extra_pred, extra_truth::INT AS extra_truth, tp::INT AS tp FROM listed WHERE extra_pred > 0", *SCORED[:3]))
def e7_merge_bonus_lists(spark, sf_dir):
    """Merged and split items of the lists of whole records."""
    a = S.read_answers(responses(spark, sf_dir)).select(*KEYS, *S.LISTS).join(truth(spark, sf_dir).select("image_id", *(F.col(f).alias(f"t_{f}") for f in S.LISTS)), "image_id")
    d = stored(spark, a, "lists").select(*KEYS, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("said"), F.col(f"t_{f}").alias("true")) for f in S.LISTS))))
    d = once_each(d, ["said", "true"], lambda x: match_lists(x, ["said", "true"], "said", "true").where("extra_pred > 0"))
    return d.select("image_id", "model_key", "field", "extra_pred", "extra_truth", "tp")


@query(twin("SELECT image_id, model_key, n_pred::INT AS n_pred, n_truth::INT AS n_truth, n_matched, n_correct, n_errors AS n_pairing_errors, round(f1, 6) AS name_f1, round(value_accuracy, 6) AS value_accuracy, round(pairing_accuracy, 6) AS pairing_accuracy FROM nut", ANSWERED, PERMS, NUTRITION))
def e9_match_nutrition_names(spark, sf_dir):
    """Nutrition of whole records: names in two languages and misspelled, in another order, with wrong and swapped values."""
    a = S.read_answers(responses(spark, sf_dir)).select(*KEYS, F.col("nutrition").alias("said")).join(truth(spark, sf_dir).select("image_id", F.col("nutrition").alias("true")), "image_id")
    d = once_each(stored(spark, a, "nutrition"), ["said", "true"], lambda x: match_nutrition(x, ["said", "true"], "said", "true"))
    return d.select("image_id", "model_key", "n_pred", "n_truth", "n_matched", "n_correct", "n_pairing_errors", *(R(c).alias(c) for c in ("name_f1", "value_accuracy", "pairing_accuracy")))


@query(twin("SELECT image_id, model_key, count(*) AS n_fields, round(sum(f1), 6) AS total, round(sum(strict_f1), 6) AS strict, max(n_issues)::INT AS n_issues FROM field_scores GROUP BY ALL", *SCORED))
def f1_score_records(spark, sf_dir):
    d = scored(spark, sf_dir).groupBy("image_id", "model_key")
    return d.agg(F.count("*").alias("n_fields"), R(F.sum("f1")).alias("total"), R(F.sum("strict_f1")).alias("strict"), F.max(F.size("structural_issues")).alias("n_issues"))


@query(twin("SELECT image_id, model_key, condition, field, field_type, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, strict_f1, round(similarity, 6) AS similarity, diacritic_only AS diacritic_only_mismatch, round(pairing_accuracy, 6) AS pairing_accuracy, round(value_accuracy, 6) AS value_accuracy, json_valid, api_error FROM field_scores", *SCORED))
def f2_field_table(spark, sf_dir):
    d = S.field_table(scored(spark, sf_dir))
    return d.withColumns({c: R(c) for c in ("precision", "recall", "f1", "similarity", "pairing_accuracy", "value_accuracy")})


@query(twin("SELECT image_id, model_key, condition, round(macro_field_f1, 6) AS macro_field_f1, round(macro_field_f1_strict, 6) AS macro_field_f1_strict, round(pairing_accuracy, 6) AS pairing_accuracy, json_valid, api_error, n_structural_issues FROM image_scores", *SCORED))
def f3_image_table(spark, sf_dir):
    return S.image_table(scored(spark, sf_dir)).withColumns({c: R(c) for c in ("macro_field_f1", "macro_field_f1_strict", "pairing_accuracy")})


@query(twin("SELECT model_key, round(avg(macro_field_f1), 6) AS macro, round(avg(macro_field_f1_strict), 6) AS strict, round(avg(pairing_accuracy), 6) AS pairing, round(avg(json_valid::INT), 6) AS json_validity, count(*) AS n FROM image_scores GROUP BY ALL", *SCORED))
def f4_macro_of_nine_fields(spark, sf_dir):
    d = P.model_summary(S.image_table(scored(spark, sf_dir)))
    return d.select("model_key", R("macro_field_f1").alias("macro"), R("macro_field_f1_strict").alias("strict"), R("pairing_accuracy").alias("pairing"), R("json_validity").alias("json_validity"), F.col("n_images").alias("n"))


@query(twin("SELECT model_key, field, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(DISTINCT image_id) AS n_images FROM field_scores GROUP BY ALL", *SCORED))
def g1_summary_of_nine_fields(spark, sf_dir):
    d = P.model_field_summary(S.field_table(scored(spark, sf_dir)))
    return d.select("model_key", "field", *(R(c).alias(c) for c in ("precision", "recall", "f1")), "n_images")


@query(twin("SELECT model_key, round(avg(f1), 6) AS f1, round(avg(pairing_accuracy), 6) AS pairing_accuracy, round(avg(value_accuracy), 6) AS value_accuracy FROM field_scores WHERE field = 'nutrition' GROUP BY ALL", *SCORED))
def g3_nutrition_by_model(spark, sf_dir):
    d = P.nutrition_summary(S.field_table(scored(spark, sf_dir)))
    return d.select("model_key", *(R(c).alias(c) for c in ("f1", "pairing_accuracy", "value_accuracy")))


@query(twin("SELECT model_key, CAST(rank() OVER (ORDER BY avg(macro_field_f1) DESC) AS INT) AS place, count(*) AS n, round(avg(macro_field_f1), 6) AS mean FROM image_scores GROUP BY model_key", *SCORED))
def g9_leaderboard_places(spark, sf_dir):
    return P.leaderboard(S.image_table(scored(spark, sf_dir)), resamples=200).select("model_key", "place", "n", R("mean").alias("mean"))


@query()
def g9_leaderboard_intervals(spark, sf_dir):
    """Models by macro F1 with the interval of 10,000 resamples and its half-widths."""
    return P.leaderboard(images(spark, sf_dir))


@query(twin("SELECT model_key, round(avg(m), 6) AS mean_f1, " + ", ".join(f"round(max(m) FILTER (WHERE field = '{f}'), 6) AS {f}" for f in P.FIELDS) + ", CAST(rank() OVER (ORDER BY avg(m) DESC) AS INT) AS place FROM (SELECT model_key, field, avg(f1) AS m FROM field_scores GROUP BY ALL) GROUP BY model_key", *SCORED))
def g10_field_matrix_by_mean(spark, sf_dir):
    from pyspark.sql import Window

    d = P.field_matrix(P.model_field_summary(S.field_table(scored(spark, sf_dir))))
    return d.select("model_key", *(R(c).alias(c) for c in ("mean_f1", *P.FIELDS)), F.rank().over(Window.orderBy(F.desc("mean_f1"))).alias("place"))  # one row per model


@query()
def h1_bootstrap_poisson(spark, sf_dir):
    """Interval of both headline metrics by model and condition, 10,000 resamples."""
    return P.bootstrap_table(images(spark, sf_dir), ["model_key", "condition"], "image_id", ["macro_field_f1", "pairing_accuracy"])


@query(twin("SELECT image_id, model_key, field, field_type, round(score, 6) AS score FROM errors", *SCORED, ERRORS))
def i1_incorrect_of_all_types(spark, sf_dir):
    return X.incorrect_fields(scored(spark, sf_dir)).select("image_id", "model_key", "field", "field_type", R("score").alias("score"))


@query(twin("SELECT image_id, model_key, field, field_type, error_category FROM errors", *SCORED, ERRORS))
def i2_classify_all_types(spark, sf_dir):
    return X.incorrect_fields(scored(spark, sf_dir)).select("image_id", "model_key", "field", "field_type", "error_category")


@query(twin("SELECT field, error_category, count(*) AS n FROM errors WHERE field_type = 'list' GROUP BY ALL", *SCORED, ERRORS))
def i4_categories_of_lists(spark, sf_dir):
    return X.incorrect_fields(scored(spark, sf_dir)).where("field_type = 'list'").groupBy("field", "error_category").agg(F.count("*").alias("n"))


@query(twin("SELECT image_id, model_key, condition, field, field_type, round(score, 2) AS score, pred_value, gt_value, json_valid, coalesce(api_error, '') AS api_error, issues AS structural_issues, error_category, error_category = 'hallucination' AS low_confidence, '' AS notes FROM errors ORDER BY md5('42#' || model_key || '#' || image_id || '#' || field), model_key, image_id, field LIMIT 300", *SCORED, ERRORS))
def i7_error_table(spark, sf_dir):
    """The sample of 300 rows with its 14 columns (scores to two places here, since engines round halves apart)."""
    d = X.error_rows(P.hash_sample(X.incorrect_fields(scored(spark, sf_dir)).withColumn("score", F.round("score", 2)), 300, 42, "model_key", "image_id", "field"))
    return d.orderBy("model_key", "image_id", "field")


@query(twin("SELECT model_key, error_category AS category, n, round(n / sum(n) OVER (PARTITION BY model_key), 6) AS share FROM (SELECT model_key, error_category, count(*) AS n FROM errors GROUP BY ALL)", *SCORED, ERRORS))
def g6_crosstab_of_all_types(spark, sf_dir):
    d = P.crosstab(X.incorrect_fields(scored(spark, sf_dir)).withColumnRenamed("error_category", "category"))
    return d.select("model_key", "category", "n", R("share").alias("share"))


def control(spark, sf_dir):
    """A second annotation of every record, some of them unknown to the first."""
    d = said(spark, sf_dir).where("model_key = 'm1'")
    d = d.withColumns({"model_key": F.lit("control_annotator"), "condition": F.lit("agreement")})
    return d.withColumn("image_id", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("x"), F.col("image_id"))).otherwise(F.col("image_id"))).select(*KEYS, *S.FIELDS)


CONTROL = ANSWERED.replace("seen AS (", "seen AS (").replace(_GONE, "false").replace(" FROM said)", " FROM said WHERE model_key = 'm1' AND p_partkey % 5 > 0)")


@query(twin("SELECT image_id, 'control_annotator' AS model_key, 'agreement' AS condition, round(macro_field_f1, 6) AS macro_field_f1, round(macro_field_f1_strict, 6) AS macro_field_f1_strict, round(pairing_accuracy, 6) AS pairing_accuracy FROM image_scores", CONTROL, *SCORED[1:]))
def j1_agreement_of_annotators(spark, sf_dir):
    d = S.image_table(S.score_records(control(spark, sf_dir), truth(spark, sf_dir)))
    return d.select(*KEYS, *(R(c).alias(c) for c in ("macro_field_f1", "macro_field_f1_strict", "pairing_accuracy")))


@query(twin("SELECT count(*) AS n, round(avg(macro_field_f1), 6) AS macro_field_f1, round(avg(macro_field_f1_strict), 6) AS macro_field_f1_strict, round(avg(pairing_accuracy), 6) AS pairing_accuracy FROM image_scores", CONTROL, *SCORED[1:]))
def g11_agreement_means(spark, sf_dir):
    c = control(spark, sf_dir)
    known = c.join(unlabelled(c, truth(spark, sf_dir)).select("image_id"), "image_id", "left_anti")
    d = P.agreement(S.image_table(S.score_records(known, truth(spark, sf_dir))))
    return d.select("n", *(R(c).alias(c) for c in ("macro_field_f1", "macro_field_f1_strict", "pairing_accuracy")))
