"""Sources, selection and work planning over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.plans import selection as S
from scorewright.operators.score import FIELDS as S9
from scorewright.plans.bridges import ANSWERS, LEDGER, RESPONSES, rows, twin
from scorewright.queries.records import BASE, ERRORS, SCORED, _duck, _spark, truth
from scorewright.queries.registry import query
from scorewright.sources import tables, versioned

ITEMS = "items AS (SELECT lpad(CAST(p_partkey AS string), 6, '0') AS image_id, p_partkey FROM part)"
MODELS = "models AS (SELECT lower(replace(r_name, ' ', '-')) AS key, concat('vendor/', lower(replace(r_name, ' ', '-'))) AS slug, r_regionkey FROM region)"
CACHED = "cached AS (SELECT 'benchmark' AS tier, model_key, image_id, condition, content, error FROM responses)"
ARMS = "SELECT 'm0' AS model_key UNION ALL SELECT 'm1' UNION ALL SELECT 'm2' UNION ALL SELECT 'm3'"
CONDS = "SELECT 'vi_zero' AS condition UNION ALL SELECT 'vi_one' UNION ALL SELECT 'en_zero'"
PLAN = f"plan_ AS (SELECT 'benchmark' AS tier, model_key, image_id, condition FROM items CROSS JOIN ({ARMS}) CROSS JOIN ({CONDS}))"
DONE = "done AS (SELECT * FROM cached WHERE error IS NULL AND content IS NOT NULL)"
WORK = (ITEMS, PLAN, ANSWERS, RESPONSES, CACHED, DONE)
MATCH = "p.model_key = d.model_key AND p.image_id = d.image_id AND p.condition = d.condition AND p.tier = d.tier"


def items(spark, sf_dir):
    return rows(spark, sf_dir, "items", ITEMS)


def models(spark, sf_dir):
    return rows(spark, sf_dir, "models", MODELS)


def plan(spark, sf_dir):
    arms = rows(spark, sf_dir, "models", MODELS).where("r_regionkey < 4").select(F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("key"))
    return S.run_plan(items(spark, sf_dir), arms, S.prompt_conditions(spark))


def cached(spark, sf_dir):
    return rows(spark, sf_dir, "cached", ANSWERS, RESPONSES, CACHED)


def labelled(spark, sf_dir, *keys):
    return items(spark, sf_dir).where("p_partkey % 3 > 0").select("image_id", *keys, F.concat(F.lit("labels/"), F.col("image_id"), F.lit(".json")).alias("label_path"))


#: Items whose numbers have more than six digits share ids, so an item is told by both.
ITEM = ["image_id", "p_partkey"]


@query(twin("SELECT image_id, concat('images/', image_id, '.jpeg') AS image_path, CASE WHEN p_partkey % 3 > 0 THEN concat('labels/', image_id, '.json') END AS label_path, p_partkey % 3 > 0 AS has_ground_truth FROM items", ITEMS))
def a3_dataset_index(spark, sf_dir):
    images = items(spark, sf_dir).select(*ITEM, F.concat(F.lit("images/"), F.col("image_id"), F.lit(".jpeg")).alias("image_path"))
    return S.dataset_index(items(spark, sf_dir).select(*ITEM), images, labelled(spark, sf_dir, "p_partkey"), ITEM).drop("p_partkey")



@query(twin("SELECT image_id, model_key, condition, CASE WHEN p_partkey % 2 = 0 THEN v + 100 ELSE v END AS v FROM answers UNION ALL SELECT image_id, 'm9', condition, v + 100 FROM answers WHERE model_key = 'm0' AND p_partkey % 2 = 1", ANSWERS))
def a9_upsert(spark, sf_dir):
    d = rows(spark, sf_dir, "answers", ANSWERS)
    new = d.where("p_partkey % 2 = 0").unionByName(d.where("model_key = 'm0' AND p_partkey % 2 = 1").withColumn("model_key", F.lit("m9")))
    cols = [*ITEM, "model_key", "condition"]
    return tables.upserted(d.select(*cols, "v"), new.select(*cols, (F.col("v") + 100).alias("v")), cols).drop("p_partkey")


STORED = twin("SELECT image_id, model_key, condition, content FROM done", ANSWERS, RESPONSES, CACHED, DONE)


@query(STORED)
def a4_read_responses(spark, sf_dir):
    """Successful answers written as JSON records under tier and model, and read back with the fixed schema."""
    path = tables.scratch(spark, "responses")
    S.successes(cached(spark, sf_dir)).withColumn("model", F.col("model_key")).write.partitionBy("model").json(path)
    return tables.read_responses(spark, path, one_a_file=False).select("image_id", "model_key", "condition", "content")


@query(twin("SELECT image_id, model_key, condition, CAST(v AS DOUBLE) / 10 AS f1 FROM answers", ANSWERS))
def a8_read_scored(spark, sf_dir):
    """Scores written as CSV and read back; ids keep their leading zeros."""
    path = tables.scratch(spark, "scored")
    d = rows(spark, sf_dir, "answers", ANSWERS).select("image_id", "model_key", "condition", (F.col("v").cast("double") / 10).alias("f1"))
    tables.write_table(d, path, "csv")
    return tables.read_scored(spark, path, "image_id string, model_key string, condition string, f1 double")


@query(twin("SELECT tier, model_key, image_id, condition, input_tokens, output_tokens, round(input_tokens / 1e6 * price_in + output_tokens / 1e6 * price_out, 6) AS cost_usd FROM ledger WHERE input_tokens + output_tokens > 0", LEDGER))
def a10_ledger(spark, sf_dir):
    from scorewright.functions.text import cost_usd

    d = rows(spark, sf_dir, "ledger", LEDGER).withColumn("cost_usd", cost_usd("input_tokens", "output_tokens", "price_in", "price_out"))
    return tables.ledger_rows(d)


@query(twin("SELECT image_id, model_key, content FROM done", ANSWERS, RESPONSES, CACHED, DONE))
def a11_successful_responses(spark, sf_dir):
    return S.successes(cached(spark, sf_dir)).select("image_id", "model_key", "content")


@query(twin("SELECT CAST(n AS INT) AS position, m.key, m.slug, m.r_regionkey FROM models m JOIN (SELECT 0 AS n, 'europe' AS s UNION ALL SELECT 1, 'vendor/asia' UNION ALL SELECT 2, 'africa') x ON m.key = x.s OR m.slug = x.s", MODELS))
def b1_select_models(spark, sf_dir):
    return S.select_models(models(spark, sf_dir), ["europe", "vendor/asia", "africa"])


@query(twin("SELECT image_id FROM items WHERE p_partkey BETWEEN 5 AND 150", ITEMS))
def b2_select_ids(spark, sf_dir):
    return S.select_ids(items(spark, sf_dir), start=5, end=150, width=6).select("image_id")


@query(twin("SELECT image_id FROM items ORDER BY image_id LIMIT 25", ITEMS))
def b3_limit(spark, sf_dir):
    return S.first_ids(items(spark, sf_dir), 25).select("image_id")


@query(twin("SELECT image_id FROM items ORDER BY md5('42#' || image_id), image_id LIMIT 120", ITEMS))
def b4_sample_subset(spark, sf_dir):
    return S.sample_subset(items(spark, sf_dir), 120).select("image_id")


@query(twin("SELECT image_id FROM items WHERE p_partkey % 11 = 0", ITEMS))
def b5_resolve_subset(spark, sf_dir):
    pinned = items(spark, sf_dir).where("p_partkey % 11 = 0").select(*ITEM)
    return S.resolve_subset(items(spark, sf_dir), pinned=pinned, key=ITEM).select("image_id")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def b6_labeled_only(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return S.labeled_only(read("documents").select("doc_id"), read("labels"), "doc_id")


@query(twin("SELECT tier, model_key, image_id, condition FROM plan_", ITEMS, PLAN))
def b7_run_plan(spark, sf_dir):
    return plan(spark, sf_dir)


@query("""SELECT c.condition, md5(replace(replace(replace('Extract {fields} by {classification_rules}. {"a": 1}{example}', '{fields}', f), '{classification_rules}', r), '{example}', CASE WHEN c.condition LIKE '%one' THEN x ELSE '' END)) AS instruction
FROM (SELECT string_agg(n_name, ', ' ORDER BY n_name) AS f, min(n_name) AS r, max(n_name) AS x FROM nation), (SELECT 'vi_zero' AS condition UNION ALL SELECT 'vi_one' UNION ALL SELECT 'en_zero') c""")
def b8_prompt_conditions(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("fields"), F.min("n_name").alias("classification_rules"), F.max("n_name").alias("example"))
    texts = parts.withColumn("template", F.lit('Extract {fields} by {classification_rules}. {"a": 1}{example}')).select("*", F.explode(F.array(F.lit("vi"), F.lit("en"))).alias("language"))
    return S.instructions(texts, spark).select("condition", F.md5("instruction").alias("instruction"))


@query(twin("SELECT image_id, concat(kind, '_s', CAST(s AS string)) AS condition, kind, CAST(s AS INT) AS severity, CASE kind WHEN 'blur' THEN [1.5, 3.5, 6.0][s] WHEN 'glare' THEN [0.35, 0.55, 0.75][s] ELSE [5.0, 15.0, 30.0][s] END AS p1, CASE kind WHEN 'glare' THEN [0.18, 0.22, 0.28][s] END AS p2, CAST(42 + p_partkey AS BIGINT) AS seed FROM items, (SELECT unnest(['blur', 'glare', 'rotation']) AS kind), (SELECT unnest([1, 2, 3]) AS s) WHERE p_partkey % 5 = 0", ITEMS))
def b9_perturbation_manifest(spark, sf_dir):
    return S.perturbation_manifest(items(spark, sf_dir).where("p_partkey % 5 = 0"), number="p_partkey")


@query(twin("SELECT count(DISTINCT image_id) AS n_images, count(DISTINCT model_key) AS n_models, count(DISTINCT condition) AS n_conditions, count(*) AS n_calls FROM plan_", ITEMS, PLAN))
def b10_scope(spark, sf_dir):
    return S.scope(plan(spark, sf_dir))


@query(twin(f"SELECT count(d.image_id) AS n_cached, count(*) AS n_total, count(*) - count(d.image_id) AS n_remaining FROM plan_ p LEFT JOIN done d ON {MATCH}", *WORK))
def b11_resume_status(spark, sf_dir):
    return S.resume_status(plan(spark, sf_dir), cached(spark, sf_dir))


@query(twin(f"SELECT tier, model_key, image_id, condition FROM plan_ p WHERE NOT EXISTS (SELECT 1 FROM done d WHERE {MATCH})", *WORK))
def b12_pending_work(spark, sf_dir):
    return S.pending_work(plan(spark, sf_dir), cached(spark, sf_dir))


@query(twin(f"SELECT p.model_key, p.image_id, p.condition, d.content FROM plan_ p JOIN done d ON {MATCH}", *WORK))
def b13_cached_records(spark, sf_dir):
    return S.cached_records(plan(spark, sf_dir), cached(spark, sf_dir)).select("model_key", "image_id", "condition", "content")


@query(twin(f"SELECT p.condition, count(d.image_id) AS n_cached, count(*) AS n FROM plan_ p LEFT JOIN done d ON {MATCH} GROUP BY p.condition", *WORK))
def b14_shared_tier_reuse(spark, sf_dir):
    done = S.successes(cached(spark, sf_dir)).select(*S.KEY, F.lit(1).alias("hit"))
    return plan(spark, sf_dir).join(done, S.KEY, "left").groupBy("condition").agg(F.count("hit").alias("n_cached"), F.count("*").alias("n"))


@query(twin("SELECT count(*) FILTER (WHERE p_partkey % 3 > 0) AS n_labeled, count(*) AS n FROM items", ITEMS))
def b15_labelled_count(spark, sf_dir):
    return S.labelled_count(items(spark, sf_dir), labelled(spark, sf_dir, "p_partkey"), "p_partkey")


@query(twin("SELECT tier, model_key, round(sum(input_tokens / 1e6 * price_in + output_tokens / 1e6 * price_out), 4) AS cost_usd FROM ledger GROUP BY ALL", LEDGER))
def c11_cost_usd(spark, sf_dir):
    from scorewright.functions.text import cost_usd

    d = rows(spark, sf_dir, "ledger", LEDGER)
    return d.groupBy("tier", "model_key").agg(F.round(F.sum(cost_usd("input_tokens", "output_tokens", "price_in", "price_out")), 4).alias("cost_usd"))




@query(twin(f"SELECT t.image_id, product_name, origin, net_weight, mfg_date, expiry_date, array_to_string(ingredient, ' | ') AS ingredient, array_to_string(warning, ' | ') AS warning, len(nutrition) AS n_nutrition FROM truth t", *map(_duck, BASE)))
def a1_read_labels(spark, sf_dir):
    """The truth of every record as JSON, read strictly."""
    return _labels(truth(spark, sf_dir, whole_ids=False))


@query(twin(f"SELECT s.image_id, product_name, origin, net_weight, mfg_date, expiry_date, array_to_string(ingredient, ' | ') AS ingredient, array_to_string(warning, ' | ') AS warning, len(nutrition) AS n_nutrition FROM said s WHERE model_key = 'm1'", *map(_duck, BASE)))
def a7_read_control_labels(spark, sf_dir):
    """A second annotation, read alike."""
    return _labels(rows(spark, sf_dir, "said", *map(_spark, BASE)).where("model_key = 'm1'"))


def _labels(written):
    d = tables.labels_of(written.select("image_id", F.to_json(F.struct(*S9)).alias("value")))
    return d.select("image_id", "product_name", "origin", "net_weight", "mfg_date", "expiry_date", F.array_join("ingredient", " | ").alias("ingredient"), F.array_join("warning", " | ").alias("warning"), F.size("nutrition").cast("long").alias("n_nutrition"))


@query("SELECT lpad(n_nationkey::VARCHAR, 4, '0') AS image_id, lpad(n_nationkey::VARCHAR, 4, '0') || '.jpeg' AS name FROM nation")
def a2_list_images(spark, sf_dir):
    """A file for each nation, among others of another ending, listed without reading it."""
    path = tables.scratch(spark, "images")
    d = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("id"), "n_nationkey", F.col("n_name").alias("body"))
    files = d.select(F.concat("id", F.lit(".jpeg")).alias("name"), "body").unionByName(d.where("n_nationkey % 5 = 0").select(F.concat("id", F.lit(".png")).alias("name"), "body"))
    tables.write_files(files, path)
    return tables.list_images(spark, path).select("image_id", F.regexp_extract("image_path", "[^/]+$", 0).alias("name"))


@query("SELECT lower(replace(r_name, ' ', '-')) AS key, 'vendor/' || lower(replace(r_name, ' ', '-')) AS slug, r_regionkey % 2 = 0 AS open_weight, CASE WHEN r_regionkey > 0 THEN r_regionkey * 0.5 END AS price_input_per_m, 'https://example.org/v1' AS base_url FROM region")
def a5_read_models(spark, sf_dir):
    """A registry in YAML, one model for each region."""
    path = tables.scratch(spark, "models")
    key = F.lower(F.replace("r_name", F.lit(" "), F.lit("-")))
    line = F.concat(F.lit("  "), key, F.lit(": {slug: vendor/"), key, F.lit(", endpoint: e, open_weight: "), F.when(F.col("r_regionkey") % 2 == 0, "true").otherwise("false"), F.coalesce(F.concat(F.lit(", price_input_per_m: "), F.when(F.col("r_regionkey") > 0, F.col("r_regionkey") * 0.5).cast("string")), F.lit("")), F.lit("}"))
    head = "endpoints:\n  e: {base_url: 'https://example.org/v1', api_key_env: E_KEY}\nmodels:\n"
    d = spark.read.parquet(f"{sf_dir}/region.parquet").agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("body"))
    tables.write_files(d.select(F.lit("models.yaml").alias("name"), "body"), path)
    return tables.read_models(spark, path).select("key", "slug", "open_weight", "price_input_per_m", "base_url")


@query(twin("SELECT image_id FROM items WHERE p_partkey % 11 = 0", ITEMS))
def a6_read_pinned_subset(spark, sf_dir):
    """The pinned list written as JSON and read back; b5 lets it win over a sample."""
    path = tables.scratch(spark, "subset")
    d = items(spark, sf_dir).where("p_partkey % 11 = 0").agg(F.count("*").cast("int").alias("size"), F.lit(42).alias("seed"), F.array_sort(F.collect_list("image_id")).alias("image_ids"))
    d.write.json(path)
    return tables.read_pinned_subset(spark, path)


@query(twin("SELECT model_key, condition, count(*) AS n FROM answers GROUP BY ALL", ANSWERS))
def a12_write_summary(spark, sf_dir):
    """A small table written over an older one."""
    path = tables.scratch(spark, "summary")
    d = rows(spark, sf_dir, "answers", ANSWERS)
    tables.write_table(d.select("model_key", "condition", F.lit(0).cast("long").alias("n")), path)
    tables.write_table(d.groupBy("model_key", "condition").agg(F.count("*").alias("n")), path)
    return spark.read.parquet(path)


@query(twin("SELECT image_id, model_key, field, error_category FROM errors ORDER BY md5('42#' || model_key || '#' || image_id || '#' || field), model_key, image_id, field LIMIT 300", *map(_duck, BASE), *SCORED, ERRORS))
def a13_write_error_table(spark, sf_dir):
    """The error table written as CSV with its 14 columns and read back with ids as strings."""
    from scorewright.queries.records import i7_error_table

    path, d = tables.scratch(spark, "errors"), i7_error_table(spark, sf_dir)
    tables.write_table(d, path, "csv")
    return tables.read_scored(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema)).select("image_id", "model_key", "field", "error_category")


@query(twin("SELECT tier, model_key, count(*) AS n, round(sum(input_tokens / 1e6 * price_in + output_tokens / 1e6 * price_out), 3) AS cost_usd FROM ledger WHERE input_tokens + output_tokens > 0 GROUP BY ALL", LEDGER))
def a10_append_ledger(spark, sf_dir):
    """The ledger appended to in two runs and read back."""
    from scorewright.functions.text import cost_usd

    path = tables.scratch(spark, "ledger")
    d = rows(spark, sf_dir, "ledger", LEDGER).withColumn("cost_usd", cost_usd("input_tokens", "output_tokens", "price_in", "price_out"))
    for part in ("model_key < 'B'", "model_key >= 'B'"):
        tables.append_ledger(d.where(part), path)
    return tables.read_scored(spark, path, tables.LEDGER).groupBy("tier", "model_key").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 3).alias("cost_usd"))


@query(twin("SELECT image_id, model_key, condition, CASE WHEN p_partkey % 2 = 0 THEN v + 200 ELSE v END AS v FROM answers", ANSWERS))
def a9_upsert_last_wins(spark, sf_dir):
    """New rows that come twice: the later arrival stays."""
    d = rows(spark, sf_dir, "answers", ANSWERS).select("image_id", "model_key", "condition", "v", "p_partkey")
    some = d.where("p_partkey % 2 = 0")
    new = some.withColumns({"v": F.col("v") + 200, "at": F.lit(2)}).unionByName(some.withColumns({"v": F.col("v") + 900, "at": F.lit(1)}))
    cols = [*ITEM, "model_key", "condition"]
    return tables.upserted(d.select(*cols, "v", F.lit(0).alias("at")), new.select(*cols, "v", "at"), cols, arrival="at").drop("at", "p_partkey")


VERSIONED = """first AS (SELECT image_id, CASE WHEN model_key <> 'm2' THEN model_key END AS model_key, CASE WHEN p_partkey % 6 > 0 THEN condition END AS condition, v, p_partkey FROM answers)"""


@query(twin("SELECT image_id, model_key, condition, CASE WHEN model_key IS NULL AND p_partkey % 4 = 0 THEN v + 300 WHEN p_partkey % 2 = 0 THEN v + 200 ELSE v END AS v, CASE WHEN model_key IS NULL AND p_partkey % 4 = 0 THEN 3 WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS wrote FROM first UNION ALL SELECT image_id, 'm9', condition, v + 300, 3 FROM first WHERE model_key = 'm0' AND p_partkey % 4 = 0", ANSWERS, VERSIONED))
def a9_versioned_upsert(spark, sf_dir):
    """Three writes to one path, read back: null models and conditions, keys that come twice in a batch, new partitions."""
    d = rows(spark, sf_dir, "first", ANSWERS, VERSIONED)
    path, keys = tables.scratch(spark, "versioned"), [*ITEM, "model_key", "condition"]
    write = lambda x, add, n: x.select(*keys, (F.col("v") + add).alias("v"), F.lit(n).alias("wrote"))
    versioned.upsert(write(d, 0, 1), path, keys)
    some = d.where("p_partkey % 2 = 0")
    versioned.upsert(write(some, 900, 9).withColumn("at", F.lit(1)).unionByName(write(some, 200, 2).withColumn("at", F.lit(2))), path, keys, arrival="at")
    some = d.where("p_partkey % 4 = 0")
    versioned.upsert(write(some.where("model_key IS NULL").unionByName(some.where("model_key = 'm0'").withColumn("model_key", F.lit("m9"))), 300, 3), path, keys)
    return versioned.read(spark, path).select("image_id", "model_key", "condition", "v", "wrote")


@query(twin("SELECT image_id, model_key, content FROM done", ANSWERS, RESPONSES, CACHED, DONE))
def a11_save_responses(spark, sf_dir):
    """Answers saved by tier and model and read back; failures are not among them."""
    path = tables.scratch(spark, "saved")
    tables.save_responses(cached(spark, sf_dir), path)
    return spark.read.schema("image_id string, condition string, content string, error string, tier string, model_key string").parquet(path).select("image_id", "model_key", "content")
