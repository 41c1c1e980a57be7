"""Selection of items and models, and planning of the work that is left."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators.report import hash_sample

KEY = ["tier", "model_key", "image_id", "condition"]
CONDITIONS = (("vi", "zero"), ("vi", "one"), ("en", "zero"))
#: Parameters of each perturbation by severity 1 to 3 (fixed values).
PERTURBATIONS = {"blur": ((1.5, None), (3.5, None), (6.0, None)), "glare": ((0.35, 0.18), (0.55, 0.22), (0.75, 0.28)), "rotation": ((5.0, None), (15.0, None), (30.0, None))}


def select_models(models: DataFrame, selectors: list[str] | None) -> DataFrame:
    """Models in selector order, by key first, then slug; all of them without selectors. Unknown selectors raise."""
    if not selectors:
        return models.withColumn("position", F.lit(None).cast("int"))
    asked = models.sparkSession.createDataFrame(list(enumerate(selectors)), "position int, selector string")
    by_key = asked.join(models, F.col("selector") == F.col("key"), "inner")
    left = asked.join(models, F.col("selector") == F.col("key"), "left_anti")
    found = by_key.unionByName(left.join(models, F.col("selector") == F.col("slug"), "inner"))
    unknown = asked.join(found.select("position"), "position", "left_anti").orderBy("position").limit(20).collect()
    if unknown:
        known = [r["key"] for r in models.select("key").orderBy("key").limit(200).collect()]
        raise ValueError(f"unknown models {[r['selector'] for r in unknown]}; known: {known}")
    return found.drop("selector")


def select_ids(items: DataFrame, ids: list[str] | None = None, start: int | None = None, end: int | None = None, width: int = 4) -> DataFrame:
    """An explicit list wins; else a range (from 1, to the number of items); else all. Ids are zero-padded strings."""
    pad = lambda c: F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))
    if ids:
        return items.where(F.col("image_id").isin([str(i).zfill(width) for i in ids]))
    if start is None and end is None:
        return items
    end = items.count() if end is None else end
    if (start or 1) > end:
        raise ValueError("the range ends before it starts")
    wanted = items.sparkSession.range(start or 1, end + 1).select(pad(F.col("id").cast("string")).alias("image_id"))
    return items.join(wanted, "image_id", "left_semi")


def first_ids(items: DataFrame, n: int) -> DataFrame:
    return items.orderBy("image_id").limit(n)


def sample_subset(items: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return hash_sample(items, n, seed, "image_id")


def resolve_subset(items: DataFrame, ids: list[str] | None = None, pinned: DataFrame | None = None, n: int = 120, seed: int = 42, key: str | list[str] = "image_id") -> DataFrame:
    """Explicit ids, else the pinned list (by key) at the default size and seed, else a fresh sample."""
    if ids:
        return select_ids(items, ids)
    if pinned is not None and (n, seed) == (120, 42):
        return items.join(pinned, key, "left_semi")
    return sample_subset(items, n, seed)


def labeled_only(items: DataFrame, labels: DataFrame, key: str = "image_id") -> DataFrame:
    return items.join(labels, key, "left_semi")


def dataset_index(ids: DataFrame, images: DataFrame, labels: DataFrame, key: list[str] | None = None) -> DataFrame:
    """ids with image_path, label_path and has_ground_truth; an id without an image raises when the row is read. key is
    what tells items apart, image_id by default."""
    key = key or ["image_id"]
    d = ids.join(images, key, "left").join(labels, key, "left")
    checked = F.coalesce("image_path", F.raise_error(F.concat(F.lit("no image for id "), F.col("image_id"))).cast("string"))
    return d.select(*key, checked.alias("image_path"), "label_path", F.col("label_path").isNotNull().alias("has_ground_truth"))


def prompt_conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{lang}_{shot}", lang, shot) for lang, shot in CONDITIONS], "condition string, language string, shot string")


def instructions(texts: DataFrame, spark: SparkSession) -> DataFrame:
    """condition, instruction: the template of each language with its parts filled in; zero-shot has no example.

    texts holds language, template, fields, classification_rules, example. Parts are replaced as plain text.
    """
    filled = F.col("template")
    for slot, value in (("{fields}", F.col("fields")), ("{classification_rules}", F.col("classification_rules")), ("{example}", F.when(F.col("shot") == "one", F.col("example")).otherwise(F.lit("")))):
        filled = F.replace(filled, F.lit(slot), value)
    return F.broadcast(prompt_conditions(spark)).join(texts, "language").select("condition", filled.alias("instruction"))


def run_plan(items: DataFrame, models: DataFrame, conditions: DataFrame, tier: str = "benchmark") -> DataFrame:
    """Every item under every model and condition. Models and conditions are small dimensions, held as one array each."""
    dims = models.select(F.col("key").alias("model_key")).agg(F.array_sort(F.collect_list("model_key")).alias("ms"))
    conds = conditions.agg(F.array_sort(F.collect_list("condition")).alias("cs"))
    d = items.select("image_id").join(F.broadcast(dims), F.lit(True)).join(F.broadcast(conds), F.lit(True))
    return d.select(F.lit(tier).alias("tier"), "image_id", F.explode("ms").alias("model_key"), "cs").select("tier", "model_key", "image_id", F.explode("cs").alias("condition"))


def perturbation_manifest(items: DataFrame, seed: int = 42, number: str = "image_id") -> DataFrame:
    """Items under every kind and severity: condition, kind, severity, p1, p2, seed (by record, from its number)."""
    grid = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s + 1).alias("severity"), F.lit(v[s][0]).cast("double").alias("p1"), F.lit(v[s][1]).cast("double").alias("p2")) for (k, v), s in product(PERTURBATIONS.items(), range(3))))
    d = items.select("image_id", F.col(number).cast("long").alias("_number"), F.inline(grid))
    return d.select("image_id", F.concat("kind", F.lit("_s"), F.col("severity").cast("string")).alias("condition"), "kind", "severity", "p1", "p2", (F.lit(seed) + F.col("_number")).alias("seed"))


def scope(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_distinct("image_id").alias("n_images"), F.count_distinct("model_key").alias("n_models"), F.count_distinct("condition").alias("n_conditions"), F.count("*").alias("n_calls"))


def successes(responses: DataFrame) -> DataFrame:
    """Only successful answers are kept for reuse; failures come up again."""
    return responses.where("error is null and content is not null")


def pending_work(plan: DataFrame, responses: DataFrame, force: bool = False) -> DataFrame:
    return plan if force else plan.join(successes(responses), KEY, "left_anti")


def cached_records(plan: DataFrame, responses: DataFrame) -> DataFrame:
    return plan.join(successes(responses), KEY)


def resume_status(plan: DataFrame, responses: DataFrame) -> DataFrame:
    hit = plan.join(successes(responses).select(*KEY, F.lit(1).alias("hit")), KEY, "left")
    return hit.agg(F.count("hit").alias("n_cached"), F.count("*").alias("n_total"), F.count_if(F.col("hit").isNull()).alias("n_remaining"))


def labelled_count(items: DataFrame, labels: DataFrame, key: str = "image_id") -> DataFrame:
    hit = items.join(labels.select(key, F.lit(1).alias("hit")).distinct(), key, "left")
    return hit.agg(F.count("hit").alias("n_labeled"), F.count("*").alias("n"))


def unlabelled(control: DataFrame, primary: DataFrame, key: str = "image_id") -> DataFrame:
    return control.join(primary, key, "left_anti")


