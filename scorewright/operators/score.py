"""Scored tables: long rows by field, and one row per record, model and condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.text import composed, list_text, nutrition_text
from scorewright.operators.match import LISTS, SCALARS, match_lists, match_nutrition, match_scalars, once_each
from scorewright.operators.parse import read_records, structural_issues
from scorewright.sources.tables import stored

KEYS = ["image_id", "model_key", "condition"]


def scalar_rows(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """KEYS, field, pred, truth for each scalar field of the answers to labelled records."""
    t = truth.select("image_id", F.struct(*(F.coalesce(f, F.lit("")).alias(f) for f in SCALARS)).alias("_t"))
    d = answers.select(*KEYS, F.struct(*(F.coalesce(f, F.lit("")).alias(f) for f in SCALARS)).alias("_p")).join(t, "image_id")
    fields = (x for f in SCALARS for x in (F.lit(f), F.col(f"_p.{f}"), F.col(f"_t.{f}")))
    return d.select(*KEYS, F.stack(F.lit(len(SCALARS)), *fields).alias("field", "pred", "truth"))


def field_scores(scalars: DataFrame, lists: DataFrame, nutrition: DataFrame | None = None, list_field: str = "ingredient") -> DataFrame:
    """One row per field. Scalars have precision = recall = f1 = lenient; list and nutrition rows have no strict_f1."""
    hit = F.col("lenient").cast("double")
    a = scalars.select(*KEYS, "field", F.lit("scalar").alias("field_type"), hit.alias("precision"), hit.alias("recall"), hit.alias("f1"), F.col("strict").cast("double").alias("strict_f1"), "similarity", "diacritic_only")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    name = F.col("field") if "field" in lists.columns else F.lit(list_field)
    b = lists.select(*KEYS, name.alias("field"), F.lit("list").alias("field_type"), "precision", "recall", "f1", null("double", "strict_f1"), null("double", "similarity"), null("boolean", "diacritic_only"))
    d = a.unionByName(b).withColumns({"pairing_accuracy": F.lit(None).cast("double"), "value_accuracy": F.lit(None).cast("double")})
    if nutrition is None:
        return d
    c = nutrition.select(*KEYS, F.lit("nutrition").alias("field"), F.lit("nutrition").alias("field_type"), F.col("name_precision").alias("precision"), F.col("name_recall").alias("recall"), F.col("name_f1").alias("f1"), null("double", "strict_f1"), null("double", "similarity"), null("boolean", "diacritic_only"), "pairing_accuracy", "value_accuracy")
    return d.unionByName(c)


def image_scores(fields: DataFrame) -> DataFrame:
    """KEYS with the mean f1 over fields, the same with strict scalars, and the pairing accuracy (1 without nutrition)."""
    return fields.groupBy(*KEYS).agg(F.avg("f1").alias("macro_field_f1"), F.avg(F.coalesce("strict_f1", "f1")).alias("macro_field_f1_strict"), F.coalesce(F.max("pairing_accuracy"), F.lit(1.0)).alias("pairing_accuracy"))


FIELDS = (*SCALARS, *LISTS, "nutrition")
FLAGS = ["json_valid", "api_error", "structural_issues"]


def read_answers(responses: DataFrame) -> DataFrame:
    """KEYS, the nine coerced fields and FLAGS of raw responses (content, error, finish_reason). An answer that can't be
    read is an empty record, so empty fields of the truth count as right for it."""
    return structural_issues(read_records(responses)).select(*KEYS, *FIELDS, "json_valid", F.col("error").alias("api_error"), "structural_issues")


def score_records(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per answer to a labelled record and field: KEYS, field, field_type, pred_value and gt_value (as text), FLAGS,
    and the columns of the matchers, null where a field's type lacks them. Answers without FLAGS count as valid.

    Fields repeat from record to record, so each different pair of values is matched once in the job (once_each).
    """
    for name, value in (("json_valid", F.lit(True)), ("api_error", F.lit(None).cast("string")), ("structural_issues", F.array().cast("array<string>"))):
        if name not in answers.columns:
            answers = answers.withColumn(name, value)
    d = answers.select(*KEYS, *FLAGS, F.struct(*FIELDS).alias("_said")).join(truth.select("image_id", F.struct(*FIELDS).alias("_true")), "image_id")
    d = stored(d.sparkSession, d, "records")  # read twice: for what is to be matched, and for what it is joined to
    d = d.select(*KEYS, *FLAGS, F.inline(F.array(*map(_item, FIELDS))))
    d = once_each(d, ITEM, _matched)
    return d.select(*KEYS, "field", "field_type", "pred", "truth", "pred_value", "gt_value", *FLAGS, *MEASURES)


#: What tells a field of a record from others: its name and both values, each in the column of its type.
TYPES = {"scalar": "string", "list": "array<string>", "nutrition": "array<struct<name:string,value:string>>"}
ITEM = ["field", *(f"_{side}_{kind}" for kind in TYPES for side in ("said", "true"))]
#: Columns of score_records() that the matchers give, with the types of those that a field's type can lack.
MEASURES = ["precision", "recall", "f1", "strict", "lenient", "strict_f1", "similarity", "diacritic_only_mismatch", "pairing_accuracy", "value_accuracy", "n_pred", "n_truth"]
LACKED = {"pred": "string", "truth": "string", "strict": "boolean", "lenient": "boolean", "strict_f1": "double", "similarity": "double", "diacritic_only_mismatch": "boolean", "pairing_accuracy": "double", "value_accuracy": "double", "n_pred": "int", "n_truth": "int"}


def _item(f: str) -> Column:
    """ITEM of one field of _said and _true."""
    own = "scalar" if f in SCALARS else "list" if f in LISTS else "nutrition"
    value = lambda side, kind: (F.col(f"_{side}.{f}") if kind == own else F.lit(None)).cast(TYPES[kind])
    return F.struct(F.lit(f).alias("field"), *(value(side, kind).alias(f"_{side}_{kind}") for kind in TYPES for side in ("said", "true")))


def _matched(items: DataFrame) -> DataFrame:
    """ITEM, field_type, pred, truth, pred_value, gt_value and MEASURES of a table of ITEM."""
    flat = lambda c: F.coalesce(c, F.lit(""))

    def of(kind: str, fields: tuple[str, ...], text) -> DataFrame:
        """The items of one type, with their values in composed form and as text."""
        d = composed(items.where(F.col("field").isin(*fields)), f"_said_{kind}", f"_true_{kind}", to=("_p", "_t"))
        return d.withColumns({"field_type": F.lit(kind), "pred_value": flat(text("_p")), "gt_value": flat(text("_t"))})

    def whole(d: DataFrame) -> DataFrame:
        lacked = {c: F.lit(None).cast(kind) for c, kind in LACKED.items() if c not in d.columns}
        return d.withColumns(lacked).select(*ITEM, "field_type", "pred", "truth", "pred_value", "gt_value", *MEASURES)

    told = [*ITEM, "field_type", "pred_value", "gt_value"]
    hit = F.col("lenient").cast("double")
    scalar = match_scalars(of("scalar", SCALARS, F.col).withColumns({"pred": F.col("pred_value"), "truth": F.col("gt_value")}), compose=False)
    scalar = scalar.withColumns({"precision": hit, "recall": hit, "f1": hit, "strict_f1": F.col("strict").cast("double")}).withColumnRenamed("diacritic_only", "diacritic_only_mismatch")
    listed = match_lists(of("list", LISTS, list_text), told, "_p", "_t", compose=False)
    nutrition = match_nutrition(of("nutrition", ("nutrition",), nutrition_text), told, "_p", "_t", compose=False)
    nutrition = nutrition.withColumnsRenamed({"name_precision": "precision", "name_recall": "recall", "name_f1": "f1"})
    return whole(scalar).unionByName(whole(listed)).unionByName(whole(nutrition))


def field_table(scored: DataFrame) -> DataFrame:
    """The field score table of score_records()."""
    return scored.select(*KEYS, "field", "field_type", "precision", "recall", "f1", "strict_f1", "similarity", "diacritic_only_mismatch", "pairing_accuracy", "value_accuracy", "json_valid", "api_error")


def image_table(scored: DataFrame) -> DataFrame:
    """The image score table of score_records(): means over the nine fields, lenient and with strict scalars."""
    return scored.groupBy(*KEYS).agg(
        F.avg("f1").alias("macro_field_f1"),
        F.avg(F.coalesce("strict_f1", "f1")).alias("macro_field_f1_strict"),
        F.coalesce(F.max("pairing_accuracy"), F.lit(1.0)).alias("pairing_accuracy"),
        F.bool_and("json_valid").alias("json_valid"),
        F.max("api_error").alias("api_error"),
        F.max(F.size("structural_issues")).alias("n_structural_issues"),
    )
