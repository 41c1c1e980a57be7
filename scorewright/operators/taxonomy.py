"""Error categories of incorrect fields, and checks of annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.text import composed, normalize_text, number_unit
from scorewright.operators.match import close

LOW_CONFIDENCE = ("hallucination",)


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def scalar_category(field: Column, pred: Column, truth: Column, similarity: Column, diacritic_only: Column) -> Column:
    p, g = number_unit(pred), number_unit(truth)
    unit = (field == "net_weight") & close(p["number"], g["number"]) & ~p["unit"].eqNullSafe(g["unit"])
    return (
        F.when(diacritic_only, "diacritics")
        .when(_blank(pred) & ~_blank(truth), "missing_field")
        .when(_blank(truth) & ~_blank(pred), "hallucination")
        .when(F.coalesce(unit, F.lit(False)), "wrong_unit")
        .when(~_blank(truth) & (similarity < 20), "hallucination")
        .otherwise("wrong_value")
    )


def list_category(field: Column, n_pred: Column, n_truth: Column, precision: Column, recall: Column) -> Column:
    return (
        F.when((n_pred == 0) & (n_truth > 0), "missing_field")
        .when((n_truth == 0) & (n_pred > 0), "hallucination")
        .when((field == "additive") & (recall < 1), "missing_additive")
        .when(precision < recall, "hallucination")
        .otherwise("wrong_value")
    )


def nutrition_category(n_pred: Column, n_truth: Column, pairing: Column, value: Column, precision: Column, recall: Column) -> Column:
    return (
        F.when((n_pred == 0) & (n_truth > 0), "missing_field")
        .when((n_truth == 0) & (n_pred > 0), "hallucination")
        .when(pairing < 1, "pairing_error")
        .when(value < 1, "wrong_value")
        .when(precision < recall, "hallucination")
        .when(recall < 1, "missing_field")
        .otherwise("wrong_value")
    )


def classify(json_valid: Column, issues: Column, field_type: Column, scalar: Column, of_list: Column, nutrition: Column) -> Column:
    """The first category that holds; an unknown field type is an error."""
    return (
        F.when(~json_valid | F.array_contains(issues, "json_parse_failed"), "malformed_json")
        .when(F.array_contains(issues, "output_truncated"), "output_truncated")
        .when(F.array_contains(issues, "generation_loop_detected"), "generation_loop")
        .when(field_type == "scalar", scalar)
        .when(field_type == "list", of_list)
        .when(field_type == "nutrition", nutrition)
        .otherwise(F.raise_error(F.concat(F.lit("unknown field type: "), F.coalesce(field_type, F.lit("null")))))
    )


def incorrect_scalars(scored: DataFrame) -> DataFrame:
    return scored.where("not lenient").withColumn("score", F.col("similarity") / 100)


def incorrect_fields(scored: DataFrame) -> DataFrame:
    """Rows of score_records() that are wrong, with their score and category."""
    c = F.col
    wrong = F.when(c("field_type") == "scalar", ~c("lenient")).when(c("field_type") == "list", c("f1") < 1).otherwise((c("f1") < 1) | (c("pairing_accuracy") < 1) | (c("value_accuracy") < 1))
    scalar = scalar_category(c("field"), c("pred"), c("truth"), c("similarity"), c("diacritic_only_mismatch"))
    of_list = list_category(*map(c, ("field", "n_pred", "n_truth", "precision", "recall")))
    nutrition = nutrition_category(*map(c, ("n_pred", "n_truth", "pairing_accuracy", "value_accuracy", "precision", "recall")))
    category = classify(c("json_valid"), c("structural_issues"), c("field_type"), scalar, of_list, nutrition)
    return scored.where(wrong).withColumns({"score": F.when(c("field_type") == "scalar", c("similarity") / 100).otherwise(c("f1")), "error_category": category})


def error_rows(incorrect: DataFrame) -> DataFrame:
    """The 14 columns of the error table, from incorrect_fields()."""
    return incorrect.select(
        "image_id", "model_key", "condition", "field", "field_type", F.bround("score", 3).alias("score"), "pred_value", "gt_value", "json_valid", F.coalesce("api_error", F.lit("")).alias("api_error"),
        F.array_join("structural_issues", "; ").alias("structural_issues"), "error_category", low_confidence("error_category").alias("low_confidence"), F.lit("").alias("notes"),
    )


def low_confidence(category: Column | str) -> Column:
    return (F.col(category) if isinstance(category, str) else category).isin(*LOW_CONFIDENCE)


def label_conflicts(labels: DataFrame) -> DataFrame:
    """Labels whose ingredient and additive lists share a string: image_id, shared."""
    return labels.where(F.arrays_overlap("ingredient", "additive")).select("image_id", F.array_sort(F.array_intersect("ingredient", "additive")).alias("shared"))


def dates_in_warnings(labels: DataFrame) -> DataFrame:
    """Labels that repeat a date text among the warnings: image_id."""
    labels = composed(labels, "warning", "mfg_date", "expiry_date")
    said = F.transform("warning", lambda w: normalize_text(w))
    hit = lambda f: (normalize_text(f) != "") & F.array_contains(said, normalize_text(f))
    return labels.where(hit("mfg_date") | hit("expiry_date")).select("image_id")
