"""Answers whose fields all have their types are read in one step, with the results of reading value by value."""

import pytest
from pyspark.sql import functions as F

from scorewright.operators import parse as P

NEVER = "(?!)"
ANSWERS = [
    '{"product_name": "a", "origin": null, "ingredient": ["x", null], "nutrition": [{"name": "Fat", "value": "5 g"}]}',
    '{"nutrition": [{"name": "Fat"}, {"value": "5 g"}], "warning": []}',
    '{"nutrition": [{"name": "Fat", "value": null}, null], "additive": null}',
    '{"nutrition": [{}], "origin": 5, "warning": "x"}',
    '{"additive: VOID, x": 1, "origin": "a"}',
    '{"ingredient": [1, "x", [2]], "product_name": true}',
    "{}",
    "no object",
    None,
]


def read(spark, answers):
    d = spark.createDataFrame(list(enumerate(answers)), "k int, content string").withColumn("finish_reason", F.lit("stop"))
    d = P.structural_issues(P.coerce(P.parse(d)))
    return {r["k"]: tuple(r) for r in d.select("k", "stage", *P.ALL_FIELDS, "type_issues", "missing_issues", "json_valid", "structural_issues").collect()}


def test_one_step_gives_what_value_by_value_gives(spark, monkeypatch):
    quick = read(spark, ANSWERS)
    monkeypatch.setattr(P, "PLAIN", NEVER)
    assert quick == read(spark, ANSWERS) and len(quick) == len(ANSWERS)


def test_plain_records_need_no_coercion_of_values(spark):
    kinds = spark.createDataFrame([(a,) for a in ANSWERS[:7]], "content string").select(F.schema_of_variant(F.parse_json("content")).rlike(P.PLAIN).alias("plain")).collect()
    assert [r["plain"] for r in kinds] == [True, True, False, False, False, False, True]


@pytest.mark.parametrize("text", ["{},[[0]]", "{}],[[0", "{},[[0]]] x", "{}, {}", "{}]", "{}, null", "[{}]", '{"a":1},', "{} x", ""])
def test_more_than_one_object_is_none(spark, text):
    assert spark.createDataFrame([(text,)], "c string").select(P.strict_object(F.col("c")).isNull().alias("x")).first()["x"]


def test_lists_in_lists_are_read_whole(spark):
    row = spark.createDataFrame([(' {"a": [[0]]}\n',)], "c string").select(P.strict_object(F.col("c")).cast("string").alias("x")).first()
    assert row["x"] == '{"a":[[0]]}'
