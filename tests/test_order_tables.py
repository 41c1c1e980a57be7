"""Nutrition of orders: the rows of its bridge, told apart and joined by little text."""

import pytest
from pyspark.sql import functions as F

from scorewright.functions import text as T
from scorewright.plans.bridges import NUTRITION, order_lines, order_tables, rows
from scorewright.queries import QUERIES, fields

LINES = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double"
ROWS = [
    *((k, n, 7 - n, 1, float(k + n), 2.5) for k in range(8) for n in (3, 1, 2)),
    *[(9, 1, 1, 1, 5.0, 1.0)] * 2,  # a line that is there twice
    *((10, 1, None, 1, x, 1.0) for x in (4.0, None, 3.0)),
    *((None, n, 1, 1, float(n), None) for n in (2, 1)),
    (13, 1, 1, 1, None, 1.0),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame(ROWS, LINES).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_tables_hold_the_rows_of_the_bridge(spark, tables):
    entries = lambda v: F.transform(F.sort_array(F.collect_list(F.struct("k", "name", F.col(v).alias("value")))), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))
    want = rows(spark, tables, "nutrition", NUTRITION).groupBy("l_orderkey").agg(entries("pred").alias("said"), entries("truth").alias("true"))
    got = order_tables(order_lines(spark, tables)).select("l_orderkey", "said", "true")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["e9_match_nutrition", "g3_nutrition_summary", "i5_nutrition_categories"])
def test_no_tables_are_stored_or_joined(spark, tables, monkeypatch, name):
    kept, own = [], fields.stored
    monkeypatch.setattr(fields, "stored", lambda s, d, n: (kept.append([f.dataType.simpleString() for f in d.schema]), own(s, d, n))[1])
    QUERIES[name](spark, tables).collect()
    assert kept == [["bigint", "string", "string"]]


def test_even_texts_are_as_the_others_become(spark, monkeypatch):
    texts = ["", "5 g", " 5 g", "5  g", "5 g ", "5 g\n", "5 g.", "a!", "A b", "it's \"x\"", "it’s", "lít", "a\tb", "a.b c", "1/2-3, (4) #5", "a b?!", "x" * 5000 + " y" * 5000, None]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    read = lambda: [r["n"] for r in d.select("k", T.normalize_text("t").alias("n")).orderBy("k").collect()]
    quick = read()
    monkeypatch.setattr(T, "UNEVEN", r"(?s)\A")
    assert quick == read()


def test_decomposed_values_are_found_in_arrays_and_structs(spark):
    d = spark.createDataFrame([([("tè", None), None], ["à", None]), ([("tè", "b")], None)], "a array<struct<name:string,value:string>>, b array<string>")
    got = T.composed(d, "a", "b").collect()
    assert [tuple(r) for r in got] == [([("tè", None), None], ["à", None]), ([("tè", "b")], None)]
    plan = T.composed(d, "a")._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(a" in plan  # values are looked at as they are; only odd ones are written as JSON
