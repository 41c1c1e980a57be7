import pytest
from pyspark.sql import functions as F

from scorewright.functions import text as T
from scorewright.functions.similarity import native_token_sort_ratio, token_sort_ratio


def values(spark, f, inputs):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, s string")
    return [r["x"] for r in d.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_normalize_text(spark):
    got = values(spark, T.normalize_text, ["See “BEST BEFORE” on pack.", "  a \t b\n", None, "Hi!?.", "Ở Việt Nam"])
    assert got == ['see "best before" on pack', "a b", "", "hi", "ở việt nam"]


def test_composed(spark):
    d = T.composed(spark.createDataFrame([("é",), ("é",), (None,)], "s string"), "s")
    assert sorted(str(r["s"]) for r in d.collect()) == ["None", "é", "é"]


def test_strip_diacritics(spark):
    assert values(spark, T.strip_diacritics, ["Đường đậu nành", "Việt Nam", "a"]) == ["Duong dau nanh", "Viet Nam", "a"]


def test_numbers(spark):
    inputs = ["34,242", "1.234", "1.234,5", "1,234.5", "1,234,5", "1.2.3", "140.", "none", None]
    assert values(spark, T.normalize_number, inputs) == [34.242, 1.234, 1234.5, 1.2345, None, None, 140.0, None, None]


def test_number_unit(spark):
    got = values(spark, T.number_unit, ["140 g (14 g x 10 cây).", "10-20g", "3 x 10g", "5g.", "70 kcal", "gram", "2 lít"])
    assert [tuple(x) for x in got] == [(140, "g"), (10, "-"), (3, "x"), (5, "g"), (70, "kcal"), (None, None), (2, "l")]


def test_dates(spark):
    got = values(spark, T.normalize_date, ["01/02/2026", "2026-2-1", "1.2.2026", "45/13/2026", "See pack."])
    assert got == ["2026-02-01", "2026-02-01", "2026-02-01", "2026-13-45", "see pack"]


def test_loops(spark):
    phrase, item = "the same words again ", '{"name": "Natri", "value": "5 mg"}, '
    assert values(spark, T.has_loop, ["a" * 20, "a" * 50, phrase * 6, item * 6, "Năng lượng 70 kcal, Chất đạm 2 g", None]) == [False, True, True, True, False, False]


@pytest.mark.parametrize("ratio", [token_sort_ratio, native_token_sort_ratio])
def test_token_sort_ratio(spark, ratio):
    d = spark.createDataFrame([("b a", "a b"), ("", ""), ("", "x"), ("140 mg", "140 g"), ("viet nam", "việt nam")], "a string, b string")
    got = [round(r[0], 1) for r in d.coalesce(1).select(ratio("a", "b")).collect()]
    assert got == [100.0, 100.0, 0.0, 90.9, 87.5]


def test_composed_nested(spark):
    d = spark.createDataFrame([(["é", "é", None], [("é", "x")]), (None, [])], "a array<string>, n array<struct<name:string,value:string>>")
    got = T.composed(d, "a", "n").collect()
    assert got[0]["a"] == ["é", "é", None] and got[0]["n"][0]["name"] == "é" and got[1]["a"] is None and got[1]["n"] == []
