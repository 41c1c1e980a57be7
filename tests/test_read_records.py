"""Answers of plain records are read in one step beside the ladder, with the results of the ladder."""

import pytest

from scorewright.operators import parse as P
from scorewright.operators import score as S

PLAIN = [
    '{"product_name":"a \\"b\\" \\\\ ü","origin":"","ingredient":["x",""],"nutrition":[{"name":"Fat","value":"5 g"}]}',
    '{"ingredient":[],"nutrition":[]}',
    "{}",
]
OTHERS = [
    '{"ingredient":["x",null,""]}',
    '{"origin":"null"}',
    ' {"origin":"a"}',
    '{"origin":"a"} x',
    '{"origin":"a"}{"origin":"b"}',
    '{"origin": "a"}',
    '{"origin":null}',
    '{"origin":5,"net_weight":true}',
    '{"origin":{"a":1},"warning":["x",2,["y"]]}',
    '{"origin":"a","origin":"b"}',
    '{"origin":"a","product_name":"b"}',
    '{"origin":"a","more":"b"}',
    '{"Origin":"a"}',
    "{'origin':'a'}",
    '{"origin":"\\u00fc"}',
    '{"warning":"x"}',
    '{"nutrition":[{"name":"Fat"},{"value":"5 g"},{},null]}',
    '{"nutrition":[{"name":"Fat","value":5}]}',
    '{"nutrition":{"name":"Fat","value":"5 g"}}',
    '{"origin":"a',
    '```json\n{"origin":"a"}\n```',
    "[]",
    "no object",
    "",
    None,
]
COLUMNS = ["k", *P.ALL_FIELDS, "parse_failed", "used_repair", "type_issues", "missing_issues", "json_valid", "structural_issues"]


def answers(spark):
    return spark.createDataFrame([(k, c, "length" if k % 3 == 0 else "stop") for k, c in enumerate(PLAIN + OTHERS)], "k int, content string, finish_reason string")


def test_results_are_those_of_the_ladder(spark):
    rows = lambda d: sorted(map(tuple, P.structural_issues(d).select(*COLUMNS).collect()))
    d = answers(spark)
    assert rows(P.read_records(d)) == rows(P.coerce(P.parse(d)))


@pytest.mark.parametrize("compact", ["true", "false"])
def test_plain_records_do_not_reach_the_ladder(spark, monkeypatch, compact):
    """Whatever the session says of null fields."""
    seen = []

    def ladder(responses, content="content"):
        seen.extend(r["k"] for r in responses.where(f"{content} is not null").select("k").collect())
        return whole(responses, content)

    whole = P.parse
    monkeypatch.setattr(P, "parse", ladder)
    spark.conf.set("spark.sql.jsonGenerator.ignoreNullFields", compact)
    try:
        S.read_answers(answers(spark).selectExpr("*", "'a' AS image_id", "'m' AS model_key", "'c' AS condition", "CAST(NULL AS string) AS error"))
    finally:
        spark.conf.unset("spark.sql.jsonGenerator.ignoreNullFields")
    assert sorted(seen) == [len(PLAIN) + k for k, c in enumerate(OTHERS) if c is not None]


LACK = [
    '{"nutrition":[{"name":"Fat"},{"value":"5 g"},{},null]}',
    '{"nutrition":[{"name":"Fat","value":null},null],"additive":null}',
    '{"nutrition":[{"value":"5 g"},{"value":"6 g"}]}',
    '{"nutrition":[{"name":"Fat"},{"name":null}]}',
    '{"nutrition":[{},{}],"warning":["x",null]}',
    '{"nutrition":[{"name":""},{"name":"Fat","value":""}]}',
]


def test_items_without_name_or_value_are_read_without_coercion(spark, monkeypatch):
    d = spark.createDataFrame([(k, c, "stop") for k, c in enumerate(LACK)], "k int, content string, finish_reason string")
    rows = lambda d: sorted(map(tuple, P.structural_issues(d).select(*COLUMNS).collect()))
    quick = rows(P.coerce(P.parse(d)))
    told = d.selectExpr("schema_of_variant(parse_json(content)) AS s").collect()
    assert all(P.re.search(P.LACKING, r["s"]) or P.re.search(P.PLAIN, r["s"]) for r in told)
    monkeypatch.setattr(P, "PLAIN", "(?!)")
    monkeypatch.setattr(P, "LACKING", "(?!)")
    assert quick == rows(P.coerce(P.parse(d)))
