"""Fields and lists that repeat are matched once in the job, and rows find what was matched by one number."""

import pytest
from pyspark.sql import functions as F

from scorewright.operators import match
from scorewright.queries import QUERIES, fields

PARTS = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Sixty records of two contents, one without a name, of which the last eleven share two cut ids; then one key twice."""
    path = str(tmp_path_factory.mktemp("repeats"))
    keys = [*(60 * k + 12 for k in range(46)), 100_000, 100_001, *range(1_000_000, 1_000_020, 2), 7, 7]
    rows = [(k, None if k == 7 else "mint red" if n % 2 else "sky", "Brand#1", "TIN", 5) for n, k in enumerate(keys)]
    spark.createDataFrame(rows, PARTS).write.parquet(f"{path}/part.parquet")
    return path


def test_lists_that_repeat_are_matched_once(spark, tables, monkeypatch):
    seen, own = [], match.match_lists
    monkeypatch.setattr(fields.match, "match_lists", lambda d, *a: (seen.append((d.count(), d.select("pred", "truth").distinct().count())), own(d, *a))[1])
    got = QUERIES["e6_match_lists"](spark, tables)
    assert seen[0][0] < 40 < got.count()


@pytest.mark.parametrize("name", ["g2_model_summary", "g1_model_field_summary", "f2_field_scores", "g12_exact_match", "f3_image_scores", "f4_macro_field_f1", "g10_field_matrix"])
def test_rows_are_neither_sent_to_python_nor_shuffled_by_their_values(spark, tables, name):
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "_of_all" in x]
    assert len(joins) == 2 and all("BroadcastHashJoin [_all" in x for x in joins)
    assert "pair_ratios" not in plan and "token_ratio" not in plan


def test_field_scores_are_those_of_each_row_for_itself(spark, tables):
    """Also for names that are missing, keys that are there twice, and ids that records share."""
    from scorewright.operators import score

    lists = fields.rows(spark, tables, "lists", *fields.LISTS)
    want = score.field_scores(match.match_scalars(fields.scalar_rows(spark, tables)), match.match_lists(lists, fields.KEYS))
    got = fields.field_scores(spark, tables)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_values_of_one_number_stay_apart(spark, monkeypatch):
    """With the same number for all values, rows meet only what was found for theirs; nulls meet nulls."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    d = spark.createDataFrame([(k, t, [t, None]) for k, t in enumerate(["a", None, "b", "a", ""])], "k int, t string, l array<string>")
    d = match.once_each(d, ["t", "l"], lambda x: x.withColumn("n", F.concat_ws("-", F.lit("of"), "t", F.size("l").cast("string"))))
    assert sorted((r["k"], r["n"]) for r in d.collect()) == [(0, "of-a-2"), (1, "of-2"), (2, "of-b-2"), (3, "of-a-2"), (4, "of--2")]
