"""Records above number 999,999, whose ids the bridges cut to six digits."""

from decimal import Decimal

import pytest

from scorewright.queries import QUERIES, records

KEYS = (7, 100_001, 1_000_010, 1_000_011, 1_000_012, 1_000_013)  # the last four share the id 100001 with the second


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("large"))
    rows = [(k, f"{a} {b}", f"Brand#{k % 5}", t, k % 50) for k, (a, b, t) in zip(KEYS, [("mint", "red", "STEEL"), ("lace", "blue", "TIN"), ("green", "gold", "BRASS"), ("sky", "dark", "STEEL"), ("plum", "pale", "TIN"), ("rose", "grey", "ZINC")], strict=True)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
    return path


def twin(name, path):
    import duckdb

    from scorewright.queries import ORACLES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{path}/part.parquet/*.parquet'")
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    return sorted(str(tuple(map(plain, r))) for r in con.execute(ORACLES[name]).fetchall())


def test_a_record_meets_its_own_truth_alone(spark, tables):
    """Nine fields for each of 6 records and 3 models, as below 999,999, not a product of all that share a cut id."""
    d = records.scored(spark, tables)
    assert d.count() == 6 * 3 * 9
    assert {r["count"] for r in d.groupBy(*records.KEYS, "field").count().collect()} == {1}
    assert QUERIES["j1_agreement_of_annotators"](spark, tables).count() == 6 - sum(k % 5 == 0 for k in KEYS)


@pytest.mark.parametrize("name", ["a3_dataset_index", "a9_upsert", "a9_upsert_last_wins", "a9_versioned_upsert", "b15_labelled_count", "b5_resolve_subset", "b9_perturbation_manifest"])
def test_items_that_share_a_cut_id_stay_apart(spark, tables, name):
    got = QUERIES[name](spark, tables)
    assert sorted(str(tuple(r)) for r in got.collect()) == twin(name, tables)


def test_paired_tests_tell_records_apart(spark, tables):
    """A cut id that several records share is no double entry: each of the six counts once in a pair of models."""
    rows = QUERIES["h6_mcnemar_by_field"](spark, tables).collect()
    assert len(rows) == 6 * 3 and {r["n"] for r in rows} == {len(KEYS)}


def test_fields_that_repeat_are_scored_once(spark, monkeypatch):
    """Forty records of the same content: each matcher sees each different pair of values once, and every record is scored."""
    from scorewright.operators import score

    seen = {}
    for name in ("match_scalars", "match_lists", "match_nutrition"):
        own = getattr(score, name)
        monkeypatch.setattr(score, name, lambda d, *a, _own=own, _name=name, **k: (seen.__setitem__(_name, d.count()), _own(d, *a, **k))[1])
    fields = "product_name string, origin string, net_weight string, mfg_date string, expiry_date string, ingredient array<string>, additive array<string>, warning array<string>, nutrition array<struct<name:string,value:string>>"
    pair = [("Fat", "5 g")]
    said = [(str(k), "m", "c", "tè a", None, "100gram", "1.2.2024", "", ["a", "té"], None, [], pair) for k in range(40)]
    true = [(str(k), "tè a", "x", "100 g", "2024-2-1", "", ["té", "b"], [], ["w"], pair) for k in range(40)]
    d = score.score_records(spark.createDataFrame(said, f"image_id string, model_key string, condition string, {fields}"), spark.createDataFrame(true, f"image_id string, {fields}"))
    rows = {(r["image_id"], r["field"]): r for r in d.collect()}
    assert d.count() == len(rows) == 360 and seen == {"match_scalars": 5, "match_lists": 3, "match_nutrition": 1}
    for k in range(40):
        assert [rows[str(k), f]["f1"] for f in score.FIELDS] == [1, 0, 1, 1, 1, 0.5, 1, 0, 1]
        assert rows[str(k), "product_name"]["pred_value"] == "tè a" and rows[str(k), "ingredient"]["pred_value"] == "a | té"
        assert rows[str(k), "origin"]["pred"] == "" and rows[str(k), "additive"]["n_pred"] == 0


def test_lists_and_nutrition_that_repeat_are_matched_once(spark, tables, monkeypatch):
    """Nutrition of the six records and three models has fewer different pairs than answers, and no answer is lost."""
    seen = []
    own = records.match_nutrition
    monkeypatch.setattr(records, "match_nutrition", lambda d, *a: (seen.append(d.count()), own(d, *a))[1])
    d = QUERIES["e9_match_nutrition_names"](spark, tables)
    rows = d.collect()
    assert len(rows) == 18 > seen[0] and {r["image_id"] for r in rows} == {str(k).zfill(6) for k in KEYS}


def test_nutrition_of_orders_that_repeats_is_matched_once(spark, tmp_path, monkeypatch):
    """Forty orders of two contents: each is matched once, and every order has its row."""
    from scorewright.queries import fields

    seen = []
    own = fields.match.match_nutrition
    monkeypatch.setattr(fields.match, "match_nutrition", lambda d, *a: (seen.append(d.count()), own(d, *a))[1])
    rows = [(4 * k, n, n, n, float(n + k % 2), 1.0) for k in range(40) for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["e9_match_nutrition"](spark, str(tmp_path)).collect()
    assert sorted(r["l_orderkey"] for r in got) == [4 * k for k in range(40)] and seen == [2]
    assert {(r["n_truth"], r["n_matched"], r["n_correct"], r["value_accuracy"], r["pairing_accuracy"]) for r in got} == {(2, 2, 2, 1.0, 1.0)}


def test_categories_are_made_once_for_different_values(spark, tables, monkeypatch):
    """Errors of the same field, answer and truth get their category from one row, and no error is lost."""
    from scorewright.queries import reports

    seen, own = [], reports._categorised
    monkeypatch.setattr(reports, "_categorised", lambda d: (seen.append((d.count(), d.distinct().count())), own(d))[1])
    got = QUERIES["i3_scalar_categories"](spark, tables)
    assert sorted(str(tuple(r)) for r in got.collect()) == twin("i3_scalar_categories", tables)
    assert seen[0][0] == seen[0][1] < QUERIES["e5_match_scalars"](spark, tables).count()
