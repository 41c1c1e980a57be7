import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.operators import match, parse, report, taxonomy
from scorewright.operators.assign import solve
from scorewright.plans import selection
from scorewright.sources import tables
from scorewright.streaming import chunks


def test_solve_against_brute_force():
    rng = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 6), repeat=2):
        sim = rng.integers(0, 5, (n, m)).astype(float)
        small, large = sorted((n, m))
        best = max(sum((sim if n <= m else sim.T)[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        pairs = solve(sim)
        assert len(pairs) == small and len({i for i, _ in pairs}) == small and sum(sim[i, j] for i, j in pairs) == best


def scalar(spark, rows):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, field string, pred string, truth string")
    return [(r["strict"], r["lenient"], r["diacritic_only"]) for r in match.match_scalars(d).orderBy("i").collect()]


def test_scalars(spark):
    got = scalar(spark, [("expiry_date", "see “best before” on pack.", 'See "BEST BEFORE" on pack'), ("origin", "Viet Nam", "Việt Nam"), ("net_weight", "140g", "140 g (14 g x 10 cây)."), ("net_weight", "140 mg", "140 g"), ("origin", None, None), ("mfg_date", "1/2/2026", "2026-02-01")])
    assert got == [(True, True, False), (False, False, True), (True, True, False), (False, True, False), (True, True, False), (True, True, False)]


def lists(spark, pred, truth):
    d = spark.createDataFrame([(1, pred, truth)], "k int, pred array<string>, truth array<string>")
    r = match.match_lists(d, ["k"]).first()
    return r["tp"], round(r["precision"], 3), round(r["recall"], 3)


def test_lists(spark):
    assert lists(spark, [], []) == (0, 1, 1)
    assert lists(spark, [], ["a"]) == (0, 1, 0)
    assert lists(spark, None, ["a"]) == (0, 1, 0)
    assert lists(spark, ["ab", "b"], ["ab", "a"]) == (0, 0, 0)  # a better total gives up the equal pair
    assert lists(spark, ["sữa", "đậu", "x"], ["đậu", "sữa", "bột"]) == (2, 0.667, 0.667)
    assert lists(spark, ["Keep dry. Keep cool and dark."], ["Keep dry.", "Keep cool and dark."])[1:] == (1, 1)


def test_nutrition(spark):
    e = "array<struct<name:string,value:string>>"
    rows = [(1, [("Energy", "70 kcal"), ("Fat", "5 g")], [("Năng lượng", "70 kcal"), ("Chất béo", "5 g")]), (2, [("Fat", "9 g"), ("Protein", "5 g")], [("Fat", "5 g"), ("Protein", "9 g")]), (3, [("Fat", "8 g")], [("Fat", "5 g")]), (4, [], [])]
    got = {r["k"]: (r["n_matched"], r["n_correct"], r["n_pairing_errors"], r["value_accuracy"], r["pairing_accuracy"]) for r in match.match_nutrition(spark.createDataFrame(rows, f"k int, pred {e}, truth {e}"), ["k"]).collect()}
    assert got == {1: (2, 2, 0, 1, 1), 2: (2, 0, 2, 0, 0), 3: (1, 0, 0, 0, 1), 4: (0, 0, 0, 1, 1)}


def test_parse(spark):
    texts = ['{"a": 1}', '```json\n{"a": 1}\n```', 'So: {"a": 1} there', '{"a": 1,}', '{"a": "x", "b": ["y", "z', "I cannot.", "", "[1, 2, 3]", '{"a": 1} trailing', None]
    d = parse.parse(spark.createDataFrame(list(enumerate(texts)), "i int, content string"))
    assert [r["stage"] for r in d.orderBy("i").collect()] == ["text", "fenced", "span", "mended", "mended", "failed", "failed", "failed", "span", "failed"]


def test_coerce(spark):
    answer = {"product_name": 5, "ingredient": "flour", "additive": 3, "warning": ["a", None, 1.0, True], "nutrition": [{"name": "Fat", "value": None}, "x", {"value": "1"}, {"name": "Salt", "value": 2}], "origin": None, "net_weight": "1 g", "mfg_date": ""}
    r = parse.coerce(parse.parse(spark.createDataFrame([(json.dumps(answer),)], "content string"))).first()
    assert (r["product_name"], r["origin"], r["ingredient"], r["additive"], r["warning"]) == ("5", "", ["flour"], [], ["a", "", "1.0", "True"])
    assert [tuple(x) for x in r["nutrition"]] == [("Fat", ""), ("Salt", "2")]
    assert r["type_issues"][:3] == ["product_name: expected str, got int; stringified", "ingredient: expected list, got str; wrapped in single-item list", "additive: expected list, got int; discarded"]
    assert "nutrition[1]: expected object, got str; skipped" in r["type_issues"] and "nutrition[2]: missing 'name'; skipped" in r["type_issues"]
    assert r["missing_issues"] == ["expiry_date: missing from output; defaulted"]


def test_statistics(spark):
    d = spark.createDataFrame([("b", 0.04), ("a", 0.01), ("c", 0.03)], "group_a string, p_value double").withColumn("s", F.lit(1))
    got = {r["group_a"]: round(r["p_holm"], 6) for r in report.holm(d, ["s"], tie=("group_a",)).collect()}
    assert got == {"a": 0.03, "c": 0.06, "b": 0.06}
    t = spark.createDataFrame([(10, 1, 5, 2, 2), (100, 10, 30, 50, 10)], "n long, a_only long, b_only long, both_correct long, both_wrong long")
    got = {r["n"]: (r["exact"], round(r["p_value"], 6)) for r in report.mcnemar_test(t).collect()}
    assert got == {10: (True, 0.21875), 100: (False, 0.002663)}


def test_taxonomy(spark):
    d = spark.createDataFrame([("net_weight", "5 kg", "5 g", 80.0, False), ("origin", "", "x", 0.0, False), ("origin", "zzz", "abc", 0.0, False), ("origin", "y", "", 0.0, False), ("origin", "Viet", "Việt", 75.0, True), ("origin", "abd", "abc", 66.0, False)], "field string, pred string, truth string, similarity double, diacritic_only boolean")
    got = [r[0] for r in d.coalesce(1).select(taxonomy.scalar_category(*map(F.col, d.columns))).collect()]
    assert got == ["wrong_unit", "missing_field", "hallucination", "hallucination", "diacritics", "wrong_value"]


def test_selection(spark):
    models = spark.createDataFrame([("a", "v/a"), ("b", "v/b")], "key string, slug string")
    assert [r["key"] for r in selection.select_models(models, ["v/b", "a"]).orderBy("position").collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="unknown"):
        selection.select_models(models, ["zzz"])
    items = spark.createDataFrame([(f"{i:04d}",) for i in range(1, 21)], "image_id string")
    assert selection.select_ids(items, start=18).count() == 3
    assert [r[0] for r in selection.select_ids(items, ids=["3"]).collect()] == ["0003"]
    with pytest.raises(ValueError, match="ends before"):
        selection.select_ids(items, start=5, end=2)
    assert selection.sample_subset(items, 5).repartition(3).orderBy("image_id").collect() == selection.sample_subset(items.repartition(5), 5).orderBy("image_id").collect()


def test_labels(spark, tmp_path):
    full = {"product_name": "Bánh", "origin": None, "net_weight": "1 g", "mfg_date": "", "expiry_date": "", "ingredient": None, "nutrition": [{"name": "Fat", "value": "1 g"}], "more": 1}
    (tmp_path / "0001.json").write_text(json.dumps(full))
    r = tables.read_labels(spark, str(tmp_path)).first()
    assert (r["image_id"], r["origin"], r["ingredient"], r["nutrition"][0]["name"]) == ("0001", "", [], "Fat")
    (tmp_path / "0002.json").write_text(json.dumps({k: v for k, v in full.items() if k != "product_name"}))
    with pytest.raises(Exception, match="missing product_name"):
        tables.read_labels(spark, str(tmp_path)).collect()


def test_upsert(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["image_id", "model_key", "condition"]
    row = lambda m, v, i="0001": spark.createDataFrame([(i, m, "vi_zero", v)], "image_id string, model_key string, condition string, f1 double")
    tables.upsert_scored(row("a", 0.1), path, keys)
    tables.upsert_scored(row("b", 0.2), path, keys)
    tables.upsert_scored(row("a", 0.3).unionByName(row("a", 0.4, "0002")), path, keys)
    got = sorted((r["image_id"], r["model_key"], r["f1"]) for r in spark.read.parquet(path).collect())
    assert got == [("0001", "a", 0.3), ("0001", "b", 0.2), ("0002", "a", 0.4)]


CHUNK = "response_id string, seq bigint, delta string, finish_reason string, prompt_tokens bigint, completion_tokens bigint"


def chunk_rows():
    loop = [("loop", k, "say it again, ", None, 5, None) for k in range(8)]
    return [("one", 1, "b", "stop", 3, 9), ("one", 0, "a", None, 3, None), ("none", 0, None, "stop", 1, None), ("gap", 7, "late", "stop", 4, None), ("gap", 3, "first ", None, 4, None), *loop]


def test_assembly(spark):
    got = {r["response_id"]: tuple(r)[1:] for r in chunks.assemble(spark.createDataFrame(chunk_rows(), CHUNK)).collect()}
    assert got["one"] == ("ab", "stop", 3, 9, 2) and got["none"] == (None, "stop", 1, 0, 1)
    assert got["gap"] == ("first late", "stop", 4, 2, 2)
    assert got["loop"] == ("say it again, " * 5, "loop_cutoff", 5, 5, 5)


def test_assembly_streams_alike(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = chunk_rows()
    for k in range(3):
        spark.createDataFrame(rows[k::3], CHUNK).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    try:
        out = chunks.assemble_stream(stream)
    except Exception as e:
        pytest.skip(f"stateful processing isn't available here: {e}")
    q = out.writeStream.outputMode("update").format("memory").queryName("assembled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.sql("SELECT * FROM assembled").collect():
        if r["response_id"] not in last or r["n_chunks"] >= last[r["response_id"]][-1]:
            last[r["response_id"]] = tuple(r)[1:]
    assert last == {r["response_id"]: tuple(r)[1:] for r in chunks.assemble(spark.createDataFrame(rows, CHUNK)).collect()}


def test_composed_and_decomposed_answers_match(spark):
    import unicodedata

    nfd = lambda s: unicodedata.normalize("NFD", s)
    assert scalar(spark, [("origin", nfd("Việt Nam"), "Việt Nam"), ("mfg_date", nfd("Ngày sản xuất"), "Ngày sản xuất.")]) == [(True, True, False)] * 2
    assert lists(spark, [nfd("Đường"), nfd("Bột mì")], ["Bột mì", "Đường"]) == (2, 1, 1)
    e = "array<struct<name:string,value:string>>"
    d = spark.createDataFrame([(1, [(nfd("Chất béo"), "5 g")], [("Chất béo", "5 g")])], f"k int, pred {e}, truth {e}")
    assert match.match_nutrition(d, ["k"]).first()["n_correct"] == 1
    labels = spark.createDataFrame([("1", [nfd("Hết hạn ở đáy")], "", "Hết hạn ở đáy.")], "image_id string, warning array<string>, mfg_date string, expiry_date string")
    assert taxonomy.dates_in_warnings(labels).count() == 1


def test_paired_tables_drop_nulls_and_refuse_duplicates(spark):
    rows = [("s", "1", "a", 1), ("s", "1", "b", 0), ("s", "2", "a", 1), ("s", "2", "b", None), ("s", "3", None, 1)]
    d = spark.createDataFrame(rows, "s string, image_id string, model_key string, correct int")
    r = report.mcnemar_table(d, ["s"]).collect()
    assert [(x["group_a"], x["group_b"], x["n"], x["a_only"]) for x in r] == [("a", "b", 1, 1)]
    with pytest.raises(Exception, match="more than one row"):
        report.mcnemar_table(d.unionByName(d), ["s"]).collect()


def test_bootstraps(spark):
    rng = np.random.default_rng(5)
    rows = [(f"{i:04d}", g, float(x)) for g, n in (("a", 300), (None, 200)) for i, x in enumerate(rng.normal(0.6, 0.2, n))] + [("x", "a", None), ("y", "c", None)]
    d = spark.createDataFrame(rows, "image_id string, g string, v double")
    poisson = {r["g"]: r for r in report.poisson_bootstrap(d.repartition(3), ["g"], "image_id", "v", 2000).collect()}
    drawn = {r["g"]: r for r in report.bootstrap_draws(d.repartition(2), ["g"], "image_id", "v", 2000).collect()}
    assert set(poisson) == set(drawn) == {"a", None}
    for g in poisson:
        v = np.array([x for i, h, x in sorted(rows, key=lambda r: r[0]) if h == g and x is not None])
        r, m = np.random.default_rng(42), []
        for _ in range(4):
            m.append(v[r.integers(0, len(v), (500, len(v)))].mean(axis=1))
        assert np.allclose(np.quantile(np.concatenate(m), [0.025, 0.975]), [drawn[g]["lo"], drawn[g]["hi"]])
        se = v.std() / len(v) ** 0.5
        assert poisson[g]["n"] == len(v) and abs(poisson[g]["lo"] - (v.mean() - 1.96 * se)) < 0.25 * se and abs(poisson[g]["hi"] - (v.mean() + 1.96 * se)) < 0.25 * se
    again = {r["g"]: r["lo"] for r in report.poisson_bootstrap(d.repartition(5), ["g"], "image_id", "v", 2000).collect()}
    assert all(abs(again[g] - poisson[g]["lo"]) < 1e-12 for g in again)


def test_similarities_side_by_side():
    """Pairs compared beside each other have the ratios of single ones: empty, equal, repeated, short, long and wide texts."""
    import random

    from scorewright.functions import similarity

    r = random.Random(5)
    word = lambda: "".join(r.choice("abc éñ😀") for _ in range(r.choice([0, 1, 7, 25, 63, 64, 65, 130])))
    a, b = ([word() for _ in range(800)] for _ in range(2))
    a, b = [*a, "", "x", "same", *a[:50]], [*b, "", "", "same", *b[:50]]
    assert similarity.ratios(a, b).tolist() == [similarity._ratio(x, y) for x, y in zip(a, b, strict=True)]
    assert similarity.ratios([], []).tolist() == []


def test_pair_ratios_of_arrays(spark):
    from scorewright.functions.similarity import pair_ratios

    rows = [(["a b", "c"], ["c", "a x"]), ([], ["a"]), (None, ["a"]), (["q"], ["q"])] * 40
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(pair_ratios("a", "b")).collect()]
    assert got == [[0.0, 200 * 2 / 6, 100.0, 0.0], [], None, [100.0]] * 40


def test_spread_of_one_split(spark):
    from scorewright.plans.bridges import spread

    n = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == n
    assert spread(spark.range(100, numPartitions=n + 3)).rdd.getNumPartitions() == n + 3


def test_bootstrap_sends_no_draws_through_the_driver(spark):
    """The draws are the larger side by far: they must be shuffled, whatever the planner takes their size for."""
    d = spark.range(3000).selectExpr("concat('g', id % 2) AS g", "CAST(id AS string) AS image_id", "CAST(id % 7 AS double) AS v")
    out = report.bootstrap(d, ["g"], "image_id", "v", 20)
    assert {(r["g"], r["n"]) for r in out.collect()} == {("g0", 1500), ("g1", 1500)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin [g" in plan and "_k" not in "".join(x for x in plan.splitlines() if "BroadcastHashJoin" in x)


def test_repeated_fields_are_matched_once(spark):
    """The same rows as match_scalars(), nulls and repeats too, while the matcher sees each different triple once."""
    from scorewright.operators import match

    some = [("net_weight", "100 g", "100gram"), ("net_weight", "5 kg", "5 g"), ("mfg_date", "1.2.2024", "2024-2-1"), ("product_name", "red tea", "tea rod"), ("product_name", None, "x"), ("origin", "Vietnam", None), ("origin", "100 g", "100 kg")]
    d = spark.createDataFrame([(k, *x) for k in range(5) for x in some], "id int, field string, pred string, truth string")
    rows = lambda x: sorted(map(str, x.select("id", "field", "pred", "truth", "strict", "lenient", "similarity", "diacritic_only").collect()))
    once = match.match_distinct(d)
    assert rows(once) == rows(match.match_scalars(d)) and once.count() == 35
    plan = once._jdf.queryExecution().optimizedPlan().toString().splitlines()
    calls = [k for k, x in enumerate(plan) if "ArrowEvalPython" in x]
    assert calls and all(any("Aggregate" in y for y in plan[k:]) for k in calls)
