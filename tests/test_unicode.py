"""Marks, composed forms and similarity over all of Unicode."""

import random
import unicodedata

from pyspark.sql import functions as F

from scorewright.functions import similarity as S
from scorewright.functions import text as T


def bare(s):
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn"))


def assigned():
    return [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x110000)] if unicodedata.category(chr(c)) not in ("Cn", "Co")]


def test_strip_diacritics_of_all_characters(spark):
    d = spark.createDataFrame([(c,) for c in assigned()], "c string").repartition(8)
    bad = [(r["c"], r["s"]) for r in d.select("c", T.stripped("c").alias("s")).collect() if r["s"] != bare(r["c"])]
    assert bad == []
    native = d.where(~F.col("c").rlike(T.RESIDUE)).select("c", T.strip_diacritics("c").alias("s")).collect()
    assert len(native) > 140_000 and all(r["s"] == bare(r["c"]) for r in native)


def test_strip_diacritics_of_texts(spark):
    r = random.Random(3)
    pools = ["Tiếng Việt đẹp ĐÁ", "йёά Ελλάδα ᾂῼ", "한국어 각ᄀ", "हिन्दी क़ बো", "אָלֶף شُكْر", "が か゚ ポ", "Å ﬁ 𝅗𝅥 ̈ ́"]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 20))) for _ in range(1500)]
    texts += [unicodedata.normalize("NFD", t) for t in [*texts[:500], *pools]] + pools + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.stripped("t").alias("s")).collect()
    assert [(r["t"], r["s"]) for r in rows if r["t"] is not None and r["s"] != bare(r["t"])] == []
    assert [r["s"] for r in rows if r["t"] is None] == [None]


def test_similarity_of_any_form(spark):
    nfd = lambda s: unicodedata.normalize("NFD", s)
    d = spark.createDataFrame([("chất béo", nfd("chất béo")), (nfd("Đường tổng số"), "total sugar"), (nfd("Bột mì"), "mì bột"), (None, "")], "a string, b string")
    got = d.select(S.token_sort_ratio("a", "b").alias("t"), S.name_similarity("a", "b").alias("n")).collect()
    assert [r["n"] for r in got] == [100.0] * 4 and [got[k]["t"] for k in (0, 2, 3)] == [100.0] * 3


def test_distinct_pairs(spark):
    """The same similarities as row by row; one pair may be that of most rows, and order doesn't matter."""
    r = random.Random(8)
    words = ["salt", "sugar", "Sugar.", "cane sugar", "sugar cane", "flour", "", "wheat flour of type", None]
    rows = [(k, r.choice(words), r.choice(words)) for k in range(300)] + [(k, "cane sugar", "cane suger") for k in range(300, 900)]
    d = spark.createDataFrame(rows, "sim int, p string, _found string").withColumnRenamed("_found", "t")
    want = {x["sim"]: x["s"] for x in d.select("sim", S.token_sort_ratio("p", "t").alias("s")).collect()}
    got = {x["sim"]: x["s"] for x in S.distinct_ratios(d, "p", "t", "s").collect()}
    assert got == want
    some = {x["sim"]: x["s"] for x in S.distinct_ratios(d, "p", "t", "s", 80.0).collect()}
    assert some == {k: v if v >= 80 else None for k, v in want.items()}
