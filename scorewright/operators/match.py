"""Matching of scalar, list and nutrition fields."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scorewright.functions.columns import let, once
from scorewright.functions.similarity import _ratio, pair_ratios, sorted_tokens, token_ratio
from scorewright.functions.text import canonical_nutrient, composed, normalize_date, normalize_text, number_unit, strip_diacritics
from scorewright.operators.assign import assigned
from scorewright.sources.tables import stored

#: Thresholds of similarity (fixed values).
LENIENT, LIST, NAME = 90.0, 80.0, 75.0
SCALARS = ("product_name", "origin", "net_weight", "mfg_date", "expiry_date")
LISTS = ("ingredient", "additive", "warning")
DATES = ("mfg_date", "expiry_date")


def close(p: Column, g: Column) -> Column:
    return F.abs(p - g) <= F.greatest(0.05 * F.abs(g), F.lit(0.05))


def match_scalars(df: DataFrame, field: str = "field", pred: str = "pred", truth: str = "truth", compose: bool = True) -> DataFrame:
    """df with strict, lenient, similarity and diacritic_only of its (field, pred, truth) rows.

    Weights with close numbers and no unit against them, and equal dates, match in full; else the text decides. Texts
    are compared in composed form; with compose = False they are taken to be in it.
    """
    d = composed(df, pred, truth, to=("_cp", "_cg")) if compose else df.withColumns({"_cp": F.col(pred), "_cg": F.col(truth)})
    # Numbers are read of weights alone and dates of dates alone.
    weighs, dated = F.col(field) == "net_weight", F.col(field).isin(*DATES)
    d = d.withColumns({"_p": normalize_text("_cp"), "_g": normalize_text("_cg"), "_pn": F.when(weighs, number_unit("_cp")), "_gn": F.when(weighs, number_unit("_cg")), "_pd": F.when(dated, normalize_date("_cp")), "_gd": F.when(dated, normalize_date("_cg"))})
    units = F.col("_pn.unit").isNull() | F.col("_gn.unit").isNull() | (F.col("_pn.unit") == F.col("_gn.unit"))
    weight = weighs & close(F.col("_pn.number"), F.col("_gn.number")) & units
    date = dated & (F.col("_pd") == F.col("_gd")) & (F.col("_gd") != "")
    d = d.withColumn("_strict", F.coalesce(weight | date, F.lit(False)) | (F.col("_p") == F.col("_g")))
    tokens = lambda c: F.when(~F.col("_strict"), sorted_tokens(F.col(c)))
    d = d.withColumn("_sim", F.coalesce(token_ratio(tokens("_p"), tokens("_g")), F.lit(100.0)))
    d = d.withColumns({"strict": F.col("_strict"), "lenient": F.col("_strict") | (F.col("_sim") >= LENIENT), "similarity": F.when(F.col("_strict"), 100.0).otherwise(F.col("_sim"))})
    return d.withColumn("diacritic_only", ~F.col("_strict") & (F.col("_g") != "") & (strip_diacritics("_p") == strip_diacritics("_g"))).drop("_cp", "_cg", "_p", "_g", "_pn", "_gn", "_pd", "_gd", "_strict", "_sim")


def match_distinct(df: DataFrame, field: str = "field", pred: str = "pred", truth: str = "truth", then: Callable[[DataFrame], DataFrame] | None = None, store: bool = False) -> DataFrame:
    """match_scalars() for tables in which fields repeat, as weights, dates and brands do: each different (field, pred,
    truth) is matched once in the job, as is what then() makes of it, and what is found is joined back. All rows stay, and
    nulls meet nulls. With store it is done by once_each(), now, so that rows are not shuffled if little is found."""
    cols = [field, pred, truth]
    work = lambda d: then(match_scalars(d, *cols)) if then else match_scalars(d, *cols)
    return once_each(df, cols, work) if store else _met(df, work(df.select(*cols).distinct()), cols)


def _met(df: DataFrame, found: DataFrame, cols: list[str]) -> DataFrame:
    """df with what was found for its values of cols, which found has once each.

    Rows meet by one number made of the values, which is quicker to look up than several texts, and then compare the values
    (strings, or arrays and structs of them), so those of one number by chance stay apart.
    """
    found = found.withColumnsRenamed({c: f"_of_{c}" for c in cols}).withColumn("_of_all", F.xxhash64(*(f"_of_{c}" for c in cols)))

    def same(a: Column, b: Column) -> Column:
        """a <=> b in a form that is no key of the join."""
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((a <= b) & (a >= b))

    meets = reduce(lambda a, b: a & b, (same(F.col(c), F.col(f"_of_{c}")) for c in cols), F.col("_all") == F.col("_of_all"))
    return df.withColumn("_all", F.xxhash64(*cols)).join(found, meets).drop("_all", "_of_all", *(f"_of_{c}" for c in cols))


def once_each(df: DataFrame, cols: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that work() adds to a table of cols, done once in the job for each different value of them.

    df is read twice, so it should be a stored table, columns of one, or a cheap step from tables. What is found is stored,
    so Spark knows its size: a small table goes to every task, and df is not shuffled; for a large one both are. All rows
    stay, and nulls meet nulls.
    """
    spark = df.sparkSession
    asked = stored(spark, df.select(*cols).distinct(), "asked")
    slots = spark.sparkContext.defaultParallelism
    asked = asked if asked.rdd.getNumPartitions() >= slots else asked.repartition(slots)
    return _met(df, stored(spark, work(asked), "found"), cols)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


@once
@F.pandas_udf(DoubleType())
def _nearest(text: pd.Series, items: pd.Series) -> pd.Series:
    """Greatest similarity of a text to any of the items; null for null. Items too long or short to beat the best are skipped."""

    def nearest(t: str, items) -> float:
        best = 0.0
        for y in items:
            if t == y or 200.0 * min(len(t), len(y)) > best * (len(t) + len(y)):
                best = max(best, _ratio(t, y))
        return best

    return pd.Series([None if t is None or x is None else nearest(t, x) for t, x in zip(text, items, strict=True)], dtype="float64")


def merge_bonus(left: DataFrame, threshold: float = LIST) -> DataFrame:
    """left with extra_pred and extra_truth, from the items that the assignment left (left_pred, left_truth).

    All left on one side, joined in order, against any left on the other; joined truth is tried first. Only records with
    items left on both sides, and several on one, reach Python.
    """
    ready = lambda c: sorted_tokens(normalize_text(c))
    some = (F.size("left_pred") > 0) & (F.size("left_truth") > 0)

    def meets(one: str, many: str) -> Column:
        ask = some & (F.size(many) > 1)
        near = _nearest(F.when(ask, ready(F.array_join(many, " "))), F.when(ask, F.transform(one, ready)))
        return F.coalesce(near >= threshold, F.lit(False))

    d = left.withColumns({"_t": meets("left_pred", "left_truth"), "_p": meets("left_truth", "left_pred")})
    extra = lambda on_truth, on_pred: F.when(F.col("_t"), on_truth).when(F.col("_p"), on_pred).otherwise(0)
    return d.withColumns({"extra_pred": extra(F.lit(1), F.size("left_pred")), "extra_truth": extra(F.size("left_truth"), F.lit(1))}).drop("_t", "_p")


def _ratios(p: Column, t: Column) -> Column:
    """pair_ratios, or null where both arrays are the same."""
    other = ~p.eqNullSafe(t)
    return pair_ratios(F.when(other, p), F.when(other, t))


def match_lists(df: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth", threshold: float = LIST, compose: bool = True) -> DataFrame:
    """One row per record: keys, n_pred, n_truth, tp, extra_pred, extra_truth, precision, recall, f1, from its own row."""
    d = df.select(*keys, F.coalesce(pred, F.array().cast("array<string>")).alias("pred"), F.coalesce(truth, F.array().cast("array<string>")).alias("truth"))
    d = composed(d, "pred", "truth") if compose else d
    ready = lambda c: F.transform(c, lambda x: sorted_tokens(normalize_text(x)))
    d = d.withColumns({"_p": ready("pred"), "_t": ready("truth"), "n_pred": F.size("pred"), "n_truth": F.size("truth")})
    d = d.withColumn("_sims", _ratios(F.col("_p"), F.col("_t")))
    d = d.withColumn("_hits", assigned(F.col("_sims"), F.col("n_pred"), F.col("n_truth"), threshold))
    rest = lambda items, side: F.filter(items, lambda x, k: ~F.array_contains(F.transform("_hits", lambda h: h[side]), k))
    d = merge_bonus(d.withColumns({"left_pred": rest("pred", "i"), "left_truth": rest("truth", "j")}), threshold)
    d = d.select(*keys, "n_pred", "n_truth", F.size("_hits").alias("tp"), "extra_pred", "extra_truth")
    p = F.when(F.col("n_pred") == 0, 1.0).otherwise((F.col("tp") + F.col("extra_pred")) / F.col("n_pred"))
    r = F.when(F.col("n_truth") == 0, 1.0).otherwise((F.col("tp") + F.col("extra_truth")) / F.col("n_truth"))
    return d.withColumns({"precision": p, "recall": r}).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _fits(p: Column, g: Column) -> Column:
    """Whether a value fits, of structs (nu, text): without a true number the texts decide; units count where both are given."""
    units = p["nu"]["unit"].isNull() | g["nu"]["unit"].isNull() | (p["nu"]["unit"] == g["nu"]["unit"])
    return F.when(g["nu"]["number"].isNull(), p["text"] == g["text"]).otherwise(F.coalesce(close(p["nu"]["number"], g["nu"]["number"]) & units, F.lit(False)))


def value_matches(pred: Column | str, truth: Column | str) -> Column:
    side = lambda c: F.struct(number_unit(c).alias("nu"), normalize_text(c).alias("text"))
    return let(F.struct(side(pred).alias("p"), side(truth).alias("g")), lambda x: _fits(x["p"], x["g"]))


def match_nutrition(df: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth", threshold: float = NAME, compose: bool = True) -> DataFrame:
    """One row per record: keys, n_pred, n_truth, n_matched, n_correct, n_pairing_errors and the accuracies.

    pred and truth are arrays of (name, value). A wrong value that fits another true row is a pairing error.
    """
    none = F.array().cast("array<struct<name:string,value:string>>")
    d = df.select(*keys, F.coalesce(pred, none).alias("pred"), F.coalesce(truth, none).alias("truth"))
    d = composed(d, "pred", "truth") if compose else d

    def item(e: Column) -> Column:
        return F.struct(canonical_nutrient(e["name"]).alias("name"), number_unit(e["value"]).alias("nu"), normalize_text(e["value"]).alias("text"))

    d = d.withColumns({"_p": F.transform("pred", item), "_t": F.transform("truth", item), "n_pred": F.size("pred"), "n_truth": F.size("truth")})
    part = lambda c, f: F.transform(c, lambda x: x[f])
    whole = part("_p", "name").eqNullSafe(part("_t", "name"))  # name by name the same nutrients
    tokens = lambda c: F.when(~whole, F.transform(c, lambda e: sorted_tokens(normalize_text(e["name"]))))
    raw = pair_ratios(tokens("pred"), tokens("truth"))
    d = d.withColumn("_raw", raw)
    same = F.flatten(F.transform("_p", lambda p: F.transform("_t", lambda t: p["name"] == t["name"])))
    d = d.withColumn("_sims", F.when(F.col("_raw").isNotNull(), F.zip_with("_raw", same, lambda x, y: F.when(y, 100.0).otherwise(x))))
    d = d.withColumn("_hits", assigned(F.col("_sims"), F.col("n_pred"), F.col("n_truth"), threshold))
    of = lambda c, k: F.get(c, k)
    fits = lambda h: _fits(of("_p", h["i"]), of("_t", h["j"]))
    other = lambda h: F.exists(F.sequence(F.lit(0), F.col("n_truth") - 1), lambda j: (j != h["j"]) & _fits(of("_p", h["i"]), of("_t", j)))
    d = d.withColumn("_right", F.transform("_hits", fits))
    wrong = F.filter(F.arrays_zip(F.col("_hits").alias("h"), F.col("_right").alias("ok")), lambda x: ~x["ok"] & other(x["h"]))
    d = d.select(*keys, "n_pred", "n_truth", F.size("_hits").cast("long").alias("n_matched"), F.size(F.filter("_right", lambda x: x)).cast("long").alias("n_correct"), F.size(wrong).cast("long").alias("n_pairing_errors"))
    n, m, g = F.col("n_pred"), F.col("n_matched"), F.col("n_truth")
    d = d.withColumns({"name_precision": F.when(n == 0, 1.0).otherwise(m / n), "name_recall": F.when(g == 0, 1.0).otherwise(m / g)})
    return d.withColumns(
        {
            "name_f1": _f1(F.col("name_precision"), F.col("name_recall")),
            "value_accuracy": F.when(m > 0, F.col("n_correct") / m).when(g == 0, 1.0).otherwise(0.0),
            "pairing_accuracy": F.when(g == 0, 1.0).otherwise(1 - F.col("n_pairing_errors") / g),
        }
    )
