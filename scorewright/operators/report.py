"""Summaries and statistics over scored tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from scorewright.functions.special import chi2_tail
from scorewright.functions.text import condition_parts

FIELDS = ("product_name", "ingredient", "additive", "warning", "nutrition", "origin", "net_weight", "mfg_date", "expiry_date")


def model_field_summary(field_scores: DataFrame) -> DataFrame:
    by = field_scores.where("model_key is not null and condition is not null and field is not null").groupBy("model_key", "condition", "field")
    return by.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count_distinct("image_id").alias("n_images"))


def model_summary(image_scores: DataFrame) -> DataFrame:
    by = image_scores.where("model_key is not null and condition is not null").groupBy("model_key", "condition")
    return by.agg(F.avg("macro_field_f1").alias("macro_field_f1"), F.avg("macro_field_f1_strict").alias("macro_field_f1_strict"), F.avg("pairing_accuracy").alias("pairing_accuracy"), F.avg(F.col("json_valid").cast("double")).alias("json_validity"), F.count_distinct("image_id").alias("n_images"))


def prompt_effects(scores: DataFrame, value: str = "score") -> DataFrame:
    """Models scored under all three prompt conditions: their means and the two effects."""
    names = ["vi_zero", "vi_one", "en_zero"]
    wide = scores.where(F.col("condition").isin(names)).groupBy("model_key").pivot("condition", names).agg(F.avg(value))
    wide = wide.where(" and ".join(f"{n} is not null" for n in names))
    return wide.withColumns({"shot_effect": F.col("vi_one") - F.col("vi_zero"), "language_effect": F.col("en_zero") - F.col("vi_zero")})


def degradation_curve(scores: DataFrame, clean_condition: str = "vi_zero", value: str = "score") -> DataFrame:
    """Mean by model, kind and severity; the clean condition over the perturbed ids is severity 0 of every kind."""
    parts = condition_parts("condition")
    perturbed = scores.withColumn("_c", parts).where("_c.severity is not null").select("image_id", "model_key", F.col("_c.kind").alias("kind"), F.col("_c.severity").alias("severity"), value)
    clean = scores.where(F.col("condition") == clean_condition).join(perturbed.select("image_id").distinct(), "image_id", "left_semi")
    kinds = perturbed.select("kind").distinct().agg(F.collect_set("kind").alias("kinds"))  # few: the kinds of perturbation
    base = clean.join(F.broadcast(kinds), F.lit(True)).select("image_id", "model_key", F.explode("kinds").alias("kind"), F.lit(0).alias("severity"), value)
    return base.unionByName(perturbed).groupBy("kind", "model_key", "severity").agg(F.avg(value).alias("mean"), F.count_distinct("image_id").alias("n_images")).orderBy("kind", "model_key", "severity")


def crosstab(errors: DataFrame, times: str | None = None) -> DataFrame:
    """Counts and shares within the model, by (model_key, category); times names a column of how often a row counts."""
    counts = errors.groupBy("model_key", "category").agg((F.sum(times) if times else F.count("*")).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("model_key")))


def cost_by_model(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("model_key").agg(F.sum("cost_usd").alias("cost_usd"))


def cost_effectiveness(summary: DataFrame, costs: DataFrame) -> DataFrame:
    return summary.join(costs, "model_key", "left").select("model_key", "macro_field_f1", F.bround(F.coalesce("cost_usd", F.lit(0.0)), 2).alias("cost_usd"))


def exact(f1: Column | str) -> Column:
    return (F.col(f1) if isinstance(f1, str) else f1) >= 0.999


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an md5, the same in every engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


#: Partitions in which a bootstrap's resamples are drawn.
DRAWING = 64


def bootstrap(values: DataFrame, groups: list[str], id_col: str, value: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean by hash-driven resampling: draw k of a resample takes row floor(u * n) of its group.

    Each row is first numbered within its group by id; draws are generated per resample and joined on the number, so the
    work is one equi-join and two partial aggregations whatever the number of groups. It draws n numbers for each resample:
    for tables of up to millions of rows. poisson_bootstrap() needs no numbers and no join.
    """
    v = values.where(F.col(value).isNotNull())
    numbered = v.select(*groups, F.col(value).alias("_v"), (F.row_number().over(Window.partitionBy(*groups).orderBy(id_col)) - 1).alias("_k"))
    sizes = v.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    # The draws grow out of a few rows of sizes, from which the planner takes them for small: each resample draws in its
    # own partition, and the join shuffles both sides instead of sending all draws through the driver.
    blocks = sizes.select(*groups, "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_b")).repartition(DRAWING, *groups, "_b")
    draws = blocks.select(*groups, "n", "_b", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("_d"))
    draws = draws.withColumn("_k", F.floor(uniform(F.lit(seed), F.col("_b"), F.col("_d")) * F.col("n")).cast("int"))
    means = draws.select(*groups, "_b", "_k").hint("merge").join(numbered, [*groups, "_k"]).groupBy(*groups, "_b").agg(F.avg("_v").alias("_m"))
    ci = means.groupBy(*groups).agg(F.percentile("_m", 0.025).alias("lo"), F.percentile("_m", 0.975).alias("hi"))
    return sizes.join(ci, groups)


#: Resamples that one row of partial sums holds.
BLOCK = 500


def poisson_bootstrap(values: DataFrame, groups: list[str], id_col: str, value: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """groups, n, mean, lo, hi: percentile interval of the mean by Poisson weights.

    In each resample a row counts as often as a Poisson(1) number says. Rows of one group and value (to 13 digits, so that
    the order of a sum before plays no part) are drawn together, as the Poisson(n) number that n such numbers add up to:
    the draws cost resamples times distinct values, not rows. They hang on the group, the value and the seed alone,
    whatever the ids and the partitioning. A task adds up its values' weights for blocks of resamples, so what is
    shuffled is a row for each distinct value, and one for each task, group and block.
    """
    kinds = ", ".join(f"{g} {values.schema[g].dataType.simpleString()}" for g in groups)
    v = values.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    hist = v.groupBy(*groups, F.format_string("%.12e", F.col("_v") + 0.0).alias("_d")).agg(F.avg("_v").alias("_v"), F.count("*").alias("_n"))
    hist = hist.select(*groups, "_v", "_n", F.xxhash64(*groups, "_d", F.lit(seed)).alias("_h")).repartition(DRAWING, "_h")

    def sums(batches):
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            *names, x, n, h = (c.to_pylist() for c in b.columns)
            for k, name in enumerate(zip(*names, strict=True)):
                total = held.setdefault(name, np.zeros((2, resamples)))
                w = np.random.default_rng(h[k] % (1 << 64)).poisson(n[k], resamples)
                total[0] += w
                total[1] += x[k] * w
        for name, total in held.items():
            n = -(-resamples // BLOCK)
            cut = [total[:, k * BLOCK : (k + 1) * BLOCK].tolist() for k in range(n)]
            columns = [*([g] * n for g in name), list(range(n)), [c[0] for c in cut], [c[1] for c in cut]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    schema = to_arrow_schema(StructType([values.schema[g] for g in groups] + [StructField("_b", IntegerType()), StructField("_w", ArrayType(DoubleType())), StructField("_x", ArrayType(DoubleType()))]))
    part = hist.mapInArrow(sums, f"{kinds}, _b int, _w array<double>, _x array<double>")
    each = part.select(*groups, "_b", F.posexplode(F.arrays_zip("_w", "_x")).alias("_k", "_p"))
    means = each.groupBy(*groups, "_b", "_k").agg(F.sum("_p._w").alias("_w"), F.sum("_p._x").alias("_x")).where("_w > 0").withColumn("_m", F.col("_x") / F.col("_w"))
    ci = means.groupBy(*groups).agg(F.percentile("_m", 0.025).alias("lo"), F.percentile("_m", 0.975).alias("hi"))
    same = reduce(lambda a, b: a & b, (F.col(f"s.{g}").eqNullSafe(F.col(f"c.{g}")) for g in groups))
    sizes = v.groupBy(*groups).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    return sizes.alias("s").join(ci.alias("c"), same).select(*(F.col(f"s.{g}").alias(g) for g in groups), "n", "mean", "lo", "hi")


def bootstrap_draws(values: DataFrame, groups: list[str], id_col: str, value: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """The interval from numpy's generator, its seed set anew in each group: groups, n, mean, lo, hi.

    The generator's numbers are a row's order in its group, so the group's values are sorted by id and held in one array
    of a row; each block of resamples is a task of its own, which skips to its place in the generator's stream.
    """
    v = values.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("_v"))
    blocks = v.select(*groups, "_v", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // BLOCK) - 1))).alias("_b"))

    @F.pandas_udf(ArrayType(DoubleType()))
    def drawn(x: pd.Series, b: pd.Series) -> pd.Series:
        out, place, last = [], 0, None
        for v, k in zip(x, b, strict=True):
            if last is None or k < place or len(v) != len(last) or (v != last).any():
                rng, place, last = np.random.default_rng(seed), 0, v
            while True:  # the numbers before this block's are drawn and left
                m = v[rng.integers(0, len(v), (min(BLOCK, resamples - place * BLOCK), len(v)))].mean(axis=1)
                place += 1
                if place > k:
                    break
            out.append(m)
        return pd.Series(out)

    means = blocks.repartition(*groups, "_b").select(*groups, F.size("_v").cast("long").alias("n"), F.aggregate("_v", F.lit(0.0), lambda a, x: a + x).alias("sum"), F.explode(drawn("_v", "_b")).alias("_m"))
    return means.groupBy(*groups, "n").agg((F.first("sum") / F.col("n")).alias("mean"), F.percentile("_m", 0.025).alias("lo"), F.percentile("_m", 0.975).alias("hi"))


def bootstrap_table(values: DataFrame, groups: list[str], id_col: str, metrics: list[str], resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """groups, metric, n, mean, ci_low, ci_high of each metric."""
    long = values.select(*groups, id_col, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))))
    d = poisson_bootstrap(long, [*groups, "metric"], id_col, "value", resamples, seed)
    return d.withColumnsRenamed({"lo": "ci_low", "hi": "ci_high"})


def leaderboard(images: DataFrame, value: str = "macro_field_f1", resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Models by their mean, best first: model_key, place, mean, ci_low, ci_high and the half-widths below and above."""
    ci = bootstrap_table(images, ["model_key"], "image_id", [value], resamples, seed)
    place = F.rank().over(Window.orderBy(F.desc("mean")))  # one row per model
    return ci.select("model_key", place.alias("place"), "n", "mean", "ci_low", "ci_high", (F.col("mean") - F.col("ci_low")).alias("below"), (F.col("ci_high") - F.col("mean")).alias("above")).orderBy("place", "model_key")


def field_matrix(summary: DataFrame) -> DataFrame:
    """Model by field F1 from model_field_summary(), best mean over the fields first; fields in their fixed order."""
    wide = summary.groupBy("model_key").pivot("field", list(FIELDS)).agg(F.first("f1")).join(summary.groupBy("model_key").agg(F.avg("f1").alias("mean_f1")), "model_key")
    return wide.select("model_key", "mean_f1", *FIELDS).orderBy(F.desc("mean_f1"), "model_key")


def nutrition_summary(fields: DataFrame) -> DataFrame:
    return fields.where("field = 'nutrition'").groupBy("model_key").agg(F.avg("f1").alias("f1"), F.avg("pairing_accuracy").alias("pairing_accuracy"), F.avg("value_accuracy").alias("value_accuracy"))


def agreement(images: DataFrame) -> DataFrame:
    """Means over the double-labelled records."""
    return images.agg(F.count("*").alias("n"), F.avg("macro_field_f1").alias("macro_field_f1"), F.avg("macro_field_f1_strict").alias("macro_field_f1_strict"), F.avg("pairing_accuracy").alias("pairing_accuracy"))


def mcnemar_table(binaries: DataFrame, strata: list[str], id_col: str = "image_id", group: str = "model_key", correct: str = "correct") -> DataFrame:
    """Per stratum and unordered pair of groups, over ids with a value in both: n, a_only, b_only, both_correct, both_wrong.

    Rows without a value count as absent. A group that has an id twice in a stratum is an error, raised when the rows are read.
    """
    d = binaries.select(*strata, F.col(id_col).alias("i"), F.col(group).alias("g"), F.col(correct).cast("int").alias("c")).where("c is not null and g is not null and i is not null")
    d = d.groupBy(*strata, "i").agg(F.array_sort(F.collect_list(F.struct("g", "c"))).alias("x"))
    names = F.transform("x", lambda a: a["g"])
    twice = F.raise_error(F.concat(F.lit("more than one row of a group for id "), F.col("i").cast("string"))).cast(d.schema["x"].dataType)
    d = d.withColumn("x", F.when(F.size(F.array_distinct(names)) < F.size(names), twice).otherwise(F.col("x")))
    # Groups of one id are few (the models), so its pairs are taken from its own row instead of a self-join.
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b["g"] > a["g"]), lambda b: F.struct(a["g"].alias("group_a"), b["g"].alias("group_b"), a["c"].alias("a"), b["c"].alias("b")))))
    d = d.select(*strata, F.inline(pairs))
    n = lambda a, b: F.count_if((F.col("a") == a) & (F.col("b") == b))
    return d.groupBy(*strata, "group_a", "group_b").agg(F.count("*").alias("n"), n(1, 0).alias("a_only"), n(0, 1).alias("b_only"), n(1, 1).alias("both_correct"), n(0, 0).alias("both_wrong"))


def mcnemar_test(table: DataFrame) -> DataFrame:
    """table with exact (fewer than 25 discordant pairs), statistic and p_value."""
    b, c = F.col("a_only"), F.col("b_only")
    exact = b + c < 25
    n, low = F.when(exact, b + c).otherwise(0).cast("int"), F.least(b, c)
    term = lambda acc, k: F.struct((acc["t"] * (n - k + 1) / k).alias("t"), (acc["s"] + acc["t"] * (n - k + 1) / k).alias("s"))
    first = F.struct(F.pow(F.lit(0.5), n.cast("double")).alias("t"), F.pow(F.lit(0.5), n.cast("double")).alias("s"))
    steps = F.when(exact & (low > 0), F.sequence(F.lit(1), F.when(exact, low).otherwise(1).cast("int"))).otherwise(F.array().cast("array<int>"))
    below = F.aggregate(steps, first, term, lambda acc: acc["s"])
    chi = F.pow(F.abs(b - c) - 1, 2) / F.when(~exact, b + c)
    d = table.withColumn("exact", exact).withColumn("statistic", F.when(exact, low.cast("double")).otherwise(chi))
    return d.withColumn("p_value", F.when(exact, F.least(F.lit(1.0), 2 * below)).otherwise(chi2_tail(F.col("statistic"))))


def holm(tests: DataFrame, strata: list[str], p: str = "p_value", tie: tuple[str, ...] = ("group_a", "group_b"), alpha: float = 0.05) -> DataFrame:
    """tests with p_holm and significant, stepped down within each stratum."""
    by = Window.partitionBy(*strata)
    rank = F.row_number().over(by.orderBy(p, *tie))
    d = tests.withColumns({"_r": rank, "_m": F.count("*").over(by)}).withColumn("_q", F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p)))
    d = d.withColumn("p_holm", F.max("_q").over(by.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("significant", F.col("p_holm") < alpha).drop("_r", "_m", "_q")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def hash_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows without replacement, uniform and repeatable: the first by a hash of seed and keys. All rows if fewer."""
    return df.orderBy(F.md5(F.concat_ws("#", F.lit(str(seed)), *keys)), *keys).limit(n)
