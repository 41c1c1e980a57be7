"""Bootstrap intervals: of value histograms with hash-drawn counts, and in parity with numpy's generator from stored states."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from math import ceil, exp, lgamma, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Values are resampled as whole multiples of this.
STEP = 1e-6
#: Copies of a value up to which its count in a resample is an exact Poisson number; beyond, it is a rounded normal one.
EXACT = 64
#: Resamples that are drawn by one task at a time.
BLOCK = 500
#: Numbers that a task draws at once.
AT_ONCE = 1 << 22
#: Mixing of 31-bit numbers: shifts and odd multipliers whose products fit 63 bits.
MASK = (1 << 31) - 1
MIX = ((15, 739982445), (12, 695872825))


def cumulative(n: int) -> list[float]:
    """P(Poisson(n) <= k) for k = 0, 1, ... up to where it is 1 in doubles."""
    return np.cumsum([exp(-n + k * log(n) - lgamma(k + 1)) for k in range(n + 8 * ceil(sqrt(n)) + 12)]).tolist()


def mixed(x: Column) -> Column:
    """A hash of a number of 31 bits."""
    for shift, times in MIX:
        x = _bits(x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(times).cast("bigint"))
    return x.bitwiseXOR(F.shiftright(x, 15))


def _bits(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK).cast("bigint"))


def drawn_counts(hist: DataFrame, groups: list[str], resamples: int, seed: int) -> DataFrame:
    """hist (groups, x, n) by resample b, with w: how often the n copies of value x are in the resample.

    w is Poisson(n), the sum of the Poisson(1) weights of n rows: read off the cumulative probabilities by a uniform hash
    of seed, x and b. From EXACT copies on it is n plus a normal number times the root of n, rounded, at least 0.
    """
    spark = hist.sparkSession
    table = spark.createDataFrame([(n, cumulative(n)) for n in range(1, EXACT + 1)], "n bigint, cdf array<double>")
    named = hist.withColumn("_h", mixed(_bits(F.col("x") + seed * 7919)))
    blocks = named.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // BLOCK) - 1))).alias("_k")).repartition(32, "_k", "x")
    d = blocks.join(F.broadcast(table), "n", "left")  # a row for each count up to EXACT
    last = F.least(F.col("_k") * BLOCK + BLOCK, F.lit(resamples)) - 1
    d = d.select(*groups, "x", "n", "cdf", "_h", F.explode(F.sequence(F.col("_k") * BLOCK, last)).alias("b"))
    d = d.withColumn("_a", mixed(_bits(F.col("_h") + F.col("b") * F.lit(40503).cast("bigint")))).withColumn("_z", mixed(_bits(F.col("_a") + 12345)))
    u, v = ((F.col(c) + 0.5) / float(1 << 31) for c in ("_a", "_z"))
    one = reduce(lambda s, c: s + (u >= c).cast("bigint"), cumulative(1)[1:14], (u >= cumulative(1)[0]).cast("bigint"))
    normal = F.greatest(F.lit(0), F.floor(F.col("n") + F.sqrt(F.col("n").cast("double")) * F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * pi * v) + 0.5))
    few = F.size(F.filter("cdf", lambda c: c <= u)).cast("bigint")
    return d.select(*groups, "x", "b", F.when(F.col("n") == 1, one).when(F.col("n") <= EXACT, few).otherwise(normal).alias("w"))


def histogram_bootstrap(values: DataFrame, groups: list[str], value: str, resamples: int = 10_000, seed: int = 42, step: float = STEP) -> DataFrame:
    """groups, n, mean, lo, hi: percentile interval of the mean, at a cost of resamples times distinct values, not rows.

    Each group becomes a histogram of its values, rounded to the step; a resample draws how often each distinct value is in
    it and takes the weighted mean, in whole numbers. What is shuffled is a row for each value and block, and partial sums
    for each resample. Nulls are left out; groups whose name is null are groups.
    """
    v = values.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    hist = v.groupBy(*groups, F.round(F.col("_v") / step).cast("bigint").alias("x")).agg(F.count("*").alias("n"), F.sum("_v").alias("s"))
    sizes = hist.groupBy(*groups).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    drawn = drawn_counts(hist.drop("s"), groups, resamples, seed)
    means = drawn.groupBy(*groups, "b").agg(F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("x")).alias("_x")).where("_w > 0").withColumn("_m", F.col("_x") / F.col("_w") * step)
    ci = means.groupBy(*groups).agg(F.percentile("_m", 0.025).alias("lo"), F.percentile("_m", 0.975).alias("hi"))
    same = reduce(lambda a, b: a & b, (F.col(f"s.{g}").eqNullSafe(F.col(f"c.{g}")) for g in groups))
    return sizes.alias("s").join(ci.alias("c"), same).select(*(F.col(f"s.{g}").alias(g) for g in groups), "n", "mean", "lo", "hi")


def histogram_sql(values: str, groups: str, value: str, resamples: int = 10_000, seed: int = 42) -> str:
    """hist, drawn, means and ci: the same as DuckDB common table expressions over a table; groups as a list of columns."""

    def mix(x: str) -> str:
        for shift, times in MIX:
            x = f"((xor({x}, ({x}) >> {shift}) * {times}) & {MASK})"
        return f"xor({x}, ({x}) >> 15)"

    one = " + ".join(f"(u >= {c!r}::DOUBLE)::BIGINT" for c in cumulative(1)[:14])
    table = "cdf AS (SELECT n, list_transform(range(1, len(p) + 1), lambda k: list_sum(p[1:k])) AS cdf FROM (SELECT n, list_transform(range(0, (n + 8 * ceil(sqrt(n)) + 12)::BIGINT), lambda k: exp(-n + k * ln(n) - CASE WHEN k < 2 THEN 0.0 ELSE lgamma(k + 1) END)) AS p FROM (SELECT unnest(range(2, 65)) AS n)))"
    normal = "greatest(0, floor(n + sqrt(n::DOUBLE) * sqrt(-2.0 * ln(u)) * cos(2.0 * pi() * v) + 0.5))::BIGINT"
    return f"""hist AS (SELECT {groups}, round({value} / {STEP})::BIGINT AS x, count(*) AS n, sum({value}) AS s FROM {values} WHERE {value} IS NOT NULL GROUP BY ALL),
{table},
seeded AS (SELECT {groups}, x, n, (x + {seed * 7919}) & {MASK} AS h FROM hist),
named AS (SELECT {groups}, x, n, {mix("h")} AS h FROM seeded),
each AS (SELECT *, unnest(range(0, {resamples})) AS b FROM named),
first AS (SELECT {groups}, x, n, b, (h + b * 40503) & {MASK} AS h FROM each),
second AS (SELECT {groups}, x, n, b, {mix("h")} AS a FROM first),
third AS (SELECT {groups}, x, n, b, a, (a + 12345) & {MASK} AS h FROM second),
uniform AS (SELECT {groups}, x, n, b, (a + 0.5) / 2147483648.0::DOUBLE AS u, ({mix("h")} + 0.5) / 2147483648.0::DOUBLE AS v FROM third),
drawn AS (SELECT {groups}, x, b, CASE WHEN n = 1 THEN {one} WHEN n <= {EXACT} THEN len(list_filter(cdf, lambda c: c <= u)) ELSE {normal} END AS w FROM uniform LEFT JOIN cdf USING (n)),
means AS (SELECT {groups}, b, sum(w * x)::DOUBLE / sum(w)::DOUBLE * {STEP} AS m FROM drawn GROUP BY {groups}, b HAVING sum(w) > 0),
ci AS (SELECT {groups}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY {groups}),
sizes AS (SELECT {groups}, sum(n)::BIGINT AS n, sum(s) / sum(n) AS mean FROM hist GROUP BY {groups})"""


def ranked_intervals(values: DataFrame, model: str = "model_key", value: str = "macro_field_f1", resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Models by their mean, best first, with the interval's ends and half-widths."""
    d = histogram_bootstrap(values, [model], value, resamples, seed)
    return d.select(model, F.rank().over(Window.orderBy(F.desc("mean"))).alias("place"), "n", "mean", "lo", "hi", (F.col("mean") - F.col("lo")).alias("below"), (F.col("hi") - F.col("mean")).alias("above"))


def generator_states(sizes: DataFrame, resamples: int, seed: int, block: int = BLOCK) -> DataFrame:
    """n, _b, state: numpy's generator as it stands before each block of resamples of n values; sizes holds distinct n.

    One pass for each n draws all numbers in order and gathers nothing, so that every block can start at once later.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n in (int(x) for b in batches for x in b["n"]):
            rng, out = np.random.default_rng(seed), []
            for k in range(0, resamples, block):
                out.append(json.dumps(rng.bit_generator.state))
                for _ in indexes(rng, min(block, resamples - k), n):
                    pass
            yield pd.DataFrame({"n": n, "_b": range(len(out)), "state": out})

    return sizes.select("n").distinct().mapInPandas(run, "n bigint, _b int, state string")


def indexes(rng: np.random.Generator, rows: int, n: int) -> Iterator[np.ndarray]:
    """The generator's index matrix of rows resamples of n values, a few rows at a time; the numbers are the same."""
    step = max(1, AT_ONCE // n)
    for k in range(0, rows, step):
        yield rng.integers(0, n, (min(step, rows - k), n))


def bootstrap_parity(values: DataFrame, groups: list[str], id_col: str, value: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """groups, n, mean, lo, hi as numpy's generator, seeded anew in each group, gives them for the values in id order.

    The numbers index a group's values as a whole, so these are one array of a row; each block of resamples is a row of
    its own and starts from its stored state.
    """
    held = values.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("_v"))
    held = held.withColumn("n", F.size("_v").cast("bigint")).withColumn("mean", F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.col("n"))
    states = generator_states(held.select("n"), resamples, seed)

    @F.pandas_udf(ArrayType(DoubleType()))
    def drawn(v: pd.Series, state: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, s, k in zip(v, state, b, strict=True):
            rng = np.random.default_rng(0)
            rng.bit_generator.state = json.loads(s)
            rows = min(BLOCK, resamples - k * BLOCK)
            out.append(np.concatenate([x[i].mean(axis=1) for i in indexes(rng, rows, len(x))]))
        return pd.Series(out)

    blocks = held.join(states, "n").repartition(32, *groups, "_b")
    means = blocks.select(*groups, "n", "mean", F.explode(drawn("_v", "state", "_b")).alias("_m"))
    return means.groupBy(*groups, "n", "mean").agg(F.percentile("_m", 0.025).alias("lo"), F.percentile("_m", 0.975).alias("hi"))
