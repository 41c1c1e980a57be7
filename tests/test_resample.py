"""Bootstrap forms and the native tail function."""

import math

import numpy as np
from pyspark.sql import functions as F

from scorewright.functions.special import chi2_tail, erfc
from scorewright.operators import resample as B


def test_erfc(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.5, 1.999, 2.0, 2.001, 2.5, 3.0, 5.0, 8.0, 12.0, 20.0, 26.0]
    rows = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select("x", erfc(F.col("x")).alias("e"), chi2_tail(2 * F.col("x") ** 2).alias("t")).collect()
    for r in rows:
        if r["x"] is None:
            assert r["e"] is None and r["t"] is None
        else:
            assert math.isclose(r["e"], math.erfc(r["x"]), rel_tol=1e-12) and math.isclose(r["t"], math.erfc(r["x"]), rel_tol=1e-11)


def test_counts_are_poisson(spark):
    """Counts of n copies have mean and variance n, exact or normal, and 0 as often as they must."""
    hist = spark.createDataFrame([("g", 10 * k, n) for k, n in enumerate((1, 1, 3, 40, 64, 65, 5000))], "g string, x bigint, n bigint")
    rows = B.drawn_counts(hist, ["g"], 4000, 7).groupBy("x").agg(F.count("*").alias("k"), F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("zero")).collect()
    sizes = {10 * k: n for k, n in enumerate((1, 1, 3, 40, 64, 65, 5000))}
    assert len(rows) == 7
    for r in rows:
        n = sizes[r["x"]]
        assert r["k"] == 4000 and abs(r["m"] - n) < 5 * math.sqrt(n / 4000) and abs(r["v"] / n - 1) < 0.15
        assert abs(r["zero"] - math.exp(-n)) < 0.04


def test_histogram_interval(spark):
    """The interval agrees with numpy's bootstrap of the rows; nulls are out, a null group is a group, one value is a point."""
    r = np.random.default_rng(5)
    values = r.choice([0.0, 0.25, 0.5, 1.0], 900)
    rows = [("a", float(v)) for v in values] + [("a", None), (None, 0.3), (None, 0.3), ("x", None)]
    got = {x["g"]: x for x in B.histogram_bootstrap(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 4000).collect()}
    means = values[r.integers(0, 900, (4000, 900))].mean(axis=1)
    assert set(got) == {"a", None} and got["a"]["n"] == 900 and math.isclose(got["a"]["mean"], values.mean())
    assert np.allclose([got["a"]["lo"], got["a"]["hi"]], np.quantile(means, [0.025, 0.975]), atol=0.004)
    assert math.isclose(got[None]["lo"], 0.3) and math.isclose(got[None]["hi"], 0.3)
    assert B.histogram_bootstrap(spark.createDataFrame([], "g string, v double"), ["g"], "v", 100).collect() == []


def test_parity_with_one_matrix(spark, monkeypatch):
    """Blocks from stored states give what one index matrix of the generator gives, also when drawn a few rows at a time."""
    r = np.random.default_rng(1)
    groups = {"a": r.random(37), "b": r.random(37), "c": r.random(1), "d": r.random(500)}
    df = spark.createDataFrame([(g, k, float(v)) for g, x in groups.items() for k, v in enumerate(x)] + [("a", 99, None)], "g string, i int, v double").repartition(4)
    for row in B.bootstrap_parity(df, ["g"], "i", "v", 1200).collect():
        x = groups[row["g"]]
        means = x[np.random.default_rng(42).integers(0, len(x), (1200, len(x)))].mean(axis=1)
        assert row["n"] == len(x) and np.allclose([row["mean"], row["lo"], row["hi"]], [x.mean(), *np.quantile(means, [0.025, 0.975])], rtol=1e-12)
    monkeypatch.setattr(B, "AT_ONCE", 100)
    few = np.concatenate(list(B.indexes(np.random.default_rng(3), 50, 37)))
    assert (few == np.random.default_rng(3).integers(0, 37, (50, 37))).all()
