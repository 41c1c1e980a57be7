"""Special functions as Column expressions, and the same in DuckDB's SQL."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below SPLIT the series is used, from there on the continued fraction; with these terms both reach double precision.
SPLIT, SERIES, FRACTION = 2.0, 50, 90


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0; null for null. Relative error below 1e-12.

    Small x: 1 - 2 x exp(-x x) / sqrt(pi) times the sum of (2 x x)^k / (1 * 3 * ... * (2 k + 1)), all terms positive, from
    the last term inwards. Large x: exp(-x x) / sqrt(pi) over the continued fraction x + (1/2) / (x + 1 / (x + (3/2) / (x + ...))).
    """
    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    series = F.aggregate(down(SERIES), F.lit(1.0), lambda s, k: 1.0 + s * 2.0 * x * x / (2.0 * k + 1.0))
    fraction = F.aggregate(down(FRACTION), x, lambda s, k: x + k * 0.5 / s)
    scale = F.exp(-x * x) / sqrt(pi)
    return F.when(x < SPLIT, 1.0 - 2.0 * x * scale * series).when(x.isNotNull(), scale / F.when(x >= SPLIT, fraction))


def chi2_tail(x: Column) -> Column:
    """Survival function of chi-square with one degree of freedom."""
    return erfc(F.sqrt(x / 2.0))


def erfc_sql(x: str) -> str:
    down = lambda n: f"list_transform(range({n}, 0, -1), lambda k: k::DOUBLE)"
    series = f"list_reduce(list_prepend(1.0::DOUBLE, {down(SERIES)}), lambda s, k: 1.0 + s * 2.0 * {x} * {x} / (2.0 * k + 1.0))"
    fraction = f"list_reduce(list_prepend({x}, {down(FRACTION)}), lambda s, k: {x} + k * 0.5 / s)"
    return f"CASE WHEN {x} < {SPLIT} THEN 1.0 - 2.0 * {x} * exp(-{x} * {x}) / sqrt(pi()) * {series} ELSE exp(-{x} * {x}) / sqrt(pi()) / {fraction} END"
