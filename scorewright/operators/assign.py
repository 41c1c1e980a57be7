"""Optimal one-to-one assignment of predicted to true items, as a table operator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from scorewright.functions.columns import once


def solve(sim: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a maximum-total assignment of a matrix, by shortest augmenting paths; rows in order, lowest column first."""
    if sim.shape[0] > sim.shape[1]:
        return sorted((i, j) for j, i in solve(sim.T))
    n, m = sim.shape
    cost = sim.max(initial=0) - sim
    row_price, column_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, at, length = start, -1, 0.0
        while True:
            new = length + cost[i] - row_price[i] - column_price
            better = ~done & (new < reach - 1e-12)
            reach[better], via[better] = new[better], at
            at = int(np.argmin(np.where(done, np.inf, reach)))
            done[at], length = True, reach[at]
            if owner[at] < 0:
                break
            i = owner[at]
        row_price[start] += length
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                row_price[owner[j]] += length - reach[j]
            column_price[j] -= length - reach[j]
        while at >= 0:
            owner[at] = owner[via[at]] if via[at] >= 0 else start
            at = via[at]
    return sorted((int(owner[j]), int(j)) for j in range(m) if owner[j] >= 0)


def item_pairs(df: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """keys, i, j, p, t, n_pred, n_truth: every predicted with every true item of a record."""
    left = df.select(*keys, F.size(pred).alias("n_pred"), F.size(truth).alias("n_truth"), truth, F.posexplode(pred).alias("i", "p"))
    return left.select(*keys, "n_pred", "n_truth", "i", "p", F.posexplode(truth).alias("j", "t"))


def assigned(sims: Column, n: Column, m: Column, threshold: float) -> Column:
    """Array of (i, j, sim): a maximum-total assignment of n to m items, those at the threshold or above.

    sims holds the n * m similarities, by i, then j; null stands for equal arrays, which are assigned as they lie. All
    pairs take part in the assignment; the threshold comes after it. One-sided and 2 x 2 records have closed forms; only
    the others send their similarities to the solver. Nothing leaves the record's row.
    """
    one, two = (n == 1) | (m == 1), (n == 2) & (m == 2)
    at = lambda k: F.get(sims, F.lit(k))
    best = (F.array_position(sims, F.array_max(sims)) - 1).cast("int")
    straight = at(0) - at(1) - at(2) + at(3) >= 0
    count = F.sequence(F.lit(0), n - 1)
    to = (
        F.when((n == 0) | (m == 0), F.array().cast("array<int>"))
        .when(sims.isNull(), count)
        .when(one, F.transform(count, lambda i: F.when(F.floor(best / m) == i, best % m).otherwise(-1)))
        .when(two, F.when(straight, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(0))))
        .otherwise(_partners(F.when(~one & ~two & (n > 0) & (m > 0), sims), n))
    )
    hits = F.transform(to, lambda j, i: F.struct(i.alias("i"), j.cast("int").alias("j"), F.coalesce(F.get(sims, i * m + j), F.lit(100.0)).alias("sim")))
    return F.filter(hits, lambda h: (h["j"] >= 0) & (h["sim"] >= threshold))


@once
@F.pandas_udf(ArrayType(IntegerType()))
def _partners(sims: pd.Series, n_pred: pd.Series) -> pd.Series:
    """Column of each row of the records' matrices, -1 without one; null for null."""
    out = []
    for flat, n in zip(sims, n_pred, strict=True):
        if flat is None:
            out.append(None)
            continue
        to = [-1] * int(n)
        for i, j in solve(np.asarray(flat, float).reshape(int(n), -1)):
            to[i] = j
        out.append(to)
    return pd.Series(out)
