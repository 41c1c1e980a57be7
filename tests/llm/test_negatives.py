"""Hard negatives against a plain version, and the safety of angle bounds."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row string, q int, block long"


def brute_mine(rows, every=5):
    rows = [(i, [math.floor(256 * c) for c in v], l) for i, v, l in rows if v is not None and l is not None and all(c is not None and math.isfinite(c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    key = lambda t: (-t[0], t[1] is None, t[1] or 0, t[2])
    out = []
    for k, (i, v, l) in enumerate(rows):
        if i is None or i % every:
            continue
        said = [(dot(v, w), j, n, m) for n, (j, w, m) in enumerate(rows) if n != k]
        for p in sorted((t for t in said if t[3] == l), key=key)[:5]:
            fit = sorted((t for t in said if t[3] != l and 30 * p[0] <= 100 * t[0] <= 90 * p[0]), key=key)[:10]
            out += [(i, p[1], r + 1, t[1], p[0], t[0]) for r, t in enumerate(fit)]
    return out


def vectors(seed=2, n=260, d=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, d))
    rows = []
    for k in range(n):
        v = centres[k % 5] * (k % 7 > 0) + r.normal(size=d) * r.choice([0.1, 1, 20])
        rows.append((k, [float(np.float32(c)) for c in v], int(r.integers(0, 3))))
    rows += [(n + k, list(rows[3][1]), k % 3) for k in range(20)]  # ties
    rows += [(400, None, 1), (405, rows[0][1], None), (410, [1.0, None], 0), (415, [float("nan")] * d, 0), (420, [float("-inf")] * d, 1)]
    return [*rows, (425, [], 0), (430, [0.0] * d, 1), (435, [2.0, 1.0], 2), (440, [1.0] * (d + 2), 2), (None, rows[1][1], 2)]


@pytest.mark.parametrize("seed", [2, 3])
def test_mined(spark, seed):
    rows = vectors(seed)
    df = spark.createDataFrame([(*x, "x", 1, 2) for x in rows], SCHEMA).repartition(5)
    got = Counter(tuple(x) for x in negatives.mine(df, F.col("vec_id") % 5 == 0).collect())
    assert got == Counter(brute_mine(rows)) and len(got) > 100


def test_repeated_rows(spark):
    """A copy of an anchor is another anchor, and a positive of the first."""
    rows = [*vectors(4, 60)[:60]] * 2
    got = Counter(tuple(x) for x in negatives.mine(spark.createDataFrame([(*x, "x", 1, 2) for x in rows], SCHEMA), F.col("vec_id") % 5 == 0).collect())
    assert got == Counter(brute_mine(rows))


def test_small_blocks(spark, monkeypatch):
    """Many blocks, of which some pairs are left out by their ranges, give the same."""
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rows = [x for x in vectors(6, 150) if x[0] is not None]
    df = spark.createDataFrame([(*x, "x", 1, 2) for x in rows], SCHEMA)
    assert Counter(tuple(x) for x in negatives.mine(df, F.col("vec_id") % 5 == 0).collect()) == Counter(brute_mine(rows))


def test_no_vectors(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).collect() == []


def test_too_large(spark):
    df = spark.createDataFrame([(0, [1e30], 1, "x", 1, 2)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        negatives.mine(df, F.col("vec_id") % 5 == 0).collect()


def test_bounds_hold_and_filter():
    """No score lies outside its bounds; on clustered vectors most pairs are left out before scoring."""
    r = np.random.default_rng(1)
    for spread in (0.01, 1.0):
        q = np.floor(256 * (r.normal(size=(8, 32))[r.integers(0, 8, 400)] + spread * r.normal(size=(400, 32))))
        norms = np.linalg.norm(q, axis=1)
        to = negatives.angles(q, norms, negatives.references(q[:100]))
        low, high = negatives.bounds(to, norms, to, norms)
        s = q @ q.T
        assert (low <= s).all() and (s <= high).all()
        if spread < 1:
            fifth = np.partition(low, -5, axis=1)[:, -5]
            assert (high >= fifth[:, None]).mean() < 0.3


@pytest.mark.parametrize("p", [-101, -1, 0, 1, 3, 10, 99, 12345])
def test_window(p):
    lo, hi = negatives.window(p)
    assert [n for n in range(-200, 12000) if 30 * p <= 100 * n <= 90 * p] == list(range(lo, hi + 1))
