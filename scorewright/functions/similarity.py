"""Token-sort similarity: 200 * LCS / (length + length) of texts whose words are sorted."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from scorewright.functions.columns import let, once
from scorewright.functions.text import canonical_nutrient, compose, normalize_text


def sorted_tokens(normalized: Column) -> Column:
    return F.array_join(F.array_sort(F.split(normalized, " ")), " ")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        both = row & where.get(c, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


@lru_cache(100_000)
def _ratio(a: str, b: str) -> float:
    return 100.0 if a == b else 200.0 * _common(a, b) / (len(a) + len(b))


#: Characters of the shorter text of a pair that is compared beside others; characters that lie side by side at a time.
WORD, CELLS = 64, 1 << 17
#: Pairs below which a text for itself is quicker, and pairs of rows that are compared in one go.
FEW, PAIRS = 16, 200_000


def _codes(texts: list[str], width: int, pad: int) -> np.ndarray:
    """Code points of texts as rows of one array."""
    size = np.array([len(t) for t in texts])
    out = np.full((len(texts), width), pad, np.int32)
    out[np.arange(width) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<i4")
    return out


def _common_of(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences of pairs, a of at most WORD characters: a 64-bit word for each pair, and a
    step over all pairs for each character of b."""
    x, y = _codes(a, -(-max(map(len, a)) // 8) * 8, -1), _codes(b, max(map(len, b)), -2)
    row = np.full(len(a), ~np.uint64(0))
    seen = np.zeros((len(a), 8), np.uint8)
    for c in y.T:
        seen[:, : x.shape[1] // 8] = np.packbits(x == c[:, None], axis=1, bitorder="little")
        both = row & seen.view("<u8")[:, 0]
        row = (row + both) | (row - both)  # bits above a's characters stay set
    return WORD - np.bitwise_count(row).astype(np.int64)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Similarity of each pair of a and b; each different pair is compared once."""
    number: dict[tuple[str, str], int] = {}
    which = np.fromiter((number.setdefault(p, len(number)) for p in zip(a, b, strict=True)), np.int64, len(a))
    pairs = [p if len(p[0]) <= len(p[1]) else p[::-1] for p in number]
    short, long = (np.array([len(p[k]) for p in pairs], np.int64) for k in range(2))
    common = np.zeros(len(pairs), np.int64)
    side = np.flatnonzero((short > 0) & (short <= WORD))
    side = side[np.argsort(long[side], kind="stable")]
    # Pairs whose longer texts have lengths of one power of 2 lie side by side, so at most half is padding.
    part = np.frexp(long[side])[1].astype(np.int64) * (1 << 40) + np.cumsum(long[side]) // CELLS
    alone = [np.flatnonzero(short > WORD)]
    for rows in np.split(side, np.flatnonzero(np.diff(part)) + 1):
        if len(rows) < FEW:
            alone.append(rows)
        else:
            common[rows] = _common_of(*zip(*(pairs[k] for k in rows.tolist()), strict=True))
    for k in np.concatenate(alone).tolist():
        common[k] = _common(*pairs[k])
    total = short + long
    return np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))[which]


@once
@F.pandas_udf(DoubleType())
def token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two columns of sorted tokens; null for null."""
    asked = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[asked] = ratios(a[asked].tolist(), b[asked].tolist())
    return pd.Series(out)


def ratio(a: Column, b: Column) -> Column:
    """token_ratio of sorted tokens; equal texts never reach Python."""
    other = a != b
    return F.coalesce(token_ratio(F.when(other, a), F.when(other, b)), F.lit(100.0))


@once
@F.pandas_udf(ArrayType(DoubleType()))
def pair_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarities of every text of one array with every one of another, row by row; null for null."""
    out: list[np.ndarray | None] = []
    held: list[tuple[int, list[str], list[str]]] = []
    waiting = 0

    def flush() -> None:
        found = ratios([x for _, left, _ in held for x in left], [y for *_, right in held for y in right])
        ends = np.cumsum([len(left) for _, left, _ in held])
        for (at, *_), values in zip(held, np.split(found, ends[:-1]), strict=True):
            out[at] = values
        held.clear()

    for x, y in zip(a, b, strict=True):
        if x is not None and y is not None:
            held.append((len(out), [p for p in x for _ in y], [t for _ in x for t in y]))
            waiting += len(x) * len(y)
        out.append(None)
        if waiting > PAIRS:
            flush()
            waiting = 0
    if held:
        flush()
    return pd.Series(out, dtype=object)


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    """Similarity 0 to 100 of two raw texts in any Unicode form; two empty texts have 100."""
    return _of_composed(compose(a), compose(b))


def _of_composed(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(normalize_text(a)), sorted_tokens(normalize_text(b)))


def native_token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    """The same without Python, for short texts in composed form: the table of the recurrence row by row in nested aggregates."""
    side = lambda c: F.filter(F.split(sorted_tokens(normalize_text(c)), ""), lambda x: x != "")

    def common(x: Column, y: Column) -> Column:
        def row(before: Column, c: Column) -> Column:
            def cell(acc: Column, k: Column) -> Column:
                up, left = F.get(before, k), F.element_at(acc, -1)
                corner = F.when(k > 0, F.get(before, k - 1)).otherwise(0) + 1
                return F.concat(acc, F.array(F.greatest(up, left, F.when(F.get(x, k) == c, corner).otherwise(0))))

            return F.slice(F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), F.array(F.lit(0)), cell), F.lit(2), F.size(x))

        return F.element_at(F.aggregate(y, F.array_repeat(F.lit(0), F.size(x)), row), -1)

    def of(s: Column) -> Column:
        x, y = s["x"], s["y"]
        return F.when(x == y, 100.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(200.0 * common(x, y) / (F.size(x) + F.size(y)))

    return let(F.struct(side(a).alias("x"), side(b).alias("y")), of)


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """100 for names of the same nutrient, else token_sort_ratio; raw texts in any Unicode form."""
    a, b = compose(a), compose(b)
    return F.when(canonical_nutrient(a) == canonical_nutrient(b), 100.0).otherwise(_of_composed(a, b))


def length_bound(a: Column, b: Column) -> Column:
    """The greatest similarity that texts of these lengths can have."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb > 0, 200.0 * F.least(la, lb) / (la + lb)).otherwise(100.0)


def distinct_ratios(df: DataFrame, a: str, b: str, to: str = "sim", threshold: float | None = None) -> DataFrame:
    """df with the similarity of two columns of raw texts in composed form, each different pair compared once in the job.

    Pairs go into a table of distinct ones, in either order the same, and what is found is joined back. With a threshold
    only pairs whose lengths let them reach it are compared, and the others' similarity is null; so are those below it.
    A pair may be that of very many rows: each of SALT parts of the rows meets its own copy of the table.
    """
    d = df.withColumns({"_a": sorted_tokens(normalize_text(a)), "_b": sorted_tokens(normalize_text(b))})
    d = d.withColumns({"_x": F.least("_a", "_b"), "_y": F.greatest("_a", "_b")})
    ask = F.col("_x") != F.col("_y")
    if threshold is not None:
        ask = ask & (length_bound(F.col("_x"), F.col("_y")) >= threshold)
    pairs = d.where(ask).select("_x", "_y").distinct().withColumn("_found", token_ratio("_x", "_y"))
    pairs = pairs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    part = F.when(ask, F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    sim = F.when(F.col("_x") == F.col("_y"), 100.0).otherwise(F.col("_found"))
    if threshold is not None:
        sim = F.when(sim >= threshold, sim)
    d = d.withColumn("_part", part).join(pairs, ["_x", "_y", "_part"], "left")
    return d.withColumn(to, sim).select(*df.columns, to)


#: Parts into which the rows of one pair of texts are salted.
SALT = 8
