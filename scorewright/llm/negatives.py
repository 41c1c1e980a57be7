"""Hard-negative mining with angular triangle filtering.

Vectors become whole numbers, floor(256 * x) of each component, and a score is the inner product of two rows. A row stores
its norm and its angles to a few reference directions. For two rows the angle between them is at least the greatest
difference of their angles to a reference, and at most the least sum (or what the sum lacks to a full turn). The cosines of
these, times the norms and widened beyond any rounding, bound the score. Only rows whose bounds overlap what an anchor
asks for are scored, in whole numbers: first its best rows of the same label, then, for each of these positives, rows of
other labels in a window of scores.

Anchors are a part of the rows, so both grow with the table. Rows are range-partitioned by label and nearest reference and
cut into blocks of a bounded number; a pair of an anchor block and a row block is a task's work, unless the angle and
norm ranges of the two already show that no bound can overlap. A task returns the first few of each anchor only.

References are found on SAMPLE rows, the first by a hash of their vectors, farthest first; they change speed, never results.

Rows with a null label or vector, or a null or non-finite component, take no part. Shorter vectors count as padded with
zeros. Null ids sort last and are no anchors. Repeated rows are rows of their own: a copy of an anchor is another anchor
and one of its positives. Scores are limited to 2 ** 55 in size; larger components are an error. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import stored

SCALE = 256
REFERENCES = 16
#: Rows from which the references are chosen.
SAMPLE = 2048
#: Rows and anchors of one block at most.
ROWS, ANCHORS = 4096, 1024
TILE = 64
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
#: Share of overlapping pairs of a tile from which it is scored as one product.
DENSE = 0.05
LIMIT = float(1 << 55)
#: What rounding can add to a product of norms and a cosine, as a share of the norms' product, and in whole numbers.
SHARE, WHOLE = 1e-6, 2.0
NO_SCORE = -(1 << 62)
PREPARED = "vec_id long, label long, q array<bigint>, norm double, angles array<double>, cell int"


def angles(q: np.ndarray, norms: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles of rows to the references; a zero vector's are zero, and its bounds are zero by its norm."""
    n = max(q.shape[1], refs.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, n - m.shape[1])))
    cosine = pad(q) @ pad(refs).T / np.where(norms > 0, norms, 1)[:, None]
    return np.where(norms[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a list column, padded with zeros to the longest."""
    n = column.value_lengths().to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    width = int(n.max()) if len(n) else 0
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), kind)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def references(sample: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """Unit directions, each the farthest from those before; the first is that of the mean."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.ones((1, 1))
    mean = unit.mean(0)
    out = [mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-9 else unit[0]]
    best = unit @ out[0]
    while len(out) < min(n, len(unit)):
        out.append(unit[int(best.argmin())])
        best = np.maximum(best, unit @ out[-1])
    return np.array(out)


def prepared(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The rows that take part, stored: row (a number), vec_id, label, q, norm, angles, block. Blocks hold ROWS rows at most."""
    spark = df.sparkSession
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # neither is NaN below infinity
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("x")).where(F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    sample = d.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).toArrow()["x"].combine_chunks()
    refs = references(np.floor(SCALE * matrix(sample, np.float64)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = np.floor(SCALE * matrix(b.column(2), np.float64))
            norms = np.linalg.norm(q, axis=1)
            if not (norms * norms < LIMIT).all():
                raise ValueError("components are too large for whole-number scores")
            to = angles(q, norms, refs)
            lists = lambda m: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(q.astype(np.int64)), pa.array(norms), lists(to), pa.array(to.argmin(1).astype(np.int32))], ["vec_id", "label", "q", "norm", "angles", "cell"])

    rows = stored(spark, d.mapInArrow(make, PREPARED).withColumn("row", F.monotonically_increasing_id()), "vectors")
    return stored(spark, blocked(rows, ROWS), "vector-blocks")


def blocked(rows: DataFrame, most: int) -> DataFrame:
    """rows with their block: runs of at most `most` rows in the order of label and cell, within a range partition."""
    dealt = rows.repartitionByRange("label", "cell", "row").sortWithinPartitions("label", "cell", "row")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            yield b.append_column("block", pa.array(first + (n + np.arange(b.num_rows)) // most))
            n += b.num_rows

    return dealt.mapInArrow(number, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", block long")


def ranges(rows: DataFrame, mark: str) -> DataFrame:
    """A row for each block: its least and greatest label, norm and angles; names end in the mark."""
    lists = [F.min(F.get("angles", F.lit(k))) for k in range(REFERENCES)], [F.max(F.get("angles", F.lit(k))) for k in range(REFERENCES)]
    d = rows.groupBy(F.col("block").alias(f"block{mark}")).agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("norm").alias("n1"), F.array(*lists[0]).alias("t0"), F.array(*lists[1]).alias("t1"))
    return d.withColumnsRenamed({c: f"{c}{mark}" for c in ("l0", "l1", "n1", "t0", "t1")})


def block_bounds() -> tuple[Column, Column]:
    """Least and greatest score of two blocks' rows (marks a and x), by their ranges of angles and norms."""
    turn, half = F.lit(2 * np.pi), F.lit(np.pi)
    gaps, fars = [F.lit(0.0)], [half]
    for k in range(REFERENCES):
        a0, a1, x0, x1 = (F.get(c, F.lit(k)) for c in ("t0a", "t1a", "t0x", "t1x"))
        gaps += [a0 - x1, x0 - a1]
        # min(s, turn - s) over sums s from a0 + x0 to a1 + x1 is greatest at half a turn or at an end.
        ends = F.greatest(F.least(a0 + x0, turn - a0 - x0), F.least(a1 + x1, turn - a1 - x1))
        fars.append(F.when((a0 + x0 <= half) & (a1 + x1 >= half), half).otherwise(ends))
    gap, far = F.greatest(*gaps), F.least(*fars)  # references that there are not give null, which both leave out
    n = F.col("n1a") * F.col("n1x")
    return F.least(F.lit(0.0), n * F.cos(far)) - n * SHARE - WHOLE, F.greatest(F.lit(0.0), n * F.cos(gap)) + n * SHARE + WHOLE


def bounds(ta: np.ndarray, na: np.ndarray, tx: np.ndarray, nx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores of anchors (angles, norms) and rows."""
    near, far = np.zeros((len(na), len(nx))), np.full((len(na), len(nx)), np.pi)
    for k in range(ta.shape[1]):
        a, x = ta[:, k, None], tx[None, :, k]
        np.maximum(near, np.abs(a - x), out=near)
        s = a + x
        np.minimum(far, np.minimum(s, 2 * np.pi - s), out=far)
    n = na[:, None] * nx[None, :]
    slack = n * SHARE + WHOLE
    return n * np.cos(far) - slack, n * np.cos(near) + slack


def scores(a: np.ndarray, x: np.ndarray, ask: np.ndarray, whole: bool) -> np.ndarray:
    """Inner products of the pairs asked for, else NO_SCORE. whole: doubles can't hold the products exactly."""
    out = np.full(ask.shape, NO_SCORE)
    if ask.mean() > DENSE:
        out[ask] = (a @ x.T if whole else (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64))[ask]
        return out
    i, j = np.nonzero(ask)
    for k in range(0, len(i), 1 << 14):
        some = slice(k, k + (1 << 14))
        out[i[some], j[some]] = (a[i[some]] * x[j[some]]).sum(1)
    return out


class Block:
    """Rows of a group in order of their ids (null last), so that stable sorts by score keep ties right."""

    def __init__(self, group: pa.Table):
        ids = group["vec_id"].combine_chunks()
        row = group["row"].to_numpy()
        order = np.lexsort((row, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        group = group.take(pa.array(order))
        self.table, self.row, self.ids = group, row[order], group["vec_id"].combine_chunks()
        self.label, self.norm = group["label"].to_numpy(), group["norm"].to_numpy()
        self.q, self.angles = matrix(group["q"].combine_chunks(), np.int64), matrix(group["angles"].combine_chunks(), np.float64)


def _tiles(a: Block, x: Block):
    """Tiles of anchors: their numbers, bounds to all rows, and a function that scores what is asked for."""
    width = max(a.q.shape[1], x.q.shape[1])
    qa, qx = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a.q, x.q))
    whole = a.norm.max() * x.norm.max() >= float(1 << 52)
    for k in range(0, len(a.row), TILE):
        at = slice(k, k + TILE)
        yield k, *bounds(a.angles[at], a.norm[at], x.angles, x.norm), lambda ask, at=at: scores(qa[at], qx, ask, whole)


FIRST = "row long, p_row long, p_id long, p_score long"


def _positives(most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            a, x = Block(left), Block(right)
            for k, low, high, score in _tiles(a, x):
                n = len(low)
                ask = (a.label[k : k + n, None] == x.label[None, :]) & (a.row[k : k + n, None] != x.row[None, :])
                # A row goes on if it can reach the least score that `most` rows are sure to have.
                sure = np.where(ask, low, -np.inf)
                least = np.partition(sure, -most, axis=1)[:, -most] if sure.shape[1] >= most else np.full(n, -np.inf)
                s = score(ask & (high >= least[:, None]))
                for i in range(n):
                    best = np.argsort(-s[i], kind="stable")[:most] if (s[i] != NO_SCORE).any() else []
                    found += [(a.row[k + i], x.row[j], j, s[i, j]) for j in best if s[i, j] != NO_SCORE]
            ids = x.ids.take(pa.array([f[2] for f in found], pa.int64()))
        else:
            ids = pa.array([], pa.int64())
        return pa.table({"row": pa.array([f[0] for f in found], pa.int64()), "p_row": pa.array([f[1] for f in found], pa.int64()), "p_id": ids, "p_score": pa.array([f[3] for f in found], pa.int64())})

    return run


def window(p: int) -> tuple[int, int]:
    """Scores from LOW to HIGH hundredths of a positive's; empty where that is negative."""
    return -(-LOW * p // 100), HIGH * p // 100


LAST = "row long, p_row long, n_row long, n_id long, n_score long"


def _negatives(most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        ids = pa.array([], pa.int64())
        if left.num_rows and right.num_rows:
            a, x = Block(left), Block(right)
            asked = a.table["positives"].to_pylist()
            for k, low, high, score in _tiles(a, x):
                n = len(low)
                other = a.label[k : k + n, None] != x.label[None, :]
                ask = np.zeros_like(other)
                for i in range(n):
                    for p in asked[k + i]:
                        lo, hi = window(p["p_score"])
                        if lo <= hi:
                            ask[i] |= (high[i] >= lo) & (low[i] <= hi)
                s = score(ask & other)
                for i in np.flatnonzero((s != NO_SCORE).any(1)).tolist():
                    order = np.argsort(-s[i], kind="stable")
                    ranked = -s[i][order[: int((s[i] != NO_SCORE).sum())]]
                    for p in asked[k + i]:
                        lo, hi = window(p["p_score"])
                        first, end = np.searchsorted(ranked, -hi), np.searchsorted(ranked, -lo, "right")
                        found += [(a.row[k + i], p["p_row"], x.row[j], j, s[i, j]) for j in order[first : min(end, first + most)].tolist()]
            ids = x.ids.take(pa.array([f[3] for f in found], pa.int64()))
        column = lambda c: pa.array([f[c] for f in found], pa.int64())
        return pa.table({"row": column(0), "p_row": column(1), "n_row": column(2), "n_id": ids, "n_score": column(4)})

    return run


def _met(rows: DataFrame, anchors: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
    """run over each pair of an anchor block and a row block (blocka, blockx)."""
    left = anchors.withColumnRenamed("block", "blocka").join(pairs, "blocka").groupBy("blocka", "blockx")
    right = rows.withColumnRenamed("block", "blockx").join(pairs, "blockx").groupBy("blocka", "blockx")
    return left.cogroup(right).applyInArrow(run, schema)


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. anchor: a condition on vec_id."""
    spark = df.sparkSession
    rows = prepared(df, id_col, vec_col, label_col)
    anchors = stored(spark, blocked(rows.where(anchor).drop("block"), ANCHORS), "anchors")
    # Every anchor block meets every row block as a pair of ranges; those that can't hold a result are left out.
    ra, rx = stored(spark, ranges(anchors, "a"), "anchor-ranges"), stored(spark, ranges(rows, "x"), "row-ranges")
    pairs = stored(spark, grid(ra, rx), "block-pairs")
    found = _met(rows, anchors, pairs.where("l0a <= l1x and l0x <= l1a").select("blocka", "blockx"), _positives(positives), FIRST)
    by = Window.partitionBy("row").orderBy(F.desc("p_score"), F.asc_nulls_last("p_id"), "p_row")
    best = found.withColumn("k", F.row_number().over(by)).where(F.col("k") <= positives)
    best = stored(spark, best.drop("k"), "positives")
    asked = stored(spark, anchors.join(best.groupBy("row").agg(F.collect_list(F.struct("p_row", "p_score")).alias("positives")), "row"), "asked")
    least, most = F.array_min(F.transform("positives", lambda p: p["p_score"])), F.array_max(F.transform("positives", lambda p: p["p_score"]))
    spans = asked.groupBy(F.col("block").alias("blocka")).agg(F.min(least).alias("p0"), F.max(most).alias("p1"))
    low, high = block_bounds()
    apart = (F.col("l0a") == F.col("l1a")) & (F.col("l0x") == F.col("l1x")) & (F.col("l0a") == F.col("l0x"))
    near = pairs.join(spans, "blocka").where(~apart & (high >= F.col("p0") * LOW / 100 - 1) & (low <= F.col("p1") * HIGH / 100 + 1))
    said = _met(rows, asked, near.select("blocka", "blockx"), _negatives(negatives), LAST)
    by = Window.partitionBy("row", "p_row").orderBy(F.desc("n_score"), F.asc_nulls_last("n_id"), "n_row")
    said = said.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    ids = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return said.join(best, ["row", "p_row"]).join(ids, "row").select("anchor_id", F.col("p_id").alias("positive_id"), "rank", F.col("n_id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score"))


def grid(a: DataFrame, x: DataFrame) -> DataFrame:
    """All pairs of anchor blocks and row blocks: the anchors are a stated query set against all rows, in blocks. Pairs of
    block ranges, not of rows; each anchor block is numbered, and each row block meets the numbers in turn."""
    n = a.count()
    one = Window.orderBy("blocka")  # a row for ANCHORS anchors
    numbered = a.withColumn("_n", F.row_number().over(one) - 1)
    many = x.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else x.withColumn("_n", F.lit(-1))
    return many.join(numbered, "_n").drop("_n")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, p AS positive_id, k::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 10
"""
