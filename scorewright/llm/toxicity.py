"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic documents count as labelled; the rest of the training rows is unlabelled text, drawn whatever its
label. With the share of toxic documents (the class prior, from all training labels) the risk of a classifier g is
prior * E_P[loss(g, 1)] + max(0, E_U[loss(g, 0)] - prior * E_P[loss(g, 0)]): the bracket estimates the loss on clean
documents and may not fall below zero. A linear model over word counts is trained with numpy on a sample whose size is
bounded by documented parameters (documents, drawn by a hash of their ids); its words are all those of the sample that
enough toxic documents hold and that are clearly more frequent there. Scoring reads every whole text.

Null and empty texts have no words and get the score of the bias alone. Without a confirmed toxic document, or without
other text, every score is the prior. Repeated label rows of a document count once, toxic if any of them says so. Null
labels are no labels. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import map_slices, stored

#: Documents of either sort in the sample, about, at most.
POSITIVES = 3000
UNLABELLED = 9000
#: Toxic documents that hold a word, and its z value against the unlabelled ones, at least.
LEAST_DOCS = 4
LEAST_Z = 3.0
EPOCHS = 400
RATE = 0.05
L2 = 1e-4

_WORDS = re.compile(r"[^\W\d_]+")


def _hashed(c: Column, share: Column | float) -> Column:
    return F.pmod(F.xxhash64(c.cast("string"), F.lit("toxicity")), F.lit(1_000_003)) / 1_000_003 < share


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """{"words": [...], "weights": array, "bias": float, "prior": float} from training rows."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    n, n_toxic = known.agg(F.count("*"), F.count_if(F.col("y") > 0)).first()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    n_rows = rows.count()
    prior = min(max(n_toxic / n, 1e-4), 0.999) if n else 1e-4
    empty = {"words": [], "weights": np.zeros(0), "bias": float(np.log(prior / (1 - prior))), "prior": prior}
    if not n_toxic or not n_rows:
        return empty
    spark = docs.sparkSession
    toxic = stored(spark, known.where("y > 0").where(_hashed(F.col("i"), min(1.0, positives / n_toxic))).select("i"), "toxic-ids")
    p = rows.join(toxic, "i", "left_semi").select(F.lit(1).alias("y"), "t")
    u = rows.where(_hashed(F.concat_ws("/", F.lit("u"), F.col("i").cast("string")), min(1.0, unlabelled / n_rows))).select(F.lit(0).alias("y"), "t")

    def bags(batches):
        for b in batches:
            counts = [Counter(_WORDS.findall((t or "").lower())) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["y", "w", "n"])

    sample = stored(spark, p.unionByName(u).mapInArrow(bags, "y int, w array<string>, n array<int>"), "toxicity-sample")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return empty
    a, b = F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")
    counted = sample.select("y", F.explode("w").alias("w")).groupBy("w").agg(a, b)
    pa_, pb = F.col("a") / sizes[1], F.col("b") / sizes[0]
    both = (F.col("a") + F.col("b") + 1) / (sizes[0] + sizes[1] + 2)
    z = (pa_ - pb) / F.sqrt(both * (1 - both) * (1 / sizes[0] + 1 / sizes[1]))
    words = sorted(r["w"] for r in counted.where((F.col("a") >= LEAST_DOCS) & (z >= LEAST_Z)).select("w").collect())  # of the bounded sample
    if not words:
        return empty
    at = {w: k for k, w in enumerate(words)}

    def sparse(batches):
        for x in batches:
            rows = [sorted((at[w], n) for w, n in zip(ws, ns, strict=True) if w in at) for ws, ns in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([[k for k, _ in r] for r in rows], pa.list_(pa.int32())), pa.array([[n for _, n in r] for r in rows], pa.list_(pa.int32()))], ["y", "k", "n"])

    rows = sorted((tuple(r) for r in sample.mapInArrow(sparse, "y int, k array<int>, n array<int>").collect()), key=lambda r: (r[0], r[1], r[2]))
    w, bias = fit(*(Sparse([(r[1], np.log1p(r[2])) for r in rows if r[0] == y], len(words)) for y in (1, 0)), prior)
    return {"words": words, "weights": w, "bias": bias, "prior": prior}


class Sparse:
    """Rows of (columns, values), multiplied from both sides."""

    def __init__(self, rows: list[tuple[list[int], np.ndarray]], width: int):
        self.height, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
        self.column = np.array([c for k, _ in rows for c in k], np.int64)
        self.value = np.concatenate([np.asarray(v, np.float64) for _, v in rows]) if rows else np.zeros(0)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.height)

    def summed(self, d: np.ndarray) -> np.ndarray:
        """Sum of the rows, each times its d."""
        return np.bincount(self.column, self.value * d[self.row], self.width)


def vectoriser(words: list[str]):
    """Function from a text to its (feature, log1p of the count) pairs."""
    at = {w: i for i, w in enumerate(words)}

    def of(text: str | None) -> list[tuple[int, float]]:
        counts: dict[int, int] = {}
        for w in _WORDS.findall((text or "").lower()):
            if w in at:
                counts[at[w]] = counts.get(at[w], 0) + 1
        return [(k, float(np.log1p(v))) for k, v in sorted(counts.items())]

    return of


def fit(p: Sparse, u: Sparse, prior: float, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam on the whole sample."""
    w, bias = np.zeros(p.width + 1), float(np.log(prior / (1 - prior)))
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    grad = lambda x, d: np.append(x.summed(d), d.sum()) / x.height
    for step in range(1, epochs + 1):
        zp, zu = p.times(w[:-1]) + w[-1], u.times(w[:-1]) + w[-1]
        sp, su = sigmoid(zp), sigmoid(zu)
        positive = prior * grad(p, sp - 1)
        negative = grad(u, su) - prior * grad(p, sp)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = positive + negative if risk >= 0 else -negative
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, score (0 to 1)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        of, w, bias = vectoriser(model["words"]), model["weights"], model["bias"]

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            z = [bias + sum(w[k] * v for k, v in of(t)) for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -40, 40))))], [id_col, "score"])

        return one

    return map_slices(df.select(id_col, text_col), make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double")
