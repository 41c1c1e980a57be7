"""Connected components by alternating stars, and bitmaps of fixed size over hashed keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import stored

#: Bits of a bitmap; its size does not grow with the input, only its share of false positives.
BITS = 1 << 24


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges but roots themselves.

    Each round joins every node's neighbours to its smallest neighbour, first the larger ones, then the smaller ones;
    the rounds needed grow with the logarithm of the longest path. Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    both = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = stored(spark, edges.where(F.col(a) != F.col(b)).select(*both).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        # Large star: neighbours above a node go to the least of it and its neighbours. The least are stored, so that
        # both sides of each join are plain exchanges, of which Spark splits the one with a hub's rows.
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(spark, sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(spark, large, "large-star")
        # Small star: neighbours below a node, and the node, go to the least of them.
        least = stored(spark, large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(spark, small.where("u <> v").distinct(), "edges")


def bitmap(keys: DataFrame, hashed: Column) -> np.ndarray:
    """A map of BITS bits with those of pmod(hashed, BITS) set, built on the cluster. Ask it with may()."""
    bit = F.pmod(hashed, F.lit(BITS))
    out = np.zeros(BITS // 8, np.uint8)
    for r in keys.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect():
        if r["k"] > 0:  # Spark counts bits from 1 in bucket 1; the value 0 always counts as set
            m = np.frombuffer(r["m"], np.uint8)
            out[(r["k"] - 1) * 4096 : r["k"] * 4096] |= m
    return out


def may(known: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether each signed 64-bit hash can be among the keys of bitmap()."""
    k = hashed.astype(np.int64) % BITS
    i = np.maximum(k - 1, 0)
    return (k == 0) | (known[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool)
