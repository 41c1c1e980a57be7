"""SimHash near-duplicates: pigeonhole blocks of the fingerprints, joined and verified by Hamming distance.

A text is words parted by ASCII white space, A-Z in lower case. Its shingles (three words, repeats included; the whole
sequence if it has fewer) are hashed by XXH64; a bit of the fingerprint is set if it is set in over half the hashes.
Texts without words, null ones too, have fingerprint zero, which is linked like any other.

Two fingerprints that differ in at most two bits agree in at least two of four equal blocks of bits. So each distinct
fingerprint is a row for each of the six pairs of blocks, keyed by their bits, and only fingerprints of one key are
compared. A key of very many fingerprints is split the same way by the bits it leaves free: two of four blocks of those
agree again, and a key of the second kind leaves 16 bits free, so no task holds more than 65,536 fingerprints of a key,
whatever the input. A task verifies the Hamming distances of a key and returns the edges of a spanning forest, never pairs.
Copies share a fingerprint and are compared once.

Null ids sort last. Rows that repeat stay rows. Ids can have any type that sorts. Only the named columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import map_slices, stored, text_bytes
from scorewright.llm.graph import components

WIDTH = 3
SEED = 42
#: Bits in which linked fingerprints differ at most. Four blocks serve this distance.
DISTANCE = 2
BLOCKS = 4
#: Fingerprints of a key from which it is split by further bits.
HOT = 1024
#: Fingerprints that are compared with each other at once within a task.
DIRECT = 512
#: Shingles that are hashed at a time.
STEP = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words)) - 1
    starts, ends = starts[: len(words) - k], ends[k:]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(starts), STEP):
        hashes = [xxh64_intdigest(body[a:b], SEED) for a, b in zip(starts[i : i + STEP].tolist(), ends[i : i + STEP].tolist(), strict=True)]
        bits += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(starts)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, fp (signed 64 bits) for each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            body, at = text_bytes(b.column(1))
            found = np.array([fingerprint(body[i:j], width) for i, j in zip(at[:-1], at[1:], strict=True)], np.uint64)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

        return one

    return map_slices(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, fp long")


def agreeing(free: list[int]) -> list[list[int]]:
    """The bits that pairs of blocks of the free bits cover: two of four, so at most two bits elsewhere can differ."""
    parts = [free[i * len(free) // BLOCKS : (i + 1) * len(free) // BLOCKS] for i in range(BLOCKS)]
    return [[b for p in pair for b in p] for pair in combinations(parts, BLOCKS - DISTANCE)]


def _mask(bits: list[int]) -> int:
    """The signed 64-bit number that has these bits."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _keys(free: list[int]) -> Column:
    """array<struct<which, bits>> of fp: a key for each pair of blocks of the free bits."""
    return F.array(*(F.struct(F.lit(k).alias("which"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("bits")) for k, bits in enumerate(agreeing(free))))


def close(values: np.ndarray, free: list[int], distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all distinct values within the distance, which differ in free bits only; many are split again by them."""
    if len(values) <= DIRECT or len(free) <= 2 * BLOCKS:
        i, j = [], []
        for k in range(0, len(values), DIRECT):
            near = np.bitwise_count(values[k : k + DIRECT, None] ^ values[None, k:]) <= distance
            a, b = np.nonzero(np.triu(near, 1))
            i.append(a + k)
            j.append(b + k)
        return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, np.int64),) * 2
    left, right = [], []
    for bits in agreeing(free):
        part = values & np.uint64(_mask(bits) % (1 << 64))
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        rest = [b for b in free if b not in bits]
        for own in np.split(order, cuts):
            if len(own) > 1:
                i, j = close(values[own], rest, distance)
                i, j = own[i], own[j]
                root = spanning(len(values), i, j) if len(i) > 4 * len(own) else None
                left.append(i if root is None else own)
                right.append(j if root is None else root[own])
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of the connected group of each of n nodes: labels fall along the links until none falls."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def _edges(values: np.ndarray, free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Signed values that are joined to a smaller one, and the least ones of their groups."""
    values = np.sort(values.astype(np.int64))
    root = spanning(len(values), *close(values.view(np.uint64), free))
    apart = root != np.arange(len(values))
    return values[apart], values[root[apart]]


def _verify_lists(levels: list[list[int]]):
    """mapInArrow over rows of which, fps: all fingerprints of one key. levels: the bits that a key leaves free, by its pair."""

    def run(batches):
        for b in batches:
            which, lists = b.column(0).to_numpy(), b.column(1)
            flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            n = np.diff(at)
            two = at[:-1][n == 2]
            x, y = flat[two], flat[two + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= DISTANCE
            out = [(np.maximum(x, y)[near], np.minimum(x, y)[near])]
            out += [_edges(flat[at[k] : at[k + 1]], levels[which[k]]) for k in np.flatnonzero(n > 2).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in (0, 1)], ["fp", "root"])

    return run


def _verify_group(levels: list[list[int]]):
    def run(group: pa.Table) -> pa.Table:
        fp, root = _edges(group["fp"].to_numpy(), levels[group["which"][0].as_py()])
        return pa.table({"fp": pa.array(fp), "root": pa.array(root)})

    return run


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """fp, root: edges that connect all distinct fingerprints (column fp) within the distance."""
    every = list(range(64))
    free = [[b for b in every if b not in bits] for bits in agreeing(every)]
    keyed = fps.select("fp", F.explode(_keys(every)).alias("k")).select("fp", "k.which", "k.bits")
    counts = stored(fps.sparkSession, keyed.groupBy("which", "bits").agg(F.count("*").alias("n")).where("n > 1"), "block-counts")
    lists = keyed.join(counts.where(F.col("n") <= hot), ["which", "bits"]).groupBy("which", "bits").agg(F.collect_list("fp").alias("fps"))
    found = lists.select("which", "fps").mapInArrow(_verify_lists(free), "fp long, root long")
    # Fingerprints of a hot key differ in its 32 free bits only; they get keys of the second kind, of 48 bits.
    many = keyed.join(counts.where(F.col("n") > hot), ["which", "bits"])
    again = F.when(F.col("which") == 0, _keys(free[0]))
    for k in range(1, len(free)):
        again = again.when(F.col("which") == k, _keys(free[k]))
    second = many.select("fp", "which", F.col("bits").alias("outer"), F.explode(again).alias("k")).select("fp", "outer", (F.col("which") * len(free) + F.col("k.which")).alias("which"), F.col("k.bits").alias("bits"))
    inner = [[b for b in own if b not in bits] for own in free for bits in agreeing(own)]
    return found.unionByName(second.groupBy("which", "outer", "bits").applyInArrow(_verify_group(inner), "fp long, root long"))


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of df: id_col, fp (signed), fingerprint (16 hex digits), component_id (the least id that links reach)."""
    spark = df.sparkSession
    rows = stored(spark, fingerprints(df, id_col, text_col), "fingerprints")
    fps = stored(spark, rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    edges = stored(spark, links(fps.select("fp"), hot), "fingerprint-links")
    of = fps.join(components(edges, "fp", "root").select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(heads, "root").select("fp", "component_id")
    return _beside(rows, of).select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _beside(rows: DataFrame, of: DataFrame, parts: int = 32) -> DataFrame:
    """rows joined to of, a row for each fp; a fingerprint may be that of a third of all rows, so its rows are salted."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(parts)))
    return salted.join(of.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), ["fp", "salt"]).drop("salt")

