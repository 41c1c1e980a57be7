"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents with the same set of word shingles are one class. MinHash bands put classes into buckets; those that share a
bucket are candidates. Each class goes to the block of its head, the least class that it meets in any bucket; a block of
very many classes, or of long ones, is split by hash. So near copies lie in few blocks. A task compares the members of a
block, or those members of two blocks that share a bucket across them: each candidate pair meets in exactly one task.
There MinHash values are compared a few at a time: after each step a pair is dropped if the posterior probability (uniform
prior) that its similarity reaches the threshold is below the tolerance. What is left is verified exactly on the shingle
sets. Pairs never leave the task: it returns link counts and the edges of a spanning forest. A group of n near copies has
its n * n comparisons spread over tasks, and each of its sets is sent to n / BLOCK of them.

With 42 bands of 6 a pair at similarity 0.8 misses all bands with probability 3e-6, less above.

Words are parted by ASCII white space; a text of fewer than five words, but not none, has one shingle. Null and empty
texts have none, are linked to nothing, and are classes of their own. Null ids sort last. Rows that repeat are members
of one class. Ids can have any type that sorts. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import fresh, map_slices, row_key, stored, text_bytes
from scorewright.llm.graph import bitmap, components, may
from scorewright.llm.words import NOT_SPACE, SAME, mixed, tokens

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 42, 6
STEP = 21
TOLERANCE = 1e-6
#: Classes, and their shingles, of one block at most, but for a single longer class.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
_RNG = np.random.default_rng(77)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingles(body: bytes, offsets: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words, _, first = tokens(body, offsets, SAME, NOT_SPACE)
    out = []
    n = len(words)
    roll = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        roll = roll * np.uint64(0x100000001B3) + mixed(words[k : n - width + 1 + k]) if len(roll) else roll
    roll = mixed(roll)
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= width:
            out.append(np.unique(roll[i : j - width + 1]))
        elif j > i:
            out.append(np.frombuffer(hashlib.blake2b(words[i:j].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(words[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each set; none of the sets is empty."""
    x = np.concatenate(sets)
    x = (x >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), len(_XOR)), np.uint32)
    for k in range(len(_XOR)):
        y = (x ^ _XOR[k]) * _TIMES[k]
        y ^= y >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def class_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _hash_of(keys: list[bytes]) -> np.ndarray:
    """The first 8 bytes of each key as a signed number, as conv(hex(key)) would give them."""
    return np.frombuffer(b"".join(k[:8] for k in keys), ">i8").astype(np.int64) if keys else np.zeros(0, np.int64)


def least_agreeing(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, total: int = BANDS * ROWS, step: int = STEP) -> list[tuple[int, int]]:
    """(n, m): of n values compared, a pair with fewer than m equal ones is dropped."""
    out = []
    for n in range(step, total + 1, step):
        below, m = 0.0, 0
        while m <= n:  # posterior Beta(m + 1, n - m + 1): P(J >= t) = P(Binomial(n + 1, t) <= m)
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers of sets, one of left and one of right (both of left if right is None), that reach the threshold."""
    sig = signatures(sets)
    a, b = (left, left) if right is None else (left, right)
    size = np.array([len(s) for s in sets])
    alive = np.triu(np.ones((len(a), len(a)), bool), 1) if right is None else np.ones((len(a), len(b)), bool)
    small, large = np.minimum.outer(size[a], size[b]), np.maximum.outer(size[a], size[b])
    alive &= small >= threshold * large - 1e-9
    i, j = np.nonzero(alive)
    i, j = a[i], b[j]
    agree = np.zeros(len(i), np.int32)
    for n, m in least_agreeing(threshold, tolerance):
        for k in range(0, len(i), 50_000):
            part = slice(k, k + 50_000)
            agree[part] += (sig[i[part], n - STEP : n] == sig[j[part], n - STEP : n]).sum(1, dtype=np.int32)
        ok = agree >= m
        i, j, agree = i[ok], j[ok], agree[ok]
        if not len(i):
            return i, j
    used = np.unique(np.concatenate([i, j]))
    # One by one, or all at once by products of the incidence matrix, whichever takes fewer steps.
    if len(i) <= 64 or len(i) * (size[i] + size[j]).mean() * 50 < float(len(used)) ** 2 * size[used].sum() / 10:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        row = np.full(len(sets), -1)
        row[used] = np.arange(len(used))
        values, inverse, counts = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(used)), size[used])
        column = np.cumsum(counts > 1) - 1
        shared = counts[inverse] > 1
        owner, inverse = owner[shared], column[inverse[shared]]
        common = np.zeros((len(used), len(used)), np.float32)
        for k in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            here = (inverse >= k) & (inverse < k + 4096)
            m = np.zeros((len(used), 4096), np.float32)
            m[owner[here], inverse[here] - k] = 1
            common += m @ m.T
        both = common[row[i], row[j]].astype(np.int64)
    ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
    return i[ok], j[ok]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Root (least member) of each of n nodes under the links."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def _block_pair(threshold: float, tolerance: float):
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort([x.as_py() for x in group["key"]])
        keys = [group["key"][int(k)].as_py() for k in order]
        sets = [np.frombuffer(group["set"][int(k)].as_py(), np.uint64) for k in order]
        mine = group["mine"].to_numpy()[order]
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        left = np.flatnonzero(mine == lo)
        right = None if lo == hi else np.flatnonzero(mine == hi)
        i, j = links(sets, left, right, threshold, tolerance) if len(keys) > 1 and len(left) and (right is None or len(right)) else (left[:0], left[:0])
        n = np.bincount(np.concatenate([i, j]), minlength=len(keys))
        root = _forest(len(keys), i, j)
        some = np.flatnonzero(n).tolist()
        return pa.table({"key": pa.array([keys[k] for k in some], pa.binary()), "n": pa.array(n[some], pa.int64()), "root": pa.array([keys[root[k]] for k in some], pa.binary())})

    return run


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of df: id_col, row_key (of id and text), class_id (least id with the same shingles), n_copies,
    n_links (other classes at the threshold or above), group_id (least id over the links' connected group), keeper
    (whether this row stands for its group)."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))

    def sign():
        weights = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingles(*text_bytes(b.column(1)))
            full = [k for k, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if full:
                sig = mixed(signatures([sets[k] for k in full]).astype(np.uint64) * weights).reshape(len(full), BANDS, ROWS)
                values = mixed(sig.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                for k, v in zip(full, values, strict=True):
                    bands[k] = v
            keys = [class_key(s) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "row", "key", "size", "bands"])

        return one

    signed = stored(spark, map_slices(docs, sign, f"id {kind}, row binary, key binary, size long, bands array<bigint>"), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    classes = stored(spark, signed.where("key is not null").groupBy("key").agg(first, F.count("*").alias("n_copies")), "classes")
    blocks, tasks = _tasks(signed.where("key is not null").select("key", "size", F.explode("bands").alias("bucket")))
    known = spark.sparkContext.broadcast(bitmap(blocks, F.conv(F.substring(F.hex("key"), 1, 16), 16, -10).cast("long")))

    def again():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s for s in shingles(*text_bytes(b.column(1))) if len(s)]
            keys = [class_key(s) for s in sets]
            some = np.flatnonzero(may(known.value, _hash_of(keys))).tolist()
            found = {keys[k]: sets[k].tobytes() for k in some}
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["key", "set"])

        return one

    sets = map_slices(docs, again, "key binary, set binary").groupBy("key").agg(F.first("set").alias("set"))
    found = tasks.join(sets, "key").groupBy("lo", "hi").applyInArrow(_block_pair(threshold, tolerance), "key binary, n long, root binary")
    found = stored(spark, found, "links")
    n_links = found.groupBy("key").agg(F.sum("n").alias("n_links"))
    group = components(found.where("key <> root").select("key", "root"), "key", "root").select(F.col("node").alias("key"), "root")
    of = classes.join(n_links, "key", "left").join(group, "key", "left").withColumn("root", F.coalesce("root", "key"))
    heads = of.groupBy("root").agg(F.min("first").alias("head"))
    of = of.join(heads, "root").select("key", F.col("first.id").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("head.id").alias("group_id"), F.col("head.row").alias("head"))
    some = signed.select("id", "row", "key").where("key is not null").join(of, "key").select("id", "row", "class_id", "n_copies", "n_links", "group_id", (F.col("row") == F.col("head")).alias("keeper"))
    alone = signed.where("key is null").select("id", "row", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("group_id"), F.lit(True).alias("keeper"))
    return some.unionByName(alone).select(F.col("id").alias(id_col), F.col("row").alias("row_key"), "class_id", "n_copies", "n_links", "group_id", "keeper")


def _tasks(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, block of each class that shares a bucket; and lo, hi, mine, key: the members of each task, a pair of blocks
    (lo = hi within one), with the block that each is of. buckets: key, size, bucket, a row for each document and band."""
    spark = buckets.sparkSession
    shared = buckets.groupBy("bucket").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("bucket", "least")
    within = stored(spark, buckets.join(shared, "bucket").groupBy("bucket", "key").agg(F.first("size").alias("size"), F.first("least").alias("least")), "buckets")
    heads = within.groupBy("key").agg(F.min("least").alias("head"), F.first("size").alias("size"))
    loads = stored(spark, heads.groupBy("head").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("slots")), "loads")
    blocks = stored(spark, heads.join(loads, "head").select("key", F.xxhash64("head", F.pmod(F.hash("key"), "slots")).alias("block")), "blocks")
    several = blocks.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block")
    own = blocks.join(several, "block").select(F.col("block").alias("lo"), F.col("block").alias("hi"), F.col("block").alias("mine"), "key")
    placed = stored(spark, within.select("bucket", "key").join(blocks, "key"), "placed")
    met = placed.groupBy("bucket").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a <> b").select("bucket")
    placed = placed.join(met, "bucket", "left_semi")
    other = placed.select("bucket", F.col("block").alias("other")).distinct()
    across = placed.join(other, "bucket").where("block <> other").select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.col("block").alias("mine"), "key").distinct()
    return blocks, own.unionByName(across)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all columns, that stand for their group; texts without words all stay, a repeated row stays once.
    Rows are told apart by 128 bits of their id and text."""
    key = fresh(df, "row_key")
    keep = join(df, id_col, text_col, threshold).where("keeper").select(F.col("row_key").alias(key)).distinct()
    rows = df.withColumn(key, row_key(id_col, text_col)).join(keep, key, "left_semi")
    return rows.dropDuplicates([key]).drop(key)
