"""Prefix trie of conversations as balanced parentheses per shard.

A conversation is the row of its turns' digests (128 bits of role and text) and code points; texts don't travel. All are
range-partitioned by that row and their id, so copies split as well, and each task cuts its sorted range into shards of a
bounded number of turns. A shard's trie is a sequence of parentheses in depth-first order, an open one for each distinct
prefix. Excess values, in blocks with a tree of their least ones, give findclose, which delimits a node's subtree; the
rank of "()" pairs counts its leaves, the rank of conversation ends its members, and cumulative sums its savings.

Only prefixes of a shard's first or last conversation can go on in another shard. These spines are set apart with what
hangs on them, merged by the digest of the prefix, and their subtrees are added up by pointer doubling: joins of the few
spine rows, as often as the logarithm of the depth. All other nodes are whole where they are.

Turns are ordered by turn (null first), then by role and text (64 characters of each, then their digest); null roles and texts are empty. Rows of a null conv_id belong
to no conversation. A conversation may have no turns; it ends at the root. An empty table has the root alone, without members
(conv_id null). Ids are whole numbers. Only the named columns are read. A conversation is one row of 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import stored

#: Turns of a shard, but for a single longer conversation.
SHARD_TURNS = 1 << 18
#: Parentheses of a block.
BLOCK = 256
#: Ids in one piece of a list of ends.
PIECE = 1 << 14
#: Parts into which the rows of one parent are salted.
SALT = 16
EMPTY = hashlib.sha256(b"").hexdigest()
WIDE = 16


class Parentheses:
    """Balanced parentheses: bits (1 opens) with their excess and a tree of the least excess of each block."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        n = -(-len(bits) // BLOCK)
        self.leaves = 1 << max(n - 1, 0).bit_length()
        self.least = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.least[self.leaves : self.leaves + n] = np.minimum.reduceat(self.excess, np.arange(n) * BLOCK)
        level = self.leaves
        while level > 1:
            self.least[level // 2 : level] = self.least[level : 2 * level].reshape(-1, 2).min(1)
            level //= 2

    def _within(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place from at on, within its block, where the excess is the target; -1 if there is none."""
        out, live, stop = np.full(len(at), -1), np.arange(len(at)), np.minimum((at // BLOCK + 1) * BLOCK, len(self.bits))
        here = at.copy()
        while len(live):
            live = live[here[live] < stop[live]]
            hit = self.excess[here[live]] == target[live]
            out[live[hit]] = here[live[hit]]
            live = live[~hit]
            here[live] += 1
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: where the excess first falls below that of the opening one."""
        target = self.excess[opens] - 1
        out = self._within(opens + 1, target)
        some = np.flatnonzero(out < 0)
        node, t = opens[some] // BLOCK + self.leaves, target[some]
        # To the next block on the right whose least excess is low enough: up while a node is the right child, then on.
        up = np.ones(len(some), bool)
        while up.any():
            k = np.flatnonzero(up)
            right = node[k] & 1 == 1
            node[k[right]] >>= 1
            k = k[~right]
            node[k] += 1
            up[k[self.least[node[k]] <= t[k]]] = False
        while len(k := np.flatnonzero(node < self.leaves)):
            left = self.least[2 * node[k]] <= t[k]
            node[k] = 2 * node[k] + ~left
        out[some] = self._within((node - self.leaves) * BLOCK, t)
        return out


class Shard:
    """The trie of sorted conversations: conv ids, paths (WIDE bytes a turn) and the code points of each turn."""

    def __init__(self, ids: np.ndarray, paths: list[bytes], sizes: list[np.ndarray]):
        self.ids, self.paths = ids, paths
        n = np.array([len(p) // WIDE for p in paths], np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        turns = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, WIDE // 8)
        j = np.arange(first[-1]) - np.repeat(first[:-1], n)
        row = np.repeat(np.arange(len(n)), n)
        # Turns that the conversation before shares: up to the first that differs.
        other = first[row - 1] + j
        can = (row > 0) & (j < n[row - 1])
        same = np.zeros(len(j), bool)
        same[can] = (turns[can] == turns[other[can]]).all(1)
        shared = n.copy()
        np.minimum.at(shared, row[~same], j[~same])
        new = j >= shared[row]
        # The parentheses: the root, then for each conversation the closing ones of the last and its own opening ones.
        fresh = n - shared
        closing = np.concatenate([[0], n[:-1] - shared[1:]])
        runs = np.stack([closing, fresh], 1).ravel()
        self.bits = np.concatenate([[1], np.repeat(np.tile([0, 1], len(n)), runs), np.zeros(n[-1] + 1)]).astype(np.uint8)
        self.tree = Parentheses(self.bits)
        self.opens = np.flatnonzero(self.bits)
        self.depth = np.concatenate([[0], j[new] + 1])
        self.size = np.concatenate([[0], np.concatenate([*sizes, np.zeros(0, np.int64)])[new].astype(np.int64)])
        self.close = self.tree.findclose(self.opens)
        # Where each conversation ends: the last node that it opened, or that of its shared turns.
        order = np.lexsort((self.opens, self.depth))
        self._sorted = self.depth[order] * (len(self.bits) + 1) + self.opens[order], order
        last = np.cumsum(fresh)  # number of nodes but the root up to each conversation
        self.end = self.above(n, self.opens[last])
        ends = np.bincount(self.opens[self.end], minlength=len(self.bits))
        self.ended = np.cumsum(ends)
        self.n_ends = ends[self.opens]
        self.from_row, self.to_row = self.ended[self.opens] - self.n_ends, self.ended[self.close]
        self.members = self.to_row - self.from_row
        pairs = np.cumsum(np.concatenate([(self.bits[:-1] == 1) & (self.bits[1:] == 0), [False]]))
        self.leaf = self.close == self.opens + 1
        self.leaves = pairs[self.close] - pairs[self.opens] + self.leaf
        self.parent = self.above(self.depth - 1, self.opens)
        self.parent[0] = -1
        self.children = np.bincount(self.parent[1:], minlength=len(self.opens))
        self.least = self._least()

    def above(self, depth: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the nodes of these depths that are last opened at or before these places."""
        key, order = self._sorted
        return order[np.maximum(np.searchsorted(key, depth * (len(self.bits) + 1) + at, "right") - 1, 0)]

    def total(self, values: np.ndarray) -> np.ndarray:
        """The sum of the nodes' values over each node's subtree."""
        by = np.zeros(len(self.bits), np.int64)
        by[self.opens] = values
        by = np.cumsum(by)
        return by[self.close] - by[self.opens] + values

    def _least(self) -> np.ndarray:
        """The least id of each node's members, from least ids of runs of 1, 2, 4, ... conversations."""
        runs, out = self.ids.copy(), np.empty(len(self.opens), np.int64)
        width, level = 1, np.frexp(self.members.astype(np.float64))[1] - 1
        for k in range(int(level.max()) + 1):
            some = np.flatnonzero(level == k)
            out[some] = np.minimum(runs[self.from_row[some]], runs[self.to_row[some] - width])
            runs = np.minimum(runs[: len(runs) - width], runs[width:]) if len(runs) > width else runs
            width *= 2
        return out

    def spines(self) -> np.ndarray:
        """Whether each node is a prefix of the first or the last conversation."""
        return (self.from_row == 0) | (self.to_row == len(self.ids))

    def names(self, row: int) -> list[bytes]:
        """Digests of the prefixes of one conversation, from the root on."""
        h, out = hashlib.blake2b(digest_size=WIDE), []
        path = self.paths[row]
        for k in range(0, len(path) + 1, WIDE):
            out.append(h.digest())
            h.update(path[k : k + WIDE])
        return out


#: Rows of the shards. kind 0: a whole node, whose parent is whole too or named by parent; 1: a part of a spine node; 2: a
#: piece of the ends of a spine node.
PARTS = "kind int, name binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends string"


def _table(**columns) -> pa.RecordBatch:
    n = len(columns["conv_id"])
    kinds = [("kind", pa.int32()), ("name", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")), ("ends", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds], [c for c, _ in kinds])


def _parts(s: Shard, piece: int) -> Iterator[pa.RecordBatch]:
    spine, saved = s.spines(), (s.members - 1) * s.size
    name: list[bytes | None] = [None] * len(s.opens)
    for row in (0, len(s.ids) - 1):
        found = s.names(row)
        for k, node in enumerate(s.above(np.arange(len(found)), np.full(len(found), s.opens[s.end[row]])).tolist()):
            name[node] = found[k]
    text = lambda a, b: ",".join(map(str, s.ids[a:b].tolist()))
    n_ends, start = s.n_ends.tolist(), s.from_row.tolist()
    total = s.total(saved)
    own = np.flatnonzero(~spine)
    ends = [hashlib.sha256(text(start[k], start[k] + n_ends[k]).encode()).hexdigest() if n_ends[k] else EMPTY for k in own.tolist()]
    above = s.parent[own]
    whole = ~spine[above]
    yield _table(kind=np.zeros(len(own), np.int32), parent=[name[p] for p in above.tolist()], conv_id=s.least[own], depth=s.depth[own], parent_conv_id=pa.array(s.least[above], mask=~whole), n_convs=s.members[own], n_children=s.children[own], n_leaves=s.leaves[own], saved_tokens=total[own], ends=ends)
    # A spine node's part: sums over the whole nodes below it, but those below its spine children, which count there.
    hung = [s.total(np.where(spine, 0, v)) for v in (saved, s.leaf.astype(np.int64))]
    on = np.flatnonzero(spine)
    low = on[s.parent[on] >= 0]
    for h in hung:
        np.subtract.at(h, s.parent[low], h[low].copy())
    few = s.children.copy()
    np.subtract.at(few, s.parent[low], 1)
    yield _table(kind=np.ones(len(on), np.int32), name=[name[k] for k in on.tolist()], parent=[name[p] if p >= 0 else None for p in s.parent[on].tolist()], conv_id=s.least[on], depth=s.depth[on], n_convs=s.members[on], n_children=few[on], n_leaves=hung[1][on], saved_tokens=hung[0][on], size=s.size[on])
    pieces = [(name[k], a, min(a + piece, start[k] + n_ends[k])) for k in on.tolist() for a in range(start[k], start[k] + n_ends[k], piece)]
    if pieces:
        yield _table(kind=np.full(len(pieces), 2, np.int32), name=[p[0] for p in pieces], conv_id=[int(s.ids[a]) for _, a, _ in pieces], ends=[text(a, b) for _, a, b in pieces])


def _shards(most: int, piece: int):
    """mapInArrow over sorted rows of conv_id, path, sizes to PARTS, a shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, paths, sizes, n = [], [], [], 0
        for b in batches:
            for i, p, z in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                path = p.as_py()
                if n and n + len(path) // WIDE + 1 > most:
                    yield from _parts(Shard(np.array(ids, np.int64), paths, sizes), piece)
                    ids, paths, sizes, n = [], [], [], 0
                ids.append(i)
                paths.append(path)
                sizes.append(z.values.to_numpy())
                n += len(path) // WIDE + 1
        if n:
            yield from _parts(Shard(np.array(ids, np.int64), paths, sizes), piece)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces (name, ends) to the digest of each name's whole list, holding one piece at a time."""
    now, h = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["name", "ends_sha256"])

    for b in batches:
        for name, ends in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if name != now:
                if h is not None:
                    yield row()
                now, h = name, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ends.as_py().encode())
    if h is not None:
        yield row()


def digest(role: Column, text: Column) -> Column:
    """32 hex digits that name a turn."""
    return F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "utf-8"))


def conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns (array of struct name, size, in order) for each conversation of a table with a row for each turn."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    turns = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.substring(role, 1, 64).alias("role"), F.substring(text, 1, 64).alias("start"), digest(role, text).alias("name"), F.length(text).cast("long").alias("size")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: F.struct(t["name"].alias("name"), t["size"].alias("size"))).alias("turns"))


def rebuilt(convs: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """convs with the first h turns of conversation c - c % every in place of each conversation c's own first h turns, where
    h is the CRC-32 of c in decimal, modulo heads."""
    c = F.col("conv_id")
    own = convs.select("conv_id", "turns", (F.crc32(c.cast("string")) % heads).cast("int").alias("h"), (c - c % every).alias("base"))
    base = convs.where(c % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("_head"))
    joined = own.join(base, "base", "left")
    head = F.coalesce(F.slice("_head", 1, F.col("h")), F.array().cast(convs.schema["turns"].dataType))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def nodes(convs: DataFrame, parts: int | None = None, shard_turns: int = SHARD_TURNS, piece: int = PIECE) -> DataFrame:
    """A row for each distinct prefix of conversations (conv_id, turns): conv_id (least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    rows = stored(spark, convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), "")).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "conversations")
    dealt = rows.repartitionByRange(parts, "path", "conv_id") if parts else rows.repartitionByRange("path", "conv_id")
    found = stored(spark, dealt.sortWithinPartitions("path", "conv_id").mapInArrow(_shards(shard_turns, piece), PARTS), "shards")
    spine = merged(found)
    out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    whole = found.where("kind = 0").withColumnRenamed("ends", "ends_sha256")
    # Very many nodes can hang on one spine node, so they are salted; the spine is small beside them.
    named = spine.select(F.col("name").alias("parent"), F.col("conv_id").alias("_least"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    hung = whole.where("parent is not null").withColumn("_salt", F.pmod(F.hash("conv_id"), F.lit(SALT))).join(named, ["parent", "_salt"]).withColumn("parent_conv_id", F.col("_least"))
    return whole.where("parent is null").select(*out).unionByName(hung.select(*out)).unionByName(spine.select(*out))


def merged(found: DataFrame) -> DataFrame:
    """Whole rows of the spine nodes, from their parts."""
    spark = found.sparkSession
    root = spark.range(1).select(F.lit(hashlib.blake2b(digest_size=WIDE).digest()).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("conv_id"), *(F.lit(0).cast("long").alias(c) for c in ("depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")))
    some = found.where("kind = 1").select(*root.columns).unionByName(root)
    spine = some.groupBy("name").agg(F.first("parent", True).alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("size").alias("size"))
    below = spine.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("_more"))
    spine = spine.join(below, "name", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0))).drop("_more")
    spine = stored(spark, spine, "spine")
    # Subtree sums by doubling: after k rounds a row has the sums of its descendants less than 2 ** k below it, and knows
    # its ancestor 2 ** k above it.
    own = spine.select("name", F.col("parent").alias("up"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), (F.col("saved_tokens") + F.greatest(F.col("n_convs") - 1, F.lit(0)) * F.col("size")).alias("saved_tokens"))
    for _ in range(int(spine.agg(F.max("depth")).first()[0]).bit_length()):
        more = own.where("up is not null").groupBy(F.col("up").alias("name")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        jump = own.select(F.col("name").alias("up"), F.col("up").alias("_far"))
        own = own.join(more, "name", "left").join(jump, "up", "left")
        own = stored(spark, own.select("name", F.col("_far").alias("up"), (F.col("n_leaves") + F.coalesce("_l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_s", F.lit(0))).alias("saved_tokens")), "spine-sums")
    pieces = found.where("kind = 2").select("name", "ends", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id")
    ends = pieces.select("name", "ends").mapInArrow(_hashed, "name binary, ends_sha256 string")
    parents = spine.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    d = spine.drop("n_leaves", "saved_tokens").join(own.drop("up"), "name").join(ends, "name", "left").join(parents, "parent", "left")
    return stored(spark, d.select("name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")), "spine-nodes")


#: CRC-32 (reflected polynomial 0xEDB88320) bit by bit over the ASCII digits of c: a byte is XORed in, then eight shifts.
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_prepend(ascii(x)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1])))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, x) AS ts FROM t GROUP BY c),
h AS (SELECT c, ts, ({_CRC} % 6)::BIGINT AS h FROM own),
built AS (SELECT h.c, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100),
pre AS (SELECT c, d, ts[1:d] AS p, len(ts) AS n FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM built)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM pre GROUP BY p, d),
up AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
own_node AS (SELECT n.*, coalesce(k, 0) AS n_children, (n_convs - 1) * coalesce(length(n.p[n.d].x), 0) AS s FROM node n LEFT JOIN up USING (p, d)),
below AS (SELECT p[1:e] AS p, e AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(s) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM own_node) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM own_node n JOIN below b USING (p, d) LEFT JOIN node m ON m.d = n.d - 1 AND m.p = n.p[1:n.d - 1]
"""
