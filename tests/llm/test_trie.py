"""The conversation prefix trie against plain versions of its definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from scorewright.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, size int"


def brute_nodes(turns):
    """Rows of the contract from rows (conv_id, turn, role, text)."""
    convs = {}
    for c, t, r, x in turns:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(rows)] for c, rows in convs.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c / 100) * 100
        made[c] = own.get(base, [])[:h] + mine[h:]
    members, ends = {(): []}, {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        leaves = sum(out[q][5] for q in below) if below else 1
        least = lambda q: min(members[q], default=None)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out[p] = (least(p), len(p), least(p[:-1]) if p else None, len(members[p]), len(below), leaves, saved + sum(out[q][6] for q in below), sha)
    return sorted(out.values(), key=str)


def made(seed, n=230, long=0):
    r = random.Random(seed)
    said = ["", "a", "bb", "ccc", "é€😀", None]
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        if c % 3 == 0:
            turns = [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "bye")][: r.randint(1, 3)]
        else:
            turns = [(t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(said)) for t in range(r.randint(1, 7))]
        rows += [(c, *t) for t in turns]
    rows += [(7, k, "user", f"t{k % 5}") for k in range(long)]
    rows += [(100_000_000_001, 0, "user", "hi"), (-250, 1, "user", "x"), (None, 0, "user", "nobody"), rows[0]]
    return rows


@pytest.mark.parametrize("shard", [3, 40, 1 << 18])
@pytest.mark.parametrize("parts", [1, 5])
def test_nodes(spark, shard, parts):
    rows = made(shard + parts, long=30 if shard == 40 else 0)
    df = spark.createDataFrame([(*x, "n", 1) for x in rows], SCHEMA).repartition(3)
    got = trie.nodes(trie.rebuilt(trie.conversations(df)), parts, shard, 4).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_nodes(rows)


def test_no_conversations(spark):
    got = trie.nodes(trie.rebuilt(trie.conversations(spark.createDataFrame([], SCHEMA)))).collect()
    assert [tuple(x) for x in got] == [(None, 0, None, 0, 0, 1, 0, trie.EMPTY)]


@pytest.mark.parametrize("block", [2, 8, 256])
def test_findclose(monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    r = random.Random(block)
    for n in (1, 5, 300, 2000):
        bits, depth = [1], 1
        while len(bits) < n:
            up = depth == 1 or r.random() < 0.5
            bits.append(int(up))
            depth += 1 if up else -1
        bits += [0] * depth
        stack, close = [], {}
        for k, b in enumerate(bits):
            if b:
                stack.append(k)
            else:
                close[stack.pop()] = k
        opens = np.array(sorted(close))
        assert trie.Parentheses(np.array(bits, np.uint8)).findclose(opens).tolist() == [close[k] for k in opens.tolist()]


def test_copies_split_over_shards(spark):
    """Thousands of equal conversations: pieces of one list of ends, hashed in order."""
    df = spark.range(3000).selectExpr("id * 100 as conv_id", "0L as turn", "'user' as role", "'same' as text")
    got = {x["depth"]: x for x in trie.nodes(trie.rebuilt(trie.conversations(df)), 7, 500, 64).collect()}
    ids = hashlib.sha256(",".join(str(k * 100) for k in range(3000)).encode()).hexdigest()
    assert (got[1]["n_convs"], got[1]["n_leaves"], got[1]["saved_tokens"], got[1]["ends_sha256"]) == (3000, 1, 2999 * 4, ids)
    assert (got[0]["n_children"], got[0]["saved_tokens"], got[0]["ends_sha256"]) == (1, 2999 * 4, trie.EMPTY)
