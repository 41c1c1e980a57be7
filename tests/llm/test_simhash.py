"""SimHash near-duplicates against plain versions of fingerprint, link and component."""

import random

import numpy as np
import pytest
import xxhash

from scorewright.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root string, id int"


def brute_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """The least number of each value's component, by comparing all pairs."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def brute_group(rows):
    ids = [r[0] for r in rows]
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = brute_components(fps)
    key = lambda i: (i is None, i or 0)
    return sorted(((ids[k], f"{fps[k]:016x}", min((ids[j] for j in range(len(ids)) if root[j] == root[k]), key=key)) for k in range(len(ids))), key=str)


def corpus(seed=5, n=120):
    r = random.Random(seed)
    words = ["Stadt", "ÄPFEL", "see", "the", "RUNS", "x y", "日本", "go"] + [f"w{k}" for k in range(200)]
    text = lambda k: r.choice([" ", "\t", "\r\n"]).join(r.choice(words) for _ in range(k))
    docs = [text(r.choice([1, 2, 3, 40, 300])) for _ in range(n // 2)]
    while len(docs) < n:
        own = r.choice(docs).split(" ")
        if len(own) > 100 or r.random() < 0.3:
            own[r.randrange(len(own))] = r.choice(words)
        docs.append(" ".join(own).upper() if r.random() < 0.3 else " ".join(own))
    rows = [(k, t, "a", "b", 1) for k, t in enumerate(docs)]
    return [*rows, rows[4], (-9, "", "a", "b", 1), (None, None, "a", "b", 1), (700, " \n ", "a", "b", 1), (None, docs[2], "a", "b", 1)]


@pytest.mark.parametrize("hot", [1, simhash.HOT])
def test_groups(spark, hot):
    rows = corpus()
    got = simhash.group(spark.createDataFrame(rows, SCHEMA).repartition(3), hot=hot).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_group(rows)


def test_no_documents(spark):
    assert simhash.group(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text():
    """Texts longer than one step of hashing."""
    text = " ".join(f"w{k % 977}" for k in range(simhash.STEP + 500))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def near(n, seed, bits):
    """Distinct fingerprints that differ in the first bits only, so all of them share the keys of the others."""
    r = np.random.default_rng(seed)
    return np.unique(r.integers(0, 1 << bits, n, dtype=np.uint64))


@pytest.mark.parametrize("direct", [4, 512])
def test_close_splits_many(monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    values = near(300, 3, 32)
    values = np.unique(np.concatenate([values, values[:90] ^ np.uint64(5), values[90:140] ^ np.uint64(7 << 20)]))
    root = simhash.spanning(len(values), *simhash.close(values, list(range(32))))
    assert root.tolist() == brute_components([int(v) for v in values])


@pytest.mark.parametrize("hot", [8, 100_000])
def test_one_hot_key(spark, hot):
    """Hundreds of fingerprints in the same keys are linked alike, split or not."""
    values = near(400, 9, 14).astype(np.int64)
    edges = simhash.links(spark.createDataFrame([(int(v),) for v in values], "fp long"), hot).collect()
    at = {int(v): k for k, v in enumerate(values)}
    i, j = (np.array([at[e[c]] for e in edges]) for c in ("fp", "root"))
    assert simhash.spanning(len(values), i, j).tolist() == brute_components([int(v) for v in values])
