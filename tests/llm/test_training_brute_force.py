"""Operators that SQL can't express, against brute-force versions."""

import hashlib
import random

from scorewright.llm import jaccard, suffix

SCHEMA = "doc_id long, text string, score string, key string"


def corpus(seed=3, n=60):
    """Texts with exact copies, near copies, shared passages, repeats, empty and null texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñ ") for _ in range(r.randint(2, 7))).strip() or "x" for _ in range(60)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = text(60)
    docs = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not docs:
            docs.append(text(r.randint(1, 150)))
        elif kind == 1:
            docs.append(r.choice([d for d in docs if d]))
        elif kind == 2:
            words = r.choice([d for d in docs if d]).split(" ")
            words[r.randrange(len(words))] = "changed"
            docs.append(" ".join(words))
        elif kind == 3:
            docs.append(text(20) + "\n" + passage + " " + text(r.randint(0, 30)))
        elif kind == 4:
            docs.append("ab" * r.randint(1, 200))
        else:
            docs.append(r.choice(["", None, text(3), text(400)]))
    rows = [(i, t, "x", "y") for i, t in enumerate(docs)]
    return [*rows, rows[3], (None, passage, "x", "y"), (None, None, "x", "y"), (-5, passage, "x", "y")]


def brute_suffix(rows, length=50):
    key = lambda i: suffix.NO_ID if i is None else i
    least = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            least[s] = min(least.get(s, key(i)), key(i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < key(i):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_removal(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in suffix.report(suffix.remove(df)).collect()]
    assert sorted(got, key=str) == brute_suffix(rows)


def test_suffix_removal_across_boundaries(spark, monkeypatch):
    """Partitions so small that grams go on in the next: their strings are compared across boundaries."""
    monkeypatch.setattr(suffix, "PART_BYTES", 400)
    rows = corpus(8, 80)
    got = [tuple(r) for r in suffix.report(suffix.remove(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()]
    assert sorted(got, key=str) == brute_suffix(rows)


def test_suffix_hot_gram(spark, monkeypatch):
    """A gram in every document, in different surroundings, and partitions of a few records."""
    monkeypatch.setattr(suffix, "PART_BYTES", 2000)
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    tails = [word(40) for _ in range(6)]
    rows = [(i, word(r.randint(0, 40)) + "the hottest gram of all" + r.choice(tails)[: r.randint(5, 40)] + word(r.randint(0, 30)), "x", "y") for i in range(150)]
    got = [tuple(x) for x in suffix.report(suffix.remove(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()]
    assert sorted(got, key=str) == brute_suffix(rows)


def test_suffix_tells_only_shared_strings():
    """Strings of one document make no row, however many records a gram has: only those that a smaller document has too."""
    strings = [f"{k:050d}".encode() for k in range(300)] + [b"s" * 50] * 4
    docs = [*range(300), 9, 5, 9, 7]
    batch = suffix._batch([(d, 1000 + k, 1 << k % 31, s) for k, (d, s) in enumerate(zip(docs, strings, strict=True))]).select(["doc", "name", "mask", "string"])
    rows = [r for b in suffix.across(iter([batch.slice(0, 100), batch.slice(100)])) for r in b.to_pylist()]
    assert sorted((r["doc"], r["name"]) for r in rows) == [(7, 1303), (9, 1300), (9, 1302)]
    assert all(r["lost"] == 1 << (r["name"] - 1000) % 31 for r in rows)
    assert not list(suffix.across(iter([])))


def test_suffix_long_texts(monkeypatch):
    """The records of a text that is read in stretches are those of the whole text."""
    r = random.Random(1)
    body = "".join(r.choice("abcd ") for _ in range(30_000)).encode()
    whole = suffix.Records(body, [0, len(body)])
    monkeypatch.setattr(suffix, "SLICE", 1000)
    cut = suffix.Records(body, [0, len(body)])
    string = lambda x: sorted({(p, k) for a, b, p in zip(x.first.tolist(), x.last.tolist(), x.place.tolist(), strict=True) for k in range(a, b + 1)})
    assert string(whole) == string(cut) and len(cut.first) > len(whole.first)


def test_suffix_refuses_other_ids(spark):
    import pytest

    with pytest.raises(TypeError, match="integers"):
        suffix.remove(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_suffix_empty(spark):
    assert suffix.remove(spark.createDataFrame([], SCHEMA)).count() == 0


def test_multikey_order():
    import numpy as np

    w = np.random.default_rng(0).integers(0, 3, (500, 4)).astype(np.uint64)
    order, run = suffix.multikey_order(w)
    assert [tuple(x) for x in w[order]] == sorted(map(tuple, w))
    assert len(set(run.tolist())) == len(set(map(tuple, w.tolist())))


def brute_join(rows, threshold=0.8):
    def shingles(t):
        w = (t or "").encode().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {}
    for i, t, *_ in rows:
        sets.setdefault(shingles(t), []).append(i)
    sets.pop(frozenset(), None)
    classes = list(sets)
    linked = {a: [b for b in classes if b is not a and len(a & b) >= threshold * len(a | b) - 1e-9] for a in classes}
    least = lambda ids: min([x for x in ids if x is not None], default=None)
    out = []
    for i, t, *_ in rows:
        s = shingles(t)
        if not s:
            out.append((i, i, 1, 0, i))
            continue
        group, todo = {s}, [s]
        while todo:
            new = [b for b in linked[todo.pop()] if b not in group]
            group.update(new)
            todo += new
        out.append((i, least(sets[s]), len(sets[s]), len(linked[s]), least([x for g in group for x in sets[g]])))
    return sorted(out, key=str)


def test_jaccard_join(spark, monkeypatch):
    rows = corpus(5, 90)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_join(rows)
    for block in (1024, 2):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = [tuple(r) for r in jaccard.join(df).select("doc_id", "class_id", "n_copies", "n_links", "group_id").collect()]
        assert sorted(got, key=str) == want
    kept = jaccard.deduplicate(df)
    assert kept.columns == df.columns
    per_group = {}
    ids = {r[0]: r[4] for r in want}
    for r in kept.where("text <> ''").collect():
        per_group[ids[r["doc_id"]]] = per_group.get(ids[r["doc_id"]], 0) + 1
    assert set(per_group.values()) == {1}


def test_jaccard_empty(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_least_agreeing_keeps_likely_pairs():
    for n, m in jaccard.least_agreeing():
        assert m < 0.8 * n


def test_jaccard_of_string_ids_and_nulls(spark):
    rows = [("a", None), (None, "a"), ("b", "one two three four five six"), ("c", "one two three four five six"), (None, None), (None, None)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id string, text string, row_key string, id string")
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.deduplicate(df).collect()), key=str)
    assert kept == sorted([("a", None), (None, "a"), ("b", "one two three four five six"), (None, None)], key=str)


def test_jaccard_of_many_near_copies(spark, monkeypatch):
    """One large group whose block is split, long texts, and blocks that meet in a bucket."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w), "x", "y"))
    rows += [(100 + i, " ".join(word() for _ in range(30_000)), "x", "y") for i in range(2)]
    rows += [(110, rows[-1][1] + " more", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_join(rows)
    for block, size in ((1024, 1 << 20), (7, 1 << 20), (1024, 900)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", size)
        got = [tuple(x) for x in jaccard.join(df).select("doc_id", "class_id", "n_copies", "n_links", "group_id").collect()]
        assert sorted(got, key=str) == want
