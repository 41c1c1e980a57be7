"""Texts of very many lines or tokens."""

import random
import re
import time

import numpy as np

from scorewright.llm import linededup, secrets


def test_many_recurring_lines(spark):
    """200,000 lines that recur, in one text of 6 MB, go in seconds."""
    text = "\n".join(f"this is the line number {k}" for k in range(200_000))
    own = "\n".join(f"{k * k:x} is only here" for k in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nand one of its own"), (3, "other"), (4, own + "\nthis is the line number 7")], "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r for r in linededup.transform(df).collect()}
    assert time.time() - start < 90
    assert got[1]["text"] == text and got[2]["text"] == "and one of its own" and got[2]["n_dropped"] == 200_000 and got[3]["n_lines"] == 1
    assert (got[4]["text"], got[4]["n_dropped"]) == (own, 1)


def plain_spans(text, model, threshold, least):
    """Base spans, and the tokens that a plain Markov scorer marks outside of them."""
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]{16,}", text)] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{24,}", text)]
    out = sorted(base)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", text):
        before, ratio = 0, 0.0
        for c in m[0]:
            ratio += model[before * secrets.SYMBOLS + ord(c) - 31]
            before = ord(c) - 31
        if ratio >= max(len(m[0]) * threshold, least) and not any(a < m.end() and m.start() < b for a, _, b in base):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_secret_spans_against_a_plain_scorer(spark):
    """Tokens that touch, hold or cross base spans, and those that stand clear of them."""
    r = random.Random(5)
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    parts = [lambda: hexes(30), lambda: hexes(24) + "api_key: " + hexes(8), lambda: "x" * 12, lambda: "token=" + "".join(r.choices("abcXYZ019.", k=20)), lambda: "AKIA" + "ABCD0123" * 2, lambda: "".join(r.choices("qzjxkvQZ57+/", k=r.randint(10, 30))), lambda: "plain_words_together", lambda: "zz", lambda: "SECRET = " + "Qz7" * 5 + "." + "kX9" * 6]
    texts = ["", "none here", *(r.choice([" ", "\n", ".", ", "]).join(r.choice(parts)() for _ in range(r.randint(1, 60))) for _ in range(60))]
    labelled = [("".join(r.choices("qzjxkvQZ57+/", k=20)), 1, 1) for _ in range(50)] + [(w, 0, 3) for w in ("plain", "words", "plain_words", "together", "x" * 20, "none", "here", "")]
    model = secrets.train(spark.createDataFrame(labelled, "token string, random int, n long"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: [(s["start"], s["k"], s["end"]) for s in x["spans"]] for x in secrets.spans(df, model).collect()}
    assert got == {k: plain_spans(t, model, secrets.THRESHOLD, secrets.LEAST) for k, t in enumerate(texts)}
    assert sum(s[1] == 3 for x in got.values() for s in x) > 100


def test_many_tokens_of_one_text(spark):
    """32,000 hex tokens and as many others, all marked by the model, in one text of 2 MB."""
    text = " ".join(f"{k:032x} {'ghij' * 4}{k % 7}" for k in range(32_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    got = secrets.report(secrets.spans(df, np.full(secrets.SYMBOLS**2, 1.5))).collect()[0]
    assert time.time() - start < 60
    assert got["n_hex"] == 32_000 == got["spans"].count("markov")
