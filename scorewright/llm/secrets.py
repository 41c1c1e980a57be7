"""Secret scans in DataFrame functions only: fixed patterns, and character Markov models for what they miss.

Two first-order Markov models over printable ASCII, one of random strings and one of ordinary identifiers, are trained
from labelled samples: random are the values of the patterns' matches and digests of the sampled texts in hex and base
64, ordinary are words, numbers, times, ruled lines, and words joined as identifiers and paths are. A token of 12 characters or more is a
secret if its log-likelihood ratio reaches a threshold per character and one in all. Spans that the patterns find always
stay; model spans that overlap one of them are left out.

A null text is empty and has no spans. Rows that repeat get the same result, each. Without samples of both classes the
model finds nothing. Texts of any length are read whole; the characters U+0001 and U+0002 in them match nothing. Only
id_col and text_col are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions.columns import let

#: Patterns (fixed values). Runs of a class end where the class does, so a least length in the pattern finds the same runs.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
#: What a match of ASSIGN holds, in lower case.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")
#: Symbols of the models: 0 begins a token, then printable ASCII, then everything else.
SYMBOLS = 97
SAMPLE_ROWS = 3000
#: Least log-likelihood ratio per character, and of the whole token.
THRESHOLD = 1.0
LEAST = 16.0
#: Weight of the kinds of symbols in a transition's estimate, as a number of observations.
PRIOR = 100.0
SPAN = "array<struct<start:int,k:int,end:int,value:string>>"
#: Parts of a text that one step of _placed() takes; even, so that each step begins outside of a match.
STEP = 128


def _none() -> Column:
    return F.array().cast(SPAN)


def _placed(parts: Column, kind: int, value) -> Column:
    """Spans of the matches among parts, which alternate: what stands outside of matches, a match, and so on.

    Places are summed up in steps of STEP parts, since an array that grows by an element is copied each time.
    """

    def one(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("k"), end.alias("end"), value(x).alias("value"))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def step(acc: Column, b: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.lit(False).alias("odd"), _none().alias("out"))
        some = F.aggregate(F.slice(parts, b * STEP + 1, F.lit(STEP)), start, one)
        return let(some, lambda s: F.struct(s["at"].alias("at"), F.concat(acc["done"], F.array(s["out"])).alias("done")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STEP).cast("int")), zero, step, lambda acc: F.flatten(acc["done"]))


def _found(text: Column, pattern: str, kind: int, value=lambda x: x) -> Column:
    """Spans of a pattern's matches, from one pass that marks them. text holds neither mark."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit("\x01$0\x02"))
    return let(F.split(marked, "[\x01\x02]", -1), lambda parts: _placed(parts, kind, value))


def _base(text: Column) -> Column:
    low = F.lower(text)
    named = let(low, lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(n)) for n in NAMES)))
    assigned = F.filter(_found(text, ASSIGN, 0, lambda x: F.regexp_extract(x, ASSIGN, 2)), lambda s: F.length(s["value"]) >= 6)
    found = [F.when(named, assigned), F.when(F.contains(text, F.lit("AKIA")), _found(text, ACCESS, 1)), F.when(text.rlike(HEX), _found(text, HEX, 2))]
    return F.array_sort(F.concat(*(F.coalesce(x, _none()) for x in found)))


def _text(c: Column | str) -> Column:
    return F.translate(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "\x01\x02", "\x03\x03")


def base_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base: the patterns' spans (array of start, k, end, value by start, then kind)."""
    return df.select(id_col, let(_text(text_col), _base).alias("base"))


def _codes(token: Column) -> Column:
    code = lambda c: F.when((F.ascii(c) >= 32) & (F.ascii(c) < 127), F.ascii(c) - 31).otherwise(SYMBOLS - 1)
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), code)


def _kinds() -> np.ndarray:
    """Of each symbol: start, lower case, upper case, digit, a kind of its own for other ASCII characters, all else."""
    text = [chr(k + 31) for k in range(1, SYMBOLS - 1)]
    of = [1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 + k for k, c in enumerate(text)]
    return np.unique([0, *of, 1000], return_inverse=True)[1]


def _transitions(n: np.ndarray, prior: float) -> np.ndarray:
    """Log transition probabilities from counts, smoothed by those between kinds of symbols, each symbol of a kind alike."""
    kind = _kinds()
    one = np.eye(kind.max() + 1)[kind]
    between = one.T @ n @ one + 0.5
    between /= between.sum(1, keepdims=True)
    expected = between[kind][:, kind] / one.sum(0)[kind]
    return np.log((n + prior * expected) / (n.sum(1, keepdims=True) + prior))


def train(samples: DataFrame, token_col: str = "token", label_col: str = "random", count_col: str = "n", prior: float = PRIOR) -> np.ndarray | None:
    """Log-likelihood ratios of random against ordinary, SYMBOLS x SYMBOLS by (symbol before, symbol), from labelled tokens.

    Equal tokens are counted before they are taken apart, on the cluster; at most 2 * SYMBOLS^2 of them come to the driver. None without both classes.
    """
    tokens = samples.where(F.length(token_col) > 0).groupBy(F.col(label_col).cast("int").alias("y"), F.col(token_col).alias("token")).agg(F.sum(count_col).alias("n"))
    pairs = tokens.where("y in (0, 1)").select("y", "n", _codes(F.col("token")).alias("c"))
    pairs = pairs.select("y", "n", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("c", 1, F.size("c") - 1)).alias("a"), F.col("c").alias("b"))).alias("p"))
    n = np.zeros((2, SYMBOLS, SYMBOLS))
    for r in pairs.groupBy("y", "p.a", "p.b").agg(F.sum("n").alias("n")).collect():
        n[r["y"], r["a"], r["b"]] = r["n"]
    if not n[0].any() or not n[1].any():
        return None
    return (_transitions(n[1], prior) - _transitions(n[0], prior)).ravel()


def samples(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled tokens (token, random, n: how often) from about `rows` documents, chosen by a hash of id and text."""
    share = min(1.0, rows / max(1, df.count()))
    unit = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("secrets")), F.lit(1_000_003)) / 1_000_003
    d = df.where((unit < share) & (F.col(text_col) != "")).select(F.col(text_col).alias("t"), let(_text(text_col), _base).alias("base"))
    digest = F.sha2(F.col("t"), 256)
    coded = F.base64(F.unhex(digest))
    drawn = F.array(F.substring(digest, 1, 40), F.rtrim(F.lit("="), coded), F.translate(F.substring(coded, 1, 24), "+/", "-_"), F.upper(F.base64(F.unhex(F.md5("t")))))
    clean = d.where(F.size("base") == 0)
    words = F.regexp_extract_all("t", F.lit("[A-Za-z]{2,}|[0-9]{2,}"), F.lit(0))
    words = clean.select(F.explode(let(words, lambda w: F.arrays_zip(w.alias("a"), F.slice(w, 2, F.size(w)).alias("b")))).alias("w"))
    words = words.groupBy("w.a", "w.b").agg(F.count("*").alias("n"))  # b: the word after a
    two = ("a", "b")
    joined = F.array(F.concat_ws("_", *two), F.concat_ws("-", *two), F.concat_ws("/", *two), F.concat(*map(F.initcap, two)), F.upper(F.concat_ws("_", *two)))
    named = F.concat(F.array("a"), F.when(F.col("b").isNotNull(), joined).otherwise(F.array().cast("array<string>")))
    when = F.timestamp_seconds(F.pmod(F.xxhash64("t"), F.lit(2_000_000_000)))
    rules = F.array(*(F.repeat(F.lit(c), F.lit(20)) for c in "-=_+/"), *(F.date_format(when, f) for f in ("yyyy-MM-dd'T'HH", "yyyyMMdd'T'HHmmss'Z'", "dd/MMM/yyyy")))
    one = F.lit(1).cast("long").alias("n")
    ordinary = words.select(F.explode(named).alias("token"), F.lit(0).alias("random"), "n").unionByName(clean.select(F.explode(rules).alias("token"), F.lit(0).alias("random"), one))
    random = d.select(F.explode(F.concat(F.transform("base", lambda s: s["value"]), drawn)).alias("token"), F.lit(1).alias("random"), one)
    return random.unionByName(ordinary)


def _ranks(tokens: Column, base: Column, token_place: str, base_place: str, ties: int) -> Column:
    """Of each token in order: how many base spans have base_place before its token_place; ties=1 counts equal places too.

    Tokens don't overlap, so the n-th token among the sorted places is the n-th token, and what stands before it are n
    tokens and the base spans asked for.
    """
    place = lambda spans, name, kind: F.transform(spans, lambda s: F.struct(s[name].alias("at"), F.lit(kind).alias("kind")))
    places = F.array_sort(F.concat(place(tokens, token_place, ties), place(base, base_place, 1 - ties)))
    numbered = F.transform(places, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda x: x["kind"] == ties), lambda x, n: x["i"] - n)


def _clear(tokens: Column, base: Column) -> Column:
    """Tokens that overlap no base span: as many base spans end before a token begins as begin before it ends.

    Two sorts of the places instead of a comparison of each token with each base span.
    """
    begun, ended = _ranks(tokens, base, "end", "start", 0), _ranks(tokens, base, "start", "end", 1)
    return let(F.struct(begun.alias("begun"), ended.alias("ended")), lambda r: F.filter(tokens, lambda t, n: F.get(r["begun"], n) == F.get(r["ended"], n)))


def spans(df: DataFrame, model: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least: float = LEAST) -> DataFrame:
    """id_col, base, and spans: base and model spans (start, k, end, value) by start, then kind."""
    if model is None:
        return base_spans(df, id_col, text_col).withColumn("spans", F.col("base"))
    table = F.lit(model)

    def likely(token: Column) -> Column:
        zero = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("sum"))
        step = lambda acc, b: F.struct(b.alias("a"), (acc["sum"] + F.get(table, acc["a"] * SYMBOLS + b)).alias("sum"))
        return F.aggregate(_codes(token), zero, step, lambda acc: acc["sum"]) >= F.greatest(F.length(token) * threshold, F.lit(least))

    def both(text: Column) -> Column:
        tokens = F.filter(_found(text, TOKEN, 3), lambda c: likely(c["value"]))

        def joined(base: Column) -> Column:
            added = F.when(F.size(base) == 0, tokens).otherwise(let(tokens, lambda t: _clear(t, base)))
            return F.struct(base.alias("base"), F.array_sort(F.concat(base, added)).alias("spans"))

        return let(_base(text), joined)

    return df.select(id_col, let(_text(text_col), both).alias("_found")).select(id_col, "_found.base", "_found.spans")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least: float = LEAST) -> DataFrame:
    """Train on samples of the table's own texts, then scan all of it: id_col, base, spans."""
    return spans(df, train(samples(df, id_col, text_col)), id_col, text_col, threshold, least)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest of scan(): id_col, n_assign, n_access, n_hex, base_sha256, spans."""
    names = F.array(*map(F.lit, KINDS))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return found.select(id_col, *(n(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
