"""Language identification by words first, backing off to shorter and shorter character n-grams.

A word that training knows has a score for each language: its smoothed log frequency there. A word that it doesn't know
is scored by its character n-grams of the greatest length of which at least one is known; each step down costs a fixed
penalty. A document's score is the mean over its words.

train() counts over a bounded sample (documented parameters: rows and characters for each language, chosen by a hash of
the id), so the model has at most len(ORDERS) + 1 entries for each sampled character: a proven size, linear in the number
of languages. It is sparse: hashes of the known keys, and for each the languages that have it. Null or blank languages
teach nothing. A text that is null or has no letter is `und` with score 0, and so is every text when nothing could be
learned; ties go to the language that sorts first. Rows that repeat are scored alike, and only the named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import map_slices
from scorewright.llm.words import mixed

#: Training rows and characters for each language, about, at most.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 4_000_000
#: Times that training must see a word to know it.
LEAST = 2
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
STEP_COST = 0.5
FLOOR = -20.0
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = 0x9E3779B97F4A7C15
#: Cells (words times languages) of the scores that a task keeps.
MEMO_CELLS = 4_000_000


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mixed code points of the strings in a row, and where each begins (n + 1)."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return mixed(points + np.uint64(1)), np.concatenate([[0], np.cumsum(size)])


def hashes(strings: list[str]) -> np.ndarray:
    """64-bit hash of each string; none is empty."""
    codes, at = _codes(strings)
    if not len(strings):
        return np.zeros(0, np.uint64)
    nth = np.arange(len(codes)) - np.repeat(at[:-1], np.diff(at))
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(nth.max(initial=0)), _BASE, np.uint64)]), dtype=np.uint64)
    return np.add.reduceat(codes * power[nth], at[:-1])


def grams(strings: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram of the strings, ends marked unless n is 1, and the number of the string that it is of."""
    codes, at = _codes(strings if n == 1 else [f"<{s}>" for s in strings])
    owner = np.repeat(np.arange(len(strings)), np.diff(at))
    if len(codes) < n:
        return np.zeros(0, np.uint64), owner[:0]
    h, power = np.zeros(len(codes) - n + 1, np.uint64), 1
    for k in range(n):
        h += codes[k : len(codes) - n + 1 + k] * np.uint64(power)
        power = power * _BASE % (1 << 64)
    inside = owner[: len(h)] == owner[n - 1 :]
    return h[inside], owner[: len(h)][inside]


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> dict:
    """The model: langs, and for words (0) and each n-gram length (keys, start, lang, score, default).

    keys are sorted hashes; key k has scores for the languages lang[start[k]:start[k + 1]], all others have the default.
    """
    labelled = rows.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("g")).where("g is not null and t is not null and trim(g) <> ''")
    sizes = {r[0]: (r[1], r[2]) for r in labelled.groupBy("g").agg(F.count("*"), F.sum(F.length("t"))).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "tables": {}}
    share = F.create_map(*(F.lit(x) for g, (n, chars) in sizes.items() for x in (g, min(1.0, sample_rows / n, sample_chars / max(1, chars)))))
    unit = F.pmod(F.xxhash64("i", F.lit("langid")), F.lit(1_000_003)) / 1_000_003
    sampled = labelled.where(unit < F.element_at(share, F.col("g")))

    def count(batches):
        for b in batches:
            counts: dict[tuple, int] = {}
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in words_of(t):
                    counts[g, w] = counts.get((g, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in counts], pa.string()), pa.array([w for _, w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["g", "w", "n"])

    # Words of a bounded sample; their n-grams follow from them.
    found = sampled.select("g", "t").mapInArrow(count, "g string, w string, n long").groupBy("g", "w").agg(F.sum("n").alias("n")).toArrow()
    at = {g: i for i, g in enumerate(langs)}
    words, lang, n = found["w"].to_pylist(), np.array([at[g] for g in found["g"].to_pylist()], np.int64), found["n"].to_numpy().astype(np.float64)
    tables = {}
    for k in (0, *ORDERS):
        keys, owner = (hashes(words), np.arange(len(words))) if k == 0 else grams(words, k)
        order = np.lexsort((lang[owner], keys))
        keys, owner = keys[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (lang[owner[1:]] != lang[owner[:-1]])])[: len(keys)])
        total = np.bincount(lang[owner], n[owner], len(langs))
        seen = np.add.reduceat(n[owner], new) if len(new) else np.zeros(0)
        keys, of = keys[new], lang[owner[new]]
        if k == 0:
            keys, of, seen = (x[seen >= LEAST] for x in (keys, of, seen))
        known, start = np.unique(keys, return_index=True)
        size = total + SMOOTHING * max(len(known), 1)
        tables[k] = (known, np.append(start, len(keys)), of.astype(np.int32), np.log((seen + SMOOTHING) / size[of]).astype(np.float32), np.log(SMOOTHING / size).astype(np.float32))
    return {"langs": langs, "tables": tables}


class Scorer:
    """Scores of a task: a row for each word seen, made for many new words at once."""

    def __init__(self, model: dict):
        self.langs, self.tables = model["langs"], model["tables"]
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)
        self.limit = MEMO_CELLS // max(1, len(self.langs))

    def _mean(self, k: int, keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean score of the known keys of each of n owners, and how many it has."""
        known, start, lang, score, default = self.tables[k]
        i = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        hit = known[i] == keys if len(known) else np.zeros(len(keys), bool)
        i, owner = i[hit], owner[hit]
        size = start[i + 1] - start[i]
        at = np.repeat(start[i], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        width = len(self.langs)
        cell = np.repeat(owner, size) * width + lang[at]
        above = np.bincount(cell, (score[at] - default[lang[at]]).astype(np.float64), n * width).reshape(n, width)
        count = np.bincount(owner, minlength=n)
        return default + above / np.maximum(count, 1)[:, None], count

    def of(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        out = np.full((len(words), len(self.langs)), FLOOR, np.float32)
        found, count = self._mean(0, hashes(words), np.arange(len(words)), len(words))
        out[count > 0] = found[count > 0]
        left = np.flatnonzero(count == 0)
        for step, n in enumerate(ORDERS, 1):
            if not len(left):
                break
            keys, owner = grams([words[k] for k in left], n)
            found, count = self._mean(n, keys, owner, len(left))
            out[left[count > 0]] = found[count > 0] - STEP_COST * step
            left = left[count == 0]
        return out

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        words = [words_of(t) if t else [] for t in texts]
        size = np.fromiter(map(len, words), np.int64, len(words))
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        some = np.flatnonzero(size)
        if not self.langs or not len(some):
            return names.tolist(), scores
        if len(self.row) > self.limit:
            self.row, self.scores = {}, self.scores[:0]
        new = list({w for ws in words for w in ws}.difference(self.row))
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.of(new)])
        row = np.fromiter((k for ws in words for k in map(self.row.__getitem__, ws)), np.int64, int(size.sum()))
        count = size[some]
        sums = np.empty((len(some), len(self.langs)))
        starts = np.cumsum(count) - count
        for g in range(len(self.langs)):
            sums[:, g] = np.add.reduceat(self.scores[:, g].astype(np.float64)[row], starts)
        mean = sums / count[:, None]
        best = mean.argmax(1)
        # Posterior at equal priors; the evidence of a long text is damped, for its words do not stand alone.
        gain = (mean - mean.max(1, keepdims=True)) * np.sqrt(count)[:, None]
        names[some] = np.array(self.langs, object)[best]
        scores[some] = 1.0 / np.exp(np.maximum(gain, -700)).sum(1)
        return names.tolist(), scores


def predict(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, lang_pred, score (posterior of the language, 0 to 1)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        score = Scorer(sent.value)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = score(b.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

        return one

    return map_slices(df.select(id_col, text_col), make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
