"""Line dedup with a log-template tree.

A line is parsed down a tree of fixed depth: its number of tokens, then its first tokens; a token with a digit is a
variable field and becomes <*>. Below such a leaf a token stays in the template if it stands at that place in at least
min_docs lines of different documents, and is generalised to <*> else. A template that min_docs documents share is
recurring: its lines are dropped from every document but the first (the smallest id) in which it occurs. Lines that
differ in words are different content, so a template has at least `constant` of its tokens fixed and besides fields with
digits at most one variable field, in a line that is otherwise equal: WORDS of the tokens are fixed then, and the field
is not the last token of a line of fewer than LONG tokens.

A line that repeats word for word needs no template: EXACT_DOCS documents suffice, whatever its length. Lines,
templates and rows are told apart by 128 bits. Where min_docs is given, it is the support of both.

Support counts documents by id. Only for the choice of fixed tokens, rows that repeat an id count one by one.

Distinct lines are counted before anything is spread over places, so that a line in a third of all documents is one row.
Only leaves and lines that enough documents reach are worked on; bitmaps of fixed size keep other lines from being
shuffled, and exact counts follow them.

Null and empty texts have no lines to drop; blank lines stay and match nothing. A null id sorts last. Rows that repeat
an id and text get the same result, each. In transform() columns other than the text pass through unchanged.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.functions.columns import let
from scorewright.llm.common import fresh, map_slices, row_key, stored
from scorewright.llm.graph import bitmap, may

DEPTH = 3
MIN_DOCS = 10
EXACT_DOCS = 2
CONSTANT = 0.5
#: Share of fixed tokens, and tokens of a line that may end in its field, where a field without a digit varies.
WORDS = 0.8
LONG = 8
_DIGIT = re.compile(r"\d")


def parse(line: str, depth: int = DEPTH) -> tuple[int, list[str]] | None:
    """Leaf (64 bits) and masked tokens of a line; None if it is blank."""
    tokens = line.split()
    if not tokens:
        return None
    if _DIGIT.search(line):
        tokens = ["<*>" if _DIGIT.search(t) else t for t in tokens]
    return _hash(f"{len(tokens)} {' '.join(tokens[:depth])}"), tokens


def exact(line: str) -> int:
    return _hash("\n" + " ".join(line.split()))


def _name(s: str) -> bytes:
    """128 bits that stand for a line."""
    return xxhash.xxh3_128_digest(s)


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def recurring(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int | None = None, constant: float = CONSTANT) -> DataFrame:
    """Lines to drop: _key (row_key of id and text), drop (sorted array of line numbers from 0)."""
    spark = df.sparkSession
    exact_docs, min_docs = (EXACT_DOCS, MIN_DOCS) if min_docs is None else (min_docs, min_docs)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("t"), F.col(id_col).alias("d")).where("t is not null and t <> ''")

    def leaves():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            c, e = Counter(), Counter()
            for t in b.column(1).to_pylist():
                said = set(t.split("\n"))
                parsed = (parse(s, depth) for s in said)
                c.update(leaf for leaf, _ in {(p[0], " ".join(p[1])) for p in parsed if p})
                e.update({exact(s) for s in said if s.strip()})
            return pa.RecordBatch.from_arrays([pa.array([*c, *e], pa.int64()), pa.array([False] * len(c) + [True] * len(e)), pa.array([*c.values(), *e.values()], pa.int64())], ["leaf", "exact", "n"])

        return one

    reached = map_slices(docs, leaves, "leaf long, exact boolean, n long").groupBy("leaf", "exact").agg(F.sum("n").alias("n"))
    reached = stored(spark, reached.where(F.col("n") >= F.when(F.col("exact"), exact_docs).otherwise(min_docs)).select("leaf", "exact"), "leaves")
    same = spark.sparkContext.broadcast(bitmap(reached.where("exact"), F.col("leaf")))
    reached = reached.where("not exact").select("leaf")
    sent = spark.sparkContext.broadcast(bitmap(reached, F.col("leaf")))

    def lines():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for key, t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found: dict[str, tuple[int, list[str], list[int]]] = {}
                said = t.split("\n")
                parsed = [(i, p) for i, p in ((i, parse(s, depth)) for i, s in enumerate(said)) if p]
                known = may(sent.value, np.array([p[0] for _, p in parsed], np.int64)).tolist()
                for (i, p), k in zip(parsed, known, strict=True):
                    if k:
                        found.setdefault(" ".join(p[1]), (*p, []))[2].append(i)
                word: dict[str, list[int]] = {}
                for i, _ in parsed:
                    word.setdefault(" ".join(said[i].split()), []).append(i)
                repeats = may(same.value, np.array([_hash("\n" + s) for s in word], np.int64)).tolist()
                rows += [(None, _name(s), key, d, None, None, at) for (s, at), k in zip(word.items(), repeats, strict=True) if k]
                held, several = set(), Counter(leaf for leaf, _, _ in found.values())
                for s, (leaf, tokens, at) in found.items():
                    again = []
                    if several[leaf] > 1:  # places of tokens that an earlier line of the document has too
                        again = [p for p, x in enumerate(tokens) if (leaf, p, x) in held]
                        held.update((leaf, p, x) for p, x in enumerate(tokens))
                    rows.append((leaf, _name(s), key, d, tokens, again, at))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.binary(), pa.binary(), b.column(2).type, pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["leaf", "line", "_key", "d", "tokens", "again", "at"])

        return one

    found = map_slices(docs, lines, f"leaf long, line binary, _key binary, d {kind}, tokens array<string>, again array<int>, at array<int>")
    found = stored(spark, found, "lines")
    distinct = found.where("leaf is not null").groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens")).join(reached, "leaf", "left_semi")
    distinct = stored(spark, distinct, "distinct-lines")
    places = distinct.select("leaf", "line", "n", F.posexplode("tokens").alias("p", "token"))
    again = found.where("size(again) > 0").select("leaf", "tokens", F.explode("again").alias("p")).select("leaf", "p", F.get("tokens", F.col("p")).alias("token"), F.lit(-1).cast("long").alias("n"))
    fixed = places.select("leaf", "p", "token", "n").unionByName(again).groupBy("leaf", "p", "token").agg(F.sum("n").alias("m")).where(F.col("m") >= min_docs).select("leaf", "p", "token", F.lit(True).alias("fixed"))
    word = F.col("token") != "<*>"
    varies = F.col("fixed").isNull() & word
    ok = (F.col("n_fixed") >= constant * F.col("size")) & ((F.col("n_open") == 0) | ((F.col("n_open") == 1) & (F.col("n_fixed") >= WORDS * F.col("size")) & ((F.col("place") < F.col("size") - 1) | (F.col("size") >= LONG))))
    template = (
        places.join(fixed, ["leaf", "p", "token"], "left")
        .groupBy("leaf", "line")
        .agg(
            F.array_sort(F.collect_list(F.struct("p", F.when(F.col("fixed"), F.col("token")).otherwise("<*>").alias("x")))).alias("x"),
            F.count("*").alias("size"),
            F.count_if(F.col("fixed") & word).alias("n_fixed"),
            F.count_if(varies).alias("n_open"),
            F.max(F.when(varies, F.col("p"))).alias("place"),
            F.first("n").alias("n"),
        )
        .where(ok)
        .where("n_fixed < size")  # others repeat word for word
        .select("leaf", "line", "n", F.unhex(F.md5(F.encode(F.concat_ws(" ", F.col("leaf").cast("string"), F.transform("x", lambda x: x["x"])), "utf-8"))).alias("template"))
    )
    template = stored(spark, template, "templates")
    # Lines are summed first; where they suffice, the documents are counted.
    likely = template.join(template.groupBy("template").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("template"), "template", "left_semi")
    hits = stored(spark, found.select("leaf", "line", "_key", "d", "at").join(likely.select("leaf", "line", "template"), ["leaf", "line"]).select("template", "_key", "d", "at"), "hits")
    hits = hits.withColumn("need", F.lit(min_docs)).unionByName(found.where("leaf is null").select(F.col("line").alias("template"), "_key", "d", "at", F.lit(exact_docs).alias("need")))
    often = hits.groupBy("template", "need").agg(F.count_distinct(F.xxhash64("d")).alias("n"), F.min("d").alias("first")).where("n >= need")
    dropped = hits.join(often.select("template", "first"), "template").where(~F.col("d").eqNullSafe(F.col("first")))
    return dropped.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("drop"))


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """df with the text's recurring lines dropped, and the columns n_lines and n_dropped (replaced if they exist)."""
    key, gone = fresh(df, "line_key"), fresh(df, "line_numbers")
    found = recurring(df, id_col, text_col, **parameters).select(F.col("_key").alias(key), F.col("drop").alias(gone))
    d = df.withColumn(key, row_key(id_col, text_col)).join(found, key, "left")
    lines = F.split(F.col(text_col), "\n")
    # By numbers, so that the work stays in proportion to the lines of a text.
    rest = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone))
    kept = let(lines, lambda x: F.array_join(F.transform(rest(x), lambda i: F.get(x, i)), "\n"))
    out = d.withColumn("n_lines", F.coalesce(F.when(F.col(text_col) != "", F.size(lines)), F.lit(0)).cast("long"))
    out = out.withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long")).withColumn(text_col, F.when(F.col(gone).isNotNull(), kept).otherwise(F.col(text_col)))
    return out.drop(key, gone)
