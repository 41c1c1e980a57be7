"""Benchmark decontamination over a distributed positional inverted index.

build() stores the index: documents are taken in segments, and for each term of a segment a row holds the sorted list of
its positions there. Documents of a segment lie one after the other with a gap, so no phrase crosses two of them. Beside
the postings lie the documents: their segment, first position and number of words.

search() asks the stored postings, in blocks of benchmark text of a bounded size; texts are not read again. The rows of
the block's terms are gathered by segment. A query phrase takes the list of its rarest term there, shifted by the term's
offset in the phrase, and intersects it with the shifted lists of the other terms, rarest first: what is left are exact
occurrences. A proximity match asks for all terms of an item within a distance instead.

Words are runs of digits, lower-cased ASCII letters and non-ASCII characters. A null or empty text has no words and no
hits. A benchmark row with a null item_id or no words is no item. Rows of documents that repeat are each judged; rows of
an item that repeat count as one item. Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm import words
from scorewright.llm.common import fresh, row_key, slices, stored, text_bytes

WINDOW = 10
#: Text bytes of the benchmark that one block of queries holds.
BLOCK_BYTES = 4 << 20
#: Words of a proximity match, as a multiple of the item's words.
SLACK = 2
#: Postings that are looked at in one step.
STEP = 200_000
#: Positions between two documents of a segment.
GAP = 1


def tokens(body: bytes, offsets: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated UTF-8 texts: a 64-bit hash of each word, the start byte of each, and the first word of each text (n + 1)."""
    return words.tokens(body, offsets, words.LOWER, words.ALNUM)


class Queries:
    """Items of a block of the benchmark: their words in one array, item i's text t at first[t]..first[t + 1]."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        items = sorted({(i, t) for i, t in items if i is not None and t is not None})
        raw = [t.encode() for _, t in items]
        self.words, _, self.first = tokens(b"".join(raw), np.cumsum([0, *map(len, raw)]).tolist())
        self.names = sorted({i for i, _ in items})
        at = {n: k for k, n in enumerate(self.names)}
        self.item = np.array([at[i] for i, _ in items], np.int64)
        self.terms = np.unique(self.words)
        size = np.diff(self.first)
        self.lengths = np.minimum(size, window)
        #: Phrases: places of their first words, by length.
        self.phrases = []
        for n in np.unique(self.lengths[self.lengths > 0]).tolist():
            of = np.flatnonzero(self.lengths == n)
            count = size[of] - n + 1
            start = np.repeat(self.first[of] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            self.phrases.append((n, start, np.repeat(self.item[of], count)))


class Segment:
    """Some terms' postings of one segment: sorted terms, and each one's sorted positions."""

    def __init__(self, terms: np.ndarray, lists: list[bytes]):
        order = np.argsort(terms)
        self.terms = terms[order]
        size = np.array([len(lists[k]) // 4 for k in order], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.positions = np.frombuffer(b"".join(lists[k] for k in order), "<i4").astype(np.int64)
        self.posting = (np.repeat(np.arange(len(size)), size) << 32) | self.positions  # sorted by term, then position

    def number(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each term in the segment, and the length of its list (0 if it has none)."""
        i = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        known = self.terms[i] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return i, np.where(known, self.start[i + 1] - self.start[i], 0) if len(self.terms) else np.zeros(len(terms), np.int64)

    def listed(self, number: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of the term of that number."""
        want = (number << 32) | position
        i = np.minimum(np.searchsorted(self.posting, want), len(self.posting) - 1)
        return (position >= 0) & (self.posting[i] == want)

    def occurrences(self, q: Queries, n: int, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of phrases of n words from start on: numbers among start, and positions, of every exact occurrence."""
        number, count = self.number(q.words)
        missing = np.concatenate([[0], np.cumsum(count == 0)])
        possible = np.flatnonzero(missing[start + n] == missing[start])
        # Leads: the rarest word of each phrase. A step takes as many phrases as have about STEP postings in all.
        lead = np.zeros(len(possible), np.int64)
        least = count[start[possible]]
        for k in range(1, n):
            rarer = count[start[possible] + k] < least
            lead[rarer], least = k, np.minimum(least, count[start[possible] + k])
        cuts = np.unique(np.concatenate([np.searchsorted(np.cumsum(least), np.arange(STEP, least.sum() + STEP, STEP)) + 1, [len(possible)]]))
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            rows, off = possible[a:b], lead[a:b]
            if not len(rows):
                continue
            order = np.argsort(count[start[rows][:, None] + np.arange(n)], axis=1, kind="stable")
            word = start[rows] + off
            size = count[word]
            row = np.repeat(np.arange(len(rows)), size)
            at = self.positions[np.repeat(self.start[number[word]] - (np.cumsum(size) - size), size) + np.arange(size.sum())] - off[row]
            for step in range(1, n):
                other = order[row, step]
                ok = self.listed(number[start[rows][row] + other], at + other)
                row, at = row[ok], at[ok]
            yield rows[row], at

    def near(self, terms: np.ndarray, within: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Documents (numbers of starts) with all the terms inside a stretch of `within` words, in any order."""
        number, count = self.number(np.unique(terms))
        if not len(count) or count.min() == 0:
            return np.zeros(0, np.int64)
        lists = [self.positions[self.start[k] : self.start[k + 1]] for k in number[np.argsort(count, kind="stable")].tolist()]
        docs = np.unique(np.searchsorted(starts, lists[0], "right") - 1)
        for x in lists[1:]:  # documents with all terms, rarest first
            docs = docs[np.searchsorted(x, starts[docs]) < np.searchsorted(x, ends[docs])]
            if not len(docs):
                return docs
        # A stretch that ends at one of the positions has every term if the last place of each lies inside.
        of = np.sort(np.concatenate(lists))
        doc = np.searchsorted(starts, of, "right") - 1
        inside = np.isin(doc, docs)
        of, doc = of[inside], doc[inside]
        left = np.maximum(of - within + 1, starts[doc])
        for x in lists:
            i = np.searchsorted(x, of, "right") - 1
            ok = (i >= 0) & (x[np.maximum(i, 0)] >= left)
            of, doc, left = of[ok], doc[ok], left[ok]
        return np.unique(doc)


@dataclass
class Index:
    """docs: row (number of the row), id, key (of id and text), segment, first, n_words. postings: segment, term,
    positions (little-endian 32-bit integers)."""

    docs: DataFrame
    postings: DataFrame


def _part(body: bytes, offsets: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment: its terms, the ends of their lists in bytes, the positions, and each document's words (n + 1)."""
    of, _, first = tokens(body, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.argsort(of, kind="stable")
    ordered = of[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[new], np.append(new, len(ordered)) * 4, (order + doc[order] * GAP).astype("<i4"), first


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Store the index of documents, each in one row of docs and in the lists of its words."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        for k, b in enumerate(slices(batches)):
            terms, ends, positions, first = _part(*text_bytes(b.column(1)))
            n, m, segment = b.num_rows, len(terms), task + k
            none = lambda count, t: pa.nulls(count, t)
            lists = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(positions)])
            base = first[:-1] + np.arange(n) * GAP
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + m, segment), pa.int64()),
                    pa.concat_arrays([b.column(0), none(m, b.column(0).type)]),
                    pa.concat_arrays([b.column(2).cast(pa.binary()), none(m, pa.binary())]),
                    pa.concat_arrays([pa.array(base, pa.int64()), none(m, pa.int64())]),
                    pa.concat_arrays([pa.array(np.diff(first), pa.int64()), none(m, pa.int64())]),
                    pa.concat_arrays([none(n, pa.int64()), pa.array(terms.view(np.int64), pa.int64())]),
                    pa.concat_arrays([none(n, pa.binary()), lists]),
                ],
                ["segment", "id", "key", "first", "n_words", "term", "positions"],
            )

    rows = stored(spark, d.mapInArrow(index, f"segment long, id {kind}, key binary, first long, n_words long, term long, positions binary"), "postings")
    return Index(rows.where("n_words is not null").select("segment", "id", "key", "first", "n_words"), rows.where("term is not null").select("segment", "term", "positions"))


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about block_bytes, one after the other; only one block is on the driver at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    n = max(1, -(-(items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]) // block_bytes))
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()]


HITS = "segment long, first long, start int, end int, item string, near boolean"


def hits(index: Index, benchmark: DataFrame, window: int = WINDOW, slack: int | None = None) -> DataFrame:
    """segment, first (of the document), and start, end, item of each run of hit words of an item; with slack, rows of
    near = true name the items (start and end null) whose terms lie close together."""
    spark = benchmark.sparkSession
    # What a segment's positions mean: a document's first position and words, beside the lists of its terms.
    lengths = index.docs.where("n_words > 0").groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("first", "n_words"))).alias("docs"))
    found = None
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)
        asked = spark.createDataFrame(pa.table({"term": pa.array(Queries(block, window).terms.view(np.int64), pa.int64())}))  # at most a block's words
        lists = index.postings.join(asked, "term", "left_semi").select("segment", "term", "positions", F.lit(None).cast("array<struct<first:bigint,n_words:bigint>>").alias("docs"))
        layout = lengths.select("segment", F.lit(None).cast("long").alias("term"), F.lit(None).cast("binary").alias("positions"), "docs")
        part = stored(spark, lists.unionByName(layout).groupBy("segment").applyInArrow(_look(sent, window, slack), HITS), "hits")
        found = part if found is None else found.unionByName(part)
    return found


def _look(sent, window: int, slack: int | None):
    """Function from a segment's rows (its documents, and the block's terms that it holds) to its hits."""
    block = uuid.uuid4().hex

    def look(group: pa.Table) -> pa.Table:
        q = _queries(block, sent, window)
        lists = group.filter(group["term"].is_valid())
        layout = group.filter(group["term"].is_null())["docs"].to_pylist()
        starts, size = (np.array([d[c] for d in layout[0]], np.int64) if layout else np.zeros(0, np.int64) for c in ("first", "n_words"))
        s = Segment(lists["term"].to_numpy().view(np.uint64), lists["positions"].to_pylist())
        rows = _runs(s, q, starts) + (_near(s, q, starts, starts + size, slack) if slack else [])
        cols = list(zip(*((group["segment"][0].as_py(), *r) for r in rows), strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("segment", "first", "start", "end", "item", "near"), cols, kinds, strict=True)})

    return look


def _queries(block: str, sent, window: int) -> Queries:
    """The block's queries, made once in each Python worker."""
    kept = _queries.__dict__
    if kept.get("block") != block:
        kept.update(block=block, queries=Queries(sent.value, window))
    return kept["queries"]


def _runs(s: Segment, q: Queries, starts: np.ndarray) -> list[tuple]:
    """(first, start, end, item, near) of every maximal run of an item's hit words in a document."""
    rows = []
    for n, start, item in q.phrases:
        for k, at in s.occurrences(q, n, start):
            rows.append(np.stack([item[k], at, np.full(len(at), n)]))
    if not rows:
        return []
    item, at, n = np.concatenate(rows, axis=1)
    order = np.lexsort((at, item))
    item, at, end = item[order], at[order], (at + n)[order]
    if not len(at):
        return []
    doc = np.searchsorted(starts, at, "right") - 1
    group = np.cumsum(np.concatenate([[0], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])]))
    high = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)  # how far the runs so far reach
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (at[1:] > high[:-1])])
    a, b = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(new)) - 1
    first = starts[doc[a]]
    return list(zip(first.tolist(), (at[a] - first).tolist(), (high[b] - first).tolist(), [q.names[i] for i in item[a]], [False] * len(a), strict=True))


def _near(s: Segment, q: Queries, starts: np.ndarray, ends: np.ndarray, slack: int) -> list[tuple]:
    """(first, None, None, item, True) where an item's terms lie within slack times its words."""
    _, count = s.number(q.words)
    whole = np.flatnonzero(np.diff(q.first) > 0)
    if not len(whole):
        return []
    least = np.minimum.reduceat(count, q.first[whole])
    rows = set()
    for t in whole[least > 0].tolist():
        terms = q.words[q.first[t] : q.first[t + 1]]
        rows.update((d, q.names[q.item[t]]) for d in s.near(terms, slack * len(terms), starts, ends).tolist())
    return [(int(starts[d]), None, None, name, True) for d, name in sorted(rows)]


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slack: int | None = None) -> DataFrame:
    """One row per document: id_col, n_words, spans (array of start, end; hit words), items (array of string, sorted).

    With slack, the column near too: the items whose terms lie close together in any order (array of string, sorted).
    """
    index = build(docs, id_col, text_col)
    exact = lambda c: F.when(~F.col("near"), c)
    spans = F.collect_list(exact(F.struct("start", "end")))
    of = hits(index, benchmark, window, slack).groupBy("segment", "first").agg(_merged(spans).alias("spans"), F.array_sort(F.collect_set(exact(F.col("item")))).alias("items"), F.array_sort(F.collect_set(F.when(F.col("near"), F.col("item")))).alias("near"))
    words_of = index.docs.where("n_words > 0").join(of, ["segment", "first"], "left").select("id", "n_words", "spans", "items", "near")
    none = index.docs.where("n_words = 0").select("id", "n_words", *(F.lit(None).cast(of.schema[c].dataType).alias(c) for c in ("spans", "items", "near")))
    empty = lambda c: F.coalesce(c, F.array().cast(of.schema[c].dataType)).alias(c)
    return words_of.unionByName(none).select(F.col("id").alias(id_col), "n_words", empty("spans"), empty("items"), *([empty("near")] if slack else []))


def _merged(spans):
    """Overlapping or touching runs as one."""
    kind = "array<struct<start:int,end:int>>"

    def grow(done, s):
        last = F.element_at(done, -1)
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))).cast(kind)
        return F.when((F.size(done) > 0) & (last["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(s).cast(kind)))

    return F.aggregate(F.array_sort(F.array_distinct(spans.cast(kind))), F.array().cast(kind), grow)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest of search(): id_col, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def proximity(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest of search() with slack: id_col, n_near, near_sha256."""
    return found.select(id_col, F.size("near").cast("long").alias("n_near"), F.sha2(F.array_join("near", ","), 256).alias("near_sha256"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, all columns, that hold no window of the benchmark; told apart by 128 bits of id and text."""
    index = build(docs, id_col, text_col)
    name = fresh(docs, "row_key")
    hit = hits(index, benchmark, window).select("segment", "first").distinct()
    hit = stored(docs.sparkSession, index.docs.where("n_words > 0").join(hit, ["segment", "first"], "left_semi").select(F.col("key").alias(name)).distinct(), "contaminated")
    return docs.withColumn(name, row_key(id_col, text_col)).join(hit, name, "left_anti").drop(name)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM q),
o AS (SELECT doc_id, k, x.n, array_to_string(w[k : k + x.n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n.n, unnest(range(1, len(w) - n.n + 2)) AS k FROM d, n WHERE len(w) >= n.n) x),
h AS (SELECT o.doc_id, o.k, o.n, q.item_id FROM o JOIN q ON o.g = q.g AND o.n = q.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
