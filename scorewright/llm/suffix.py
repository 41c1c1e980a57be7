"""Exact removal of repeated byte strings with a sampled suffix array.

Every string of `length` bytes holds a gram of 20 bytes that is least by a fixed hash among those in it, the leftmost of
equals; equal strings choose the same gram at the same place. So suffixes need to be sorted only where a gram was chosen.

1. Chosen grams, as hashes in sorted blocks by hash range, are counted by tasks; those that two documents hold set bits in
   a map of fixed size. The map only saves work: a bit set in vain costs a comparison.
2. The strings that chose one gram lie in a row and make a record: the bytes that they cover. Records with known grams
   get names of 64 bits. A gram all of whose records have one name (128 bits with the gram's own hash) is the same record
   everywhere, and its least document keeps it: thousands of copies are one row here. Tasks make a gram with several names
   one row too, so that a hot gram is a row a task.
3. The other records are stored, equal bytes of a task once, with their least document: these are the suffixes to sort,
   each with its context. They are range-partitioned by their leading tokens, the gram and then all their bytes, at
   splitters that Spark samples, so that a gram with very many records is cut too. Each partition is sorted by three-way
   multikey quicksort on words of eight bytes. Runs of equal grams are expanded to their strings, which are sorted
   likewise; the least document of a run of equal strings keeps it. All of this compares bytes.
4. The first and last gram of a partition can go on in the next. What its records keep so far is compared across
   boundaries: these strings are range-partitioned by all their bytes and sorted again, and those that a smaller document
   has elsewhere are taken from what the record keeps.
5. Only keepers are told: a row for each record that its least document keeps, with a bit for each string. A document
   then removes each byte of every string in a known record that it isn't told to keep. Within one document its records
   are told apart by their names.

Ids are integers (others are a TypeError); a null id counts as the largest. Equal ids are one document here: they don't
remove each other's strings. Null and empty texts, and texts shorter than `length`, lose nothing. Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import stored, text_bytes
from scorewright.llm.graph import bitmap, may
from scorewright.llm.words import mixed

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1
#: Bits of the map of shared grams (32 MB); a power of 2.
MAP_BITS = 28
#: Bytes of records in a partition, and of gram hashes in a block group.
PART_BYTES = 4 << 20
SLICE = 1 << 20
NO_ID = (1 << 63) - 1
_VALUE = np.random.default_rng(4321).integers(1, 1 << 63, 256, dtype=np.uint64)
_C = 0x9E3779B97F4A7C15
_POWER = np.cumprod(np.full(SLICE + 256, _C, np.uint64), dtype=np.uint64)
_UNPOWER = np.cumprod(np.full(SLICE + 256, pow(_C, -1, 1 << 64), np.uint64), dtype=np.uint64)
#: Records, and hashes of grams, that a task gathers before it passes them on, so that copies within it are one row.
GATHER = 150_000
HASHES = 1_000_000
#: Strings that are sorted at a time, about.
STRINGS = 100_000
#: Rows that the quicksort leaves to a plain sort.
LEAF = 1024


def _rolled(b: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every n bytes in a row, for n the sum of at most a few powers of 2."""
    power, width, h = np.array([_C], np.uint64), 1, _VALUE[b]
    out, done = None, 0
    while True:
        if n & width:
            if out is None:
                out, done = h, width
            else:  # the part done so far stands first
                out = out[: len(b) - done - width + 1] * power + h[done:]
                done += width
        if width * 2 > n:
            return out
        h = h[:-width] * power + h[width:]
        power, width = power * power, width * 2


class Records:
    """Records of a block of documents: window starts first..last (inclusive), gram place, hash, and document."""

    def __init__(self, body: bytes, offsets: list[int]):
        parts = []
        if len(offsets) == 2 and offsets[1] > 4 * SLICE:  # one long text: in stretches counted from its start
            for at in range(0, offsets[1] - LENGTH + 1, SLICE):
                parts.append([x + at if k < 3 else x for k, x in enumerate(self._of(body[at : at + SLICE + LENGTH - 1], [0, min(SLICE + LENGTH - 1, offsets[1] - at)]))])
        elif len(body) >= LENGTH:
            parts.append(self._of(body, offsets))
        empty = np.zeros(0, np.int64)
        self.first, self.last, self.place, self.hash, self.doc = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [empty, empty, empty, empty.astype(np.uint64), empty]

    @staticmethod
    def _of(body: bytes, offsets: list[int]) -> list[np.ndarray]:
        b = np.frombuffer(body, np.uint8)
        gram = mixed(_rolled(b, GRAM))
        key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        low, width = key, 1
        while width * 2 <= SPAN:
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        low = np.minimum(low[: len(key) - SPAN + 1], low[SPAN - width :])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ends = np.asarray(offsets, np.int64)
        size = np.diff(ends)
        doc = np.flatnonzero(size >= LENGTH)
        n = size[doc] - LENGTH + 1
        starts = np.repeat(ends[:-1][doc] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner = np.repeat(doc, n)
        place = place[starts]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])) if len(starts) else starts
        last = np.append(new[1:], len(starts)) - 1
        return [starts[new], starts[last], place[new], gram[place[new]], owner[new]]


def _names(raw: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """64-bit names of records: of the bytes start..end (starts in order) and the place of the gram among them."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = int(np.searchsorted(start, a + SLICE))
        b = int(end[i:j].max())
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw[a:b]] * _POWER[: b - a], dtype=np.uint64)])
        out[i:j] = (sums[end[i:j] - a] - sums[start[i:j] - a]) * _UNPOWER[start[i:j] - a]
        i = j
    return mixed(out ^ mixed(((end - start) * 256 + place + 1).astype(np.uint64))).view(np.int64)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian words, and the number of each row's run of equals in that order.

    Three-way multikey quicksort: rows part into those below, at and above a pivot's word; only those at it go on to the
    next word. Short stretches are sorted by what words are left.
    """
    n, width = words.shape
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, k = todo.pop()
        if hi - lo < 2 or k == width:
            continue
        rows = order[lo:hi]
        if hi - lo <= LEAF:
            order[lo:hi] = rows[np.lexsort(words[rows, k:].T[::-1])]
            continue
        word = words[rows, k]
        pivot = np.sort(word[[0, (hi - lo) // 4, (hi - lo) // 2, 3 * (hi - lo) // 4, -1]])[2]
        low, same = word < pivot, word == pivot
        order[lo:hi] = np.concatenate([rows[low], rows[same], rows[~low & ~same]])
        a, b = lo + int(low.sum()), lo + int(low.sum() + same.sum())
        todo += [(lo, a, k), (a, b, k + 1), (b, hi, k)]
    new = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    return order, np.cumsum(np.concatenate([[0], new]))[:n]


def _padded(raw: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian words."""
    n, w = raw.shape
    out = np.zeros((n, -(-w // 8) * 8), np.uint8)
    out[:, :w] = raw
    return out.view(">u8").astype(np.uint64)


def _least(words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each row's document is the least one of the rows with equal words."""
    order, run = multikey_order(words)
    mine = np.zeros(len(docs), bool)
    if len(docs):
        least = np.full(run[-1] + 1, NO_ID, np.int64)
        np.minimum.at(least, run, docs[order])
        mine[order] = least[run] == docs[order]
    return mine


def keepers(contents: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each different record, with its least document: a bit for every string that this document keeps among these
    records; and whether its gram is the first or last one of the sorted records, which can have more elsewhere."""
    n = len(contents)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    size = np.array([len(c) for c in contents], np.int64)
    flat = np.frombuffer(b"".join(contents), np.uint8)
    at = np.cumsum(size) - size
    off = flat[at].astype(np.int64)
    count = size - 1 - LENGTH + 1
    masks = (np.int64(1) << count) - 1
    order, run = multikey_order(_padded(np.lib.stride_tricks.sliding_window_view(flat, GRAM)[at + 1 + off]))
    edge = np.zeros(n, bool)
    edge[order] = (run == 0) | (run == run[-1])
    many = np.bincount(run)[run] > 1
    several, of = order[many], run[many]
    # Equal strings have equal grams, so whole runs of grams are expanded a few at a time.
    step = np.cumsum(count[several]) // STRINGS
    step = step[np.searchsorted(of, of)] if len(of) else step
    for k in np.unique(step).tolist():
        some = several[step == k]
        row = np.repeat(some, count[some])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
        mine = _least(_padded(np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[at[row] + 1 + nth]), docs[row])
        masks[some] = 0
        np.bitwise_or.at(masks, row, mine.astype(np.int64) << nth)
    return masks, edge


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bytes, list[int]]]:
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(512, b.num_rows - at)
            while n > 1 and b.column(1).slice(at, n).nbytes > SLICE:
                n //= 2
            part = b.slice(at, n)
            yield part, *text_bytes(part.column(1))
            at += n


def shared_grams(docs: DataFrame) -> np.ndarray:
    """The map of chosen grams that two documents hold, from docs (id, text)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(5, min(MAP_BITS - 3, int(np.ceil(np.log2(max(1, total / 13 * 8 / PART_BYTES))))))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            g, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(g, kind="stable")
            g, ids = g[order], ids[order]
            new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])[: len(g)])
            other = np.concatenate([[False], (g[1:] == g[:-1]) & (ids[1:] != ids[:-1])])[: len(g)]
            several = np.logical_or.reduceat(other, new) if len(g) else other
            g = g[new]
            bucket = (g >> np.uint64(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(g)]).tolist()
            spans = list(zip(cut, [*cut[1:], len(g)], strict=True)) if cut else []
            return pa.RecordBatch.from_arrays([pa.array([int(bucket[i]) for i, _ in spans], pa.int64()), pa.array([g[i:j].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for i, j in spans], pa.binary()), pa.array([np.packbits(several[i:j]).tobytes() for i, j in spans], pa.binary())], ["bucket", "grams", "several"])

        for part, body, offsets in _slices(batches):
            r = Records(body, offsets)
            held.append((r.hash, part.column(0).to_numpy(zero_copy_only=False)[r.doc]))
            if sum(len(g) for g, _ in held) >= HASHES:
                yield flush()
        if held:
            yield flush()

    def shared(group: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(group["grams"].to_pylist()), np.uint8).reshape(-1, 6)  # the upper 48 bits
        g = np.zeros((len(raw), 8), np.uint8)
        g[:, :6] = raw
        g = g.view(">u8").ravel().astype(np.uint64)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(y) // 6) for x, y in zip(group["several"].to_pylist(), group["grams"].to_pylist(), strict=True)]).astype(bool)
        order = np.argsort(g, kind="stable")
        g, several = g[order], several[order]
        again = np.concatenate([g[1:] == g[:-1], [False]]) | several
        bucket = group["bucket"][0].as_py()
        own = np.zeros(1 << (MAP_BITS - bits), np.uint8)
        own[((g[again] >> np.uint64(64 - MAP_BITS)) - np.uint64(bucket << (MAP_BITS - bits))).astype(np.int64)] = 1
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "own": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    found = docs.mapInArrow(blocks, "bucket long, grams binary, several binary").groupBy("bucket").applyInArrow(shared, "bucket long, own binary")
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    width = 1 << (MAP_BITS - bits - 3)
    for r in found.collect():  # at most the size of the map
        out[r["bucket"] * width : (r["bucket"] + 1) * width] = np.frombuffer(r["own"], np.uint8)
    return out


def _known(grams: np.ndarray, of: np.ndarray) -> np.ndarray:
    k = (of >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (grams[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool)


def keeps(docs: DataFrame, sent) -> DataFrame:
    """doc, told (array of struct name, mask): the records of which a document keeps strings. sent: broadcast shared_grams()."""
    spark = docs.sparkSession

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            gram, name, doc = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [np.zeros(0, np.int64)] * 3
            held.clear()
            order = np.argsort(gram, kind="stable")
            gram, name, doc = gram[order], name[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)])
            of = [f.reduceat(x, new) if len(new) else x for f, x in ((np.minimum, name), (np.maximum, name), (np.minimum, doc))]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (gram[new], *of)], ["gram", "lo", "hi", "doc"])

        for part, body, offsets in _slices(batches):
            r = Records(body, offsets)
            k = np.flatnonzero(_known(sent.value, r.hash))
            name = _names(np.frombuffer(body, np.uint8), r.first[k], r.last[k] + LENGTH, r.place[k] - r.first[k])
            held.append((r.hash.view(np.int64)[k], name, part.column(0).to_numpy(zero_copy_only=False)[r.doc[k]]))
            if sum(len(x[0]) for x in held) >= 2 * GATHER:
                yield flush()
        yield flush()

    grams = docs.mapInArrow(named, "gram long, lo long, hi long, doc long").groupBy("gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("doc").alias("doc"))
    grams = stored(spark, grams.select("gram", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("name"), F.when(F.col("lo") == F.col("hi"), F.col("doc")).alias("doc")), "grams")
    several = spark.sparkContext.broadcast(bitmap(grams.where("name is null"), F.col("gram")))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(least), pa.binary()), pa.array(list(least.values()), pa.int64())], ["content", "doc"])
            least.clear()
            return out

        for part, body, offsets in _slices(batches):
            ids = part.column(0).to_pylist()
            r = Records(body, offsets)
            k = np.flatnonzero(_known(sent.value, r.hash) & may(several.value, r.hash.view(np.int64)))
            for first, end, off, doc in zip(r.first[k].tolist(), (r.last[k] + LENGTH).tolist(), (r.place[k] - r.first[k]).tolist(), r.doc[k].tolist(), strict=True):
                content, d = _PLACE[off] + body[first:end], ids[doc]
                if d < least.get(content, NO_ID + 1):
                    least[content] = d
            if len(least) >= GATHER:
                yield flush()
        yield flush()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        for b in batches:
            for c, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d < least.get(c, NO_ID + 1):
                    least[c] = d
        contents, docs = list(least), np.array(list(least.values()), np.int64)
        if not contents:
            return
        masks, edge = keepers(contents, docs)
        size = np.array([len(c) for c in contents], np.int64)
        flat, at = np.frombuffer(b"".join(contents), np.uint8), np.cumsum(size) - size
        name = _names(flat, at + 1, at + size, flat[at].astype(np.int64))
        some = np.flatnonzero(masks != 0)
        for k in range(0, len(some), 20_000):
            rows = some[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[rows], pa.int64()) for x in (docs, name, masks)), pa.array(edge[rows]), pa.nulls(len(rows), pa.binary())], ["doc", "name", "mask", "edge", "string"])
        out: list[tuple] = []
        for k in np.flatnonzero((masks != 0) & edge).tolist():  # strings of the records at the boundaries
            c, m = contents[k], int(masks[k])
            out += [(docs[k], name[k], 1 << i, c[1 + i : 1 + i + LENGTH]) for i in range(len(c) - LENGTH) if m >> i & 1]
            if len(out) >= 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    stored_records = stored(spark, docs.mapInArrow(records, "content binary, doc long"), "records")
    parts = _parts(stored_records.agg(F.sum(F.length("content"))).first()[0])
    schema = "doc long, name long, mask long, edge boolean, string binary"
    found = stored(spark, stored_records.repartitionByRange(parts, _leading(), "content").mapInArrow(sort, schema), "keepers")
    edges = found.where("string is not null").select("doc", "name", "mask", "string")
    lost = edges.repartitionByRange(_parts(edges.agg(F.sum(F.length("string") + 24)).first()[0]), "string").mapInArrow(across, "doc long, name long, lost long")
    own, none = found.where("string is null"), F.lit(0).cast("long")
    both = own.where("edge").select("doc", "name", "mask", none.alias("lost")).unionByName(lost.select("doc", "name", none.alias("mask"), "lost"))
    joined = both.groupBy("doc", "name").agg(F.bit_or("mask").bitwiseAND(F.bitwise_not(F.bit_or("lost"))).alias("mask")).where("mask <> 0")
    alone = grams.where("name is not null").select("doc", "name", F.lit(-1).cast("long").alias("mask"))
    return alone.unionByName(own.where("not edge").select("doc", "name", "mask")).unionByName(joined).groupBy("doc").agg(F.collect_list(F.struct("name", "mask")).alias("told"))


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings (doc, name, mask, string) of a partition that a smaller document has too. A string that only one
    document has makes no row, so however many records one gram has, only what they share is told."""
    held = list(batches)
    if sum(b.num_rows for b in held):
        docs, name, mask = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
        lost = ~_least(_padded(np.frombuffer(b"".join(x for b in held for x in b.column(3).to_pylist()), np.uint8).reshape(-1, LENGTH)), docs)
        yield pa.RecordBatch.from_arrays([pa.array(x[lost], pa.int64()) for x in (docs, name, mask)], ["doc", "name", "lost"])


_PLACE = [bytes([k]) for k in range(SPAN)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, name, mask, string = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([*(pa.array(list(map(int, x)), pa.int64()) for x in (doc, name, mask)), pa.array([True] * len(rows), pa.bool_()), pa.array(list(string), pa.binary())], ["doc", "name", "mask", "edge", "string"])


def _parts(total: int | None) -> int:
    return max(8, -(-(total or 0) // PART_BYTES))


def _leading() -> Column:
    """The gram of a record, which its first byte places."""
    return F.expr(f"substring(content, CAST(conv(hex(substring(content, 1, 1)), 16, 10) AS int) + 2, {GRAM})")


def _keyed(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    return mixed(name.view(np.uint64) ^ mixed(doc.astype(np.uint64) + np.uint64(1)))


def _removed(body: bytes, offsets: list[int], told: pa.Array, grams: np.ndarray) -> np.ndarray:
    """Which bytes go. told: for each document of the slice its (name, mask)."""
    r, raw = Records(body, offsets), np.frombuffer(body, np.uint8)
    size = pc.fill_null(pc.list_value_length(told), 0).to_numpy(zero_copy_only=False)
    flat = told.flatten()
    key = _keyed(np.repeat(np.arange(len(size)), size), flat.field("name").to_numpy(zero_copy_only=False).astype(np.int64))
    order = np.argsort(key)
    key, mask = key[order], flat.field("mask").to_numpy(zero_copy_only=False).astype(np.int64)[order]

    def heard(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
        if not len(key):
            return np.zeros(len(doc), np.int64)
        want = _keyed(doc, name)
        i = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where(key[i] == want, mask[i], 0)

    k = np.flatnonzero(_known(grams, r.hash))
    first, last, place, doc = r.first[k], r.last[k], r.place[k] - r.first[k], r.doc[k]
    keep = heard(doc, _names(raw, first, last + LENGTH, place))
    count = last - first + 1
    full = (np.int64(1) << count) - 1
    lost = ~keep & full
    edge = np.zeros(len(body) + 1, np.int32)
    whole = lost == full
    np.add.at(edge, first[whole], 1)
    np.add.at(edge, last[whole] + LENGTH, -1)
    row, nth = _spread(np.flatnonzero(~whole & (lost != 0)), count)
    at = (first[row] + nth)[(lost[row] >> nth) & 1 == 1]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + LENGTH, -1)
    return np.cumsum(edge)[:-1] > 0


def _spread(rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the rows count times, and the numbers from 0 within each."""
    n = count[rows]
    return np.repeat(rows, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, n_bytes, kept (binary), n_removed, n_spans (maximal removed runs)."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be integers, not {kind}")
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    grams = shared_grams(docs)
    sent = df.sparkSession.sparkContext.broadcast(grams)
    told = keeps(docs, sent)
    joined = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc")).join(told, "doc", "left").select("id", "text", "told")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, body, offsets in _slices(batches):
            gone = _removed(body, offsets, part.column(2), sent.value)
            raw = np.frombuffer(body, np.uint8)
            rows = []
            for i, j in zip(offsets[:-1], offsets[1:], strict=True):
                g = gone[i:j]
                rows.append((j - i, raw[i:j][~g].tobytes(), int(g.sum()), int((g & ~np.concatenate([[False], g[:-1]])).sum()) if j > i else 0))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], [id_col, "n_bytes", "kept", "n_removed", "n_spans"])

    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, kept binary, n_removed long, n_spans long")


def report(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest of remove(): id_col, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
