"""Byte-pair encoding and decoding with content-defined chunk reuse.

A rolling hash of the last 16 bytes cuts each text into chunks, so a passage that several documents share is cut alike
in each of them. Chunks are counted by 64-bit names over all tasks; those that several tasks hold are encoded once and
sent to all tasks as a table of bounded size, the most useful ones first (`shared_chunks`). Any other chunk is encoded as
it stands, once for all documents of a task that hold it; a bounded cache keeps the chunks used last. A cut can fall inside of a word, so each join is repaired: a window over it is encoded anew, one word
wider on each side than the join may reach, and its ids there must be those of the chunk on that side. Where they differ
the windows grow until both sides agree; a window that meets the next join grows over it, at last over the whole text.
Places where any scan of a text must start a new word bound the windows, so ids that agree are those of the whole text.
They follow from the split pattern for every script: a run of letters, of numbers or of other characters ends where the
next character is of another kind, apart from apostrophes, which may join the letters after them. Characters whose kind
differs between versions of Unicode, and places inside a special token, bound nothing. Vocabularies with another split
have such places only before a space or line feed that follows printable ASCII.

Nulls and empty texts have no ids. Repeated rows give repeated results; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import map_slices, slices, text_bytes

#: The byte-level split of this family of vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside of these, Unicode versions and regular-expression libraries may class a character otherwise.
ODD = r"[^\t\n\r -~\xa1-\xac\xae-\u017f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2013\u2014\u2018\u2019\u201c-\u201e\u2026\u20ac\u4e00-\u9fa5]"
CHUNK_BYTES = 512
#: Bytes of encoded pieces that a task keeps; the half used last stays when it is full.
CACHE_BYTES = 32 << 20
#: Bounds of the table of chunks that several tasks hold: chunks, and bytes of their texts.
SHARED_CHUNKS = 1 << 14
SHARED_BYTES = 4 << 20
#: Names that a task remembers to count a chunk once; beyond them it may count one again.
SEEN = 1 << 20
#: Kinds of characters. APOSTROPHE is an OTHER that may begin "'s" or "'ll"; SPACE holds ASCII white space only.
UNSURE, LETTER, NUMBER, OTHER, SPACE, APOSTROPHE = range(6)
#: Bytes whose characters are classed at a time.
CLASS_BYTES = 1 << 20


@lru_cache(1)
def kinds() -> np.ndarray:
    """Kind of each code point below 2^17; those whose general category isn't the same in an old Unicode version are unsure."""
    by_category = {"L": LETTER, "N": NUMBER, "P": OTHER, "S": OTHER, "M": OTHER}
    out = np.zeros(1 << 17, np.uint8)
    for c in range(0x21, len(out)):
        kind = by_category.get(unicodedata.category(chr(c))[0], UNSURE)
        if kind and by_category.get(unicodedata.ucd_3_2_0.category(chr(c))[0]) == kind:
            out[c] = kind
    out[[9, 10, 13, 32]] = SPACE
    out[0x27] = APOSTROPHE
    return out


@lru_cache(1)
def boundaries() -> np.ndarray:
    """[kind before, kind after]: whether a word of the split pattern ends between them in any scan."""
    out = np.zeros((6, 6), bool)
    out[LETTER, [NUMBER, OTHER, SPACE, APOSTROPHE]] = True
    out[NUMBER, [LETTER, OTHER, SPACE, APOSTROPHE]] = True
    out[OTHER, [LETTER, NUMBER, SPACE]] = True
    out[APOSTROPHE, [NUMBER, SPACE]] = True
    return out


def kind_boundaries(body: bytes) -> np.ndarray:
    """Whether each byte of UTF-8 text begins a word in any scan of a text, by its kind and that of the character before."""
    out = np.zeros(len(body), bool)
    bytes_, before, at = np.frombuffer(body, np.uint8), UNSURE, 0
    while at < len(body):
        end = min(at + CLASS_BYTES, len(body))
        while end < len(body) and bytes_[end] & 0xC0 == 0x80:
            end += 1
        part = bytes_[at:end]
        starts = np.flatnonzero(part & 0xC0 != 0x80)
        if len(starts) == len(part):
            kind = kinds()[part]
        else:
            points = np.frombuffer(body[at:end].decode().encode("utf-32-le"), "<u4")
            kind = np.where(points < len(kinds()), kinds()[np.minimum(points, len(kinds()) - 1)], UNSURE)
        out[at + starts] = boundaries()[np.concatenate([[before], kind[:-1]]), kind]
        before, at = int(kind[-1]), end
    return out


@lru_cache(1)
def gear() -> np.ndarray:
    """A number drawn for each byte, from which the rolling hash is summed up."""
    return np.random.default_rng(12345).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_cuts(b: np.ndarray, chunk_bytes: int) -> np.ndarray:
    """Places, by the last 16 bytes, where chunks begin; each is the start of a character."""
    mask = np.uint32((1 << max(4, int(np.log2(chunk_bytes)))) - 1)
    h = gear()[b]
    for step, factor in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (4, 0xC2B2AE35), (8, 0x27D4EB2F)):
        h[step:] += h[:-step] * np.uint32(factor)
    cuts = np.flatnonzero((h >> np.uint32(7)) & mask == 0) + 1
    for _ in range(3):  # to the start of a character
        cuts = cuts + ((cuts < len(b)) & (b[np.minimum(cuts, len(b) - 1)] & 0xC0 == 0x80))
    return cuts


def named_chunks(body: bytes, offsets: list[int], chunk_bytes: int) -> dict[int, tuple[int, int]]:
    """Name of each distinct chunk of some texts -> where it begins and ends."""
    from xxhash import xxh3_64_intdigest

    ends = np.asarray(offsets, np.int64)
    cuts = np.union1d(ends, chunk_cuts(np.frombuffer(body, np.uint8), chunk_bytes)).tolist()
    return {xxh3_64_intdigest(body[x:y]) - (1 << 63): (x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)}


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkCodec:
    """Exact encoder and decoder of one task. Ids are kept as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, chunk_bytes: int = CHUNK_BYTES, shared: dict[bytes, bytes] | None = None):
        """shared: ids of chunks that other tasks hold too."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        if any(c.isspace() for s in self.special for c in s):
            raise ValueError("a special token with white space could span a cut")
        alphabet = byte_alphabet()
        self.special_bytes = [t.encode() for t in self.special]
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.by_kind = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex"))
        vocab = spec["model"]["vocab"]
        self.token_bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = token.encode() if token in self.special else bytes(alphabet[c] for c in token)
        self.fast = self._ranked(spec, {self.token_bytes[i]: i for t, i in vocab.items() if t not in self.special})
        self.odd = re.compile(ODD).search
        self.chunk_bytes = chunk_bytes
        self.size = np.array([len(x) for x in self.token_bytes], np.int64)
        self.new: dict[bytes, tuple[bytes, array]] = {}
        self.old: dict[bytes, tuple[bytes, array]] = {}
        self.shared = {text: (ids, self._ends(ids)) for text, ids in (shared or {}).items()}
        self.held = self.given = self.encoded = self.encoded_bytes = self.asked = self.widened = 0

    def _ranked(self, spec: dict, ranks: dict[bytes, int]) -> object | None:
        """A faster encoder of the same vocabulary, where ids follow the order of merges and nothing else alters the text."""
        import tiktoken

        model = spec["model"]
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        plain = self.by_kind and not spec["pre_tokenizer"].get("add_prefix_space") and not model.get("dropout") and not model.get("ignore_merges")
        if not plain or merged != list(range(256, 256 + len(merged))) or len(ranks) != 256 + len(merged):
            return None
        return tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def places(self, body: bytes, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks begin, and the places that bound windows; both hold the ends of each text."""
        b = np.frombuffer(body, np.uint8)
        ends = np.unique(np.asarray(offsets, np.int64))
        if len(b) < 2:
            return ends, ends
        cuts = chunk_cuts(b, self.chunk_bytes)
        if self.by_kind:
            inner = np.append(kind_boundaries(body), True)
            for token in self.special_bytes:
                at = body.find(token)
                while at >= 0:
                    inner[at + 1 : at + len(token)] = False
                    at = body.find(token, at + 1)
        else:
            inner = (b[1:] == 0x20) | (b[1:] == 0x0A)
            inner &= (b[:-1] > 0x20) & (b[:-1] < 0x7F)
            inner = np.concatenate([[False], inner, [True]])
        inner[ends] = True
        return np.union1d(ends, cuts), np.flatnonzero(inner)

    def encode(self, piece: str) -> bytes:
        """Ids of one piece that starts and ends at boundaries."""
        if self.fast is None or self.odd(piece) or any(t in piece for t in self.special):
            return np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(piece, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def _ends(self, ids: bytes) -> array:
        return array("i", np.cumsum(self.size[np.frombuffer(ids, "<u4")]).astype(np.int32).tobytes())

    def piece(self, text: bytes) -> tuple[bytes, array]:
        """Ids of a chunk or window as it stands, and the ends of their bytes, from the cache if it is there."""
        self.asked += 1
        got = self.shared.get(text)
        if got is not None:
            self.given += 1
            return got
        got = self.new.get(text)
        if got is None:
            got = self.old.pop(text, None)
            if got is None:
                self.encoded += 1
                self.encoded_bytes += len(text)
                ids = self.encode(text.decode())
                ends = self._ends(ids)
                if ends and ends[-1] != len(text):
                    raise ValueError("the tokenizer alters the text")
                got = ids, ends
            self.new[text] = got
            self.held += len(text) + 2 * len(got[0]) + 300
            if self.held > CACHE_BYTES // 2:
                self.old, self.new, self.held = self.new, {}, 0
        return got

    def encode_all(self, body: bytes, offsets: list[int]) -> list[bytes]:
        """Ids of each text, from its chunks and the windows over their joins."""
        cuts, safe = self.places(body, offsets)
        first, last = np.searchsorted(cuts, offsets[:-1]).tolist(), np.searchsorted(cuts, offsets[1:]).tolist()
        after = np.searchsorted(safe, cuts)  # the first place at a cut or after it
        cuts, after = cuts.tolist(), after.tolist()
        return [self._text(body, cuts[i : j + 1], after[i : j + 1], safe) if j > i else b"" for i, j in zip(first, last, strict=True)]

    def _text(self, body: bytes, cuts: list[int], after: list[int], safe: np.ndarray) -> bytes:
        """Ids of the text from the first cut to the last."""
        width = 1
        while True:
            ids = self._joined(body, cuts, after, safe, width)
            if ids is not None:
                return ids
            self.widened += 1
            width *= 2

    def _joined(self, body: bytes, cuts: list[int], after: list[int], safe: np.ndarray, width: int) -> bytes | None:
        """Ids with windows that are checked over `width` words on each side; None if a side disagrees.

        A window reads bytes a to b and counts from l to r; both l and r are places where a word starts.
        """
        low, high = after[0], after[-1]
        windows: list[list[int]] = []  # a, l, r, b, and the numbers of the first and last cut inside
        for n in range(1, len(cuts) - 1):
            left, right = max(low, after[n] - (safe[after[n]] != cuts[n])), after[n]
            a, b = int(safe[max(low, left - width)]), int(safe[min(high, right + width)])
            if windows and a < windows[-1][3]:
                windows[-1][2:4], windows[-1][5] = [int(safe[right]), b], n
            else:
                windows.append([a, int(safe[left]), int(safe[right]), b, n, n])
        out, done, origin = [], cuts[0], 0
        before = None
        for a, l, r, b, first, last in [*windows, [cuts[-1]] * 4 + [len(cuts) - 1] * 2]:
            at = cuts[origin]
            chunk = self.piece(body[at : cuts[first]])
            if before and not self._same(before[0], done - before[1], before[2] - before[1], chunk, done - at, before[2] - at):
                return None
            out.append(self._slice(*chunk, done - at, l - at))
            if first == len(cuts) - 1:
                break
            window = self.piece(body[a:b])
            if (a, b) == (cuts[0], cuts[-1]):  # it has grown over the whole text
                return window[0]
            if not self._same(window, 0, l - a, chunk, a - at, l - at):
                return None
            out.append(self._slice(*window, l - a, r - a))
            before, done, origin = (window, a, b), r, last
        return None if None in out else b"".join(out)

    @staticmethod
    def _slice(ids: bytes, ends: array, a: int, b: int) -> bytes | None:
        """The ids of bytes a to b; None if no token begins or ends there."""
        i = bisect_left(ends, a) + 1 if a else 0
        j = bisect_left(ends, b) + 1 if b else 0
        if any(k and (k > len(ends) or ends[k - 1] != x) for k, x in ((i, a), (j, b))):
            return None
        return ids[4 * i : 4 * j]

    def _same(self, x: tuple[bytes, array], a: int, b: int, y: tuple[bytes, array], c: int, d: int) -> bool:
        """Whether ids of x between a and b are those of y between c and d."""
        p, q = self._slice(*x, a, b), self._slice(*y, c, d)
        return p is not None and p == q

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def shared_chunks(df: DataFrame, path: str, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Broadcast | None:
    """Ids of chunks that several tasks hold, by their bytes, as a broadcast table within SHARED_CHUNKS and SHARED_BYTES.

    The chunks that spare most come first; those that find no place are encoded by each task that meets them. One job
    counts names (8 bytes a chunk are shuffled). A second one encodes each chosen chunk in the first task that holds it;
    tasks that have none read nothing. If a table is cut into tasks anew in between, chunks may be missed, ids never.
    None for a stream, or if no chunk is shared.
    """
    if df.isStreaming:
        return None
    texts = df.select(text_col)

    def names(batches):
        part, seen = TaskContext.get().partitionId(), set()
        for b in slices(batches, 0):
            found = named_chunks(*text_bytes(b.column(0)), chunk_bytes)
            new = [n for n in found if n not in seen]
            seen.update(new)
            if len(seen) > SEEN:
                seen.clear()
            sizes = [found[n][1] - found[n][0] for n in new]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array(sizes, pa.int64()), pa.array([part] * len(new), pa.int32())], ["name", "size", "part"])

    counted = texts.mapInArrow(names, "name long, size long, part int").groupBy("name").agg(F.count("*").alias("n"), F.min("size").alias("size"), F.min("part").alias("part"))
    useful = counted.where((F.col("n") > 1) & (F.col("size") <= SHARED_BYTES // 64)).orderBy(((F.col("n") - 1) * F.col("size")).desc(), "name").limit(SHARED_CHUNKS)
    chosen, total = {}, 0
    for r in useful.collect():
        total += r["size"]
        if total > SHARED_BYTES:
            break
        chosen.setdefault(r["part"], set()).add(r["name"])
    if not chosen:
        return None

    def encoded(batches):
        wanted = set(chosen.get(TaskContext.get().partitionId(), ()))
        codec = _codec(path, chunk_bytes)() if wanted else None
        for b in slices(batches, 0) if wanted else ():
            body, offsets = text_bytes(b.column(0))
            here = {n: at for n, at in named_chunks(body, offsets, chunk_bytes).items() if n in wanted}
            wanted.difference_update(here)
            chunks = [body[x:y] for x, y in here.values()]
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), pa.array([codec.piece(x)[0] for x in chunks], pa.binary())], ["chunk", "ids"])
            if not wanted:
                break

    got = texts.mapInArrow(encoded, "chunk binary, ids binary").collect()
    return df.sparkSession.sparkContext.broadcast({bytes(r["chunk"]): bytes(r["ids"]) for r in got})


def _codec(path: str, chunk_bytes: int, shared: Broadcast | None = None) -> Callable[[], ChunkCodec]:
    def make() -> ChunkCodec:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return ChunkCodec(path, chunk_bytes, shared.value if shared else None)

    return make


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of df: id_col, ids (array of int, in order). Null and empty texts give an empty array."""
    make = _codec(path, chunk_bytes, shared_chunks(df, path, text_col, chunk_bytes))

    def work():
        codec = make()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = codec.encode_all(*text_bytes(b.column(1)))
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32), flat)], [id_col, "ids"])

        return one

    return map_slices(df.select(id_col, text_col), work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of df: id_col, text. Null ids give an empty text."""
    make = _codec(path, chunk_bytes)

    def work():
        codec = make()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [codec.decode(np.asarray(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

        return one

    return map_slices(df.select(id_col, ids_col), work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string")


def digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Encode and decode every text: id_col, n_tokens, ids_sha256, decoded_sha256."""
    make = _codec(path, chunk_bytes, shared_chunks(df, path, text_col, chunk_bytes))

    def work():
        codec = make()
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = codec.encode_all(*text_bytes(b.column(1)))
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(codec.decode(x).encode()) for x in ids])],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return one

    return map_slices(df.select(id_col, text_col), work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def reuse(df: DataFrame, path: str, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """How far pieces (chunks and windows) were found encoded, a row a task: asked, given (from the shared table), encoded, widened, encoded_bytes."""
    shared = shared_chunks(df, path, text_col, chunk_bytes)

    def count(batches):
        codec = _codec(path, chunk_bytes, shared)()
        for b in slices(batches, 0):
            codec.encode_all(*text_bytes(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (codec.asked, codec.given, codec.encoded, codec.widened, codec.encoded_bytes)], ["asked", "given", "encoded", "widened", "encoded_bytes"])

    return df.select(text_col).mapInArrow(count, "asked long, given long, encoded long, widened long, encoded_bytes long")
