"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.sources.tables import fresh, stored

__all__ = ["fresh", "map_slices", "row_key", "slices", "stored", "table", "text_bytes"]

#: Rows that a Python worker holds at a time; long texts make a row large.
SLICE_ROWS = 256
#: Text bytes after which a slice ends early.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: Column | str) -> Column:
    """128 bits that name a row by its values, nulls told from values; equal rows have equal keys."""
    parts = []
    for c in cols:
        c = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.unhex(F.md5(F.encode(F.concat(*parts), "utf-8")))


def slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of few rows and few text bytes; a single longer text is a slice of its own."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(SLICE_ROWS, b.num_rows - at)
            while n > 1 and b.column(text).slice(at, n).nbytes > SLICE_BYTES:
                n //= 2
            yield b.slice(at, n)
            at += n


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text: int = 1) -> DataFrame:
    """mapInArrow over slices; make() runs once in each task and gives the function of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in slices(batches, text):
            out = work(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[bytes, list[int]]:
    """UTF-8 bytes of a string column without a copy for each row, and n + 1 offsets; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    offsets = pa.array([], pa.int64()) if len(column) == 0 else None
    if offsets is not None:
        return b"", [0]
    raw = memoryview(column.buffers()[1]).cast("q")[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2]
    body = b"" if data is None else memoryview(data)[raw[0] : raw[-1]].tobytes()
    return body, [x - raw[0] for x in raw]
