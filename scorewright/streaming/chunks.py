"""Assembly of streamed answers with a loop guard: a batch form and a streaming form with the same results. Chunks of one
response have different seq."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scorewright.functions.text import has_loop
from scorewright.sources import versioned
from scorewright.sources.tables import scratch

OUT = "response_id string, content string, finish_reason string, prompt_tokens bigint, output_tokens bigint, n_chunks bigint"
TAIL = 800
_LOOP = re.compile(r"(?s)(.{8,200})\1{4}\Z")


def assemble(chunks: DataFrame, guard: bool = True) -> DataFrame:
    """One row per response: content in seq order, last finish reason and usage, output tokens (or the number of texts).

    With the guard, content ends with the first chunk after which the text's tail loops, and the reason is loop_cutoff.
    Only the tail of TAIL characters is tested, which a running fold over the ordered chunks carries along.
    """
    d = chunks.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("seq", "delta", "finish_reason", "prompt_tokens", "completion_tokens"))).alias("c"))
    if guard:
        start = F.struct(F.lit("").alias("tail"), F.lit(None).cast("bigint").alias("stop"))

        def fold(acc, x):
            tail = F.right(F.concat(acc["tail"], F.coalesce(x["delta"], F.lit(""))), F.lit(TAIL))
            hit = acc["stop"].isNull() & (F.coalesce(x["delta"], F.lit("")) != "") & has_loop(tail)
            return F.struct(tail.alias("tail"), F.when(hit, x["seq"].cast("bigint")).otherwise(acc["stop"]).alias("stop"))

        d = d.withColumn("stop", F.aggregate("c", start, fold, lambda acc: acc["stop"]))
        d = d.withColumn("c", F.filter("c", lambda x: F.col("stop").isNull() | (x["seq"] <= F.col("stop"))))
    else:
        d = d.withColumn("stop", F.lit(None).cast("bigint"))
    texts = F.filter(F.transform("c", lambda x: x["delta"]), lambda t: t.isNotNull() & (t != ""))
    last = lambda f: F.element_at(F.filter(F.transform("c", lambda x: x[f]), lambda v: v.isNotNull()), -1)
    safe = lambda f: F.when(F.exists("c", lambda x: x[f].isNotNull()), last(f))
    return d.select(
        "response_id",
        F.when(F.size(texts) > 0, F.array_join(texts, "")).alias("content"),
        F.when(F.col("stop").isNotNull(), "loop_cutoff").otherwise(safe("finish_reason")).alias("finish_reason"),
        safe("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.coalesce(safe("completion_tokens"), F.size(texts)).cast("bigint").alias("output_tokens"),
        F.size("c").cast("bigint").alias("n_chunks"),
    )


#: What a response's state holds once and for all: the next seq in a row and what all chunks before it came to. content is
#: the text of the present part; the tail goes on over parts.
HEAD = "next_seq bigint, part int, content string, tail string, reason string, prompt bigint, completion bigint, n_texts bigint, n_chunks bigint, stopped boolean, expired boolean"
START = (0, 0, None, "", None, None, None, 0, 0, False, False)


class Head:
    """What the chunks so far came to; add() takes the next one and says whether the guard stops there."""

    def __init__(self, values: tuple):
        self.next_seq, self.part, self.content, self.tail, self.reason, self.prompt, self.completion, self.n_texts, self.n_chunks, self.stopped, self.expired = values

    def values(self) -> tuple:
        return self.next_seq, self.part, self.content, self.tail, self.reason, self.prompt, self.completion, self.n_texts, self.n_chunks, self.stopped, self.expired

    def add(self, chunks: list[tuple], guard: bool) -> int:
        """Number of (seq, delta, finish_reason, prompt_tokens, completion_tokens) taken; fewer if the guard stops."""
        pieces = [self.content] if self.content else []
        for k, (seq, delta, reason, prompt, completion) in enumerate(chunks):
            self.next_seq, self.n_chunks = seq + 1, self.n_chunks + 1
            self.reason, self.prompt, self.completion = reason or self.reason, self.prompt if prompt is None else prompt, self.completion if completion is None else completion
            if delta:
                pieces.append(delta)
                self.n_texts += 1
                self.tail = (self.tail + delta)[-TAIL:]
                if guard and _LOOP.search(self.tail):
                    self.reason, self.stopped = "loop_cutoff", True
                    break
        self.content = "".join(pieces) or None
        return k + 1 if chunks else 0

    def row(self, response: Any, status: str | None) -> pd.DataFrame:
        out = {"response_id": [response], "content": [self.content], "finish_reason": [self.reason], "prompt_tokens": [self.prompt], "output_tokens": [self.n_texts if self.completion is None else self.completion], "n_chunks": [self.n_chunks]}
        return pd.DataFrame(out | ({} if status is None else {"part": [self.part], "status": [status]}))


class Assembler(StatefulProcessor):
    """Chunks in a row from seq 0 on are folded into one value; only chunks beyond a gap wait, by their seq, and what is
    said of a response counts them too, as in the batch form. A chunk that comes late takes its place.

    Once the guard stops a response within the row, its text and waiting chunks go and a mark of constant size stays: later
    chunks are neither stored nor said again. With event times, a response whose last chunk the watermark has left behind
    by idle_ms expires: what waits is taken in order (gaps count as lost), the part is said a last time with status
    expired, and only the mark stays, so later chunks go on as the next part, with the tail and the counts carried along.
    A chunk for a place before that is left out. After forget_ms more the mark goes as well.
    """

    def __init__(self, guard: bool, idle_ms: int | None, forget_ms: int | None = None):
        self.guard, self.idle, self.forget = guard, idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.waiting = handle.getMapState("waiting", "seq bigint", "delta string, finish_reason string, prompt_tokens bigint, completion_tokens bigint")

    def _timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            at = max(at, t)
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        none = lambda v: None if v is None or v != v else v
        whole = lambda v: None if none(v) is None else int(v)
        head = Head(self.head.get() or START)
        if head.stopped:
            for _ in rows:
                pass
            return
        latest, fresh = 0, {}
        for part in rows:
            for r in part.itertuples():
                if r.seq >= head.next_seq:
                    fresh[int(r.seq)] = (none(r.delta), none(r.finish_reason), whole(r.prompt_tokens), whole(r.completion_tokens))
            latest = max(latest, int(part["ts"].max().timestamp() * 1000)) if self.idle else latest
        if self.idle:
            self._timer(max(latest + self.idle, timerValues.getCurrentWatermarkInMs() + 1))
        if not fresh:
            return
        held = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        chunks = sorted((k, *v) for k, v in (held | fresh).items())
        # A part after an expiry begins anywhere; otherwise the row goes on at the next seq.
        n = 0
        while n < len(chunks) and chunks[n][0] == head.next_seq + n:
            n += 1
        head.expired = False
        head.add(chunks[:n], self.guard)
        said = head
        if not head.stopped and chunks[n:]:
            said = Head(head.values())
            said.add(chunks[n:], self.guard)
        yield said.row(key[0], "open" if self.idle else None)
        if head.stopped:
            head.content, head.tail = None, ""
            self.waiting.clear()
        else:
            for seq, *_ in chunks[:n]:
                if seq in held:
                    self.waiting.removeKey((seq,))
            for seq, *values in chunks[n:]:
                if seq in fresh:
                    self.waiting.updateValue((seq,), tuple(values))
        self.head.update(head.values())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        head = Head(self.head.get() or START)
        if head.expired:
            self.head.clear()
            self.waiting.clear()
            return
        if not head.stopped:
            head.add(sorted((k[0], *v) for k, v in self.waiting.iterator()), self.guard)
            yield head.row(key[0], "expired")
            self.waiting.clear()
            head.content, head.part = None, head.part + 1
        if head.stopped:
            head.content, head.tail = None, ""
        head.expired = True
        self.head.update(head.values())
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.forget)

    def close(self) -> None:
        pass


#: Milliseconds of event time after which a silent response expires, which is also the watermark's delay, and after which
#: its mark is dropped from state.
IDLE_MS, FORGET_MS = 600_000, 86_400_000


def assemble_stream(chunks: DataFrame, guard: bool = True, idle_ms: int = IDLE_MS, forget_ms: int = FORGET_MS) -> DataFrame:
    """A streaming DataFrame of each response as far as it has come, in update mode; needs the RocksDB state store. seq
    counts from 0.

    Where chunks have the event time ts, responses expire by it, and there are two more columns: part, of whose texts in
    order the response consists (the other columns count all parts so far), and status (open, expired). Without ts all
    responses stay in state.
    """
    timed = "ts" in chunks.columns
    if timed:
        chunks = chunks.withWatermark("ts", f"{idle_ms} milliseconds")
    assembler = Assembler(guard, idle_ms, forget_ms) if timed else Assembler(guard, None)
    return chunks.groupBy("response_id").transformWithStateInPandas(assembler, OUT + ", part int, status string" if timed else OUT, "Update", "EventTime" if timed else "None")


def join_parts(said: DataFrame, order: str = "batch") -> DataFrame:
    """One row per response (OUT) from all that a stream with parts has said, with the number of the batch that said it."""
    last = said.groupBy("response_id", "part").agg(F.max_by(F.struct(*(c for c in said.columns if c != order)), F.struct(order, "n_chunks")).alias("x"))
    parts = last.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("part", "x"))).alias("p"))
    texts = F.filter(F.transform("p", lambda p: p["x"]["content"]), lambda t: t.isNotNull())
    end = F.element_at("p", -1)["x"]
    return parts.select("response_id", F.when(F.size(texts) > 0, F.array_join(texts, "")).alias("content"), *(end[c].alias(c) for c in ("finish_reason", "prompt_tokens", "output_tokens", "n_chunks")))


def assemble_files(source: str, schema: str, guard: bool = True, files_at_a_time: int = 1, idle_ms: int = IDLE_MS) -> DataFrame:
    """What assemble_stream() says last of each response, for chunk files (Parquet) that are there; one stream to its end."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = scratch(spark, "assembled")
    try:
        out = assemble_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(source), guard, idle_ms)
        write = lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("append").parquet(path)
        query = out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    said = spark.read.parquet(path)
    if "part" in said.columns:
        return join_parts(said)
    last = said.groupBy("response_id").agg(F.max_by(F.struct(*said.columns), "batch").alias("x"))
    return last.select("x.*").drop("batch")


def score_incrementally(responses: DataFrame, score, path: str, checkpoint: str, keys: list[str]):
    """A query that scores new response files as they come and upserts the scores into a versioned table, a version a batch;
    failed answers simply come again. A batch that is run again after a crash puts the same rows in place once more."""
    return responses.writeStream.foreachBatch(lambda batch, _: versioned.upsert(score(batch), path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_spend(ledger: DataFrame) -> DataFrame:
    """Totals by model, for batch and streaming input alike."""
    return ledger.groupBy("model_key").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"))


def spend_of_files(spark, source: str, schema: str) -> DataFrame:
    """The last totals that a running_spend() stream over ledger files (Parquet) says, in complete mode."""
    path = scratch(spark, "spend")
    write = lambda batch, k: batch.write.mode("overwrite").parquet(path)
    stream = running_spend(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
