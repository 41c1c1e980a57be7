"""Streams of chunks with pauses, gaps and loops against the batch form."""

import datetime
import random

import pytest

from scorewright.streaming import chunks

CHUNK = "response_id string, seq bigint, delta string, finish_reason string, prompt_tokens bigint, completion_tokens bigint"
TIMED = CHUNK + ", ts timestamp"


def at(minutes):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=minutes)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def batch(spark, rows):
    return sorted((tuple(r) for r in chunks.assemble(spark.createDataFrame([r[:6] for r in rows], CHUNK)).collect()), key=str)


def drop(spark, path, files, schema):
    """Files of rows in the order in which a stream reads them."""
    import os
    import time

    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and not f.startswith("k"):
                os.rename(f"{path}/{f}", f"{path}/k{k}-{f}")
                os.utime(f"{path}/k{k}-{f}", (time.time() - 1000 + k * 10,) * 2)


def test_paused_responses(spark, tmp_path):
    """A response that pauses for longer than the idle time goes on where it was, also amid a loop and after its end."""
    again = lambda n, k, t: [("loop", k + j, "say it again, ", None, 5, None, at(t)) for j in range(n)]
    other = lambda k, t: [("clock", k, f"tick {k} ", None, None, None, at(t))]
    files = [
        [("r", 0, "one ", None, 3, None, at(0)), ("r", 1, "two ", None, 3, None, at(0)), ("gap", 0, "a", None, 1, None, at(0)), ("gap", 5, "f", None, 1, None, at(0)), *again(3, 0, 0), *other(0, 0)],
        other(1, 60), other(2, 120),
        [("r", 2, "three ", None, 3, None, at(121)), ("gap", 7, "h", "stop", 2, 9, at(121)), *again(4, 3, 121), *other(3, 121)],
        other(4, 200), other(5, 260),
        [("r", 3, "four", "stop", 4, 8, at(261)), *again(2, 7, 261), *other(6, 261)],
    ]
    source = str(tmp_path / "in")
    drop(spark, source, files, TIMED)
    got = sorted((tuple(r) for r in chunks.assemble_files(source, TIMED).select("response_id", "content", "finish_reason", "prompt_tokens", "output_tokens", "n_chunks").collect()), key=str)
    assert got == batch(spark, [r for f in files for r in f])


def test_nothing_is_kept_after_a_loop(spark, tmp_path, rocks):
    """10,000 chunks after the cut: none is stored and none is said."""
    loop = [("x", k, "say it again, ", None, 5, None) for k in range(6)]
    later = [("x", k, f"more {k} ", None, 5, None) for k in range(6, 10_006)]
    source = str(tmp_path / "in")
    drop(spark, source, [loop[:3], loop[3:], later[:5000], later[5000:]], CHUNK)
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(source)
    query = chunks.assemble_stream(stream).writeStream.outputMode("update").format("memory").queryName("looped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    said = [tuple(r) for r in spark.sql("SELECT * FROM looped").collect()]
    assert len(said) == 2 and max(said, key=lambda r: r[-1]) == batch(spark, loop + later)[0]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_any_order(spark, tmp_path):
    """Chunks in random order over several files, with gaps, late and missing first ones."""
    r = random.Random(4)
    rows = [(f"r{i}", k, r.choice([None, "", f"t{k} ", "same words, "]), r.choice([None, "stop"]) if k > 8 else None, r.choice([None, k]), r.choice([None, 2 * k]), at(k / 60)) for i in range(12) for k in range(r.choice([0, 0, 1]), r.randint(3, 14)) if r.random() < 0.9]
    rows += [("loop", k, "over and over ", None, None, None, at(k / 60)) for k in range(9)]
    r.shuffle(rows)
    source = str(tmp_path / "in")
    drop(spark, source, [rows[k::4] for k in range(4)], TIMED)
    got = sorted((tuple(x) for x in chunks.assemble_files(source, TIMED).select("response_id", "content", "finish_reason", "prompt_tokens", "output_tokens", "n_chunks").collect()), key=str)
    assert got == batch(spark, rows)
