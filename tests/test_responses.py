"""Answers of one file each, taken in run by run."""

import json
import os

from scorewright.sources import responses, versioned


def put(root, under, model, name, at, **record):
    folder = root / under / model
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(record) if record else "no record")
    os.utime(folder / name, (at, at))


def rows(spark, store):
    return sorted((r["tier"], r["model_slug"], r["image_id"], r["condition"], r["content"], r["taken"]) for r in versioned.read(spark, store).collect())


def test_runs(spark, tmp_path):
    root, store = tmp_path / "raw", str(tmp_path / "store")
    put(root, "t1", "v_m", "00 1__vi_zero.json", 1_700_000_000, content="a", tier="wrong", image_id="wrong", model_key="m")
    put(root, "t1", "v_m", "a__b+c__vi_zero.json", 1_700_000_000, content="b")
    put(root, "t2", "v_m", "00 1__glare_s2.json", 1_700_000_000)
    put(root, "t2", "v_m", "notes.json", 1_700_000_000, content="no answer")
    assert responses.compact(spark, str(root), store) == 1
    first = [("t1", "v_m", "00 1", "vi_zero", "a", 1), ("t1", "v_m", "a__b+c", "vi_zero", "b", 1), ("t2", "v_m", "00 1", "glare_s2", None, 1)]
    assert rows(spark, store) == first
    assert responses.compact(spark, str(root), store) is None
    # A later file of the same time as the latest, an answer given anew, and one that is untouched.
    put(root, "t1", "w", "2__vi_zero.json", 1_700_000_000, content="c")
    put(root, "t1", "v_m", "00 1__vi_zero.json", 1_700_000_500, content="a2")
    assert responses.compact(spark, str(root), store) == 2
    assert rows(spark, store) == [("t1", "v_m", "00 1", "vi_zero", "a2", 2), *first[1:2], ("t1", "w", "2", "vi_zero", "c", 2), first[2]]


def test_only_later_files_are_opened(spark, tmp_path):
    root, store = tmp_path / "raw", str(tmp_path / "store")
    for k in range(6):
        put(root, "t", "m", f"{k}__vi_zero.json", 1_700_000_000 + k, content=str(k))
    responses.compact(spark, str(root), store)
    put(root, "t", "m", "9__vi_zero.json", 1_700_000_900, content="9")
    from pyspark.sql import functions as F

    since = versioned.read(spark, store).agg(F.max("file_time")).first()[0]
    read = responses.one_a_file(spark, str(root), F.lit(since))
    assert read.count() == 2 and read.rdd.getNumPartitions() <= 2
