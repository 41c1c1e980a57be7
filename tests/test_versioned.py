"""The versioned table: last arrival, null partitions, killed and racing writes."""

import pytest

from scorewright.sources import tables, versioned

KEYS = ["image_id", "model_key", "condition"]
SCHEMA = "image_id string, model_key string, condition string, f1 double, at int"


def write(spark, path, rows, **more):
    return versioned.upsert(spark.createDataFrame([(*r, *([None] * (5 - len(r)))) for r in rows], SCHEMA), path, KEYS, **more)


def read(spark, path, version=None):
    return sorted((tuple(r)[:4] for r in versioned.read(spark, path, version).collect()), key=str)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert write(spark, path, [("1", "a", None, 0.1), ("2", None, None, 0.2), ("3", "a", "", 0.3)]) == 1
    assert write(spark, path, [("1", "a", None, 0.9), ("4", None, None, 0.4), ("1", "a", None, 0.5)]) == 2
    after = [("1", "a", None, 0.5), ("2", None, None, 0.2), ("3", "a", "", 0.3), ("4", None, None, 0.4)]
    assert read(spark, path) == after
    assert read(spark, path, 1) == [("1", "a", None, 0.1), ("2", None, None, 0.2), ("3", "a", "", 0.3)]
    assert write(spark, path, [("2", None, None, 0.7, 2), ("2", None, None, 0.8, 1), (None, None, None, 0.0, None)], arrival="at") == 3
    assert read(spark, path) == sorted([*after[:1], ("2", None, None, 0.7), *after[2:], (None, None, None, 0.0)], key=str)
    # Untouched partitions keep their files.
    first, last = (versioned.manifest(spark, path, v)["parts"] for v in (1, 3))
    assert len({first[p] for p in first} & set(last.values())) == 1


def test_killed_write(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    write(spark, path, [("1", "a", "c", 0.1)])

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versioned, "_commit", die)
        with pytest.raises(KeyboardInterrupt):
            write(spark, path, [("1", "a", "c", 0.2), ("2", "a", "c", 0.2)])
    assert read(spark, path) == [("1", "a", "c", 0.1)]
    assert write(spark, path, [("3", "a", "c", 0.3)]) == 2
    assert read(spark, path) == [("1", "a", "c", 0.1), ("3", "a", "c", 0.3)]


def test_racing_writers(spark, tmp_path, monkeypatch):
    """A version can be made once; the later writer starts again from it and loses nothing."""
    path = str(tmp_path / "t")
    write(spark, path, [("1", "a", "c", 0.1)])
    commit, raced = versioned._commit, []

    def late(*args):
        if not raced:
            raced.append(1)
            write(spark, path, [("2", "a", "c", 0.2)])
        commit(*args)

    monkeypatch.setattr(versioned, "_commit", late)
    assert write(spark, path, [("3", "a", "c", 0.3)]) == 3
    assert read(spark, path) == [("1", "a", "c", 0.1), ("2", "a", "c", 0.2), ("3", "a", "c", 0.3)]


def test_no_rows_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark, path, [])
    assert read(spark, path) == []
    write(spark, path, [("1", "a", "c", 0.1)])
    more = spark.createDataFrame([("2", "a", "c", "x")], "image_id string, model_key string, condition string, note string")
    versioned.upsert(more, path, KEYS)
    assert sorted((r["image_id"], r["f1"], r["note"]) for r in versioned.read(spark, path).collect()) == [("1", 0.1, None), ("2", None, "x")]
    with pytest.raises(ValueError, match="partition"):
        versioned.upsert(more, path, ["image_id"])


def test_plain_upsert_keeps_null_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    make = lambda rows: spark.createDataFrame(rows, "image_id string, model_key string, condition string, f1 double")
    tables.upsert_scored(make([("1", "a", None, 0.1), ("2", "a", None, 0.2)]), path, KEYS)
    tables.upsert_scored(make([("3", "a", None, 0.9), ("3", "a", None, 0.1), ("1", "a", None, 0.5)]), path, KEYS)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("image_id", "model_key", "condition", "f1").collect()) == [("1", "a", None, 0.5), ("2", "a", None, 0.2), ("3", "a", None, 0.1)]
