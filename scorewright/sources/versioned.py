"""A keyed table of Parquet files with versions: an upsert writes new files beside the old ones and then commits.

data/ holds folders of files, none of which is ever changed; versions/ holds a manifest for each version, which says for
each partition (the values of some columns, nulls told from values) the folder with its rows. A version exists once its
manifest has its final name: the manifest is written under another name and renamed in one step, which fails if another
writer has made that version. A write that dies before the rename leaves files that no manifest names, and the version
before stays what readers see. Only partitions with new rows are read and written again.

Rows carry their arrival number, the version of their batch; within a batch the arrival column orders them, or else their
order in the DataFrame. The last arrival of a key wins. Null keys and null partition values are values like others.
A manifest has an entry for each partition (a model and a condition), so partitions are meant to be few.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorewright.sources.tables import fresh, stored

PARTITIONS = ("model_key", "condition")
#: A row's arrival number in the files, its place in a batch that is being written, and the folder of its partition.
BATCH, PLACE, PART = "_batch", "_place", "_part"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    _, fs, where = _fs(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version consists of (the last one by default): version, schema, parts (folder by partition). None if there is none."""
    known = versions(spark, path)
    if version is None and not known:
        return None
    text = spark.read.text(f"{path}/versions/{known[-1] if version is None else version:020d}.json", wholetext=True).first()[0]
    return json.loads(text)


def _commit(spark: SparkSession, path: str, said: dict) -> None:
    """Give the manifest its final name in one step."""
    hadoop, fs, folder = _fs(spark, f"{path}/versions")
    fs.mkdirs(folder)
    temporary, final = hadoop.Path(folder, f".{uuid.uuid4().hex}"), hadoop.Path(folder, f"{said['version']:020d}.json")
    out = fs.create(temporary, False)
    out.write(json.dumps(said).encode())
    out.close()
    rename = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    rename[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, final, rename)
    except Exception as e:
        fs.delete(temporary, False)
        if "AlreadyExists" in str(e):
            raise Conflict(f"version {said['version']} of {path} is there") from e
        raise


def _files(spark: SparkSession, path: str, said: dict, parts: list[str]) -> DataFrame:
    """Stored rows of some partitions, with their arrival."""
    schema = StructType.fromJson(said["schema"])
    folders = sorted({said["parts"][p] for p in parts})
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one by default."""
    said = manifest(spark, path, version)
    if said is None:
        raise FileNotFoundError(f"no version of {path}")
    return _files(spark, path, said, list(said["parts"])).drop(BATCH)


def _tag(partitions: tuple[str, ...]):
    """A name for the partition of a row; null and every text have different ones."""
    values = (F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in partitions)
    return F.md5(F.encode(F.concat(F.lit(""), *values), "utf-8"))


def _last(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last arrival of each key."""
    r = fresh(df, "arrival_rank")
    return df.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(BATCH)))).where(f"{r} = 1").drop(r)


def upsert(new: DataFrame, path: str, keys: list[str], partitions: tuple[str, ...] = PARTITIONS, arrival: str | None = None, tries: int = 5) -> int:
    """Put rows in place of those of the same keys, and return the version that this made.

    Among new rows of one key the last by the arrival column stays, without one the last in the order of the DataFrame.
    The partition columns must be among the keys. A column that one side lacks is null there.
    """
    spark = new.sparkSession
    if not set(partitions) <= set(keys):
        raise ValueError("a key must lie in one partition: the partition columns have to be keys")
    new = stored(spark, new.withColumn(PLACE, F.col(arrival) if arrival else F.monotonically_increasing_id()), "arrived")
    for k in range(tries):
        try:
            return _upsert_once(new, path, keys, partitions)
        except Conflict:
            if k + 1 == tries:
                raise
    raise AssertionError


def _upsert_once(new: DataFrame, path: str, keys: list[str], partitions: tuple[str, ...]) -> int:
    spark = new.sparkSession
    said = manifest(spark, path) or {"version": 0, "parts": {}, "schema": None}
    version = said["version"] + 1
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(PLACE))
    rows = new.withColumn(BATCH, F.row_number().over(order)).where(F.col(BATCH) == 1).drop(PLACE).withColumn(BATCH, F.lit(version).cast("bigint"))
    touched = [r[0] for r in new.select(_tag(partitions)).distinct().collect()]  # few, as the manifest's entries
    again = [p for p in touched if p in said["parts"]]
    if again:
        old = _files(spark, path, said, again).withColumn(PART, _tag(partitions)).where(F.col(PART).isin(again)).drop(PART)
        rows = _last(old.unionByName(rows, allowMissingColumns=True), keys)
    folder = f"data/{version:020d}-{uuid.uuid4().hex}"
    rows = rows.withColumn(PART, _tag(partitions))
    schema = rows.drop(PART).schema
    rows.repartition(PART, F.pmod(F.xxhash64(*keys), F.lit(8))).write.partitionBy(PART).parquet(f"{path}/{folder}")
    old_schema = StructType.fromJson(said["schema"]) if said["schema"] else schema
    names = {f.name for f in schema}
    merged = StructType([*schema, *(f for f in old_schema if f.name not in names)])
    parts = said["parts"] | {p: f"{folder}/{PART}={p}" for p in touched}
    _commit(spark, path, {"version": version, "schema": json.loads(merged.json()), "parts": parts})
    return version
