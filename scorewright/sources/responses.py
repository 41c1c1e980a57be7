"""Answers that are kept as one JSON file each, tier/model/image__condition.json, taken into a versioned table run by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.sources import versioned
from scorewright.sources.tables import RESPONSES

KEYS = ["tier", "model_slug", "image_id", "condition"]
PLACE = r"([^/]+)/([^/]+)/([^/]+)__([^/]+)\.json$"


def one_a_file(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """RESPONSES of the files, with file and file_time: the keys come from a file's place, the rest from its record. A file
    that holds no record has null there. since: only files of that time or later are opened."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*__*.json").text(path, wholetext=True)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("file_time"))
    if since is not None:
        raw = raw.where(F.col("file_time") >= since)  # decides by the listing which files are read
    place = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    own = {c: F.regexp_extract(place, PLACE, k + 1) for k, c in enumerate(KEYS)}
    d = raw.withColumn("r", F.from_json("value", RESPONSES))
    names = [f.split()[0] for f in RESPONSES.split(", ")]
    return d.select(*(own.get(c, F.col(f"r.{c}")).alias(c) for c in names), "file", "file_time").where("tier <> ''")


def compact(spark: SparkSession, path: str, store: str) -> int | None:
    """Take files that are new or have changed since the last run into the store, and return its version; None if there are
    none. The store is the list of files read: each row has its file, the file's time, and taken, the version that took it.

    Only files as late as the latest known one are opened, and those of just that time are told apart by name. Of several
    records of one answer the latest file's stays.
    """
    known = versioned.manifest(spark, store)
    new = one_a_file(spark, path)
    if known:
        old = versioned.read(spark, store)
        since = old.agg(F.max("file_time")).first()[0]
        if since is not None:
            new = one_a_file(spark, path, F.lit(since))
            new = new.join(old.where(F.col("file_time") == F.lit(since)).select("file", "file_time"), ["file", "file_time"], "left_anti")
    if new.isEmpty():
        return None
    version = (known["version"] if known else 0) + 1
    return versioned.upsert(new.withColumn("taken", F.lit(version)), store, KEYS, ("tier", "model_slug"), arrival="file_time")
