"""Readers and writers of labels, responses, models, subsets, scores and the ledger. Keys are strings everywhere."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALARS = ("product_name", "origin", "net_weight", "mfg_date", "expiry_date")
LISTS = ("ingredient", "additive", "warning")
LABEL = "image_id string, product_name string, origin string, net_weight string, mfg_date string, expiry_date string, ingredient array<string>, additive array<string>, warning array<string>, nutrition array<struct<name:string,value:string>>"
NUTRITION = "array<struct<name:string,value:string>>"
RESPONSES = "tier string, model_key string, model_slug string, image_id string, condition string, content string, input_tokens bigint, output_tokens bigint, cost_usd double, latency_s double, error string, finish_reason string, cached_at timestamp"
FIELD_SCORES = "image_id string, model_key string, condition string, field string, field_type string, precision double, recall double, f1 double, strict_f1 double, similarity double, diacritic_only_mismatch boolean, pairing_accuracy double, value_accuracy double, json_valid boolean, api_error string"
IMAGE_SCORES = "image_id string, model_key string, condition string, macro_field_f1 double, macro_field_f1_strict double, pairing_accuracy double, json_valid boolean, api_error string, n_structural_issues int"
LEDGER = "tier string, model_key string, image_id string, condition string, input_tokens bigint, output_tokens bigint, cost_usd double"
FIELD_KEY = ["image_id", "model_key", "condition", "field"]
IMAGE_KEY = ["image_id", "model_key", "condition"]


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share. In local mode without one (tests) a
    temporary folder is set; a cluster without one is an error, since its machines don't see each other's disks."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete what this application has stored; DataFrames that still read it fail afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One strict record for each JSON file; the id is the file's name without its ending.

    Nulls are empty; a missing list is empty; a missing scalar, a wrong type or text that is no object raises.
    """
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return labels_of(raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("image_id"), "value"))


def labels_of(raw: DataFrame) -> DataFrame:
    """read_labels() of records that are a table already: image_id, value (JSON)."""
    d = raw.select("image_id", F.try_parse_json("value").alias("v"), F.json_object_keys("value").alias("keys"))
    bad = lambda what: F.raise_error(F.concat(F.lit("label "), F.col("image_id"), F.lit(f": {what}")))
    kind = lambda f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant"))

    def scalar(f: str):
        ok = kind(f).isin("STRING", "VOID")
        return F.when(F.col("keys").isNull() | ~F.array_contains("keys", f), bad(f"missing {f}").cast("string")).when(~ok, bad(f"{f} is no string").cast("string")).otherwise(F.coalesce(F.try_variant_get("v", f"$.{f}", "string"), F.lit(""))).alias(f)

    def listed(f: str, of: str):
        got = F.try_variant_get("v", f"$.{f}", of)
        wrong = F.array_contains("keys", f) & (kind(f) != "VOID") & got.isNull()
        return F.when(wrong, bad(f"{f} is no list of the right kind").cast(of)).otherwise(F.coalesce(got, F.array().cast(of))).alias(f)

    return d.select("image_id", *(scalar(f) for f in SCALARS), *(listed(f, "array<string>") for f in LISTS), listed("nutrition", NUTRITION))


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, image_path of the *.jpeg files of one folder; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpeg").option("recursiveFileLookup", "false").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.jpeg$", 1).alias("image_id"), F.col("path").alias("image_path")).orderBy("image_id")


def read_responses(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """Cached answers under tier/model/ folders: one JSON record a file, or one a line."""
    return spark.read.schema(RESPONSES).option("multiLine", one_a_file).option("recursiveFileLookup", True).json(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """The model registry (YAML, a small dimension); each model gets its endpoint's address and key name."""
    import yaml

    spec = yaml.safe_load("\n".join(r[0] for r in spark.read.text(path).collect()))
    ends = spec.get("endpoints") or {}
    rows = []
    for key, m in (spec.get("models") or {}).items():
        end = ends.get(m.get("endpoint")) or {}
        rows.append((key, m.get("slug"), m.get("display_name"), m.get("group"), m.get("open_weight"), *(float(m[p]) if m.get(p) is not None else None for p in ("price_input_per_m", "price_output_per_m")), m.get("base_url") or end.get("base_url"), m.get("api_key_env") or end.get("api_key_env")))
    return spark.createDataFrame(rows, "key string, slug string, display_name string, `group` string, open_weight boolean, price_input_per_m double, price_output_per_m double, base_url string, api_key_env string")


def read_pinned_subset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("size int, seed int, image_ids array<string>").option("multiLine", True).json(path).select(F.explode("image_ids").alias("image_id"))


def read_scored(spark: SparkSession, path: str, schema: str = FIELD_SCORES) -> DataFrame:
    """Scored CSV with an explicit schema, so that ids keep their leading zeros."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def upserted(existing: DataFrame | None, new: DataFrame, keys: list[str], arrival: str | None = None) -> DataFrame:
    """existing with the rows of new in place of those of the same keys. Among rows of one key the last by the arrival
    column wins; without one, the greatest by its other columns, so that the choice doesn't hang on the partitioning."""

    def last(df: DataFrame) -> DataFrame:
        order = [F.col(arrival)] if arrival else [F.col(c) for c in df.columns if c not in keys]
        r = fresh(df, "arrival_rank")
        return df.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in order or [F.lit(0)])))).where(f"{r} = 1").drop(r)

    new = last(new)
    return new if existing is None else last(existing.join(new.select(*keys), keys, "left_anti")).unionByName(new, allowMissingColumns=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def upsert_scored(new: DataFrame, path: str, keys: list[str], partitions: tuple[str, ...] = ("model_key", "condition"), arrival: str | None = None) -> None:
    """Upsert into a plain Parquet table laid out by partitions, null ones too; only partitions that new rows touch are read
    and rewritten. Of new rows of one key the last by the arrival column stays, without one the last in the order of the
    DataFrame. A write that dies midway can lose a partition; versioned.upsert() can't."""
    spark = new.sparkSession
    place = arrival or fresh(new, "arrival_place")
    new = stored(spark, new if arrival else new.withColumn(place, F.monotonically_increasing_id()), "arrived")  # it is read several times
    new = new.withColumn(fresh(new, "r_"), F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(place))))
    new = new.where(F.col(new.columns[-1]) == 1).drop(new.columns[-1], *([] if arrival else [place]))
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is None:
        return new.write.partitionBy(*partitions).parquet(path)
    old = old.withColumns({p: F.col(p).cast(new.schema[p].dataType) for p in partitions})
    same = lambda cols, right: reduce(lambda a, b: a & b, (old[c].eqNullSafe(right[c]) for c in cols))
    touched = new.select(*partitions).distinct()
    old = old.join(F.broadcast(touched) if touched.limit(10_001).count() <= 10_000 else touched, same(partitions, touched), "left_semi")
    merged = old.join(new, same(keys, new), "left_anti").unionByName(new, allowMissingColumns=True)
    merged = stored(spark, merged, "upsert")  # what is read is about to be overwritten
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def ledger_rows(responses: DataFrame) -> DataFrame:
    """Rows for the ledger: answers that used tokens, cost to 6 places."""
    return responses.where("input_tokens + output_tokens > 0").select("tier", "model_key", "image_id", "condition", "input_tokens", "output_tokens", F.round("cost_usd", 6).alias("cost_usd"))


def append_ledger(responses: DataFrame, path: str) -> None:
    ledger_rows(responses).write.mode("append").option("header", True).csv(path)


def save_responses(responses: DataFrame, path: str) -> None:
    """Append successful answers, by tier and model; failures are not kept, so they are tried again."""
    responses.where("error is null and content is not null").write.mode("append").partitionBy("tier", "model_key").parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def write_files(df: DataFrame, path: str) -> None:
    """A file for each row of df (name, body), written by tasks through Spark's text writer, one partition folder a file
    name being flattened away: for small sets of files that readers want one by one."""
    df.select("name", F.col("body").alias("value")).write.partitionBy("name").text(f"{path}.parts")
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(f"{path}.parts")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(path))
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("name="):
            for f in fs.listStatus(folder.getPath()):
                fs.rename(f.getPath(), fs_path(path, name[len("name=") :]))
