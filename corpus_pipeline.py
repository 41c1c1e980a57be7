"""Training-corpus pipeline: stages over the table documents, each written as Parquet and read again by the next.

Quality rules drop rejected documents; line dedup drops recurring lines from all documents but the first, and documents
that have no words left by it; the n-gram join keeps one document of each near-duplicate group; decontamination drops documents that hold a window of the
benchmark; the last stage encodes and decodes what is left. n_chars follows the text. Input columns other than doc_id,
text, lang, source and n_chars are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import bpe, decontam, jaccard, linededup, quality
from scorewright.llm.common import stored, table
from scorewright.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps. Each text is judged once, beside the row it belongs to."""
    judged = quality.apply_policy(quality.ledger(docs, keep=COLUMNS))
    return judged.where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their recurring lines. Documents that lost all their words go: each line stays in another one."""
    cut = linededup.transform(docs.select(*COLUMNS)).where(~((F.col("n_dropped") > 0) & ~F.col("text").rlike(r"\S")))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: Line templates, connected groups and token ids have no SQL twin; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
