"""The corpus pipeline: quality filter, near-copy removal, surrogates for personal data, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last keep
the columns of documents. run applies them to the documents table, each written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import mixing, near_copies, packing, pii, quality
from gridloom.llm.common import save
from gridloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows among the stage's own input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs.select(*COLUMNS), quality.fit(docs, labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike by 0.8 or more on five-word shingles, the least id stays."""
    return near_copies.keep_one(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data; n_chars follows the text."""
    from pyspark.sql import functions as F

    done = pii.rewrite(docs.select(*COLUMNS)).drop("_entities")
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated sampling selects."""
    return mixing.mix(docs.select(*COLUMNS), tokenizer_path("byte_bpe_50k.json")).where("_selected").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_stage), ("simhash near-dedup", near_dedup_stage), ("pii surrogates", pii_stage), ("source mixing", mixing_stage), ("packing", packing_stage)]

#: SQL cannot express the learned, hashed and tokenised stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
