"""From raw documents to packed training sequences, in five stages.

Every stage but the last returns the columns of documents. Exact dedup keeps one
row of each text, that of the smallest id (a null id stays only where there is
no other); a row with a null id cannot be named by a decision on ids and stays
in near-dedup. Null texts count as empty, and an empty table runs through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.common import stage, table
from trailweave.llm.decontaminate import decontaminate
from trailweave.llm.exact_dedup import drop_repeats
from trailweave.llm.near_dedup import minhash_dedup
from trailweave.llm.packing import pack
from trailweave.llm.toxicity import drop_toxic


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs without the ids of which no row is kept."""
    gone = decided.where("id is not null").groupBy("id").agg(F.bool_or("kept").alias("kept")).where("not kept")
    return docs.join(gone.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, minhash_dedup(docs))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers  # read where it is used, so that a missing vocabulary takes no other query along

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", unseen),
    ("best-fit packing", packed),
]

#: A trained classifier and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
