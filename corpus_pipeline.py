"""A corpus pipeline: toxicity, quality, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import keep_rows, materialize, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below one half stay."""
    from tidewater.llm.toxicity import keep_clean

    return keep_clean(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote at least 0.3 for good quality stay."""
    from tidewater.llm.quality import keep_good

    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    from tidewater.llm.exact_dedup import exact_dedup as dedup

    return keep_rows(docs, dedup(docs).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word similarities of at least 0.8 one document stays:
    that with the smallest doc_id, of equal ids that with the smallest hash of its text."""
    from tidewater.llm.near_copies import near_copies

    return keep_rows(docs, near_copies(docs).where("kept"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 tokens; the result of the pipeline."""
    from tidewater.llm.packing import pack_documents
    from tidewater.llm.queries import BYTE_VOCABULARY, vocabulary

    return pack_documents(docs, vocabulary(BYTE_VOCABULARY))


STAGES = [("toxicity", toxicity), ("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Trained models and packing have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
