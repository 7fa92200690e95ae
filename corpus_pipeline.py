"""A corpus made ready for training: quality rules, near copies, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All stages but the last
return the columns of documents; the last adds size, text_crc32, shard and slot.

Defined cases: extra columns pass through whatever their names, and where the last stage's names are taken, its
values take their place; null texts and texts of fewer than 20 words fail the quality rules; very long texts pass like others, whole; of repeated rows one
stays, and of near copies the one with the least id; null languages and sources form groups of their own; an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialize, table
from tidemark.llm.decontamination import clean_documents
from tidemark.llm.mixing import sample_mix
from tidemark.llm.nearcopies import drop_near_copies
from tidemark.llm.quality import quality_filter
from tidemark.llm.sharding import histogram_sort


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return sample_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    return histogram_sort(docs)


STAGES = [("quality rules", quality), ("near copies", near_copies), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Sketches, alignment and seeded choices aren't expressible in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
