"""The corpus pipeline: quality rules, near-duplicate join, decontamination, mixing and sharding over `documents`.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; run() writes each stage's
result as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloudloom.llm.common import staged, table
from cloudloom.llm.decontaminate import decontaminate
from cloudloom.llm.jaccard_join import one_of_each
from cloudloom.llm.mixing import mix
from cloudloom.llm.quality import clean_lines
from cloudloom.llm.sharding import described, with_shards

SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that are rejected."""
    return clean_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of any benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of the mix."""
    return with_shards(staged(described(docs), "shard-rows"), SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: The line rules, the chosen paths and the k-d splits are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
