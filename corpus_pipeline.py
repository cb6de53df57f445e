"""A training-data pipeline: quality rules, near-dedup, benchmark decontamination, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Stage by stage: rejected documents go; one document of each near-duplicate group stays;
benchmark passages are cut out of the texts; rows are repeated or left out to meet the source weights;
the rows are stored as compacted shards and each row's shard is returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evencut.functions.loop import settle
from evencut.llm import decontamination, mixing, quality_rules, sharding, simhash
from evencut.llm.common import new_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.cleaned_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.store_and_locate(spark, docs, new_path(spark, "shards"))


STAGES = [
    ("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("source mix", mix_sources), ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; each stage's output is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SimHash groups, distances of robust estimates and files have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None
