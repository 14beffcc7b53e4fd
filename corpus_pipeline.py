"""From raw documents to training shards: five operators in a row.

Every stage takes the documents that the one before kept, and its decisions take
effect: rows go, or are repeated, and the last stage places each remaining row
in a shard.  Stages are written to the shared folder and read again, so a lost
executor repeats part of one stage at most.

Defined results: null and empty texts fail the quality rules; rows with one id are
told apart by their text; of near-duplicates the smallest id stays, and rows
without an id are no duplicates; without benchmark items nothing is
contaminated; an empty table gives an empty result with all columns; other columns of the documents, whatever their names, are
carried to the end, where the shard's own columns come last and go before those of
the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from satspan.llm import (
    hilbert_sharding,
    latent_decontamination,
    quality_rules,
    setsketch_dedup,
    source_mixing,
)
from satspan.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return setsketch_dedup.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return latent_decontamination.keep(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated until sources have their weights."""
    return source_mixing.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row, whole, gets its shard and its slot there."""
    return hilbert_sharding.plan(docs, carry=True)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


#: Sketches, singular vectors and subsequences have no SQL form.
ORACLE_SQL = None
