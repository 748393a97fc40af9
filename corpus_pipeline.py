"""Documents in, shuffled training shards out: five stages, each over all that the one before kept.

In every stage null and empty texts are texts without words, null ids and sources are values of their own, rows of one id are told apart by
their texts, an empty table gives an empty table, and further columns pass through, those named like a result under another name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontam, mixing, quality, sharding, simhash
from weftline.llm.common import discard, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, their cutoffs certified on the labels; each repeated row is judged, ties don't arise."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id (a null id only where there is no other; of rows that share the
    smallest id the first in the order of all columns)."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows alike in id and text go or stay together."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; repeated rows count each, ties of hashes are cut in the order of all columns."""
    return mixing.take(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shuffled order with shard and slot; repeated rows are placed each."""
    return sharding.shuffled(docs).drop("__bucket")


STAGES = [("quality", quality_stage), ("dedup", dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("sharding", sharding_stage)]

#: Hidden hashes, knapsacks and shuffles are not SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
            discard(*([before] if k else []))  # what the stage read of the one before, and shuffles that are done
    return docs
