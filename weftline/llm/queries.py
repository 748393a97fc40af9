"""The queries of this subpackage, one an operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, lattice_lm, mixing, prefix_trie, quality, sharding, simhash, spelling, suffix_dedup, token_counts, url_filter, warc
from .common import materialize, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = chat.raw(table(spark, sf_dir, "conversations"))
    model = chat.train(transcripts.filter(~chat.held_out()))
    return chat.parse(transcripts.drop("role"), model)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("stratum"), "text")
    features = materialize(quality.with_features(docs).drop("text"), "quality-features")
    cutoffs = materialize(quality.judged(features, table(spark, sf_dir, "labels"), stratum="stratum"), "quality-cutoffs")
    return quality.with_verdict(features, cutoffs, stratum="stratum").select("doc_id", *quality.FEATURES, "base_failed", "kept", "stratum", "n_good", "step")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scored(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = materialize(token_counts.trees(table(spark, sf_dir, "documents")), "token-trees", compression="zstd")
    return token_counts.recount(state.withColumn("edits", token_counts.sample_edits()))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").filter(url_filter.listed_label(F.col("url")))
    return url_filter.filter_urls(pages, listed).drop("maybe_listed")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(table(spark, sf_dir, "conversations"))))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_format, op2_quality_rules, op3_simhash, op4_lattice_lm, op5_token_counts, op6_warc, op7_url_filter, op8_mixing, op9_sharding, op10_decontamination, op11_suffix_dedup, op12_prefix_trie, op13_spelling)}
SQL = {"op2_quality_rules": quality.sql(), "op6_warc": warc.SQL, "op7_url_filter": url_filter.sql(), "op11_suffix_dedup": suffix_dedup.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_spelling": spelling.SQL}
