"""Plans: which chunk occurrences are kept, moved, added or deleted, and what embedding the rest costs.

Occurrences are rows (document_id, position, chunk_hash, start_offset, end_offset, token_count, metadata, document_metadata).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("keep", "move", "add", "delete")
_COLUMNS = ("position", "start_offset", "end_offset", "token_count", "metadata", "document_metadata")


def _side(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    return df.withColumn("nth", nth).withColumnsRenamed({c: f"{p}_{c}" for c in _COLUMNS if c not in keys})


def _folded(df: DataFrame, name: str) -> DataFrame:
    """A document's rows, whatever their order, as their number and two sums of hashes."""
    kinds = {"position": "int", "start_offset": "long", "end_offset": "long", "token_count": "long"}
    what = [F.col(c).cast(kinds.get(c, "string")) for c in ("chunk_hash", *_COLUMNS)]
    sums = [F.sum(F.xxhash64(*more, *what, *(c.isNull() for c in what)).cast("decimal(38,0)")) for more in ([], [F.lit(1)])]
    return df.groupBy("document_id").agg(F.struct(F.count("*").alias("n"), *(x.alias(f"s{k}") for k, x in enumerate(sums))).alias(name))


def changed_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id) of documents that are not in both with equal occurrences: one aggregate a side, and a join of a row a document."""
    both = _folded(old, "a").join(_folded(new, "b"), "document_id", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("document_id")


def occurrence_diff(old: DataFrame, new: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """One row an operation: kind, document_id, chunk_hash and the old_ and new_ columns. Equal occurrences pair first in first out: by
    hash and offsets, what is left by hash alone (moves); exact pairs whose count or metadata changed are moves too. Rows of documents that
    are equal in both (all but ``changed``) are kept where they lie; only the others are matched."""
    changed = changed_documents(old, new) if changed is None else changed
    same = new.join(changed, "document_id", "left_anti")
    both = lambda c: [F.col(c).alias(f"old_{c}"), F.col(c).alias(f"new_{c}")]
    kept = same.select(F.lit("keep").alias("kind"), "document_id", "chunk_hash", *(x for c in ("position", "start_offset", "end_offset", "token_count") for x in both(c)))
    mine = lambda df: df.join(changed, "document_id", "left_semi")
    return _matched(mine(old), mine(new)).unionByName(kept)


def _matched(old: DataFrame, new: DataFrame) -> DataFrame:
    exact = ["document_id", "chunk_hash", "start_offset", "end_offset"]
    a = _side(old, "old", exact).withColumnsRenamed({"document_metadata": "old_document_metadata"})
    first = a.join(_side(new, "new", exact), [*exact, "nth"], "full")
    paired = F.col("old_position").isNotNull() & F.col("new_position").isNotNull()
    same = F.lit(True)
    for c in ("token_count", "metadata", "document_metadata"):
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    offsets = [F.col(c).alias(f"{p}_{c}") for p in ("old", "new") for c in ("start_offset", "end_offset")]
    tail = ["document_id", "chunk_hash", "old_position", "new_position", "old_start_offset", "old_end_offset", "new_start_offset", "new_end_offset", "old_token_count", "new_token_count"]
    matched = first.where(paired).select("*", *offsets).select(F.when(same, "keep").otherwise("move").alias("kind"), *tail)
    keys = ["document_id", "chunk_hash"]

    def rest(p: str, other: str) -> DataFrame:
        left = first.where(F.col(f"{other}_position").isNull())
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(f"{p}_position"))
        return left.select(*keys, f"{p}_position", F.col("start_offset").alias(f"{p}_start_offset"), F.col("end_offset").alias(f"{p}_end_offset"), f"{p}_token_count", nth.alias("nth"))

    second = rest("old", "new").join(rest("new", "old"), [*keys, "nth"], "full")
    kind = F.when(paired, "move").when(F.col("old_position").isNull(), "add").otherwise("delete")
    return matched.unionByName(second.select(kind.alias("kind"), *tail))


def plan_order() -> list[Column]:
    """Kinds in their order, then new and old positions, then hashes; absent positions last."""
    return [F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")), F.col("new_position").asc_nulls_last(), F.col("old_position").asc_nulls_last(), F.col("chunk_hash")]


def op_counts(ops: DataFrame) -> DataFrame:
    """(kind, n) for all four kinds."""
    return ops.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS)).select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in KINDS))))


def plan_cost(old: DataFrame, new: DataFrame, ops: DataFrame, cached: DataFrame | None = None, price_per_million: float | None = None, embed_all: bool = False) -> DataFrame:
    """One row: cache_hits, chunks_to_embed, tokens_to_embed, estimated_cost, naive_* (all chunks of changed documents) and
    avoided_embeddings. ``cached`` holds chunk_hash; a chunk is paid once however often it occurs; no price, no cost (null)."""
    if embed_all:
        wanted = new.select("chunk_hash", "token_count", "document_id", "position")
    else:
        adds = ops.where("kind = 'add'").select("chunk_hash", F.col("new_token_count").alias("token_count"), "document_id", F.col("new_position").alias("position"))
        wanted = adds.join(old.select("chunk_hash").distinct(), "chunk_hash", "left_anti")
    unique = wanted.groupBy("chunk_hash").agg(F.min_by("token_count", F.struct("document_id", "position")).alias("token_count"))
    if cached is None:
        unique = unique.withColumn("hit", F.lit(False))
    else:
        unique = unique.join(cached.select("chunk_hash").distinct().withColumn("hit", F.lit(True)), "chunk_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    cost = unique.agg(F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("chunks_to_embed"), F.coalesce(F.sum(F.when(~F.col("hit"), F.col("token_count"))), F.lit(0)).alias("tokens_to_embed"))
    naive = new if embed_all else new.join(ops.where("kind <> 'keep'").select("document_id").distinct(), "document_id", "left_semi")
    naive = naive.agg(F.count("*").alias("naive_chunks_to_embed"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("naive_tokens_to_embed"))
    rate = F.lit(None if price_per_million is None else price_per_million / 1e6).cast("double")
    both = cost.crossJoin(F.broadcast(naive))  # one row each
    return both.withColumns({"estimated_cost": F.col("tokens_to_embed") * rate, "naive_estimated_cost": F.col("naive_tokens_to_embed") * rate, "avoided_embeddings": F.greatest(F.col("naive_chunks_to_embed") - F.col("chunks_to_embed"), F.lit(0).cast("long"))})


def requires_apply(old: DataFrame | None, new: DataFrame, embed_all: bool = False) -> bool:
    """Whether anything differs, metadata included."""
    if embed_all or old is None:
        return True
    return bool(changed_documents(old, new).limit(1).count())
