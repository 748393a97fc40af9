"""Manifests: what a generation is to hold, one JSON object a document (a line) under one header of the corpus.

Objects have sorted keys and no spaces; a document declares the Merkle root of its chunk hashes, which is computed anew when it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import wire
from ..errors import VerificationError
from ..operators import merkle

SCHEMA_VERSION = 1
IDENTITY = ("chunker_id", "chunker_params_hash", "normalizer_version")
RECORD = ("chunk_hash", "start_offset", "end_offset", "token_count", "metadata")
DOCUMENT = ("document_id", "root_hash", "chunk_count", "hard_cuts", "metadata", *IDENTITY)
_READ = "chunker_id string, chunker_params_hash string, chunks array<struct<chunk_hash:string,end_offset:bigint,metadata:variant,start_offset:bigint,token_count:bigint>>, document_id string, metadata variant, normalizer_version string, root_hash string, schema_version int"


def canonical(text: Column) -> Column:
    """A JSON text with sorted keys and no spaces; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def hard_cut(metadata: Column) -> Column:
    """Whether a chunk's metadata say that it was cut hard."""
    value = lambda k: F.get_json_object(metadata, f"$.{k}")
    truthy = F.coalesce(~value("hard_cut").isin("false", "0", "", "[]", "{}", "null"), F.lit(False))
    return truthy | F.coalesce(value("boundary_reason").isin(*wire.HARD_REASONS), F.lit(False)) | F.coalesce(value("boundary_kind") == "hard", F.lit(False))


def with_identity(target: DataFrame) -> DataFrame:
    """The target with all columns of an identity, empty where it has none."""
    return target.withColumns({c: F.lit("") for c in IDENTITY if c not in target.columns})


def documents(target: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(DOCUMENT) of occurrences, and of the documents without chunks in ``every`` (document_id, metadata); a document whose chunks were
    made by different chunkers is an error."""
    target = with_identity(target)
    identity = F.struct(*IDENTITY)
    facts = target.groupBy("document_id").agg(F.count_if(hard_cut(F.col("metadata"))).cast("int").alias("hard_cuts"), F.max(canonical(F.col("document_metadata"))).alias("metadata"), F.min(identity).alias("lo"), F.max(identity).alias("hi"))
    checked = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.concat(F.lit("chunks of different chunkers in "), "document_id"))).otherwise(F.col("document_id"))
    out = merkle.document_roots(target).join(facts, "document_id")
    out = out.select(checked.alias("document_id"), "root_hash", F.col("chunk_count").cast("int").alias("chunk_count"), "hard_cuts", "metadata", *(F.col(f"lo.{c}").alias(c) for c in IDENTITY))
    if every is None:
        return out
    bare = every.join(out.select("document_id"), "document_id", "left_anti")
    return out.unionByName(bare.select("document_id", F.lit(merkle.EMPTY).alias("root_hash"), F.lit(0).alias("chunk_count"), F.lit(0).alias("hard_cuts"), canonical(F.col("metadata")).alias("metadata"), *(F.lit("").alias(c) for c in IDENTITY)))


def to_json(docs: DataFrame, chunks: DataFrame, by: Column | None = None) -> DataFrame:
    """(document_id, json) from (DOCUMENT) and (document_id, position, RECORD). With ``by``, a named column of document ids, rows of one value
    lie together, and the value comes first; documents and their chunks meet in one shuffle."""
    packed, facts = F.struct("position", "chunk_hash", "end_offset", "metadata", "start_offset", "token_count"), F.struct("root_hash", "metadata", *IDENTITY)
    own = chunks.select("document_id", packed.alias("p")).unionByName(docs.select("document_id", facts.alias("d")), True)
    key = ["document_id"]
    if by is not None:
        own = own.select(by, "*")
        key = [own.columns[0], "document_id"]
        own = own.repartition(key[0])
    both = own.groupBy(*key).agg(F.array_sort(F.collect_list("p")).alias("ps"), F.max("d").alias("d")).where("d is not null").select(*key, "ps", "d.*")
    # Variants have no order, so rows are sorted first and parsed then.
    records = F.transform("ps", lambda p: F.struct(p["chunk_hash"].alias("chunk_hash"), p["end_offset"].alias("end_offset"), F.try_parse_json(p["metadata"]).alias("metadata"), p["start_offset"].alias("start_offset"), p["token_count"].alias("token_count")))
    whole = F.struct("chunker_id", "chunker_params_hash", records.alias("chunks"), "document_id", F.try_parse_json("metadata").alias("metadata"), "normalizer_version", "root_hash", F.lit(SCHEMA_VERSION).alias("schema_version"))
    return both.select(*key, F.to_json(whole).alias("json"))


def from_json(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(DOCUMENT), (document_id, position, RECORD) and (document_id, problem) of JSON lines (column value)."""
    read = lines.select(F.from_json("value", _READ, {"mode": "PERMISSIVE"}).alias("m"))
    bad = F.when(F.col("m.document_id").isNull() | (F.col("m.document_id") == "") | F.col("m.chunks").isNull(), "manifest is invalid").when(~F.col("m.schema_version").eqNullSafe(SCHEMA_VERSION), "manifest is invalid: another schema version")
    marked = read.withColumn("bad", bad)
    m = marked.where("bad is null").select("m.*")
    rows = m.select("document_id", F.posexplode("chunks").alias("position", "c"))
    text = lambda c: F.to_json(c)
    chunks = rows.select("document_id", "position", "c.chunk_hash", "c.start_offset", "c.end_offset", "c.token_count", text(F.col("c.metadata")).alias("metadata"))
    cuts = chunks.groupBy("document_id").agg(F.count_if(hard_cut(F.col("metadata"))).cast("int").alias("hard_cuts"))
    docs = m.join(cuts, "document_id", "left").select("document_id", "root_hash", F.size("chunks").alias("chunk_count"), F.coalesce("hard_cuts", F.lit(0)).alias("hard_cuts"), text(F.col("metadata")).alias("metadata"), *IDENTITY)
    real = merkle.document_roots(chunks).select("document_id", F.col("root_hash").alias("real"))
    wrong = docs.join(real, "document_id", "left").where(F.col("root_hash").isNotNull() & ~F.col("root_hash").eqNullSafe(F.coalesce("real", F.lit(merkle.EMPTY))))
    problems = marked.where("bad is not null").select("m.document_id", F.col("bad").alias("problem")).unionByName(wrong.select("document_id", F.lit("manifest is invalid: root hash is not that of its chunks").alias("problem")))
    return docs, chunks, problems


def read_strict(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``from_json``, but any problem is an error."""
    docs, chunks, problems = from_json(lines)
    if (first := problems.first()) is not None:
        raise VerificationError(f"{first['document_id']}: {first['problem']}")
    return docs, chunks


def with_documents(lines: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, json): those of ``new`` replace or join the others."""
    return lines.join(new.select("document_id"), "document_id", "left_anti").unionByName(new)


def without_documents(lines: DataFrame, ids: DataFrame) -> DataFrame:
    return lines.join(ids.select("document_id"), "document_id", "left_anti")
