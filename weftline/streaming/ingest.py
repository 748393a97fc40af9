"""Continuous indexing: new files of a folder join the index, a generation a micro-batch (an extension; batch runs need none of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, embedding
from ..plans import manifest
from ..plans.index import Index, occurrences
from ..sources.files import relative_id, unique_ids
from ..tables import written


def follow(spark: SparkSession, folder: str, index: Index, chunker: chunking.Chunker, provider: embedding.Provider, checkpoint: str) -> StreamingQuery:
    """Each batch replaces the documents it holds, named by their path below the folder, and keeps the others: it writes the texts and vectors
    of new chunks and narrow rows only. A batch that is repeated after a crash changes nothing; one that holds an id twice is an error."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # the metadata hold it as a URI
    docs = files.select(relative_id(spark, path, folder).alias("document_id"), F.col("value").alias("text"))

    def batch(new: DataFrame, _number: int) -> None:
        new = written(unique_ids(new), "stream")
        fresh = occurrences(chunking.chunk_documents(new, chunker)).select(*_COLUMNS)
        now = index.newest()
        kept = index.documents(now).join(new.select("document_id"), "document_id", "left_anti")
        old = index.active(now).join(kept.select("document_id", *manifest.IDENTITY), "document_id").select(*_COLUMNS)
        every = kept.select("document_id", "metadata").unionByName(new.select("document_id", F.lit("{}").alias("metadata")))
        index.apply(old.unionByName(fresh), provider, documents=every)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_COLUMNS = ("document_id", "position", "chunk_hash", "text", "start_offset", "end_offset", "token_count", "metadata", "document_metadata", *manifest.IDENTITY)
