"""Two-pass external shuffle into shards.

Pass one scatters records into buckets by a seeded hash of id and text, as many buckets as keep each near ``bucket_bytes``; pass two holds
one bucket at a time, puts it into a canonical order and Fisher-Yates shuffles it with a generator seeded by bucket. Buckets in order give
one random permutation of all rows; row ``i`` of it goes to shard ``i mod shards``, slot ``i div shards``: the counts of shards differ by
one at most and slots have no gaps (law ``rows``). The result depends on rows and seed only, not on partitions: the canonical order is that
of hashes, then of all columns. Buckets' sizes and starts are tables, not numbers of the driver.

Defined results: null text counts as empty and null ids as a value; repeated rows are placed each and scattered like others; an empty table
gives none. Groups of equal texts are spread like all other rows, as their ids differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import materialize, numbered, scratch_path, small, sortable

SHARDS, SEED, BUCKET_BYTES = 16, 20240607, 4 << 20
#: Rows alike in id and text that may share a bucket; leading bits of the hash that number tasks at most.
COPIES, MOST_TASKS = 256, 14


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def permutation(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """Fisher-Yates: a uniform permutation of 0..n-1."""
    order, rng = list(range(n)), np.random.Generator(np.random.PCG64(np.random.SeedSequence(seed)))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else (), strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _bits(octets: int, each: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, octets / each)))))


def shuffled(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, copies: int = COPIES) -> DataFrame:
    """All rows and columns, plus __bucket (long), shard (int) and slot (long), in shuffled order within buckets.

    Rows alike in id and text that number more than ``copies`` are counted through and hashed with their number, so they too are scattered.
    """
    clash = {"__bucket", "__hash", "shard", "slot"} & set(df.columns)
    if clash:
        df = df.withColumnsRenamed({c: f"{c}_in" for c in clash})
    key = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    hashes = materialize(df.select(key.alias("__hash"), size_of(F.col(text)).alias("size")).groupBy("__hash").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "shard-hashes")
    bits = _bits(hashes.agg(F.sum("size")).first()[0] or 0, bucket_bytes)
    hot = materialize(hashes.filter(F.col("n") > copies).select(F.col("__hash").alias("__hot")), "shard-hot")
    keyed, counted = df.withColumn("__hash", key), hashes.select("__hash", "n")
    if hot.limit(1).count():
        mine = F.col("__hash") == F.col("__hot")
        many = numbered(keyed.join(small(hot), mine, "left_semi"), ["__hash"], sortable(df))
        many = materialize(many.withColumn("__hash", F.xxhash64("__hash", "__row")).drop("__row"), "shard-copies")
        keyed = keyed.join(small(hot), mine, "left_anti").unionByName(many)
        counted = counted.filter(F.col("n") <= copies).unionByName(many.groupBy("__hash").agg(F.count("*").alias("n")))
    bucket = (lambda h: F.shiftrightunsigned(h, 64 - bits)) if bits else (lambda h: F.lit(0).cast("long"))
    # A task takes the buckets of a range of hashes, so tasks stay few however many buckets there are; sorting keeps buckets apart.
    wide = min(bits, MOST_TASKS, max(_bits(1 << bits, (16 << 20) // min(16 << 20, bucket_bytes)), _bits(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)))
    part = lambda b: F.shiftrightunsigned(b, bits - wide).cast("int")
    sizes = materialize(counted.groupBy(bucket(F.col("__hash")).alias("__bucket")).agg(F.sum("n").alias("n")).withColumn("p", part(F.col("__bucket"))), "shard-buckets")
    above = sizes.groupBy("p").agg(F.sum("n").alias("n")).select(F.col("p").alias("pp"), (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("up"))  # a row a task
    inside = F.sum("n").over(Window.partitionBy("p").orderBy("__bucket")) - F.col("n")
    starts = sizes.withColumn("inside", inside).join(F.broadcast(above), F.col("p") == F.col("pp")).select("__bucket", (F.col("up") + F.col("inside")).alias("__start"))
    rows = keyed.withColumn("__bucket", bucket(F.col("__hash"))).withColumn("__start", F.lit(None).cast("long"))
    every = starts.unionByName(rows, allowMissingColumns=True).select(*df.columns, "__bucket", "__start", "__hash")
    out = StructType([*df.schema.fields, StructField("__bucket", LongType()), StructField("shard", IntegerType()), StructField("slot", LongType())])

    def deal(table: pa.Table) -> pa.Table:
        """A bucket: the row that says where it starts, then its rows in their canonical order."""
        at, start = table.column("__bucket")[0].as_py(), table.column("__start")[0].as_py()
        table = table.slice(1).drop_columns(["__hash", "__start"])
        table = table.take(pa.array(permutation(table.num_rows, (seed, at))))
        index = start + np.arange(table.num_rows, dtype=np.int64)
        return table.append_column("shard", pa.array((index % shards).astype(np.int32))).append_column("slot", pa.array(index // shards))

    def run(batches):  # noqa: ANN001, ANN202
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("__bucket")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column("__bucket")[0].as_py() != ids[lo]:
                    yield from deal(pa.Table.from_batches(held)).to_batches(2000)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from deal(pa.Table.from_batches(held)).to_batches(2000)

    ordered = every.repartitionById(1 << wide, part(F.col("__bucket"))).sortWithinPartitions("__bucket", F.col("__start").desc_nulls_last(), "__hash", *sortable(df))
    return ordered.mapInArrow(run, out)


def write_shards(df: DataFrame, path: str | None = None, **options) -> str:  # noqa: ANN003
    """Writes the shuffled rows as Parquet under ``path`` (or a new one in the shared folder), one folder a shard; Spark's committer publishes them whole or not at all."""
    path = path or scratch_path(df.sparkSession, "shards")
    shuffled(df, **options).write.partitionBy("shard").parquet(path)
    return path


def digest(df: DataFrame) -> DataFrame:
    """The columns of query op9."""
    t = F.col("text")
    return shuffled(df.select("doc_id", "text")).select("doc_id", size_of(t).alias("size"), F.crc32(F.coalesce(t, F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
