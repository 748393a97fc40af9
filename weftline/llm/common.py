"""What the operators of this subpackage share: tables, words, and written intermediate results."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import discard
from ..tables import scratch as scratch_path
from ..tables import spread
from ..tables import written as materialize

__all__ = ["BROADCAST_ROWS", "SPACE", "discard", "fresh", "materialize", "met", "numbered", "row_key", "scratch_path", "slices", "small", "sortable", "table", "words"]

#: ASCII white space as a Java and RE2 character class; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
#: Size in rows up to which a side may be broadcast after it was counted (some MB at most).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts a table that has at most ``rows`` rows (counted); leaves any other to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def met(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows with the facts of their key, from one row (keys, n, ...) a key, n its number of rows: all by broadcast if keys are few, else those
    of at least one in ``most`` rows, which are at most ``most`` keys, so no key's rows are brought to one task. how: inner or left."""
    facts = materialize(facts, "facts")
    if facts.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(facts.drop("n")), keys, how)
    hot = F.broadcast(facts.filter(F.col("n") >= facts.agg(F.sum("n")).first()[0] / most).drop("n"))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(facts.drop("n"), keys, how))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def row_key(*values: Column) -> list[Column]:
    """Two 64-bit hashes, k1 and k2, that name a row by values of it, nulls told apart from empty ones."""
    told = [x for v in values for x in (v, v.isNull())]
    return [F.xxhash64(*told).alias("k1"), F.xxhash64(F.lit("second"), *told).alias("k2")]


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def slices(batches: Iterable[pa.RecordBatch], text: int, octets: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``octets`` of their column number ``text`` (a longer text is a piece by itself)."""
    for b in batches:
        held = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + octets, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def sortable(df: DataFrame) -> list[Column]:
    """All columns in a form that has an order (maps have none of their own)."""
    return [F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "__row") -> DataFrame:
    """Adds ``name``, the number of a row in its group, without bringing a group to one task: by range, then by counts before it. Rows
    alike in keys and order are spread over ranges too."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.withColumn("__tied", F.monotonically_increasing_id())
    ranged = marked.repartitionByRange(parts, *(F.col(k).asc_nulls_first() for k in keys), *order, "__tied")
    own = materialize(ranged.withColumn("__part", F.spark_partition_id()), "numbered")
    counts = own.groupBy(*keys, "__part").agg(F.count("*").alias("n"))  # a row a partition and group
    before = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__p"), (F.sum("n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("n")).alias("__before")).filter("__before > 0")
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    got = own.join(small(materialize(before, "numbered-before")), same, "left")
    at = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order, "__tied"))
    return got.withColumn(name, F.coalesce("__before", F.lit(0)) + at - 1).drop("__part", "__p", "__before", "__tied", *(f"__{k}" for k in keys))
