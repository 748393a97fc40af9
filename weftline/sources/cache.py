"""Embedding cache: one row a (chunk_hash, model_id, params_hash). Parquet parts of data and of accesses in tiers; a commit lists the parts
that count, so readers see the state before or after a change and a writer that dies changes nothing.

A change adds a part of tier 0. When a tier has FAN parts, the commit that adds the last of them holds one part of the next tier in their
stead, so after n changes there are about FAN log(n) parts, and a row is written again once a tier. Accesses keep one row a key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BackendError
from ..tables import CommitLog, file_system, written

KEY = ["chunk_hash", "model_id", "params_hash"]
SCHEMA = "chunk_hash string, model_id string, params_hash string, dimensions int, vector array<float>, token_count long, created_at timestamp"
ACCESS = "chunk_hash string, model_id string, params_hash string, accessed_at timestamp"
VERSION, IMPORT_BYTES, LINE_BYTES, FAN = 2, 512 << 20, 4 << 20, 8
#: Keys that are looked up by broadcast at most.
KNOWN = 100_000


def stats(rows: DataFrame) -> DataFrame:
    """entries, chunks, models (model and parameters) and bytes (four a dimension)."""
    return rows.agg(F.count("*").alias("entries"), F.count_distinct("chunk_hash").alias("chunks"), F.count_distinct(F.concat_ws(":", "model_id", "params_hash")).alias("models"), F.coalesce(F.sum(F.col("dimensions").cast("long") * 4), F.lit(0)).alias("bytes"))


def lookup(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Every distinct key with its vector, null where it is missed."""
    return keys.select(*KEY).distinct().join(rows.select(*KEY, "vector", "token_count"), KEY, "left")


def prune_age(rows: DataFrame, cutoff) -> DataFrame:  # noqa: ANN001
    """What stays: accessed at or after the cutoff."""
    return rows.where(F.col("accessed_at") >= cutoff)


def prune_lru(rows: DataFrame, most: int) -> DataFrame:
    """What stays of the ``most`` latest accessed, ties by key; the eviction limit is the feature. The oldest are found by a bounded top-k."""
    overflow = max(0, rows.count() - most)
    if not overflow:
        return rows
    gone = rows.orderBy(F.col("accessed_at").asc(), *KEY).limit(overflow).select(*KEY)
    return rows.join(gone, KEY, "left_anti")


def invalid() -> Column:
    """Why a row (KEY, dimensions, vector, token_count) can't be cached, null if it can."""
    empty = F.lit(False)
    for k in KEY:
        empty = empty | F.col(k).isNull() | (F.col(k) == "")
    wrong = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(empty, "a key is empty").when(F.col("vector").isNull() | (F.size("vector") == 0) | (F.size("vector") != F.col("dimensions")), "the vector has another length").when(wrong, "the vector is not finite").when(F.coalesce(F.col("token_count") < 0, F.lit(True)), "the token count is negative")


class Cache:
    """The folder ``path`` with parts and commits."""

    def __init__(self, spark: SparkSession, path: str, readonly: bool = False) -> None:
        self.spark, self.path, self.readonly = spark, path.rstrip("/"), readonly
        self.log = CommitLog(spark, f"{self.path}/commits")

    def _state(self) -> dict:
        found = self.log.newest()
        state = found[1] if found else {"version": VERSION, "data": [], "access": []}
        if state.get("version") != VERSION:
            raise BackendError("the cache has another version")
        return state

    def _read(self, parts: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def _part(self, kind: str, rows: DataFrame, tier: int = 0) -> str:
        name = f"{kind}-{tier}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _tiered(self, kind: str, parts: list[str]) -> list[str]:
        """The parts, full tiers merged into one part of the next."""
        tier_of = lambda p: int(p.split("-")[1])
        tier = 0
        while tier <= max(map(tier_of, parts), default=-1):
            full = [p for p in parts if tier_of(p) == tier]
            if len(full) >= FAN:
                if kind == "data":
                    rows = self._read(full, SCHEMA).coalesce(max(1, self.spark.sparkContext.defaultParallelism))  # keys don't repeat over parts
                else:
                    rows = self._read(full, ACCESS).groupBy(*KEY).agg(F.max("accessed_at").alias("accessed_at"))
                parts = [*(p for p in parts if p not in full), self._part(kind, rows, tier + 1)]
            tier += 1
        return parts

    def _commit(self, change: Callable[[dict], dict | None]) -> None:
        if self.readonly:
            raise BackendError("the cache is read-only")
        self.log.update(lambda now: change(now or {"version": VERSION, "data": [], "access": []}))

    def rows(self, state: dict | None = None) -> DataFrame:
        state = state or self._state()
        touched = self._read(state["access"], ACCESS).groupBy(*KEY).agg(F.max("accessed_at").alias("accessed_at"))
        own = self._read(state["data"], SCHEMA).groupBy(*KEY).agg(F.min_by(F.struct("dimensions", "vector", "token_count", "created_at"), "created_at").alias("r"))
        return own.select(*KEY, "r.*").join(touched, KEY, "left").withColumn("accessed_at", F.greatest("created_at", F.coalesce("accessed_at", "created_at")))

    def contains(self, keys: DataFrame) -> DataFrame:
        """(KEY, hit) of the distinct keys; no access is noted."""
        held = self._read(self._state()["data"], SCHEMA).select(*KEY).distinct().withColumn("hit", F.lit(True))  # vectors stay where they lie
        return keys.select(*KEY).distinct().join(held, KEY, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def get(self, keys: DataFrame) -> DataFrame:
        """Looks keys up; on a writable cache hits count as accesses."""
        found = written(lookup(self.rows(), keys), "cache-hits")
        if not self.readonly:
            hits = found.where("vector is not null").select(*KEY, F.current_timestamp().alias("accessed_at"))
            self._touch(hits)
        return found

    def _touch(self, hits: DataFrame) -> None:
        if hits.limit(1).count():
            part = self._part("access", hits)
            self._commit(lambda now: now | {"access": self._tiered("access", [*now["access"], part])})

    def put(self, rows: DataFrame) -> None:
        """Adds rows (KEY, dimensions, vector, token_count), all or none. An invalid row is an error; so is a key with another value than the
        cached one or than its other row; with the same value it counts as an access."""
        given = written(rows.select(*KEY, F.col("dimensions").cast("int").alias("dimensions"), F.col("vector").cast("array<float>").alias("vector"), F.col("token_count").cast("long").alias("token_count")), "cache-put")
        if (why := given.select(invalid().alias("why")).where("why is not null").first()) is not None:
            raise BackendError(f"a row can't be cached: {why['why']}")
        value = F.struct("dimensions", "token_count", "vector")
        one = written(given.groupBy(*KEY).agg(F.min(value).alias("lo"), F.max(value).alias("hi")), "cache-one")

        def change(now: dict) -> dict | None:
            cached = self._read(now["data"], SCHEMA)
            known = written(cached.select(*KEY).join(one.select(*KEY), KEY, "left_semi").distinct(), "cache-known")  # keys alone; few, if any, move on
            few = F.broadcast(known) if known.limit(KNOWN + 1).count() <= KNOWN else known
            old = cached.join(few, KEY, "left_semi").groupBy(*KEY).agg(F.min(value).alias("old"))
            both = written(one.join(old, KEY, "left"), "cache-both")
            if both.where((F.col("lo") != F.col("hi")) | (F.col("old") != F.col("lo"))).limit(1).count():
                raise BackendError("a key has another value than the one that is cached, or two values")
            moment, new = F.current_timestamp(), {}
            for kind, rows in (("data", both.where("old is null").select(*KEY, "lo.dimensions", "lo.vector", "lo.token_count", moment.alias("created_at"))), ("access", both.where("old is not null").select(*KEY, moment.alias("accessed_at")))):
                if rows.limit(1).count():
                    new[kind] = self._tiered(kind, [*now[kind], self._part(kind, rows)])
            return now | new

        if given.limit(1).count():
            self._commit(change)

    def prune(self, keep: Callable[[DataFrame], DataFrame]) -> int:
        """Commits what ``keep`` keeps as the only part; the number of rows that went. Old parts stay until ``vacuum``."""
        went = 0

        def change(now: dict) -> dict | None:
            nonlocal went
            rows = written(self.rows(now), "cache-rows")
            kept = written(keep(rows), "cache-kept")
            went = rows.count() - kept.count()
            data, access = self._part("data", kept.select(*KEY, "dimensions", "vector", "token_count", "created_at")), self._part("access", kept.select(*KEY, "accessed_at"))
            return now | {"data": [data], "access": [access]} if went or len(now["data"]) > 1 else None

        self._commit(change)
        return went

    def vacuum(self) -> int:
        """Deletes parts that the newest commit doesn't list, for when no reader or writer is at work; their number."""
        state, (fs, p) = self._state(), file_system(self.spark, self.path)
        listed = {*state["data"], *state["access"]}
        gone = [s.getPath() for s in (fs.listStatus(p) if fs.exists(p) else ()) if s.isDirectory() and s.getPath().getName().startswith(("data-", "access-")) and s.getPath().getName() not in listed]
        for g in gone:
            fs.delete(g, True)
        return len(gone)

    def export_jsonl(self, path: str, force: bool = False) -> None:
        """JSON lines in key order, under a temporary name until they are complete; an existing target is an error or, by force, replaced."""
        (fs, target), (_, own) = file_system(self.spark, path), file_system(self.spark, self.path)
        if fs.exists(target) and not force:
            raise BackendError(f"{path} exists")
        if fs.makeQualified(target).toString().startswith(fs.makeQualified(own).toString()):
            raise BackendError("a cache isn't exported into itself")
        temp = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
        self.rows().orderBy(*KEY).write.json(temp)
        if fs.exists(target):
            fs.delete(target, True)
        fs.rename(file_system(self.spark, temp)[1], target)

    def import_jsonl(self, path: str, trusted: bool = False) -> None:
        """All rows of JSON lines or none: bounded sizes, known fields of the right types, valid values; times are set anew."""
        if not trusted:
            raise BackendError("vectors of others are imported only when they are trusted")
        fs, p = file_system(self.spark, path)
        if fs.getContentSummary(p).getLength() > IMPORT_BYTES:
            raise BackendError(f"more than {IMPORT_BYTES} bytes")
        lines = self.spark.read.text(path).where(F.trim("value") != "")
        if lines.where(F.octet_length("value") > LINE_BYTES).limit(1).count():
            raise BackendError(f"a line has more than {LINE_BYTES} bytes")
        kinds = "chunk_hash string, model_id string, params_hash string, vector array<double>, token_count long"
        known = F.array(*(F.lit(c) for c in (*KEY, "vector", "token_count", "dimensions", "created_at", "accessed_at")))
        rows = lines.select(F.from_json("value", kinds, {"mode": "PERMISSIVE"}).alias("r"), F.json_object_keys("value").alias("k"), F.schema_of_variant(F.try_parse_json("value")).alias("t"))
        wrong = F.col("k").isNull() | (F.size(F.array_except("k", known)) > 0) | ~F.col("t").rlike(r"token_count: BIGINT") | F.col("r.vector").isNull()
        if rows.where(wrong).limit(1).count():
            raise BackendError("a line is no object with the fields of a cached row")
        self.put(rows.select("r.*").withColumn("dimensions", F.size("vector")))
