"""The index: immutable generations of chunk rows behind commits.

``bodies/<id>`` hold texts and vectors, one row a chunk hash and model, each file in order of hashes, and are only ever added to. Narrow rows
(``chunks``, tombstones among them), ``documents`` and the manifest (JSON lines of what a generation is to hold, in two copies) lie in
buckets of document ids: ``rows/<id>/<table>/bucket=<k>``. ``commits/<n>.json`` says for every bucket which part holds it. An edit writes the
bodies of new chunks and the buckets of changed documents, so what it writes grows with the edit, and never copies a text or vector.
Readers take the newest commit, so they see one generation, and may hold it by a lease; writers take turns (``leases``). ``vacuum`` deletes
what neither the newest generations nor a lease needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import wire
from ..errors import BackendError
from ..functions.hashing import hash_fields_column, instance_id_column
from ..operators import diff, embedding, merkle
from ..tables import CommitLog, Store, discard, file_system, release, written
from . import manifest
from .leases import READ_SECONDS, Leases

CHUNKS = "instance_id string, document_id string, position int, chunk_hash string, start_offset long, end_offset long, token_count long, metadata string, document_metadata string, model_id string, params_hash string, record_digest string, valid_from timestamp, valid_to timestamp"
BODIES = "chunk_hash string, text string, vector array<float>"
DOCUMENTS = "document_id string, root_hash string, chunk_count int, hard_cuts int, metadata string, chunker_id string, chunker_params_hash string, normalizer_version string"
SCHEMA_VERSION, BUCKET_ROWS, RETAINED = 4, 1 << 20, 2
#: How many hashes of earlier bodies that changed rows need are broadcast; for more, all of these bodies are moved.
FEW = 200_000
_TABLES = {"chunks": CHUNKS, "documents": DOCUMENTS}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _cast(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in schema.split(", "))))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written and read back; hashes in hexadecimal are half as large in this compression."""
    return written(df, name, "zstd")


@dataclass(frozen=True)
class Commit:
    generation: int
    corpus_root: str
    model_id: str
    params_hash: str
    dimensions: int
    bodies: tuple[str, ...] = ()
    buckets: int = 1
    tables: dict[str, dict[str, list[int]]] = field(default_factory=dict)  # table to part to the buckets that it holds
    fence: int = 0
    schema_version: int = SCHEMA_VERSION

    def parts(self) -> set[str]:
        return {p for held in self.tables.values() for p in held} | set(self.bodies)


class IndexAdapter(Protocol):
    """What a project needs of an index, whatever stores it."""

    def newest(self) -> Commit | None: ...

    def status(self) -> DataFrame: ...

    def active(self, commit: Commit | None = None) -> DataFrame: ...

    def apply(self, target: DataFrame, provider: embedding.Provider, cache=None) -> Commit: ...  # noqa: ANN001

    def query(self, text: str, provider: embedding.Provider, k: int = 5) -> DataFrame: ...

    def verify(self, expected: DataFrame | None = None) -> DataFrame: ...

    def compact(self, before=None, dry_run: bool = False) -> int: ...  # noqa: ANN001


def carried_ids(ops: DataFrame, active: DataFrame, corpus_root: str, scope: str) -> DataFrame:
    """Instance ids of the new occurrences: kept and moved ones keep theirs, added ones get a repeatable new one."""
    old = active.select("document_id", F.col("position").alias("old_position"), "chunk_hash", "instance_id")
    now = ops.where("kind <> 'delete'").join(old, ["document_id", "old_position", "chunk_hash"], "left")
    fresh = instance_id_column(F.lit(scope), F.lit(corpus_root), F.col("document_id"), F.col("new_position"), F.col("chunk_hash"))
    return now.select("document_id", F.col("new_position").alias("position"), "chunk_hash", F.coalesce("instance_id", fresh).alias("instance_id"), F.col("instance_id").isNotNull().alias("carried"))


def record_digest() -> Column:
    """The digest of a row with its body: every field of a record that lasts, the vector as bytes."""
    text = [F.col(c).cast("string") for c in ("instance_id", "document_id", "position", "chunk_hash", "text", "start_offset", "end_offset", "token_count")]
    return hash_fields_column(wire.INDEX_RECORD_DOMAIN, *text, embedding.vector_bytes("vector"), F.size("vector").cast("string"), F.col("model_id"), F.col("params_hash"), F.col("metadata"))


def status(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """document_count, active_chunks, tombstones, hard_cuts, boundaries and hard_cut_rate."""
    a = chunks.agg(F.count_if(F.col("valid_to").isNull()).alias("active_chunks"), F.count_if(F.col("valid_to").isNotNull()).alias("tombstones"))
    d = documents.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("hard_cuts"), F.lit(0)).alias("hard_cuts"), F.coalesce(F.sum(F.greatest(F.col("chunk_count") - 1, F.lit(0))), F.lit(0)).alias("boundaries"))
    return a.crossJoin(F.broadcast(d)).withColumn("hard_cut_rate", F.when(F.col("boundaries") > 0, F.col("hard_cuts") / F.col("boundaries")).otherwise(0.0))  # one row each


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _first_to_last(key: list[str], checks: list[tuple[Column, str]], df: DataFrame) -> DataFrame:
    """A row for each check that holds."""
    found = F.filter(F.array(*(F.when(c, F.lit(what)) for c, what in checks)), lambda x: x.isNotNull())
    return df.select(*key, F.explode(found).alias("problem"))


def document_problems(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(document_id, problem) between documents of a manifest and those of the index (root_hash, chunk_count, hard_cuts, metadata)."""
    values = ["root_hash", "chunk_count", "hard_cuts", "metadata"]
    both = expected.select("document_id", F.struct(*values).alias("exp")).join(actual.select("document_id", F.struct(*values).alias("act")), "document_id", "full")
    there = F.col("exp").isNotNull() & F.col("act").isNotNull()
    sane = manifest.canonical(F.col("act.metadata"))
    checks = [(F.col("act").isNull(), "document not indexed"), (F.col("exp").isNull(), "document not in the manifest"), (there & _differs(F.col("exp.root_hash"), F.col("act.root_hash")), "other root hash"), (there & _differs(F.col("exp.chunk_count"), F.col("act.chunk_count")), "other number of chunks")]
    checks += [(there & _differs(F.col("exp.hard_cuts"), F.col("act.hard_cuts")), "other number of hard cuts"), (there & sane.isNull(), "document metadata unreadable"), (there & sane.isNotNull() & _differs(manifest.canonical(F.col("exp.metadata")), sane), "other document metadata")]
    return _first_to_last(["document_id"], checks, both)


def problems(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(document_id, position, problem) between a manifest and active rows (document_id, position, chunk_hash, start_offset, end_offset, token_count)."""
    key, values = ["document_id", "position"], ["chunk_hash", "start_offset", "end_offset", "token_count"]
    one = actual.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct(*values)).alias("act"))
    both = expected.select(*key, F.struct(*values).alias("exp")).join(one, key, "full")
    there = F.col("exp").isNotNull() & F.col("act").isNotNull()
    checks = [(F.col("act").isNull(), "position not indexed"), (F.col("exp").isNull(), "position not in the manifest"), *((there & _differs(F.col(f"act.{v}"), F.col(f"exp.{v}")), f"other {v}") for v in values), (F.col("n") > 1, "position held twice")]
    return _first_to_last(key, checks, both)


def content_problems(expected: DataFrame, actual: DataFrame, model_id: str, params_hash: str, dimensions: int) -> DataFrame:
    """(document_id, position, problem) of what rows carry: ``actual`` are active rows with text and vector, ``expected`` the manifest's
    rows with metadata and the identity of their document's chunker."""
    key = ["document_id", "position"]
    e = _exp(expected)
    return _content_problems(actual.join(e, key), model_id, params_hash, dimensions)


def _content_problems(both: DataFrame, model_id: str, params_hash: str, dimensions: int) -> DataFrame:
    key = ["document_id", "position"]
    parsed, named = F.try_parse_json("metadata"), lambda k: F.get_json_object("metadata", f"$.{k}")
    invalid = parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed), F.lit("")).startswith("OBJECT")
    complete = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"exp.{c}") != "", F.lit(False)) for c in manifest.IDENTITY))
    real = hash_fields_column(wire.CHUNK_DOMAIN, F.lit(wire.IDENTITY_SCHEMA), F.col("exp.normalizer_version"), F.col("exp.chunker_id"), F.col("exp.chunker_params_hash"), F.coalesce("text", F.lit("")))
    broken = F.col("vector").isNull() | (F.size("vector") == 0) | F.exists(F.coalesce("vector", F.array()), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reserved = ("chunk_hash", "start_offset", "end_offset", "token_count")
    checks = [(_differs(F.col("model_id"), F.lit(model_id)) | _differs(F.col("params_hash"), F.lit(params_hash)), "embedded by another model"), (invalid, "metadata unreadable")]
    checks += [(~invalid & named(k).isNotNull() & _differs(named(k), F.col(f"exp.{k}").cast("string")), f"other {k} in metadata") for k in reserved]
    user = lambda text: F.to_json(F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: ~k.isin(*reserved)))
    checks += [(~invalid & _differs(user(manifest.canonical(F.col("metadata"))), user(manifest.canonical(F.col("exp.metadata")))), "other metadata"), (complete & _differs(real, F.col("exp.chunk_hash")), "hash is not that of the text"), (~complete, "chunker not named")]
    checks += [(broken, "vector unusable"), (~broken & (F.size("vector") != dimensions), "vector of other length"), (~broken & _differs(F.col("record_digest"), F.col("__digest")), "other record digest")]
    return _first_to_last(key, checks, both.withColumn("__digest", record_digest()))


def _exp(expected: DataFrame) -> DataFrame:
    return expected.select("document_id", "position", F.struct("chunk_hash", "start_offset", "end_offset", "token_count", "metadata", *manifest.IDENTITY).alias("exp"))


def checked_rows(rows: DataFrame, dead: DataFrame) -> None:
    """Raises if rows to be published repeat an id or a position, or if an id was a tombstone's; one job over narrow rows."""
    twice = lambda key: rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.concat(F.lit(" and ".join(key) + " "), F.concat_ws(", ", *(F.col(k).cast("string") for k in key)), F.lit(" would occur twice")).alias("why"))
    risen = rows.join(dead.select("instance_id"), "instance_id", "left_semi").select(F.concat(F.lit("instance "), "instance_id", F.lit(" was withdrawn before")).alias("why"))
    if (why := twice(["instance_id"]).unionByName(twice(["document_id", "position"])).unionByName(risen).first()) is not None:
        raise BackendError(why["why"])


def sound(vector: str, dimensions: int) -> Column:
    """The vector, or an error where it is missing, of another length or not finite; checked while it is read or written."""
    v = F.col(vector)
    bad = v.isNull() | (F.size(v) != dimensions) | F.exists(F.coalesce(v, F.array()), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(bad, F.raise_error(F.concat(F.lit("the vector of "), "chunk_hash", F.lit(f" is missing, not finite or not of {dimensions} dimensions")))).otherwise(v)


class Index:
    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.path, self.bucket_rows = spark, path.rstrip("/"), bucket_rows
        self.log, self.leases = CommitLog(spark, f"{self.path}/commits"), Leases(spark, self.path)

    def newest(self) -> Commit | None:
        found = self.log.newest()
        return self._commit(found[1]) if found else None

    def at(self, generation: int) -> Commit | None:
        """A generation that is still kept."""
        found = self.log.at(generation)
        return self._commit(found) if found else None

    @staticmethod
    def _commit(found: dict) -> Commit:
        if found.get("schema_version") != SCHEMA_VERSION:
            raise BackendError(f"the index has schema version {found.get('schema_version')}, not {SCHEMA_VERSION}")
        return Commit(**found | {"bodies": tuple(found.get("bodies", ()))})

    def _paths(self, commit: Commit, table: str, only: set[int] | None = None) -> list[str]:
        held = commit.tables.get("documents" if table in ("manifest", "mirror") else table, {})
        return [f"{self.path}/{part}/{table}/bucket={k}" for part, buckets in held.items() for k in buckets if only is None or k in only]

    def _table(self, commit: Commit | None, name: str, only: set[int] | None = None) -> DataFrame:
        paths = self._paths(commit, name, only) if commit else []
        return self.spark.read.schema(_TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], _TABLES[name])

    def rows(self, commit: Commit | None = None) -> DataFrame:
        """Narrow rows (CHUNKS), tombstones among them."""
        return self._table(commit or self.newest(), "chunks")

    def documents(self, commit: Commit | None = None) -> DataFrame:
        return self._table(commit or self.newest(), "documents")

    def bodies(self, commit: Commit | None = None) -> DataFrame:
        """(BODIES) of all chunk hashes, those of tombstones among them."""
        c = commit or self.newest()
        return self.spark.read.schema(BODIES).parquet(*(f"{self.path}/{b}" for b in c.bodies)) if c and c.bodies else self.spark.createDataFrame([], BODIES)

    def manifest_lines(self, commit: Commit | None = None, mirror: bool = False) -> DataFrame:
        """The manifest, or its mirror, as JSON lines (value)."""
        c = commit or self.newest()
        paths = self._paths(c, "mirror" if mirror else "manifest") if c else []
        return self.spark.read.text(paths) if paths else self.spark.createDataFrame([], "value string")

    def active_rows(self, commit: Commit | None = None) -> DataFrame:
        return self.rows(commit).where("valid_to is null")

    def active(self, commit: Commit | None = None) -> DataFrame:
        """Active rows with text and vector."""
        c = commit or self.newest()
        return self.active_rows(c).join(self.bodies(c), "chunk_hash", "left")

    def status(self) -> DataFrame:
        now = self.newest()
        return status(self.rows(now), self.documents(now))

    @contextmanager
    def snapshot(self, seconds: float = READ_SECONDS) -> Iterator[Commit]:
        """The newest generation, whose files stay while the block lasts (``seconds`` at most), whatever writers and ``vacuum`` do."""
        while True:
            if (now := self.newest()) is None:
                raise BackendError("the index is empty")
            with self.leases.reading(now.generation, seconds):
                if self.log.at(now.generation) is None:
                    continue  # vacuumed before the lease was there
                yield now
                return

    def plan(self, target: DataFrame, provider: embedding.Provider, cached: DataFrame | None = None, price: float | None = None) -> dict[str, DataFrame]:
        """Writes nothing. target: occurrences with text (CHUNK columns, position, metadata, document_metadata)."""
        now = self.newest()
        changed = now is not None and (now.model_id, now.params_hash) != (provider.model_id, provider.params_hash)
        old = self.active_rows(now)
        ops = diff.occurrence_diff(old, target.drop("text"))
        return {"operations": ops, "counts": diff.op_counts(ops), "cost": diff.plan_cost(old, target, ops, cached, price, changed)}

    def apply(self, target: DataFrame, provider: embedding.Provider, cache=None, force: bool = False, documents: DataFrame | None = None, expected: int | None = None, batch_size: int = 64) -> Commit:  # noqa: ANN001
        """Publishes the target as the next generation; an unchanged one stays. Vectors come from the index, then from ``cache`` (a Cache,
        which gets the new ones), then from the provider; under another model nothing is carried over. ``documents`` (document_id,
        metadata) names those without chunks too; ``expected`` is the generation that was planned against, another one is an error."""
        if not 0 < provider.dimensions <= embedding.MAX_DIMENSIONS:
            raise BackendError(f"dimensions must be 1 to {embedding.MAX_DIMENSIONS}")
        with self.leases.writing() as fence:
            return self._applied(target, provider, cache, force, documents, expected, batch_size, fence)

    def _applied(self, target: DataFrame, provider: embedding.Provider, cache, force: bool, documents: DataFrame | None, expected: int | None, batch_size: int, fence: int) -> Commit:  # noqa: ANN001
        now = self.newest()
        if expected is not None and expected != (now.generation if now else 0):
            raise BackendError("the index has changed since the plan was made")
        same = now is not None and (now.model_id, now.params_hash) == (provider.model_id, provider.params_hash)
        target = _kept(manifest.with_identity(target).withColumn("position", F.col("position").cast("int")), "index-target")
        docs = _kept(manifest.documents(target, documents), "index-documents")
        old, before = self.active_rows(now), self.documents(now)
        source, used, whole = target, [], now is None or not same or force  # all documents count as changed
        if whole:
            changed, idle = None, now is not None and not any(df.limit(1).count() for df in (docs, before, old))
        else:
            facts = F.struct("root_hash", "metadata", *manifest.IDENTITY)
            other = before.select("document_id", facts.alias("a")).join(docs.select("document_id", facts.alias("b")), "document_id", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("document_id")
            changed = _kept(diff.changed_documents(old, target).unionByName(other).distinct(), "index-changed")
            idle = not changed.limit(1).count()
        lasting = [docs] if changed is None else [docs, changed]
        if idle:
            discard(source, *lasting)
            return now
        root = merkle.corpus_root(docs.select("document_id", "root_hash"))
        generation, n = (now.generation + 1, now.buckets) if now else (1, 0)
        if whole:
            n = max(1, -(-target.count() // self.bucket_rows))
        touched = None if whole else {r[0] for r in changed.select(bucket(n).alias("k")).distinct().collect()}  # one a bucket
        mine = lambda df: df if whole else df.join(changed, "document_id", "left_semi")
        rest = lambda df: df.limit(0) if whole else df.join(changed, "document_id", "left_anti")
        was, target = mine(self._table(now, "chunks", touched).where("valid_to is null")), mine(target)
        scope = f"{provider.model_id}\0{provider.params_hash}\0generation:{generation}"
        have, fresh, part = self._bodies(now if same else None, target, provider, cache, batch_size)
        release(self.spark)
        if now is None or not same:  # nothing is carried over, so rows get their ids where they lie
            ids, gone = None, was
        else:
            everything = whole and was.select("document_id").unionByName(target.select("document_id")).distinct()
            ops = diff.occurrence_diff(was, target.drop("text"), everything if whole else changed)
            ids = _kept(carried_ids(ops, was, root, scope), "index-ids")
            gone = was.join(ids.select("instance_id"), "instance_id", "left_anti")
            used.append(ids)
        rows = _kept(self._new_rows(target, ids, was, have, fresh, provider, root, scope, used), "index-rows")
        gone = _kept(_cast(gone.withColumn("valid_to", F.current_timestamp()), CHUNKS), "index-gone")
        discard(source, *used)
        buried = self.rows(now).where("valid_to is not null")
        checked_rows(rows, gone.select("instance_id").unionByName(buried.select("instance_id")))
        stored = self._table(now, "chunks", touched)
        every = _cast(rows, CHUNKS).unionByName(gone).unionByName(_cast(rest(stored.where("valid_to is null")), CHUNKS)).unionByName(_cast(stored.where("valid_to is not null"), CHUNKS))
        held = docs if touched is None else docs.where(bucket(n).isin(*touched))
        parts = ([] if not same else list(now.bodies)) + ([part] if part else [])
        made = Commit(generation, root, provider.model_id, provider.params_hash, provider.dimensions, tuple(parts), n, fence=fence)
        made = self._publish(self._write(made, None if whole else now, touched, every, held))
        discard(*lasting, rows, gone)
        return made

    def _bodies(self, now: Commit | None, target: DataFrame, provider: embedding.Provider, cache, batch_size: int) -> tuple[DataFrame | None, DataFrame | None, str | None]:  # noqa: ANN001
        """Bodies that the index has, those that the target needs besides, and the part to which these were written (None if there are none)."""
        have = self.bodies(now) if now else None
        wanted = embedding.distinct_inputs(target.select("chunk_hash", "text", "token_count"))
        if have is not None:
            wanted = wanted.join(have.select("chunk_hash"), "chunk_hash", "left_anti")
        if cache is None:
            both, used = embedding.embed_texts(wanted, provider, batch_size), []
        else:
            wanted = _kept(wanted, "index-wanted")
            both, used = wanted.join(embedding.embed_with_cache(wanted, provider, cache, batch_size), "chunk_hash", "left"), [wanted]
        part = self._write_body(_cast(both.withColumn("vector", sound("vector", provider.dimensions)), BODIES))
        fresh = self.spark.read.schema(BODIES).parquet(f"{self.path}/{part}")
        discard(*used)
        if not fresh.limit(1).count():
            Store(self.spark, self.path).delete(part, True)
            return have, None, None
        return have, fresh, part

    def _new_rows(self, target: DataFrame, ids: DataFrame | None, old: DataFrame, have: DataFrame | None, fresh: DataFrame | None, provider: embedding.Provider, root: str, scope: str, used: list[DataFrame]) -> DataFrame:
        """(CHUNKS) of the target. A row that is as it was keeps its digest; only others meet their text and vector to make one, and of the
        bodies of earlier generations only those that these need are moved."""
        known = {"model_id": F.lit(provider.model_id), "params_hash": F.lit(provider.params_hash), "valid_to": F.lit(None).cast("timestamp")}
        digested = lambda df, bodies: _cast(df.join(bodies, "chunk_hash", "left").withColumn("record_digest", record_digest()), CHUNKS)
        if ids is None:
            fresh_id = instance_id_column(F.lit(scope), F.lit(root), F.col("document_id"), F.col("position"), F.col("chunk_hash"))
            rows = target.drop("text").withColumns(known | {"instance_id": fresh_id, "valid_from": F.current_timestamp()}).select(*(c for c in _names(CHUNKS) if c != "record_digest"))
            return digested(rows, fresh if fresh is not None else self.spark.createDataFrame([], BODIES))
        same = ["document_id", "position", "chunk_hash", "start_offset", "end_offset", "token_count", "metadata"]
        before = old.select("instance_id", F.col("valid_from").alias("since"), F.struct(*same).alias("was"), F.col("record_digest").alias("old_digest"))
        rows = target.drop("text", *manifest.IDENTITY).join(ids, ["document_id", "position", "chunk_hash"]).join(before, "instance_id", "left")
        rows = rows.withColumns(known | {"valid_from": F.coalesce("since", F.current_timestamp())})
        unchanged = F.coalesce(F.struct(*same).eqNullSafe(F.col("was")), F.lit(False))
        rows = _kept(_cast(rows.withColumn("record_digest", F.when(unchanged, F.col("old_digest")).otherwise("")), CHUNKS), "index-narrow")
        used.append(rows)
        moved, bodies = rows.where("record_digest = ''"), have
        if fresh is not None:
            older = _kept(moved.select("chunk_hash").join(fresh.select("chunk_hash"), "chunk_hash", "left_anti").distinct(), "index-older")
            few = older.limit(FEW + 1).count() <= FEW
            bodies = fresh.unionByName(have.join(F.broadcast(older), "chunk_hash", "left_semi") if few else have)
            used.append(older)
        return rows.where("record_digest <> '' or record_digest is null").unionByName(digested(moved.drop("record_digest"), bodies))

    def _write_body(self, fresh: DataFrame) -> str:
        """Each file in the order of hashes, so that a look for a few hashes passes most of its pages over."""
        name = f"bodies/{uuid.uuid4().hex}"
        fresh.sortWithinPartitions("chunk_hash").write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def _write(self, commit: Commit, before: Commit | None, touched: set[int] | None, rows: DataFrame, docs: DataFrame) -> Commit:
        """Writes the buckets ``touched`` (all for None) as a part; the commit with its tables, those of ``before`` elsewhere, not published yet."""
        part, k = f"rows/{uuid.uuid4().hex}", bucket(commit.buckets).alias("bucket")
        place = lambda df: df.repartition("bucket").sortWithinPartitions("bucket", "document_id").write.partitionBy("bucket").option("compression", "zstd")
        place(_cast(rows, CHUNKS).select("*", k)).parquet(f"{self.path}/{part}/chunks")
        place(_cast(docs, DOCUMENTS).select("*", k)).parquet(f"{self.path}/{part}/documents")
        store, tables = Store(self.spark, f"{self.path}/{part}"), {}
        for name in _TABLES:
            kept = {p: [b for b in own if b not in touched] for p, own in before.tables[name].items()} if before and touched is not None else {}
            own = [int(f.removeprefix("bucket=")) for f in store.names(name) if f.startswith("bucket=")]
            tables[name] = {p: sorted(own) for p, own in (kept | {part: own}).items() if own}
        made = replace(commit, tables=tables)
        new = replace(commit, tables={t: {p: own for p, own in held.items() if p == part} for t, held in tables.items()})
        lines = manifest.to_json(self.documents(new), self.active_rows(new), k).select("bucket", "json")
        save = lambda df, copy: df.write.partitionBy("bucket").option("compression", "gzip").text(f"{self.path}/{part}/{copy}")
        save(lines, "manifest")
        if any(f.startswith("bucket=") for f in store.names("manifest")):
            lines = self.spark.read.text(f"{self.path}/{part}/manifest")  # as it was written, in files of one bucket
        save(lines, "mirror")
        return made

    def _publish(self, commit: Commit) -> Commit:
        self.leases.held(commit.fence)
        self.log.publish(commit.generation, asdict(commit))
        return commit

    def republish(self, generation: int, root: str) -> Commit:
        """A generation that is still kept, as the next one: its tables are the old one's, nothing is written but the commit."""
        with self.leases.writing() as fence:
            now, old = self.newest(), self.at(generation)
            if now is None or old is None:
                raise BackendError(f"generation {generation} is not kept any more")
            if old.corpus_root != root:
                raise BackendError(f"generation {generation} has another root")
            return self._publish(replace(old, generation=now.generation + 1, fence=fence))

    def vacuum(self, retained: int = RETAINED) -> int:
        """Deletes the parts that neither the newest ``retained`` generations nor one that a reader holds needs, and their commits; the number
        of parts. It reserves the index, so no writer's unpublished part is met."""
        with self.leases.writing() as fence:
            now, store = self.newest(), Store(self.spark, self.path)
            if now is None:
                return 0
            numbers = [int(f[:-5]) for f in store.names("commits") if f.endswith(".json") and f[:-5].isdigit()]
            keep = {g for g in numbers if g > now.generation - retained} | self.leases.read_generations()
            needed = {p for g in keep if (c := self.at(g)) for p in c.parts()}
            self.leases.held(fence)
            for g in sorted(set(numbers) - keep):
                store.delete(f"commits/{g:08d}.json")  # first, so that nobody opens what is going
            gone = [f"{kind}/{f}" for kind in ("rows", "bodies") for f in store.names(kind) if f"{kind}/{f}" not in needed]
            for part in gone:
                store.delete(part, True)
            return len(gone)

    def query(self, text: str, provider: embedding.Provider, k: int = 5) -> DataFrame:
        """The k nearest chunks. Bodies are scored where they lie, and only what can be among the first k meets its rows and then its text."""
        now = self.newest()
        if now is None:
            raise BackendError("the index is empty")
        if (now.model_id, now.params_hash, now.dimensions) != (provider.model_id, provider.params_hash, provider.dimensions):
            raise BackendError("the index was embedded by another model")
        vector = embedding.embed_checked([text], provider)[0]
        bodies = self.bodies(now)
        narrow = self.active_rows(now).select("chunk_hash", "document_id", "start_offset", "end_offset", "metadata")
        best = embedding.late_top_k(bodies.select("chunk_hash", sound("vector", now.dimensions).alias("vector")), narrow, vector, k, ["document_id", "start_offset"])
        found = written(best, "query-best")
        hashes = [r[0] for r in found.select("chunk_hash").distinct().limit(1001).collect()]
        texts = bodies.select("chunk_hash", "text").where(F.col("chunk_hash").isin(hashes)) if len(hashes) <= 1000 else bodies.select("chunk_hash", "text")
        return F.broadcast(found).join(texts, "chunk_hash").orderBy(F.desc("score"), "document_id", "start_offset").select("score", "chunk_hash", "text", "document_id", "start_offset", "end_offset", "metadata") if hashes else found.select("score", "chunk_hash", F.lit("").alias("text"), "document_id", "start_offset", "end_offset", "metadata")

    def verify(self, expected: DataFrame | None = None) -> DataFrame:
        """(document_id, position, problem): the newest generation against its manifest, its texts, vectors and digests, and against the
        rows ``expected`` from the sources if they are given."""
        wrong = lambda *what: self.spark.createDataFrame([(None, None, w) for w in what], "document_id string, position int, problem string")
        now = self.newest()
        if now is None:
            return wrong("no index")
        found = [wrong(*(what for bad, what in ((not now.corpus_root, "no corpus root"), (not now.model_id or not now.params_hash, "no embedding model"), (type(now.dimensions) is not int or now.dimensions <= 0, "dimensions not positive"), (type(now.generation) is not int or now.generation < 1, "generation not positive")) if bad))]
        lost = {t for t in ("manifest", "mirror") for path in self._paths(now, t) if not (at := file_system(self.spark, path))[0].exists(at[1])}
        if "manifest" in lost:
            return reduce(DataFrame.unionByName, [*found, wrong("no manifest")])
        if "mirror" in lost:
            found.append(wrong("no mirror of the manifest"))
        docs, chunks, bad = manifest.from_json(self.manifest_lines(now))
        docs, chunks = _kept(docs, "verify-documents"), _kept(chunks, "verify-chunks")
        if merkle.corpus_root(docs.select("document_id", "root_hash")) != now.corpus_root:
            found.append(wrong("manifest has another root"))
        none = F.lit(None).cast("int").alias("position")
        if "mirror" not in lost:
            found.append(mirror_problems(self.manifest_lines(now), self.manifest_lines(now, True)).select("document_id", none, "problem"))
        active = self.active_rows(now)
        # Narrow rows meet first, so that texts and vectors are moved once.
        asked = _exp(chunks.join(docs.select("document_id", *manifest.IDENTITY), "document_id"))
        held = active.select("instance_id", "document_id", "position", "chunk_hash", "start_offset", "end_offset", "token_count", "metadata", "model_id", "params_hash", "record_digest").join(asked, ["document_id", "position"]).join(self.bodies(now), "chunk_hash", "left")
        found += [d.select("document_id", none, "problem") for d in (bad, document_problems(docs, self.documents(now)))]
        found += [problems(chunks, active), _content_problems(held, now.model_id, now.params_hash, now.dimensions)]
        if expected is not None:
            found.append(problems(expected, active))
        return reduce(DataFrame.unionByName, (f.select("document_id", F.col("position").cast("int").alias("position"), "problem") for f in found)).distinct()

    def compact(self, before=None, dry_run: bool = False) -> int:  # noqa: ANN001
        """Drops tombstones up to a time (all without one), and bodies that no row needs any more; the number of tombstones."""
        now = self.newest()
        if now is None:
            return 0
        dead = F.col("valid_to").isNotNull() & (F.lit(True) if before is None else F.col("valid_to") <= before)
        n = self.rows(now).where(dead).count()
        if n and not dry_run:
            with self.leases.writing() as fence:
                rows = written(self.rows(now).where(~dead | dead.isNull()), "compact-rows")
                bodies, parts = self.bodies(now), now.bodies
                needed = bodies.join(rows.select("chunk_hash").distinct(), "chunk_hash", "left_semi")
                if needed.count() < bodies.count():
                    parts = (self._write_body(needed),)
                buckets = max(1, -(-rows.count() // self.bucket_rows))
                made = replace(now, generation=now.generation + 1, bodies=parts, buckets=buckets, fence=fence)
                self._publish(self._write(made, None, None, rows, self.documents(now)))
        return n


def bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(n)).cast("int")


def mirror_problems(lines: DataFrame, mirror: DataFrame) -> DataFrame:
    """(document_id, problem) of a manifest's mirror: lines that can't be read, that are not there, or that say something else."""
    named = lambda df, p: df.select(F.get_json_object("value", "$.document_id").alias("document_id"), F.col("value").alias(p), (F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT") & F.get_json_object("value", "$.document_id").isNotNull()).alias("ok"))
    torn = named(mirror, "b").where(~F.coalesce("ok", F.lit(False))).select(F.lit(None).cast("string").alias("document_id"), F.lit("mirror of the manifest unreadable").alias("problem")).limit(1)
    digest = lambda df, p: named(df, p).where("ok").select("document_id", F.unhex(F.sha2(p, 256)).alias(p))
    both = digest(lines, "a").join(digest(mirror, "b"), "document_id", "full")
    what = F.when(F.col("b").isNull(), "no mirror of the manifest").when(~F.col("a").eqNullSafe(F.col("b")), "mirror has another manifest")
    return both.select("document_id", what.alias("problem")).where("problem is not null").unionByName(torn)


def occurrences(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Chunk rows as index targets: position, metadata and document metadata added."""
    facts = F.to_json(F.struct("boundary_kind", "chunk_index", "end_word", "raw_end_word", "snap_kind", "start_word"))
    out = chunks.withColumns({"position": F.col("chunk_index"), "metadata": facts})
    if documents is None:
        return out.withColumn("document_metadata", F.lit("{}"))
    return out.join(documents.select("document_id", F.col("metadata").alias("document_metadata")), "document_id")
