"""Deterministic sharded WARC writer, and the reader of what it wrote.

Records are dealt to shards by key ranges of about ``shard_bytes`` (from an exact histogram of bytes over keys, not from samples; a key that
holds more is cut by digests), sorted inside a shard, written one gzip member each, and rolled to a new file when the compressed size passes ``roll_bytes``. Headers and digests
are made anew. Each task writes under temporary names of its own; tasks then rename the files that were reported and Spark publishes the
manifest last, as a table of its own, so a reader sees all files or none, and repeated or lost attempts leave nothing behind. A folder
that has a manifest is never written again. Readers hold each file to the bytes, records and digest that the manifest states: one that was
cut, lengthened, changed or lost is an error. File names, bytes and manifest depend on the records only.

Equal payloads of at least ``revisit_bytes`` are written once, by the record with the largest key; the others are revisits of it. Defined
results: null payload is empty; a null key sorts first and yields to any other as the response; of repeated keys with equal payloads the
first is the response; a null URL leaves its header out; an empty table gives a manifest without files.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import file_system
from .common import materialize, scratch_path, small

SHARD_BYTES, ROLL_BYTES, REVISIT_BYTES = 64 << 20, 32 << 20, 1000
DATE, MOST_TASKS = "2024-01-01T00:00:00Z", 16_384
_BINS, MANIFEST = 4096, "MANIFEST"
#: Fixed names of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "temp string, name string, shard long, part long, records long, bytes long, sha256 string"
_RECORDS = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def range_bounds(rows: DataFrame, key: str, weight: str, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of key ranges of about ``target`` weight (the first is the least key), and into how many shards each is cut: one, but
    for a single key that weighs more.

    Histograms of at most 4096 bins first, then of two bins a ``target`` of a heavy range's weight, each level one aggregate; what the driver
    holds is a few numbers per ``target`` weight.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    big = lambda c: F.col(c).cast("decimal(20,0)") if isinstance(c, str) else F.lit(c).cast("decimal(20,0)")
    at = lambda start, width: F.floor((big(key) - big(start)) / big(width)).cast("long")
    done: dict[int, int] = {}
    first = max(1, -(-(high - low + 1) // _BINS))
    ask, ranges = rows.filter(F.col(key).isNotNull()).select(key, weight).withColumns({"__start": F.lit(low), "__width": F.lit(first)}), {low: first}
    while True:
        found = ask.groupBy("__start", at("__start", "__width").alias("bin")).agg(F.sum(weight).alias("w")).collect()
        heavy: dict[int, tuple[int, int]] = {}  # start of a range to (its width, the width of its bins)
        for start, k, w in found:
            width = ranges[start]
            if w > target and width > 1:
                heavy[start + k * width] = (width, max(1, -(-width // min(_BINS, 2 * -(-w // target)))))
            else:
                done[start + k * width] = w
        if not heavy:
            break
        marks = rows.sparkSession.createDataFrame(pa.table({"__heavy": pa.array(list(heavy), pa.int64()), "__next": pa.array([b for _, b in heavy.values()], pa.int64())}))
        own = ask.withColumn("__at", (big("__start") + at("__start", "__width").cast("decimal(20,0)") * big("__width")).cast("long"))
        ask = own.join(small(marks), F.col("__at") == F.col("__heavy")).select(key, weight, F.col("__heavy").alias("__start"), F.col("__next").alias("__width"))
        ranges = {start: b for start, (_, b) in heavy.items()}
    bounds, cuts, held = [], [], 0
    for start in sorted(done):
        if not bounds or cuts[-1] > 1 or held and held + done[start] > target:
            bounds.append(start)
            cuts.append(-(-done[start] // target) or 1)
            held = 0
        held += done[start]
    return np.array(bounds, np.int64), np.array(cuts, np.int64)


class Placement:
    """Shards in the order of keys: those of null keys first, then the ranges'. A key with several shards is spread by its payloads' digests."""

    def __init__(self, bounds: np.ndarray, cuts: np.ndarray, nulls: int) -> None:
        self.bounds, self.cuts = bounds, np.append(nulls, cuts)
        self.first = np.append(0, np.cumsum(self.cuts))

    @property
    def shards(self) -> int:
        return int(self.first[-1])

    def column(self, spark: SparkSession, key: Column, digest: Column) -> Column:
        shared = spark.sparkContext.broadcast(self)  # a few numbers a shard

        @F.arrow_udf("long")
        def shard(keys: pa.Array, lead: pa.Array) -> pa.Array:
            own = shared.value
            at = np.searchsorted(own.bounds, keys.fill_null(0).to_numpy(zero_copy_only=False), "right")
            at = np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, np.maximum(at, 1))
            return pa.array(own.first[at] + (lead.to_numpy(zero_copy_only=False) * own.cuts[at] >> 32))

        return shard(key, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def record(key: int | None, url: str | None, payload: bytes, turn: int, refers: tuple[int | None] | None) -> bytes:
    """One gzip member. turn: how many records with this key and payload came before; refers: the response's key, for a revisit."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    headers = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", _id(key, digest, turn)), ("WARC-Date", DATE)]
    headers += [("WARC-Target-URI", _safe(url))] if url is not None else []
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("X-Payload-Length", str(len(payload)))]
    headers += [("X-Record-Key", str(key))] if key is not None else []
    if refers:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _id(refers[0], digest, 0))]
        headers += [("X-Refers-To-Key", str(refers[0]))] if refers[0] is not None else []
    return _member([*headers, ("Content-Type", "application/http;msgtype=response")], block)


class _Roller:
    """Files of one shard under temporary names."""

    def __init__(self, out: str, shard: int, roll_bytes: int) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(out)
        self.temp, self.shard, self.roll, self.part, self.file = f"_temporary/{uuid.uuid4().hex}", shard, roll_bytes, 0, None

    def add(self, member: bytes) -> dict | None:
        closed = self.close() if self.file and self.size + len(member) > self.roll and self.records else None
        if not self.file:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.fs.create_dir(f"{self.root}/{self.temp}", recursive=True)
            self.file, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.root}/{self.temp}/{self.name}", compression=None), 0, 0, hashlib.sha256()
            self._write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id(self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._write(member)
        self.records += 1
        return closed

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> dict | None:
        if not self.file:
            return None
        self.file.close()
        self.file, self.part = None, self.part + 1
        return {"temp": f"{self.temp}/{self.name}", "name": self.name, "shard": self.shard, "part": self.part - 1, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}


def write_warc(df: DataFrame, out: str, key: str = "page_id", url: str = "url", payload: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes one record a row under ``out`` (a URI that Spark and pyarrow's file systems know, shared by all machines); the manifest.

    Payloads move once, to their shard; which records revisit which is found over digests and meets them there in sort order.
    """
    spark = df.sparkSession
    fs, p = file_system(spark, f"{out}/{MANIFEST}")
    if fs.exists(p):
        raise FileExistsError(f"{out} was written before")
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.sha1(body).alias("digest"), body.alias("payload"))
    narrow = materialize(rows.select("key", "digest", F.octet_length("payload").cast("long").alias("n")), "warc-keys")
    weights = narrow.select("key", (F.col("n") + 512).alias("w"))
    nulls = weights.filter("key is null").agg(F.sum("w")).first()[0] or 0
    place = Placement(*range_bounds(weights, "key", "w", shard_bytes), -(-nulls // shard_bytes))
    large = narrow.filter(F.col("n") >= revisit_bytes)
    copied = large.groupBy("digest").agg(F.max("key").alias("refers"), F.count("*").alias("c")).filter("c > 1").select(F.col("digest").alias("d"), "refers")
    known = large.select("key", "digest").join(small(materialize(copied, "warc-copies")), F.col("digest") == F.col("d")).select("key", "digest", "refers").distinct()
    info = known.select("key", F.lit(None).cast("string").alias("url"), "digest", F.lit(None).cast("binary").alias("payload"), F.lit(0).alias("kind"), "refers")
    every = info.unionByName(rows.withColumns({"kind": F.lit(1), "refers": F.lit(None).cast("long")}))
    every = every.withColumn("shard", place.column(spark, F.col("key"), F.col("digest")))

    def run(batches):  # noqa: ANN001, ANN202
        roller, group, turn, refers = None, None, 0, None
        files: list[dict] = []
        for b in batches:
            for r in zip(*(b.column(n).to_pylist() for n in ("shard", "key", "digest", "kind", "refers", "url")), b.column(b.schema.get_field_index("payload")), strict=True):
                shard, k, digest, kind, to, u, p = r
                if (shard, k, digest) != group:
                    group, turn, refers = (shard, k, digest), 0, None
                if kind == 0:
                    refers = (to,)
                    continue
                if roller is None or roller.shard != shard:
                    files += [f] if roller and (f := roller.close()) else []
                    roller = _Roller(out, shard, roll_bytes)
                revisit = refers if refers and (refers[0] != k or turn) else None
                files += [f] if (f := roller.add(record(k, u, p.as_py(), turn, revisit))) else []
                turn += 1
        files += [f] if roller and (f := roller.close()) else []
        if files:
            yield pa.RecordBatch.from_pylist(files)

    parts = min(MOST_TASKS, max(1, place.shards))  # a task takes neighbouring shards
    task = F.floor(F.col("shard") * parts / max(1, place.shards)).cast("int")
    ready = every.repartitionById(parts, task).sortWithinPartitions(F.col("shard"), F.col("key").asc_nulls_first(), "digest", "kind", "url")
    return _commit(out, materialize(ready.mapInArrow(run, _FILES), "warc-files"))


def _commit(out: str, files: DataFrame) -> DataFrame:
    """Gives the reported files their names, in tasks (again if one was lost), then writes the manifest."""

    def run(batches):  # noqa: ANN001, ANN202
        fs, root = pafs.FileSystem.from_uri(out)
        for b in batches:
            for temp, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if fs.get_file_info(f"{root}/{temp}").type == pafs.FileType.File:
                    fs.move(f"{root}/{temp}", f"{root}/{name}")
            yield b

    spark, own = files.sparkSession, [x.split()[0] for x in _FILES.split(", ")]
    named = materialize(files.repartition("shard").select(*own).mapInArrow(run, _FILES).drop("temp"), "warc-named")
    named.repartitionByRange(max(1, min(64, named.count() // 100_000 + 1)), "name").sortWithinPartitions("name").write.json(f"{out}/{MANIFEST}")
    fs, p = file_system(spark, f"{out}/_temporary")
    fs.delete(p, True)
    return manifest(spark, out)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """(name, shard, part, records, bytes, sha256) of the files that were published."""
    fs, p = file_system(spark, f"{out}/{MANIFEST}/_SUCCESS")
    if not fs.exists(p):
        raise FileNotFoundError(f"{out} has no whole manifest")
    return spark.read.schema(_FILES.removeprefix("temp string, ")).json(f"{out}/{MANIFEST}")


class _Held(io.RawIOBase):
    """A file that is read once from start to end, with its size and digest."""

    def __init__(self, source) -> None:  # noqa: ANN001
        self.source, self.size, self.sha = source, 0, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:  # noqa: ANN001
        data = self.source.read(len(into))
        into[: len(data)] = data
        self.size += len(data)
        self.sha.update(data)
        return len(data)


def parse(stream):  # noqa: ANN001, ANN201
    """(headers with lower-case names, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """The records of all files of the manifest; a file or payload that differs from what is stated is an error. Revisits have null payload."""
    files = manifest(spark, out)

    def run(batches):  # noqa: ANN001, ANN202
        fs, root = pafs.FileSystem.from_uri(out)
        schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for name, records, size, sha in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows, held, met = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    own = _Held(source)
                    with gzip.GzipFile(fileobj=io.BufferedReader(own, 1 << 20)) as stream:
                        for h, block in parse(stream):
                            if h["warc-type"] == "warcinfo":
                                continue
                            met += 1
                            digest, revisit = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "revisit"
                            payload = None if revisit else block[block.index(b"\r\n\r\n") + 4 :]
                            if h["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}" or payload is not None and digest != hashlib.sha1(payload).hexdigest():
                                raise ValueError(f"{name}: a digest differs")
                            rows.append({"key": number(h.get("x-record-key")), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "refers_to": number(h.get("x-refers-to-key")), "payload_bytes": int(h["x-payload-length"]), "payload_digest": digest, "payload": payload})
                            held += len(payload or b"")
                            if held > 8 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                                rows, held = [], 0
                    if (met, own.size, own.sha.hexdigest()) != (records, size, sha):
                        raise ValueError(f"{name} differs from the manifest: {met} records and {own.size} bytes, not {records} and {size}, or another digest")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = min(MOST_TASKS, max(1, files.count()))
    return files.select("name", "records", "bytes", "sha256").repartition(tasks, "name").mapInArrow(run, _RECORDS)


def digest(pages: DataFrame) -> DataFrame:
    """The columns of query op6, from archives written to the shared folder and read back."""
    out = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, out)
    return read_warc(pages.sparkSession, out).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
with p as (select page_id, coalesce(html, '') as t from pages),
q as (select page_id, strlen(t)::bigint as payload_bytes, sha1(t) as payload_digest from p),
r as (select *, count(*) over (partition by payload_digest) as n, max(page_id) over (partition by payload_digest) as top, row_number() over (partition by payload_digest order by page_id desc nulls last) as k from q)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= {REVISIT_BYTES} and k > 1 then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {REVISIT_BYTES} and k > 1 then top end as refers_to from r"""
