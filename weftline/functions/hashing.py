"""Framed SHA-256 identities, as Columns (JVM only) and in Python; both give the same digests."""

from __future__ import annotations

import hashlib
import json
import struct
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import wire


def hash_fields(domain: str, fields: list[str | bytes]) -> str:
    name = domain.encode("ascii")
    h = hashlib.sha256(struct.pack(">I", len(name)) + name)
    for f in fields:
        data = f.encode() if isinstance(f, str) else bytes(f)
        h.update(struct.pack(">Q", len(data)) + data)
    return h.hexdigest()


def hash_bytes(data: bytes, domain: str = wire.BYTES_DOMAIN) -> str:
    return hash_fields(domain, [data])


def hash_text(text: str, domain: str = wire.TEXT_DOMAIN) -> str:
    return hash_fields(domain, [text])


def canonical_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def hash_json(value: Any, domain: str = wire.JSON_DOMAIN) -> str:
    return hash_fields(domain, [canonical_json(value)])


def chunk_hash(text: str, chunker_id: str, params_hash: str, normalizer: str = wire.NORMALIZER, schema: str = wire.IDENTITY_SCHEMA) -> str:
    if schema != wire.IDENTITY_SCHEMA:
        raise ValueError(f"unknown identity schema {schema!r}")
    for name, value in (("text", text), ("chunker_id", chunker_id), ("params_hash", params_hash), ("normalizer", normalizer)):
        if not value:
            raise ValueError(f"{name} is empty")
    return hash_fields(wire.CHUNK_DOMAIN, [schema, normalizer, chunker_id, params_hash, text])


def framed(value: Column) -> Column:
    """A field with its length, as binary."""
    data = value.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0")), data)


def hash_fields_column(domain: str, *fields: Column) -> Column:
    name = domain.encode("ascii")
    return F.sha2(F.concat(F.lit(struct.pack(">I", len(name)) + name), *map(framed, fields)), 256)


def chunk_hash_column(text: Column, chunker_id: str, params_hash: str) -> Column:
    return hash_fields_column(wire.CHUNK_DOMAIN, *map(F.lit, (wire.IDENTITY_SCHEMA, wire.NORMALIZER, chunker_id, params_hash)), text)


def instance_id_column(scope: Column, corpus_root: Column, document_id: Column, position: Column, digest: Column) -> Column:
    parts = [x for c in (scope, corpus_root, document_id, position.cast("string"), digest) for x in (c.cast("binary"), F.lit(b"\0"))]
    return F.substring(F.sha2(F.concat(F.lit(wire.INSTANCE_PREFIX), *parts), 256), 1, 32)


def sql_framed(domain: str, *fields: str) -> str:
    """The same hash as DuckDB SQL; fields are SQL expressions of strings."""
    head = "".join(f"\\x{b:02X}" for b in struct.pack(">I", len(domain)))
    parts = [f"'{head}'::blob", f"'{domain}'::blob"]
    for f in fields:
        parts += [f"unhex(lpad(to_hex(octet_length(encode({f}))), 16, '0'))", f"encode({f})"]
    return f"sha256({' || '.join(parts)})"
