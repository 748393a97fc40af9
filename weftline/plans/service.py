"""Projects: configuration, sources, index and cache together; migrations with a journal. A project lives in a folder of any file system
that Spark reads."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from ..errors import ConfigError, VerificationError, WeftlineError
from ..operators import chunking, diff, merkle
from ..sources.cache import Cache
from ..sources.files import read_documents, unique_ids
from ..tables import Store, written
from . import manifest
from .index import Commit, Index, occurrences

JOURNAL, RECEIPTS, STATE = ".weftline/migration.json", ".weftline/receipts", ".weftline"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Prepared:
    """A plan with what it was made from: chunks and documents are read and cut once, and the plan holds for one generation only."""

    target: DataFrame
    documents: DataFrame
    generation: int
    operations: dict[str, int]
    cost: dict[str, Any]
    rows: DataFrame
    chunks: int = 0

    def first(self, n: int) -> list[dict[str, Any]]:
        """The first operations in the order of plans."""
        return [r.asDict() for r in self.rows.orderBy(*diff.plan_order()).limit(n).collect()]


class Project:
    def __init__(self, spark: SparkSession, folder: object, config: cfg.Config | None = None) -> None:
        self.spark, self.store = spark, Store(spark, str(folder))
        if config is None and not self.store.exists(cfg.FILENAME):
            raise ConfigError(f"{self.store.path(cfg.FILENAME)} does not exist")
        self.config = config or cfg.loads(self.store.read(cfg.FILENAME))
        self._open()

    def _open(self) -> None:
        self.index, self.cache = Index(self.spark, self.store.path(self.config.store.index)), Cache(self.spark, self.store.path(self.config.store.cache))

    @staticmethod
    def init(spark: SparkSession, folder: object, force: bool = False) -> str:
        store = Store(spark, str(folder))
        if store.exists(cfg.FILENAME) and not force:
            raise ConfigError(f"{store.path(cfg.FILENAME)} exists")
        store.write(cfg.FILENAME, cfg.render(cfg.Config()))
        return store.path(cfg.FILENAME)

    @staticmethod
    def adopt(spark: SparkSession, folder: object, old: str) -> str:
        """Makes the project's configuration of an earlier one's file, which stays as it is."""
        store = Store(spark, str(folder))
        if not store.exists(old):
            raise ConfigError(f"{store.path(old)} does not exist")
        store.write(cfg.FILENAME, cfg.render(cfg.adopted(store.read(old))), exclusive=True)
        return store.path(cfg.FILENAME)

    def documents(self, config: cfg.Config | None = None, inputs: tuple[str, ...] = ()) -> DataFrame:
        """The sources; the project's own state is never one."""
        s = (config or self.config).sources
        base = "" if s.base in (".", "") else s.base.rstrip("/") + "/"
        own = (cfg.FILENAME, STATE, self.config.store.index, self.config.store.cache)
        protect = tuple(p.removeprefix(base) for p in own if p.startswith(base))
        return unique_ids(read_documents(self.spark, self.store.path(s.base), s.exclude, include=s.include, inputs=inputs, protect=protect))

    def prepare(self, config: cfg.Config | None = None, force: bool = False, inputs: tuple[str, ...] = ()) -> Prepared:
        """Reads, cuts and plans; writes nothing but scratch tables."""
        c = config or self.config
        docs = written(self.documents(c, inputs), "sources")
        target = written(occurrences(chunking.chunk_documents(docs, c.chunker.build()), docs), "target")
        now, provider = self.index.newest(), c.embedding.build()
        known = self.cache.rows().where((F.col("model_id") == provider.model_id) & (F.col("params_hash") == provider.params_hash)).select("chunk_hash")
        out = self.index.plan(target, provider, known, c.embedding.price_per_million_tokens)
        return Prepared(target, docs.select("document_id", "metadata"), now.generation if now else 0, {r["kind"]: r["n"] for r in out["counts"].collect()}, out["cost"].first().asDict(), out["operations"], target.count())

    def plan(self, config: cfg.Config | None = None, inputs: tuple[str, ...] = (), show: int = 0) -> dict[str, Any]:
        """Counts and cost, and with ``show`` the first so many operations."""
        p = self.prepare(config, inputs=inputs)
        return {"operations": p.operations, "cost": p.cost} | ({"first": p.first(show)} if show else {})

    def apply_prepared(self, p: Prepared, config: cfg.Config | None = None, force: bool = False) -> Commit:
        c = config or self.config
        return self.index.apply(p.target, c.embedding.build(), self.cache, force, p.documents, p.generation, c.embedding.batch_size)

    @staticmethod
    def _allowed(p: Prepared, deletes: bool, empty: bool) -> None:
        """Raises if a change would withdraw chunks, or all of them, without consent."""
        if p.operations["delete"] and not deletes and p.generation:
            raise WeftlineError(f"{p.operations['delete']} chunks would be deleted; allow it explicitly")
        if not p.chunks and not empty and p.generation:
            raise WeftlineError("the index would be left empty; allow it explicitly")

    def apply(self, config: cfg.Config | None = None, allow_deletes: bool = False, inputs: tuple[str, ...] = (), allow_empty: bool = False) -> Commit:
        p = self.prepare(config, inputs=inputs)
        self._allowed(p, allow_deletes, allow_empty)
        return self.apply_prepared(p, config)

    def query(self, text: str, k: int = 5) -> list[dict[str, Any]]:
        if not text.strip() or k < 1:
            raise WeftlineError("a query needs text and a positive limit")
        return [r.asDict() for r in self.index.query(text, self.config.embedding.build(), k).collect()]

    def verify(self, sources: bool = True) -> None:
        """The index against its manifest and, with ``sources``, against the files as they are now."""
        found = self.index.verify(self.prepare().target if sources else None).limit(20).collect()  # the first of them for the message
        if found:
            raise VerificationError("; ".join(f"{r['document_id'] or 'index'}[{r['position']}]: {r['problem']}" for r in found))

    def migrate(self, strategy: str | None = None, model: str | None = None, apply: bool = False, allow_deletes: bool = False, allow_empty: bool = False) -> dict[str, Any]:
        """Another chunker or model: preview, or a new generation and then the new configuration, through a journal."""
        self.recover()
        new = self.config.with_changes(strategy, model)
        p = self.prepare(new)
        out = {"changes": [k for k in ("chunker", "embedding") if getattr(new, k) != getattr(self.config, k)], "operations": p.operations, "cost": p.cost}
        if not apply or not out["changes"]:
            return out
        self._allowed(p, allow_deletes, allow_empty)
        self._journal("migration", cfg.render(new), p.generation, new.embedding.build())
        self.apply_prepared(p, new, force=True)
        return out | {"recovered": self.recover()}

    def _journal(self, kind: str, config: str, generation: int, provider, root: str | None = None) -> None:  # noqa: ANN001
        """Notes a change of index and configuration before it begins; one at a time. root: what the new generation must have, if known."""
        text, before = self.store.read(cfg.FILENAME), self.index.newest()
        old = {k: getattr(before, k) for k in ("generation", "corpus_root", "model_id", "params_hash")} if before else None
        entry = {"version": 2, "kind": kind, "previous": text, "previous_sha256": _sha(text), "config": config, "config_sha256": _sha(config), "generation": generation, "model_id": provider.model_id, "params_hash": provider.params_hash, "root": root, "old": old}
        self.store.write(JOURNAL, json.dumps(entry, sort_keys=True), exclusive=True)

    def recover(self) -> str:
        """Ends a migration or rollback that was cut short: forward if its generation was published, else back."""
        if not self.store.exists(JOURNAL):
            return "nothing"
        entry, now = json.loads(self.store.read(JOURNAL)), self.index.newest()
        if entry.get("version") != 2:
            raise ConfigError("the journal is of another version")
        done = now is not None and now.generation > entry["generation"] and (now.model_id, now.params_hash) == (entry["model_id"], entry["params_hash"]) and entry["root"] in (None, now.corpus_root)
        if done:
            if _sha(self.store.read(cfg.FILENAME)) not in (entry["previous_sha256"], entry["config_sha256"]):
                raise ConfigError("the configuration was changed while it was being replaced")
            receipt = {"kind": entry["kind"], "applied_at": datetime.now(UTC).isoformat(), "old": entry["old"], **{k: entry[k] for k in ("previous", "previous_sha256", "config_sha256")}, **{k: getattr(now, k) for k in ("generation", "corpus_root", "model_id", "params_hash")}}
            self.store.write(f"{RECEIPTS}/{now.generation:08d}.json", json.dumps(receipt, sort_keys=True))
            self.store.write(cfg.FILENAME, entry["config"])
            self.config = cfg.loads(entry["config"])
            self._open()
        self.store.delete(JOURNAL)
        return "forward" if done else "back"

    def receipt(self) -> dict[str, Any]:
        """The newest change that led to the index and the configuration as they are."""
        now, sha = self.index.newest(), _sha(self.store.read(cfg.FILENAME))
        found = [json.loads(self.store.read(f"{RECEIPTS}/{n}")) for n in self.store.names(RECEIPTS)]
        same = ("generation", "corpus_root", "model_id", "params_hash")
        fits = [r for r in found if now and all(r[k] == getattr(now, k) for k in same) and r["config_sha256"] == sha]
        if not fits:
            raise WeftlineError("no receipt fits the index and the configuration as they are")
        return max(fits, key=lambda r: r["applied_at"])

    def rollback(self, apply: bool = False, allow_deletes: bool = False, allow_empty: bool = False) -> dict[str, Any]:
        """The configuration and the generation before the newest migration: preview, or through a journal, as a new generation.

        Refused where the stored configuration is not what it was, or where the sources, cut by it, don't make the old root under the old
        model: what would be published then never existed. The old generation is published again as it lies, or, where ``vacuum`` has taken
        it, made anew.
        """
        self.recover()
        receipt = self.receipt()
        old = receipt["old"]
        if _sha(receipt["previous"]) != receipt["previous_sha256"]:
            raise ConfigError("the receipt's configuration is not what it was")
        if old is None:
            raise WeftlineError("there was no index before")
        config = cfg.loads(receipt["previous"])
        p, provider = self.prepare(config), config.embedding.build()
        root = merkle.corpus_root(manifest.documents(p.target, p.documents).select("document_id", "root_hash"))
        if (root, provider.model_id, provider.params_hash) != (old["corpus_root"], old["model_id"], old["params_hash"]):
            raise WeftlineError("the sources no longer make the index as it was; restore them, or migrate forward")
        out = {"generation": old["generation"], "operations": p.operations, "cost": p.cost}
        if not apply:
            return out
        self._allowed(p, allow_deletes, allow_empty)
        kept = self.index.at(old["generation"])
        self._journal("rollback", receipt["previous"], self.index.newest().generation, provider, root)
        if kept is not None and (kept.corpus_root, kept.model_id, kept.params_hash) == (root, provider.model_id, provider.params_hash):
            self.index.republish(old["generation"], root)
        else:
            self.apply_prepared(p, config, force=True)
        return out | {"published": self.index.newest().generation, "recovered": self.recover()}
