"""The command: init, adopt, plan, index, status, query, verify, compact, migrate, rollback, cache, measure."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .errors import WeftlineError
from .operators import chunking, churn, embedding, retrieval
from .plans.service import Project
from .sources.cache import prune_age, prune_lru, stats
from .tables import Store, written


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("weftline")
    p.add_argument("--project", default=".", help="folder of the project, of any file system that Spark reads")
    p.add_argument("--format", choices=("json", "table"), default="json")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("--force", action="store_true")
    sub.add_parser("adopt").add_argument("old")
    i = sub.add_parser("plan")
    i.add_argument("inputs", nargs="*")
    i.add_argument("--show", type=int, default=0, help="how many operations to list")
    sub.add_parser("status")
    sub.add_parser("vacuum").add_argument("--retain", type=int, default=2, help="how many generations to keep")
    sub.add_parser("verify").add_argument("--no-sources", action="store_true", help="the index by itself")
    i = sub.add_parser("index")
    i.add_argument("inputs", nargs="*")
    m = sub.add_parser("migrate")
    m.add_argument("--strategy")
    m.add_argument("--model")
    m.add_argument("--recover", action="store_true")
    r = sub.add_parser("rollback")
    for x in (m, r):
        x.add_argument("--apply", action="store_true", help="without it, a preview")
    for x in (i, m, r):
        x.add_argument("--allow-deletes", action="store_true", help="chunks may be withdrawn")
        x.add_argument("--allow-empty", action="store_true", help="the index may be left empty")
        x.add_argument("--allow-network", action="store_true", help="texts may be sent to an embedding service")
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--limit", type=int, default=5)
    q.add_argument("--allow-network", action="store_true")
    c = sub.add_parser("compact")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--before", help="a time with its zone, as 2024-01-31T00:00:00+00:00")
    c = sub.add_parser("cache")
    c.add_argument("action", choices=("stats", "prune", "vacuum", "export", "import"))
    c.add_argument("path", nargs="?")
    c.add_argument("--max-age-days", type=int)
    c.add_argument("--max-entries", type=int)
    c.add_argument("--trusted", action="store_true")
    c.add_argument("--force", action="store_true")
    m = sub.add_parser("measure")
    m.add_argument("what", choices=("churn", "retrieval"))
    m.add_argument("--strategies", nargs="*", default=[])
    m.add_argument("--edits", nargs="*", default=list(churn.EDITS))
    m.add_argument("--questions", help="JSON lines of question_id, query, evidence (a list)")
    m.add_argument("--scores", choices=("lexical", "hash"), default="lexical")
    m.add_argument("-k", type=int, default=5)
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> object:
    if args.command == "init":
        return {"created": Project.init(spark, args.project, args.force)}
    if args.command == "adopt":
        return {"created": Project.adopt(spark, args.project, args.old)}
    p = Project(spark, args.project)
    if getattr(args, "allow_network", True) is False and p.config.embedding.provider == "openai":
        raise WeftlineError("this would send texts to an embedding service; allow it with --allow-network")
    if args.command == "plan":
        return p.plan(inputs=tuple(args.inputs), show=args.show)
    if args.command == "index":
        return asdict(p.apply(None, args.allow_deletes, tuple(args.inputs), args.allow_empty))
    if args.command == "status":
        now = p.index.newest()
        return p.index.status().first().asDict() | ({"generation": now.generation, "corpus_root": now.corpus_root, "model_id": now.model_id} if now else {"generation": 0})
    if args.command == "query":
        return p.query(args.text, args.limit)
    if args.command == "verify":
        p.verify(not args.no_sources)
        return {"ok": True}
    if args.command == "compact":
        return {"tombstones": p.index.compact(_moment(args.before), args.dry_run)}
    if args.command == "migrate":
        return {"recovered": p.recover()} if args.recover else p.migrate(args.strategy, args.model, args.apply, args.allow_deletes, args.allow_empty)
    if args.command == "rollback":
        return p.rollback(args.apply, args.allow_deletes, args.allow_empty)
    if args.command == "vacuum":
        return {"deleted": p.index.vacuum(args.retain)}
    return _cache(args, p) if args.command == "cache" else _measure(args, p, spark)


def _moment(given: str | None):  # noqa: ANN202
    from datetime import datetime

    if given is None:
        return None
    try:
        at = datetime.fromisoformat(given)
    except ValueError as e:
        raise WeftlineError(f"{given!r} is no time") from e
    if at.tzinfo is None:
        raise WeftlineError("a time needs its zone")
    return F.lit(at)


def _cache(args: argparse.Namespace, p: Project) -> object:
    if args.action == "stats":
        return stats(p.cache.rows()).first().asDict()
    if args.action == "vacuum":
        return {"deleted": p.cache.vacuum()}
    if args.action in ("export", "import"):
        if not args.path:
            raise WeftlineError("a path is needed")
        path = p.store.path(args.path) if "://" not in args.path and not args.path.startswith("/") else args.path
        p.cache.export_jsonl(path, args.force) if args.action == "export" else p.cache.import_jsonl(path, args.trusted)
        return {"ok": True}
    if args.max_age_days is None and args.max_entries is None:
        raise WeftlineError("an age or a number of entries is needed")
    keep = lambda r: prune_age(r, F.current_timestamp() - F.make_interval(days=F.lit(args.max_age_days)))
    n = p.cache.prune(keep) if args.max_age_days is not None else 0
    return {"pruned": n + (p.cache.prune(lambda r: prune_lru(r, args.max_entries)) if args.max_entries is not None else 0)}


def _measure(args: argparse.Namespace, p: Project, spark: SparkSession) -> object:
    """Churn of the edits, or retrieval of questions with known evidence, over the project's documents; by the project's own chunker or by
    the named strategies at the sizes of the benchmark."""
    from .plans.catalogue import STRATEGIES

    if unknown := set(args.strategies) - set(STRATEGIES):
        raise WeftlineError(f"unknown strategies: {', '.join(sorted(unknown))}")
    chunkers = {s: STRATEGIES[s] for s in args.strategies} or {p.config.chunker.strategy: p.config.chunker.build()}
    docs = written(p.documents(), "measure")
    if args.what == "churn":
        price = p.config.embedding.price_per_million_tokens
        cut = lambda d, c: chunking.chunk_documents(d, c).select("chunk_hash", "token_count")
        return {s: {e: churn.bag_churn(cut(docs, c), cut(churn.edited(docs, e), c), price).first().asDict() for e in args.edits} for s, c in chunkers.items()}
    if not args.questions:
        raise WeftlineError("questions are needed")
    path = args.questions if "://" in args.questions or args.questions.startswith("/") else Store(spark, args.project).path(args.questions)
    asked = spark.read.schema("question_id string, query string, evidence array<string>").json(path).withColumn("corpus", F.lit("project"))
    chunks = reduce(DataFrame.unionByName, (chunking.chunk_documents(docs, c).select(F.lit(s).alias("strategy"), F.lit("project").alias("corpus"), "document_id", "chunk_index", "text") for s, c in chunkers.items()))
    try:
        found = retrieval.evaluate(chunks, asked, args.k, embedding.HashProvider() if args.scores == "hash" else None)
    except ValueError as e:
        raise WeftlineError(str(e)) from e
    return [r.asDict() for r in retrieval.summary(found).orderBy("strategy").collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        out = run(args, spark or SparkSession.builder.appName("weftline").getOrCreate())
        print(report.as_json(out) if args.format == "json" else report.render(out))
    except WeftlineError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
