from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.errors import BackendError, VerificationError, WeftlineError
from weftline.functions import hashing, text
from weftline.operators import chunking, churn, diff, embedding, merkle, retrieval
from weftline.plans import catalogue, manifest
from weftline.plans.index import Commit, Index, occurrences, problems
from weftline.sources.cache import KEY, Cache
from weftline.sources.files import excluded, read_documents
from weftline.tables import CommitLog

SMALL = chunking.CDC(chunking.CDCParams(window_words=4, min_tokens=8, max_tokens=24, primary_mask_bits=3, backup_mask_bits=2))
HASH = embedding.HashProvider("h", 32)


def target(spark, docs):
    return occurrences(chunking.chunk_documents(spark.createDataFrame(docs, "document_id string, text string"), SMALL))


GUIDE = " ".join(f"term-{i}" for i in range(180))


def test_life_of_an_index(spark, tmp_path):
    ix = Index(spark, f"file://{tmp_path}/ix")
    first = target(spark, [("guide.md", GUIDE), ("other.md", "a short note")])
    assert ix.plan(first, HASH)["counts"].where("kind = 'add'").first()["n"] == first.count() and ix.newest() is None
    one = ix.apply(first, HASH)
    assert one.generation == 1 and ix.apply(first, HASH).generation == 1
    assert ix.verify(first).count() == 0 and ix.query("short note", HASH, 1).first()["document_id"] == "other.md"
    second = target(spark, [("guide.md", "one more sentence first. " + GUIDE), ("renamed.md", "a short note")])
    cost = ix.plan(second, HASH)["cost"].first()
    ids = {r.instance_id for r in ix.active().collect()}
    two = ix.apply(second, HASH)
    s = ix.status().first()
    assert two.generation == 2 and two.corpus_root != one.corpus_root and s.active_chunks == second.count() and s.tombstones > 0
    assert 0 < cost.chunks_to_embed < cost.naive_chunks_to_embed and ids & {r.instance_id for r in ix.active().collect()}
    assert ix.compact(dry_run=True) == s.tombstones and ix.compact() == s.tombstones and ix.status().first().tombstones == 0
    with pytest.raises(BackendError):
        ix._publish(Commit(2, "r", "m", "p", 1))
    with pytest.raises(BackendError):
        ix.query("x", embedding.HashProvider("other", 32))
    moved = ix.apply(second, embedding.HashProvider("other", 32))
    assert moved.corpus_root == two.corpus_root and not {r.instance_id for r in ix.active().collect()} & ids
    bad = second.withColumn("token_count", F.col("token_count") + 1)
    assert {r.problem for r in ix.verify(bad).collect()} == {"other token_count"}


def test_an_edit_writes_new_texts_only(spark, tmp_path):
    ix = Index(spark, f"file://{tmp_path}/ix")
    ix.apply(target(spark, [("a.md", GUIDE), ("b.md", "a short note"), ("c.md", "")]), HASH)
    two = ix.apply(target(spark, [("a.md", GUIDE), ("b.md", "another note"), ("d.md", "a short note")]), HASH)
    assert len(two.bodies) == 2 and spark.read.parquet(f"{tmp_path}/ix/{two.bodies[1]}").count() == 1
    assert sorted(r.document_id for r in ix.documents().collect()) == ["a.md", "b.md", "d.md"] and ix.verify().count() == 0
    every = spark.createDataFrame([("a.md", "{}"), ("e.md", '{"b": 1, "a": 2}')], "document_id string, metadata string")
    three = ix.apply(target(spark, [("a.md", GUIDE)]), HASH, documents=every)
    assert ix.verify().count() == 0 and {r.document_id: (r.chunk_count, r.metadata) for r in ix.documents().collect()}["e.md"] == (0, '{"a":2,"b":1}')
    with pytest.raises(BackendError, match="changed since"):
        ix.apply(target(spark, [("a.md", "x")]), HASH, expected=two.generation)
    ix.compact()
    assert len(ix.newest().bodies) == 1 and ix.newest().generation == three.generation + 1 and ix.verify().count() == 0


def test_verify_names_what_was_tampered_with(spark, tmp_path):
    ix = Index(spark, f"file://{tmp_path}/ix")
    assert [r.problem for r in ix.verify().collect()] == ["no index"]
    now = ix.apply(target(spark, [("a.md", GUIDE), ("b.md", "a short note")]), HASH)
    part, body = next(iter(now.tables["chunks"])), f"{tmp_path}/ix/{now.bodies[0]}"

    def found(part, change):
        import shutil

        shutil.move(part, f"{part}.kept")
        change(spark.read.text(f"{part}.kept") if "/manifest/" in part or "/mirror/" in part else spark.read.parquet(f"{part}.kept"), part)
        try:
            return {r.problem for r in ix.verify().collect()}
        finally:
            shutil.rmtree(part, ignore_errors=True)
            shutil.move(f"{part}.kept", part)

    only = lambda c, new: F.when(F.col("document_id") == "b.md", new).otherwise(F.col(c))
    rows = lambda c, new: lambda df, p: df.withColumn(c, only(c, new)).write.parquet(p)
    chunks, docs, lined, mirror = (f"{tmp_path}/ix/{part}/{t}/bucket=0" for t in ("chunks", "documents", "manifest", "mirror"))
    assert found(chunks, rows("start_offset", F.lit(1).cast("long"))) == {"other start_offset", "other record digest"}
    assert found(chunks, rows("metadata", F.lit("[1]"))) == {"metadata unreadable", "other record digest"}
    assert found(chunks, rows("metadata", F.lit('{"token_count": 9}'))) == {"other token_count in metadata", "other metadata", "other record digest"}
    assert found(chunks, rows("model_id", F.lit("x"))) == {"embedded by another model", "other record digest"}
    assert found(chunks, lambda df, p: df.where("document_id <> 'b.md'").write.parquet(p)) == {"position not indexed"}
    assert found(chunks, lambda df, p: df.unionByName(df).write.parquet(p)) == {"position held twice"}
    assert found(docs, rows("root_hash", F.lit("x"))) == {"other root hash"} and found(docs, rows("chunk_count", F.lit(7))) == {"other number of chunks"}
    assert found(docs, rows("hard_cuts", F.lit(7))) == {"other number of hard cuts"} and found(docs, rows("metadata", F.lit('{"x":1}'))) == {"other document metadata"}
    assert found(docs, rows("metadata", F.lit("{"))) == {"document metadata unreadable"} and found(docs, lambda df, p: df.where("document_id <> 'b.md'").write.parquet(p)) == {"document not indexed"}
    short = F.col("text") == "a short note"
    assert found(body, lambda df, p: df.withColumn("text", F.when(short, "changed").otherwise(F.col("text"))).write.parquet(p)) == {"hash is not that of the text", "other record digest"}
    assert found(body, lambda df, p: df.withColumn("vector", F.when(short, F.transform("vector", lambda x: -x)).otherwise(F.col("vector"))).write.parquet(p)) == {"other record digest"}
    assert found(body, lambda df, p: df.withColumn("vector", F.when(short, F.array(F.lit(float("nan")).cast("float"))).otherwise(F.col("vector"))).write.parquet(p)) == {"vector unusable"}
    assert found(body, lambda df, p: df.withColumn("vector", F.when(short, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vector"))).write.parquet(p)) == {"vector of other length", "other record digest"}
    lines = lambda a, b: lambda df, p: df.select(F.replace("value", F.lit(a), F.lit(b))).write.text(p)
    assert "manifest has another root" not in found(lined, lambda df, p: df.write.text(p))
    assert found(lined, lines('"schema_version":1', '"schema_version":2')) >= {"manifest is invalid: another schema version"}
    assert found(lined, lines('"root_hash":"', '"root_hash":"0')) >= {"manifest is invalid: root hash is not that of its chunks", "manifest has another root"}
    assert found(lined, lambda df, p: None) == {"no manifest"} and ix.verify().count() == 0
    assert found(mirror, lambda df, p: None) == {"no mirror of the manifest"} and found(mirror, lambda df, p: df.limit(1).write.text(p)) == {"no mirror of the manifest"}
    assert found(mirror, lines('"hard_cuts"', '"x"')) == set() and found(mirror, lines('"metadata":{}', '"metadata":{"a":1}')) == {"mirror has another manifest"}
    assert found(mirror, lambda df, p: df.select(F.expr("left(value, 20)")).write.text(p)) == {"mirror of the manifest unreadable", "no mirror of the manifest"}


def size(path):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-"))


def test_what_an_edit_writes_grows_with_the_edit(spark, tmp_path):
    from pathlib import Path

    ix = Index(spark, f"file://{tmp_path}/ix", bucket_rows=40)
    docs = [(f"d{i}.md", f"number {i} " + GUIDE) for i in range(60)]
    one = ix.apply(target(spark, docs), HASH)
    assert one.buckets > 8 and sum(map(len, one.tables["chunks"].values())) > 4
    two = ix.apply(target(spark, [("d0.md", "another text"), *docs[1:]]), HASH)
    (part,) = set(two.tables["chunks"]) - set(one.tables["chunks"])
    assert two.tables["chunks"][part] == two.tables["documents"][part] and len(two.tables["chunks"][part]) == 1
    first = next(iter(one.tables["chunks"]))
    assert size(tmp_path / "ix" / part) * 3 < size(tmp_path / "ix" / first)
    assert ix.verify(target(spark, [("d0.md", "another text"), *docs[1:]])).count() == 0 and ix.status().first().document_count == 60
    three = ix.apply(target(spark, docs[1:]), HASH)
    assert ix.verify().count() == 0 and ix.status().first().document_count == 59 and ix.status().first().tombstones > 0
    assert ix.apply(target(spark, docs[1:]), HASH) == three
    assert ix.vacuum(1) >= 1 and ix.verify().count() == 0 and {f"rows/{p.name}" for p in Path(tmp_path / "ix/rows").iterdir()} == {p for t in three.tables.values() for p in t}
    ix.compact()
    assert ix.verify().count() == 0 and ix.newest().buckets >= 1


def test_leases(spark, tmp_path):
    ix = Index(spark, f"file://{tmp_path}/ix")
    ix.apply(target(spark, [("a.md", "first words")]), HASH)
    with ix.snapshot() as held:
        ix.apply(target(spark, [("a.md", "second words")]), HASH)
        ix.apply(target(spark, [("a.md", "third words")]), HASH)
        ix.compact()
        before = size(tmp_path / "ix")
        assert ix.vacuum(1) > 0 and size(tmp_path / "ix") < before
        assert [r.text for r in ix.active(held).collect()] == ["first words"] and [r.text for r in ix.active().collect()] == ["third words"]
    assert ix.vacuum(1) > 0 and ix.at(held.generation) is None and [r.text for r in ix.active().collect()] == ["third words"]
    with ix.snapshot(seconds=-1):  # run out at once
        assert ix.leases.read_generations() == set()
    with ix.leases.writing(), pytest.raises(BackendError, match="another writer"):
        ix.apply(target(spark, [("a.md", "fourth words")]), HASH)
    with ix.leases.writing(seconds=-1) as old:  # a writer that sleeps past its end
        fourth = ix.apply(target(spark, [("a.md", "fourth words")]), HASH)
        with pytest.raises(BackendError, match="passed"):
            ix._publish(Commit(fourth.generation + 1, "r", "m", "p", 1, fence=old))
    assert ix.newest() == fourth


def test_late_query(spark, tmp_path):
    ix = Index(spark, f"file://{tmp_path}/ix")
    ix.apply(target(spark, [(f"d{i:03d}.md", f"note {i % 7} on herons") for i in range(100)] + [("e.md", "")]), HASH)
    vector = HASH.embed(["note 3 on herons"])[0]
    exact = embedding.top_k(ix.active(), vector, 20, ["document_id", "start_offset"])
    key = ("score", "document_id", "text")
    assert [r[:] for r in ix.query("note 3 on herons", HASH, 20).select(*key).collect()] == [r[:] for r in exact.select(*key).collect()]
    rows = ix.active_rows().select("chunk_hash", "document_id", "start_offset")
    late = embedding.late_top_k(ix.bodies().select("chunk_hash", "vector"), rows, vector, 20, ["document_id", "start_offset"])
    plan = late._jdf.queryExecution().executedPlan().toString().replace("DataFilters", "")
    assert "vector" not in plan and "text:" not in plan and "BroadcastHashJoin" in plan
    for first, most in ((1, 100_000), (1, 2)):  # ties beyond the first hashes, and beyond all that are asked
        got = embedding.late_top_k(ix.bodies().select("chunk_hash", "vector"), rows, vector, 40, ["document_id", "start_offset"], first, most)
        want = embedding.top_k(ix.active(), vector, 40, ["document_id", "start_offset"])
        assert [r[:] for r in got.select("score", "document_id").collect()] == [r[:] for r in want.select("score", "document_id").collect()]
    torn = f"{tmp_path}/ix/{ix.newest().bodies[0]}"
    body = spark.read.parquet(torn).withColumn("vector", F.when(F.col("text").startswith("note 5"), F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vector"))).collect()
    spark.createDataFrame(body, "chunk_hash string, text string, vector array<float>").write.mode("overwrite").parquet(torn)
    with pytest.raises(Exception, match="is missing, not finite or not of 32 dimensions"):
        ix.query("note 3 on herons", HASH, 20)


def test_what_is_not_published(spark, tmp_path):
    ix = Index(spark, f"file://{tmp_path}/ix")
    good = target(spark, [("a.md", "some words here")])
    with pytest.raises(BackendError, match="twice"):
        ix.apply(good.unionByName(good), HASH)

    class Bad:
        model_id, params_hash, dimensions = "m", "p", 0

        def embed(self, texts):
            return [[] for _ in texts]

    with pytest.raises(BackendError, match="dimensions"):
        ix.apply(good, Bad())
    assert ix.newest() is None
    log = CommitLog(spark, f"file://{tmp_path}/log")
    log.publish(1, {"a": 1})
    (tmp_path / "log/00000002.json").write_text('{"a": ')
    assert log.newest() == (1, {"a": 1})
    with pytest.raises(BackendError):
        log.publish(1, {"a": 2})


def test_manifest_round_trip(spark, tmp_path):
    rows = occurrences(chunking.chunk_documents(spark.createDataFrame([("b.md", GUIDE), ("a \"q\".md", "x /y é")], "document_id string, text string"), SMALL))
    docs = manifest.documents(rows)
    lines = manifest.to_json(docs, rows)
    import json

    for r in lines.collect():
        assert json.dumps(json.loads(r.json), sort_keys=True, ensure_ascii=False, separators=(",", ":")) == r.json
    back, chunks = manifest.read_strict(lines.select(F.col("json").alias("value")))
    assert sorted(back.collect()) == sorted(docs.select(*back.columns).collect())
    key = ["document_id", "position", "chunk_hash", "start_offset", "end_offset", "token_count"]
    assert sorted(chunks.select(*key).collect()) == sorted(rows.select(*key).collect())
    with pytest.raises(VerificationError):
        manifest.read_strict(lines.select(F.replace("json", F.lit('"root_hash":"'), F.lit('"root_hash":"f')).alias("value")))
    less = manifest.without_documents(lines, lines.where("document_id = 'b.md'"))
    assert less.count() == 1 and manifest.with_documents(less, lines).count() == 2
    mixed = rows.withColumn("chunker_id", F.when(F.col("position") == 0, "other").otherwise(F.col("chunker_id")))
    with pytest.raises(Exception, match="different chunkers"):
        manifest.documents(mixed).collect()


def test_vectors_are_cached_and_work_goes_on_where_it_stopped(spark, tmp_path):
    cache, calls = Cache(spark, f"file://{tmp_path}/cache"), tmp_path / "calls"
    rows = spark.createDataFrame([(f"h{i}", f"text {i}", 2) for i in range(10)], "chunk_hash string, text string, token_count long")

    class Counting(embedding.HashProvider):
        def embed(self, texts):
            with calls.open("a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return super().embed(texts)

    provider = Counting("c", 8)
    want = {r.chunk_hash: r.vector for r in embedding.embed_texts(rows, embedding.HashProvider("c", 8)).collect()}
    embedding.embed_with_cache(rows.where("chunk_hash < 'h4'"), provider, cache, commit_rows=2)
    got = {r.chunk_hash: r.vector for r in embedding.embed_with_cache(rows, provider, cache, commit_rows=3).collect()}
    assert got == want and sorted(calls.read_text().split("\n")[:-1]) == sorted(f"text {i}" for i in range(10))  # each text once
    assert cache.rows().count() == 10
    data = embedding.vector_of(bytes(rows.limit(1).select(embedding.vector_bytes(F.array(F.lit(1.5).cast("float"), F.lit(-2.0).cast("float")))).first()[0]), 2)
    assert data == [1.5, -2.0]


def test_fifo_matching_of_repeats(spark):
    row = lambda p, h, a, m="{}", t=1: ("doc", p, h, a, a + 1, t, m, "{}")
    schema = "document_id string, position int, chunk_hash string, start_offset long, end_offset long, token_count long, metadata string, document_metadata string"
    old = spark.createDataFrame([row(0, "x", 0), row(1, "x", 5), row(2, "y", 9), row(3, "z", 12), row(4, "k", 20)], schema)
    new = spark.createDataFrame([row(0, "x", 5), row(1, "x", 7), row(2, "q", 9), row(3, "z", 12, "{}", 2), row(4, "k", 20)], schema)
    got = [(r.kind, r.chunk_hash, r.old_position, r.new_position) for r in diff.occurrence_diff(old, new).orderBy(*diff.plan_order()).collect()]
    assert got == [("keep", "x", 1, 0), ("keep", "k", 4, 4), ("move", "x", 0, 1), ("move", "z", 3, 3), ("add", "q", None, 2), ("delete", "y", 2, None)]


def test_merkle(spark):
    assert merkle.EMPTY == hashing.hash_fields("cairn-merkle-empty-v1", []) and merkle.EMPTY.startswith("c0975005")
    leaves = [str(i) for i in range(11)]
    assert merkle.root(leaves) != merkle.root(leaves[::-1]) and merkle.changed_leaves(leaves, [*leaves[:4], "x", *leaves[5:]]) == [4] and merkle.changed_leaves(leaves, leaves[:9]) == [9, 10]
    roots = [(f"d{i}", merkle.root([str(i)])) for i in range(70)]
    want = merkle.root([hashing.hash_fields("cairn-corpus-document-v1", list(r)) for r in sorted(roots)])
    table = spark.createDataFrame(roots, "document_id string, root_hash string")
    assert merkle.corpus_root(table) == want
    levels, merkle.BLOCK_LEVELS = merkle.BLOCK_LEVELS, 3
    try:
        assert merkle.corpus_root(table.repartition(5)) == want
    finally:
        merkle.BLOCK_LEVELS = levels
    assert merkle.corpus_root(table.limit(0)) == merkle.EMPTY


def test_cache(spark, tmp_path):
    c = Cache(spark, f"file://{tmp_path}/cache")
    row = lambda k, v: (k, "m", "p", len(v), v, 3)
    schema = "chunk_hash string, model_id string, params_hash string, dimensions int, vector array<float>, token_count long"
    c.put(spark.createDataFrame([row("a", [1.0, 0.0]), row("b", [0.0, 1.0])], schema))
    c.put(spark.createDataFrame([row("a", [1.0, 0.0])], schema))
    assert c.rows().count() == 2
    for bad in ([row("a", [2.0, 0.0])], [row("c", [float("nan"), 1.0])], [("", "m", "p", 1, [1.0], 1)], [row("d", [1.0]), row("d", [2.0])], [("e", "m", "p", 2, [1.0], 1)], [("e", "m", "p", 1, [1.0], -1)]):
        with pytest.raises(BackendError):
            c.put(spark.createDataFrame(bad, schema))
    assert c.rows().count() == 2
    got = {r.chunk_hash: r.vector for r in c.get(spark.createDataFrame([("a", "m", "p"), ("z", "m", "p")], "chunk_hash string, model_id string, params_hash string")).collect()}
    assert got == {"a": [1.0, 0.0], "z": None}
    assert {r.chunk_hash: r.hit for r in c.contains(spark.createDataFrame([("a", "m", "p"), ("z", "m", "p")], "chunk_hash string, model_id string, params_hash string")).collect()} == {"a": True, "z": False}
    c.export_jsonl(f"{tmp_path}/out")
    with pytest.raises(BackendError):
        c.export_jsonl(f"{tmp_path}/out")
    c.export_jsonl(f"{tmp_path}/out", force=True)
    d = Cache(spark, f"file://{tmp_path}/copy")
    with pytest.raises(BackendError):
        d.import_jsonl(f"{tmp_path}/out")
    for line in ('{"chunk_hash": "x"}', "[]", "no", '{"chunk_hash": "x", "model_id": "m", "params_hash": "p", "vector": [1.0], "token_count": "2"}', '{"chunk_hash": "x", "model_id": "m", "params_hash": "p", "vector": [1.0], "token_count": 2, "more": 1}'):
        (tmp_path / "bad.jsonl").write_text(line + "\n")
        with pytest.raises(BackendError):
            d.import_jsonl(f"{tmp_path}/bad.jsonl", trusted=True)
    assert d.rows().count() == 0
    d.import_jsonl(f"{tmp_path}/out", trusted=True)
    assert d.rows().count() == 2 and d.prune(lambda r: r.where("chunk_hash = 'a'")) == 1 and d.rows().select(*KEY).first()[0] == "a"
    assert d.vacuum() > 0 and d.rows().count() == 1
    with pytest.raises(BackendError):
        Cache(spark, f"file://{tmp_path}/copy", readonly=True).put(spark.createDataFrame([row("q", [1.0])], schema))


def test_files_that_are_not_chosen_are_not_opened(spark, tmp_path):
    (tmp_path / "in/[odd] {x}*?").mkdir(parents=True)
    (tmp_path / "in/[odd] {x}*?/a b.md").write_text("chosen")
    for name in ("film.mp4", "big.md"):
        with (tmp_path / "in" / name).open("wb") as f:
            f.truncate(3 << 30)  # more than a row can hold
    read = lambda *exclude: [(r.document_id, r.text) for r in read_documents(spark, f"file://{tmp_path}/in", exclude).collect()]
    assert read("big.md") == [("[odd] {x}*?/a b.md", "chosen")] and read("*.md") == []
    with pytest.raises(WeftlineError, match="big.md has more than"):
        read()


def test_parts_of_a_cache_stay_few(spark, tmp_path, monkeypatch):
    from weftline.sources import cache as module

    c = Cache(spark, f"file://{tmp_path}/cache")
    made = []
    monkeypatch.setattr(c, "_read", lambda parts, schema: spark.createDataFrame([], schema))
    monkeypatch.setattr(c, "_part", lambda kind, rows, tier=0: made.append(tier) or f"{kind}-{tier}-{len(made)}")
    parts: list[str] = []
    for _ in range(1000):
        parts = c._tiered("access", [*parts, c._part("access", None)])
    assert len(parts) <= module.FAN * 4 and max(made) == 3 and len(made) < 1000 * 1.2
    monkeypatch.undo()
    monkeypatch.setattr(module, "FAN", 2)
    for k in range(5):
        c.put(spark.createDataFrame([(f"k{j}", "m", "p", 1, [float(j)], 1) for j in (k, k + 1)], "chunk_hash string, model_id string, params_hash string, dimensions int, vector array<float>, token_count long"))
    state = c._state()
    assert len(state["data"]) <= 3 and len(state["access"]) <= 3 and sorted(r.chunk_hash for r in c.rows().collect()) == [f"k{j}" for j in range(6)]
    assert c.rows().where("accessed_at > created_at").count() >= 3


def test_files(spark, tmp_path):
    (tmp_path / "docs/drafts").mkdir(parents=True)
    (tmp_path / "docs/a.md").write_bytes(b"\xef\xbb\xbfhello \xc3\xa9")
    (tmp_path / "docs/drafts/b.txt").write_text("draft")
    (tmp_path / "docs/c.bin").write_bytes(b"\0\1")
    got = read_documents(spark, str(tmp_path), ("**/drafts/**",)).collect()
    assert [(r.document_id, r.text, r.size) for r in got] == [("docs/a.md", "hello é", 11)]
    (tmp_path / "docs/d.md").write_bytes(b"x\0y")
    with pytest.raises(Exception, match="not a text file"):
        read_documents(spark, str(tmp_path)).collect()
    (tmp_path / "docs/d.md").unlink()
    (tmp_path / "docs/sub").mkdir()
    (tmp_path / "docs/sub/e.md").write_text("deep")
    ids = lambda **o: sorted(r.document_id for r in read_documents(spark, f"file://{tmp_path}", **o).select("document_id").collect())
    assert ids(include=("docs/*.md",)) == ["docs/a.md"] and ids(include=("docs/**/*.md",)) == ["docs/a.md", "docs/sub/e.md"]
    assert ids(inputs=("docs/sub", "docs/sub/e.md")) == ["docs/sub/e.md"] and ids(protect=("docs/sub", "docs/drafts/b.txt")) == ["docs/a.md"]
    for wrong in ("../x", "none.md", "/etc"):
        with pytest.raises(Exception, match="source|path"):
            ids(inputs=(wrong,))
    (tmp_path / "docs/f.md").symlink_to("/etc/hostname")
    with pytest.raises(Exception, match="outside the base"):
        read_documents(spark, f"file://{tmp_path}").collect()
    assert excluded("docs/drafts/b.txt", ("**/drafts/**",)) and excluded("x/y.lock", ("*.lock",)) and not excluded("docs/a.md", ("**/drafts/**",))


def test_embedding_and_scores(spark):
    v = HASH.embed(["unchanged RAG chunks", ""])
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-12 and set(v[1]) == {0.0}
    calls = []

    class Flaky:
        model_id, params_hash, dimensions = "m", "p", 1

        def embed(self, texts):
            calls.append(1)
            if len(calls) < 3:
                raise embedding.TransientProviderError("busy")
            return [[1.0]] * len(texts)

    waits = []
    assert embedding.embed_checked(["a"], Flaky(), sleep=waits.append) == [[1.0]] and waits == [1, 2]
    with pytest.raises(Exception, match="conflicting"):
        embedding.distinct_inputs(spark.createDataFrame([("h", "a", 1), ("h", "b", 1)], "chunk_hash string, text string, token_count long")).collect()
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])], "id int, vector array<double>")
    assert [(r.id, r.score) for r in embedding.top_k(rows, [2.0, 0.0], 3, ["id"]).collect()] == [(1, 1.0), (2, 0.0), (3, float("-inf"))]
    found = spark.createDataFrame([("q", 1, 0.9, False), ("q", 2, 0.5, True), ("q", 3, 0.1, True)], "q string, id int, score double, relevant boolean")
    r = retrieval.recall_ndcg(retrieval.first_ranked(found, "q", ["id"], 2), "q", 2).first()
    assert r.recall == 0.5 and abs(r.ndcg - (1 / 1.584962500721156) / (1 + 1 / 1.584962500721156)) < 1e-9


def test_hash_embeddings_of_a_table_against_the_rule(spark, sf):
    import hashlib
    import math
    import re

    for r in catalogue.QUERIES["hash_embeddings"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        words, want = [w.casefold() for w in re.findall(r"[^\W_]+", r.text)], [0] * 256
        for f in words + [f"{a}\x1f{b}" for a, b in zip(words, words[1:])]:
            d = hashlib.blake2b(f.encode(), digest_size=16, person=b"cairn-hash-v1").digest()
            want[int.from_bytes(d[:8], "little") % 256] += 1 if d[8] & 1 else -1
        norm = math.sqrt(sum(v * v for v in want)) or 1.0
        assert r.vector == pytest.approx([v / norm for v in want], abs=1e-6)


def test_problems_names_repeats(spark):
    schema = "document_id string, position int, chunk_hash string, start_offset long, end_offset long, token_count long"
    good = spark.createDataFrame([("d", 0, "h", 0, 1, 1), ("d", 1, "k", 1, 2, 1)], schema)
    bad = good.where("position = 0").unionByName(good.where("position = 0"))
    assert {(r.position, r.problem) for r in problems(good, bad).collect()} == {(0, "position held twice"), (1, "position not indexed")}


def test_churn_grid_has_every_strategy_and_edit(spark, tmp_path):
    body = "# Title\n\nAlpha one went far. Alpha two stayed here! Three?\n\n## First\n\n{}\n\n## Second\n\nMore of alpha was seen.\n"
    texts = [body.format(" ".join(f"word{i % (40 + k)} lies here." for i in range(60))) for k in range(3)] + ["short", "", None]
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.strategy, r.operation): r for r in catalogue.churn_grid(spark, str(tmp_path)).collect()}
    assert set(got) == {(s, e) for s in ("fixed", "recursive", "semantic", "cdc-rabin", "cdc-rabin+snap") for e in churn.EDITS}

    def changed(text, operation):
        try:
            return churn.EDITS[operation](text) if text else text
        except ValueError:
            return text

    for (s, e), r in got.items():
        bag = lambda ts: Counter(c["chunk_hash"] for t in ts if t for c in chunking.split(t, catalogue.STRATEGIES[s]))  # noqa: B023, E731
        old, new = bag(texts), bag([changed(t, e) for t in texts])
        assert (r.old_chunks, r.new_chunks, r.reused, r.to_embed) == (old.total(), new.total(), (old & new).total(), (new - old).total())
        assert r.reembed_fraction == pytest.approx((new - old).total() / new.total())


def test_hash_features_are_remembered_by_the_batch(monkeypatch):
    provider = embedding.HashProvider("m", 8)
    monkeypatch.setattr(embedding, "_MOST_DIGESTS", 3)
    want = [provider.one(t) for t in ("", "One two one two.", "straße ÄÖ one")]
    assert want[0] == [0.0] * 8 and len(embedding._DIGESTS) <= 3 + 5
    assert [provider.one(t) for t in ("", "One two one two.", "straße ÄÖ one")] == want


def test_nearest_makes_no_row_a_pair(spark):
    rows = [(i, i % 3, [float(i % 7), 1.0, float(i % 5)]) for i in range(300)] + [(300, 1, [0.0, 0.0, 0.0]), (301, None, [1.0]), (302, 2, None)]
    df = spark.createDataFrame(rows, "v long, label int, e array<float>").coalesce(2)
    found = embedding.nearest(df, df.where("v % 100 = 0"), 4, "v", "label", "e").collect()
    assert len(found) <= 4 * 4 * 2  # four queries, two tasks

    def cosine(a, b):
        norms = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / norms, 9) if norms else 0.0

    for q in (0, 100, 200, 300):
        scored = sorted((-cosine(rows[q][2], e), v) for v, _, e in rows if v != q and e and len(e) == 3)[:4]
        assert sorted((-r.score, r.v) for r in found if r.q == q)[:4] == scored


def test_a_run_commits_to_the_cache_a_few_times_however_many_rows(spark, tmp_path):
    wanted = spark.range(200).selectExpr("sha2(string(id), 256) as chunk_hash", "concat('text ', id) as text", "1L as token_count")
    store, provider = Cache(spark, f"file://{tmp_path}/cache"), embedding.HashProvider("m", 4)
    assert embedding.embed_with_cache(wanted, provider, store, commit_rows=10).count() == 200
    assert store.log.newest()[0] <= 8 and store.rows().count() == 200


def test_holding_keeps_no_text_beside_each_word(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "One two  THREE four five six."), (1, "nothing of it"), (None, "zero one two three four five six. seven"), (2, None)], "t int, text string")
    asked = spark.createDataFrame([(7, "one two three four five six."), (8, "two THREE")], "p int, text string")
    out = retrieval.holding(texts, asked, "t", "p")
    assert Counter((r.t, r.p) for r in out.collect()) == Counter([(1, 7), (1, 8), (None, 7), (None, 8)])
    seen, real = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: seen.append(df.columns) or real(df, name))
    retrieval.holding(texts, asked, "t", "p").count()
    assert seen == [["__id", "__pid", "passage"]]


def test_churn_grid_writes_no_texts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"One {i} is here. Two words follow it.", "s", "en") for i in range(5)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, real = [], churn.written
    for module in (catalogue, churn):
        monkeypatch.setattr(module, "written", lambda df, name: seen.append((df.columns, df.count())) or real(df, name))
    assert catalogue.churn_grid(spark, str(tmp_path)).count() == 45
    assert seen and not any({"text", "chunk_hash"} & set(columns) or n > 50 for columns, n in seen)


CORPORA = [
    ("guide", "a.md", "# Field guide\n\nOwls hunt at night. They fly without a sound! Can you hear owls?\n\n## Food\n\nOwls eat mice and voles. A pellet tells what an owl ate.\n\n## Nests\n\nMost owls nest in hollow trees. Some owls take old nests.\n"),
    ("guide", "b.md", "A short note on herons."),
    ("lease", "c.md", "# Lease\n\nThe tenant pays rent on Monday. The tenant keeps the harbour clean.\n\n## Repairs\n\nThe landlord repairs the quay wall each spring.\n\n## End\n\nThe lease ends when the tenant gives notice in writing.\n"),
]


def test_edit_cases_and_corpus_churn(spark):
    docs = spark.createDataFrame(CORPORA, "corpus string, document_id string, text string")
    cases = churn.edit_cases(docs).collect()
    assert {(c.corpus, c.document_id) for c in cases} == {("guide", "a.md"), ("lease", "c.md")} and len(cases) == 18
    with pytest.raises(Exception, match="no document allows"):
        churn.edit_cases(docs.where("document_id = 'b.md'")).collect()
    small = chunking.Recursive(8, 2)

    def cut(df):
        others = [c for c in df.columns if c != "text"]
        return churn.split_documents(df, lambda t: chunking.split(t, small)).select(*others, "chunk_hash", "token_count")

    got = {(r.corpus, r.operation): r for r in churn.corpus_churn(docs, cut, 1.0).collect()}
    for c in cases:
        bag = lambda t: Counter(x["chunk_hash"] for x in chunking.split(t, small))
        other = sum((bag(t) for k, d, t in CORPORA if k == c.corpus and d != c.document_id), Counter())
        old, new, r = bag(c.original) + other, bag(c.revised) + other, got[c.corpus, c.operation]
        assert (r.old_chunks, r.new_chunks, r.reused, r.to_embed) == (old.total(), new.total(), (old & new).total(), (new - old).total())
    t = churn.totals(spark.createDataFrame([("s", 4, 4, 3, 1, 10), ("s", 6, 6, 6, 0, 0)], "strategy string, old_chunks long, new_chunks long, reused long, to_embed long, tokens_to_embed long")).first()
    assert (t.to_embed, t.reembed_fraction) == (1, 0.1)


def test_chunks_of_any_splitter():
    class Doc:
        page_content, token_count = "a b c", True

    digest = lambda t: __import__("hashlib").sha256(b"cairn:measure:chunk:v1\0" + t.encode()).hexdigest()
    assert churn.snapshot("x y") == (digest("x y"), "x y", 2) and churn.snapshot(Doc()) == (digest("a b c"), "a b c", 3)
    assert churn.snapshot({"text": "q", "chunk_hash": "h", "token_count": 7}) == ("h", "q", 7)
    with pytest.raises(TypeError):
        churn.snapshot(5)


def test_retrieval_benchmark(spark):
    docs = spark.createDataFrame(CORPORA, "corpus string, document_id string, text string")
    questions = spark.createDataFrame([("q1", "guide", "what do owls eat", ["owls  EAT mice"]), ("q2", "lease", "who repairs the quay wall", ["landlord repairs the quay wall"])], "question_id string, corpus string, query string, evidence array<string>")
    chunks = None
    for name, c in {"fixed": chunking.Fixed(12), "recursive": chunking.Recursive(24, 4)}.items():
        own = chunking.chunk_documents(docs.where("true"), c).join(docs.select("document_id", "corpus"), "document_id").select(F.lit(name).alias("strategy"), "corpus", "document_id", "chunk_index", "text")
        chunks = own if chunks is None else chunks.unionByName(own)
    for scorer in (None, embedding.HashProvider("r", 256)):
        got = retrieval.evaluate(chunks, questions, 3, scorer)
        assert got.count() == 4 and all(r.recall == 1.0 and r.ndcg > 0.9 and r.top_chunks[0].relevant for r in got.collect())
        assert {r.strategy: r.questions for r in retrieval.summary(got).collect()} == {"fixed": 2, "recursive": 2}
    with pytest.raises(ValueError, match="unknown corpus"):
        retrieval.evaluate(chunks, questions.withColumn("corpus", F.lit("none")))
    with pytest.raises(ValueError, match="evidence"):
        retrieval.evaluate(chunks, questions.withColumn("evidence", F.array(F.lit("no such words"))))
    with pytest.raises(ValueError, match="positive"):
        retrieval.evaluate(chunks, questions, 0)


def test_case_folding_and_normalising_in_columns(spark):
    chars = [chr(c) for c in [*range(1, 0x3000), *range(0xA640, 0xABC0), *range(0xFB00, 0xFB18), *range(0x10400, 0x10450), 0x1E9E] if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"a{c}Σ bΣ") for c in chars], "c string, t string").select("t", text.casefold_column(F.col("t")).alias("f")).collect()
    wrong = [r.t for r in rows if r.f != r.t.casefold()]
    assert len(wrong) <= 40, wrong  # letters that the JVM's Unicode doesn't know yet
    odd = ["  a\x1c b\r\n\r\nc \n \t\n\n d", "\u3000x\u2003 y\n\n", "", " \n\n ", "a\n\n\n\nb", "\ufdd0 z", "x" + " " * 20000 + "y" + " " * 20000]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select("t", text.normalized_column(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [text.normalize(t).text for t in odd]


def test_passages_are_found_wherever_they_stand(spark):
    texts = [(1, "The quick brown Fox  jumps over it"), (2, "xthe quick brown foxy"), (3, "quick brown"), (4, None), (5, ""), (6, "STRASSE in der Stadt hier")]
    passages = [(1, "the quick brown fox"), (2, "brown fox jumps over"), (3, "quick"), (4, "straße in der stadt hier"), (5, "a b c d e")]
    got = retrieval.holding(spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame(passages, "p long, text string"), "t", "p", 2)
    fold = lambda x: " ".join((x or "").casefold().split())
    assert sorted(map(tuple, got.collect())) == sorted((t, p) for t, a in texts for p, b in passages if a is not None and fold(b) in fold(a))


def test_a_revision_is_cut_only_about_its_edit():
    from weftline.functions.text import normalize, renormalized

    text = " ".join(f"word{i * i % 997} lies{i % 13}" + ("." if i % 7 == 0 else "") + ("\n\n" if i % 90 == 89 else "") for i in range(3000))
    old, own = normalize(text), catalogue.STRATEGIES | {"back": chunking.Fixed(48, 12)}
    for operation, edit in churn.EDITS.items():
        whole = normalize(edit(text))
        new, first, last = renormalized(old, edit(text))
        assert (new.words, new.starts.tolist(), new.ends.tolist(), new.paragraph.tolist(), new.sentence_ends) == (whole.words, whole.starts.tolist(), whole.ends.tolist(), whole.paragraph.tolist(), whole.sentence_ends)
        for name, chunker in own.items():
            cutting = churn.Cutting(chunker, old)
            i, j, spans = cutting.recut(new, first, last)
            by = len(new) - len(old)
            assert cutting.spans[:i] + spans + [(a + by, b + by) for a, b in cutting.spans[j:]] == [c[:2] for c in chunker.cuts(whole)]
            if operation in ("insert-sentence", "delete-sentence", "replace-same-length") and name not in ("fixed", "back"):
                assert len(spans) < 20 < len(cutting.spans)


def test_tfidf_top_writes_no_row_a_term(spark, monkeypatch):
    words = ["alpha", "Beta", "gamma", "ΣΊΣΥΦΟΣ", "Straße", "été", "the", "x1", "ᾀͅ", "ǰ", "µm"]
    rows = [(i % 37 if i % 11 else None, " ".join(words[(i * j + j * j) % len(words)] + (str(i % 5) if j % 4 == 0 else "") for j in range(i % 9))) for i in range(80)] + [(90, None), (91, "")]
    texts = spark.createDataFrame(rows, "text_id int, text string")
    asked = spark.createDataFrame([("a", "Alpha beta0 STRASSE"), ("b", "σίσυφος the été x1"), ("c", "unknown words"), ("d", None), ("a", "gamma"), (None, "alpha")], "query_id string, text string")
    want = {(r.query_id, r.text_id): r.score for r in retrieval.tfidf_scores(asked, texts).collect()}
    monkeypatch.setattr(retrieval, "FREQUENT", 3)
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    seen, real = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: seen.append(df.columns) or real(df, name))
    found = {(r.query_id, r.text_id): r.score for r in retrieval.tfidf_top(asked, texts, 4).collect()}
    assert seen == [["text_id", "tokens", "tfs"], ["token", "df"]]
    assert len(found) >= 8 and all(want[p] == pytest.approx(score) for p, score in found.items())
    for q in ("a", "b"):
        kth = sorted((v for (x, _), v in want.items() if x == q), reverse=True)[:4][-1]
        assert {p for p, v in want.items() if p[0] == q and v >= kth - 1e-9} <= set(found)
    assert set(found) <= set(want)


def test_an_index_writes_texts_once_beside_its_bodies(spark, tmp_path, monkeypatch):
    import os

    from weftline.plans import index

    seen, real = [], index.written
    monkeypatch.setattr(index, "written", lambda df, name, *more: (out := real(df, name, *more), seen.append((name, df.columns, out.inputFiles())))[0])
    ix = Index(spark, f"file://{tmp_path}/ix")
    for text_of in (GUIDE, "one more sentence first. " + GUIDE):
        ix.apply(target(spark, [("guide.md", text_of), ("other.md", "a short note")]), HASH)
    assert [name for name, columns, _ in seen if "text" in columns] == ["index-target"] * 2
    assert not [f for _, _, files in seen for f in files if os.path.exists(f.removeprefix("file://"))]
    seen.clear()
    assert ix.verify().count() == 0 and seen and not any("text" in columns for _, columns, _ in seen)
