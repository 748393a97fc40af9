import json

import pytest

from weftline import cli, config
from weftline.errors import BackendError, ConfigError, ProviderError, WeftlineError
from weftline.operators import chunking, churn, embedding
from weftline.plans.index import Index
from weftline.plans.service import Project
from weftline.sources.files import read_documents
from weftline.streaming.ingest import follow


def test_config_round_trip_and_refusals():
    assert config.loads(config.render(config.Config())) == config.Config()
    for bad in ("[chunker]\nwindow_words = 1", "[chunker]\nother = 1", "[other]", "[embedding]\ndimensions = true", "x =", "[sources]\nexclude = ['../x']", "[embedding]\nprice_per_million_tokens = -1.0", "[chunker]\nmin_tokens = 640"):
        with pytest.raises(ConfigError):
            config.loads(bad)


def run(spark, capsys, tmp_path, *args):
    code = cli.main(["--project", str(tmp_path), *args], spark)
    out = capsys.readouterr().out
    return code, json.loads(out) if out else None


def test_commands(spark, tmp_path, capsys):
    go = lambda *a: run(spark, capsys, tmp_path, *a)
    assert go("plan")[0] == 4 and go("init")[0] == 0 and go("init")[0] == 4
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("unchanged retrieval chunks " * 100)
    (tmp_path / "docs/b.md").write_text("another note entirely")
    first = go("plan", "--show", "2")[1]
    assert first["operations"]["add"] >= 2 and [f["kind"] for f in first["first"]] == ["add"] * 2 and go("index")[1]["generation"] == 1
    assert go("query", "another note")[1][0]["document_id"].endswith("b.md") and go("verify")[0] == 0
    (tmp_path / "docs/b.md").unlink()
    assert go("verify")[0] == 2 and go("index")[0] == 1 and go("index", "--allow-deletes")[1]["generation"] == 2
    assert go("status")[1]["tombstones"] == 1 and go("compact")[1] == {"tombstones": 1}
    before = (tmp_path / config.FILENAME).read_text()
    assert go("migrate", "--strategy", "fixed")[1]["changes"] == ["chunker"] and (tmp_path / config.FILENAME).read_text() == before
    assert go("migrate", "--strategy", "fixed", "--model", "m2", "--apply")[0] == 1  # chunks would be withdrawn
    assert go("migrate", "--strategy", "fixed", "--model", "m2", "--apply", "--allow-deletes")[1]["recovered"] == "forward"
    assert 'strategy = "fixed"' in (tmp_path / config.FILENAME).read_text() and go("verify")[0] == 0
    assert go("rollback")[1]["operations"]["add"] > 0 and (tmp_path / config.FILENAME).read_text() != before and go("rollback", "--apply")[0] == 1
    assert go("rollback", "--apply", "--allow-deletes")[1]["recovered"] == "forward" and (tmp_path / config.FILENAME).read_text() == before and go("verify")[0] == 0
    seen = go("cache", "stats")[1]["entries"]
    assert seen >= 3 and go("measure", "churn", "--edits", "append")[1]["cdc-rabin"]["append"]["to_embed"] >= 1
    assert go("migrate", "--strategy", "fixed", "--model", "m2")[1]["cost"]["chunks_to_embed"] == 0  # all of it is in the cache
    (tmp_path / "q.jsonl").write_text('{"question_id": "q", "query": "retrieval chunks", "evidence": ["unchanged retrieval"]}\n')
    assert go("measure", "retrieval", "--questions", "q.jsonl", "--strategies", "fixed", "recursive")[1][0]["recall"] > 0
    assert go("compact", "--before", "2024-01-01")[0] == 1 and go("compact", "--before", "2000-01-01T00:00:00+00:00", "--dry-run")[1] == {"tombstones": 0}
    assert cli.main(["--project", str(tmp_path), "--format", "table", "status"], spark) == 0 and "active_chunks" in capsys.readouterr().out
    assert go("plan", "none.md")[0] == 1 and go("plan", "a.md")[1]["operations"]["add"] == 0


def test_a_migration_that_stopped_early_goes_back(spark, tmp_path):
    Project.init(spark, tmp_path)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("some words")
    p = Project(spark, tmp_path)
    p.apply()
    journal = tmp_path / ".weftline/migration.json"
    journal.write_text(json.dumps({"version": 2, "kind": "migration", "generation": 1, "model_id": "hash:x", "params_hash": "y", "config": "", "previous": "", "config_sha256": "", "previous_sha256": "", "root": None, "old": None}))
    assert p.recover() == "back" and not journal.exists() and p.recover() == "nothing"
    with pytest.raises(WeftlineError, match="receipt"):
        p.rollback()


def test_a_splitter_of_one_s_own(spark, tmp_path, monkeypatch):
    class Piece:
        def __init__(self, text):
            self.page_content = text

    lines = chunking.Own("lines", lambda t: [Piece(x) for x in t.split("\n")])
    monkeypatch.setattr(chunking, "OWN", {})
    chunking.register("lines", lambda: lines)
    Project.init(spark, tmp_path)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("one line\n\nanother  line here\nand one line")
    p = Project(spark, tmp_path)
    p.apply()
    assert p.migrate(strategy="lines", apply=True, allow_deletes=True)["recovered"] == "forward"
    got = sorted((r.position, r.text, r.start_offset, r.end_offset) for r in p.index.active().collect())
    assert got == [(0, "one line", 0, 8), (1, "another line here", 10, 28), (2, "and one line", 29, 41)] and p.verify() is None
    assert {r.chunker_id for r in p.index.documents().collect()} == {"lines"} and Project(spark, tmp_path).config.chunker.build() == lines
    assert chunking.Own("lines", str.split, "2").params_hash != lines.params_hash
    with pytest.raises(ValueError, match="does not hold"):
        chunking.split("some text", chunking.Own("bad", lambda t: ["other"]))
    for wrong in ("fixed", "lines"):
        with pytest.raises(ConfigError):
            chunking.register(wrong, lambda: lines)


def test_rollback(spark, tmp_path, monkeypatch):
    Project.init(spark, tmp_path)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("some words " * 300)
    p = Project(spark, tmp_path)
    one, text = p.apply(), (tmp_path / config.FILENAME).read_text()
    rows = sorted(r.chunk_hash for r in p.index.active_rows().collect())
    p.migrate(strategy="fixed", apply=True, allow_deletes=True)
    (tmp_path / "docs/b.md").write_text("a new file")
    with pytest.raises(WeftlineError, match="no longer make"):  # the old root can't be made of these sources
        p.rollback()
    (tmp_path / "docs/b.md").unlink()
    monkeypatch.setattr(p, "recover", lambda: "stopped")  # a crash between the index and the configuration
    assert p.rollback(apply=True, allow_deletes=True)["published"] == 3
    now = p.index.newest()
    assert (now.corpus_root, now.tables, now.bodies) == (one.corpus_root, one.tables, one.bodies) and (tmp_path / config.FILENAME).read_text() != text
    again = Project(spark, tmp_path)
    assert again.recover() == "forward" and (tmp_path / config.FILENAME).read_text() == text and again.recover() == "nothing"
    assert sorted(r.chunk_hash for r in again.index.active_rows().collect()) == rows and again.index.verify().count() == 0
    assert again.receipt()["kind"] == "rollback" and again.rollback()["generation"] == 2  # a rollback can be taken back
    again.migrate(strategy="recursive", apply=True, allow_deletes=True)
    again.index.vacuum(1)
    assert again.index.at(3) is None and again.rollback(apply=True, allow_deletes=True)["recovered"] == "forward"  # made anew
    assert again.index.newest().corpus_root == one.corpus_root and again.index.verify().count() == 0
    receipt = sorted((tmp_path / ".weftline/receipts").iterdir())[-1]
    receipt.write_text(receipt.read_text().replace("min_tokens", "min_tokenz", 1))
    with pytest.raises(ConfigError, match="not what it was"):
        again.rollback()


def test_adoption_of_an_earlier_configuration(spark, tmp_path):
    (tmp_path / "old.toml").write_text('[index]\nbackend = "files"\ndatabase = "state/ix"\n[chunker]\nmin_tokens = 20\n')
    Project.adopt(spark, tmp_path, "old.toml")
    c = Project(spark, tmp_path).config
    assert c.store.index == "state/ix" and c.chunker.min_tokens == 20
    with pytest.raises(BackendError):
        Project.adopt(spark, tmp_path, "old.toml")


def test_embedding_service(tmp_path, monkeypatch):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    answers = [(429, {}), (200, {"data": [{"index": 1, "embedding": [0.0, 2.0]}, {"index": 0, "embedding": [1.0, 0.0]}]}), (400, {}), (200, {"data": [{"index": 0, "embedding": [1.0, 0.0]}] * 2}), (200, [])]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert asked["input"] == ["a", "b"] and self.headers["Authorization"] == "Bearer k" and self.path == "/v1/embeddings"
            code, body = answers.pop(0)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("KEY", "k")
    p = embedding.make_provider("openai", "m", 2, "KEY", f"http://127.0.0.1:{server.server_port}/v1")
    assert embedding.embed_checked(["a", "b"], p, sleep=lambda _: None) == [[1.0, 0.0], [0.0, 2.0]]
    for _ in range(3):
        with pytest.raises(ProviderError):
            p.embed(["a", "b"])
    server.shutdown()
    monkeypatch.delenv("KEY")
    with pytest.raises(ProviderError, match="KEY"):
        p.embed(["a", "b"])


def test_stream_of_files(spark, tmp_path):
    ix, provider = Index(spark, f"file://{tmp_path}/ix"), embedding.HashProvider("s", 16)
    (tmp_path / "in").mkdir()
    for k, text in enumerate(("first file", "second file")):
        (tmp_path / f"in/{k}.txt").write_text(text)
        follow(spark, f"{tmp_path}/in", ix, chunking.Fixed(8), provider, f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.text for r in ix.active().collect()) == ["first file", "second file"] and ix.newest().generation == 2


def test_stream_names_files_by_their_path_below_the_folder(spark, tmp_path):
    ix, provider = Index(spark, f"file://{tmp_path}/ix"), embedding.HashProvider("s", 16)
    batches = [{"a/README.md": "one", "b/README.md": "two", "a b/c+d %20#ä.md": "three"}, {"c/README.md": "four"}, {"d/README.md": "five"}]
    for files in batches:
        for name, text in files.items():
            (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / name).write_text(text)
        follow(spark, f"{tmp_path}/in", ix, chunking.Fixed(8), provider, f"{tmp_path}/cp").awaitTermination()
    want = {k: v for files in batches for k, v in files.items()}
    assert {r.document_id: r.text for r in ix.active().collect()} == want
    assert {r.document_id for r in read_documents(spark, f"file://{tmp_path}/in").collect()} == set(want)


def test_edits():
    text = "# Title\n\nAlpha one. Alpha two! Three?\n\n## First\n\nBody alpha here.\n\n## Second\n\nMore alpha.\n"
    got = {k: f(text) for k, f in churn.EDITS.items()}
    assert got["insert-sentence"].startswith(f"# Title\n\nAlpha one. {churn.SENTENCE} Alpha two!")
    assert f"Three?\n\n{churn.PARAGRAPH}\n\n## First" in got["insert-paragraph"] and f"here.\n\n{churn.SECTION}\n\n## Second" in got["insert-section"]
    assert "Alpha two" not in got["delete-sentence"] and "Alpha one" not in got["delete-paragraph"] and got["delete-paragraph"].endswith("\n")
    assert len(got["replace-same-length"]) == len(text) and got["replace-same-length"] != text
    assert got["reorder-sections"].index("## Second") < got["reorder-sections"].index("## First") and got["append"].startswith(text.rstrip())
    assert got["global-replace"].count("Alpha-revised") == 4
    for k, bad in (("delete-sentence", "One."), ("delete-paragraph", "One."), ("replace-same-length", "123"), ("global-replace", "no repeats")):
        with pytest.raises(ValueError):
            churn.EDITS[k](bad)
