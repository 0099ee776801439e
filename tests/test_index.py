import io
import json

import pytest

from marginalia import cli, config, server
from marginalia.operators.embed import HashingEmbedder, HttpEmbedder
from marginalia.plans import sync as plans
from marginalia.service import NoteIndex
from marginalia.sources import vault
from marginalia.streaming.watch import latest, watch


def settings(root, **more):
    return config.Config(vault_path=root / "vault", vector_path=root / "v", keyword_path=root / "k", state_path=root / "s", chunk_size=40, chunk_overlap=5, **more)


def write(root, name, text):
    p = root / "vault" / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return p


@pytest.fixture
def index(spark, tmp_path):
    write(tmp_path, "a.md", "---\nstatus: todo\ndue: \"2026-02-24\"\n---\n# A\nhello world planning [[b]] #x\n")
    write(tmp_path, "b.md", "# B\nother note about planning\r\nsecond line\n")
    write(tmp_path, "sub dir/_c.md", "# C\ndentist appointment [[b|see]]\n")
    return NoteIndex(spark, settings(tmp_path), HashingEmbedder(16))


def test_scan(spark, tmp_path):
    for name in ("z.md", "a/b.md", "a.md", "_u.md", "_d/c.md", ".h/x.md", "a/.y.md", "Templates/t.md", "Templates/s/t.md", "TemplatesX.md", "n.txt", "é %20#.md", "e.MD"):
        write(tmp_path, name, "x")
    write(tmp_path, "empty.md", "")
    write(tmp_path, "bad.md", b"\xff\xfe")
    vault.register(spark)
    rows = spark.read.format("vault").option("exclude", json.dumps(["Templates/**"])).option("filesPerPartition", "2").load(str(tmp_path / "vault")).orderBy("seq").collect()
    assert [r.path for r in rows] == sorted(["_d/c.md", "_u.md", "a/b.md", "a.md", "bad.md", "empty.md", "z.md", "é %20#.md"], key=lambda p: p.split("/"))
    by = {r.path: r for r in rows}
    assert by["bad.md"].text is None and "bad.md" in by["bad.md"].error and by["empty.md"].text == "" and by["a.md"].mtime > 0
    assert vault.listing(str(tmp_path / "vault"), ["**"]) == []
    globs = ["Templates/**", "*/b.md", "a?md", "sub/[xy].md"]
    paths = ["Templates/t.md", "TemplatesX.md", "q/b.md", "b.md", "a.md", "abmd", "p/sub/x.md", "sub/z.md", ".git/x.md", "d/.e/f.md", "ok.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r[0]: r[1] for r in df.select("path", vault.excluded_column(df.path, globs)).collect()} == {p: vault.excluded(p, globs) for p in paths}


def test_life_of_an_index(index, tmp_path):
    assert index.sync() == {"processed": 3, "skipped": 0, "deleted": 0, "errors": []}
    assert index.sync() == {"processed": 0, "skipped": 3, "deleted": 0, "errors": []}
    status = index.status()
    assert (status["index_size"], status["last_tracked_files"], status["watcher_state"], status["model_available"]) == (3, 3, "enabled", True) and status["last_sync_timestamp"] > 0
    assert index.health() == {"vectors": True, "embedder": True, "keywords": True}
    hits = index.search("  Planning ", top_k=2)["hits"]
    assert {h["metadata"]["path"] for h in hits} == {"a.md", "b.md"} and {h["source"] for h in hits} == {"hybrid"}
    assert index.search("planning", {"status": "todo"})["hits"][0]["metadata"]["raw_frontmatter"] == {"status": "todo", "due": "2026-02-24"}
    answer = index.query("dentist", {"path_prefix": "sub dir/"})
    assert answer["answer_draft"] == "- sub dir/_c.md :: C" and answer["citations"][0]["heading_path"] == "C" and len(answer["debug_scores"]) == 1
    assert index.query("zzz", {"status": "none"})["answer_draft"] == "No relevant context found."
    context = index.note_context("a.md", backlinks=True)
    assert (context["chunk_count"], context["outlinks"], context["backlinks"]) == (1, ["b"], [])
    assert index.note_context("b.md", backlinks=True)["backlinks"] == ["a.md", "sub dir/_c.md"] and index.note_context("b.md")["backlinks"] == []
    # a change replaces, a copy survives the removal of its twin, an error keeps what was there
    write(tmp_path, "copy.md", "# B\nother note about planning\nsecond line\n")
    write(tmp_path, "a.md", "# A\nsomething else\n")
    assert index.sync("file", "a.md") == {"processed": 1, "skipped": 0, "deleted": 0, "errors": []}
    assert [h["metadata"]["path"] for h in index.search("hello world", {"path": "a.md"})["hits"]] == ["a.md"] and index.note_context("a.md")["chunk_count"] == 1
    assert index.sync()["processed"] == 1
    (tmp_path / "vault/copy.md").unlink()
    write(tmp_path, "sub dir/_c.md", b"\xff")
    done = index.sync()
    assert (done["processed"], done["deleted"], len(done["errors"])) == (0, 1, 1)
    assert index.note_context("b.md")["chunk_count"] == 1 and index.note_context("sub dir/_c.md")["chunk_count"] == 1
    assert index.status()["last_tracked_files"] == 3


def test_file_mode(index, tmp_path):
    with pytest.raises(ValueError, match="file_path"):
        index.sync("file")
    with pytest.raises(ValueError, match="inside"):
        index.sync("file", "../x.md")
    with pytest.raises(ValueError, match="mode"):
        index.sync("other")
    with pytest.raises(FileNotFoundError):
        index.sync("file", "none.md")
    assert index.sync("file", str(tmp_path / "vault/a.md"))["processed"] == 1
    assert index.sync("file", "a.md")["skipped"] == 1
    assert [r.path for r in plans.tracked(index.store.read("state")).collect()] == ["a.md"]
    note = index.store.read("chunks").first().note_id
    index.delete_note(note)
    assert index.status()["index_size"] == 0


def test_change_detection(spark):
    state = spark.createDataFrame([("a", "h1", 1.0, 5.0), ("b", "h2", 1.0, 9.0), ("gone", "h", 1.0, 1.0)], plans.STATE)
    now = spark.createDataFrame([("a", "h1", 1.0), ("b", "new", 2.0), ("c", "h3", 3.0)], "path string, content_hash string, mtime double")
    assert {r.path: r.status for r in plans.plan_sync(now, state).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert {r.path: r.status for r in plans.plan_sync(now, state, full=True).collect()} == {"a": "changed", "b": "changed", "c": "new"}
    assert [r.path for r in plans.missing(state, now).collect()] == ["gone"]
    assert plans.last_sync(state).first()[0] == 9.0


def test_change_stream(index, tmp_path, spark):
    reader = vault.ChangeReader({"path": str(tmp_path / "vault")})
    rows, end = reader.read(reader.initialOffset())
    assert {(p, k) for p, k, _ in rows} == {("a.md", "added"), ("b.md", "added"), ("sub dir/_c.md", "added")}
    changed = {**end, "a.md": end["a.md"] + 1, "new.md": 1.0}
    del changed["b.md"]
    assert {(p, k) for p, k, _ in reader.readBetweenOffsets(end, changed)} == {("a.md", "modified"), ("new.md", "added"), ("b.md", "deleted")}
    df = spark.createDataFrame([("x.md", "added", 1.0), ("x.md", "deleted", 2.0), ("y.txt", "added", 1.0)], "path string, kind string, mtime double")
    assert [tuple(r) for r in latest(df).collect()] == [("x.md", "deleted")]
    query = watch(index, str(tmp_path / "checkpoint"), interval="0 seconds")
    try:
        query.processAllAvailable()
        assert index.status()["last_tracked_files"] == 3
        (tmp_path / "vault/b.md").unlink()
        query.processAllAvailable()
        assert index.status()["last_tracked_files"] == 2
    finally:
        query.stop()


def test_config(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("NOTES", "/n")
    (tmp_path / "c").mkdir()
    f = tmp_path / "c/rag.toml"
    f.write_text('vault_path = "$CWD/v"\nqdrant_path = "./q"\nfts_path = "$NOTES/f"\nchunk_size = "7"\n')
    made = config.load(f)
    assert (made.vault_path, made.vector_path, made.keyword_path) == (tmp_path / "v", tmp_path / "c/q", config.Path("/n/f"))
    assert (made.chunk_size, made.chunk_overlap, made.watch_enabled, made.exclude_globs, made.max_context_chunks) == (7, 80, True, [], 8)
    f.write_text('vault_path = "x"\n')
    with pytest.raises(KeyError):
        config.load(f)


def test_init(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    cli.main(["--config", "rag.toml", "init"])
    assert json.loads(capsys.readouterr().out) == {"initialized": True, "config_path": "rag.toml", "data_dir": str(tmp_path / "data"), "overwritten": False}
    with pytest.raises(FileExistsError, match="--force"):
        cli.main(["--config", "rag.toml", "init"])
    cli.main(["--config", "rag.toml", "init", "--force"])
    assert json.loads(capsys.readouterr().out)["overwritten"]
    assert config.load("rag.toml").exclude_globs == [".git/**", "Templates/**"] and config.load("rag.toml").vault_path == tmp_path


class Fake:
    def __getattr__(self, verb):
        return lambda *a, **k: {"verb": verb, "args": [*a, *k.values()]}


def test_cli_and_tools():
    run = lambda *a: cli.run(cli.parser().parse_args(a), Fake())
    assert run("search", "q") == {"verb": "search", "args": ["q", None, 10]} and run("query", "q", "--top-k", "3", "--filters", '{"a": 1}')["args"] == ["q", {"a": 1}, 3]
    assert run("sync", "--mode", "file", "--file-path", "x")["args"] == ["file", "x"] and run("health")["verb"] == "health"
    out = io.StringIO()
    asked = [{"id": 1, "method": "tools/list"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/call", "params": {"name": "rag.query", "arguments": {"query": "q"}}}, {"id": 3, "method": "x"},
             {"id": 4, "method": "tools/call", "params": {"name": "nope"}}, {"id": 5, "method": "initialize"}]
    server.serve(Fake(), [json.dumps(m) for m in asked], out)
    got = {m["id"]: m for m in map(json.loads, out.getvalue().splitlines())}
    assert len(got[1]["result"]["tools"]) == 6 and json.loads(got[2]["result"]["content"][0]["text"])["verb"] == "query"
    assert got[3]["error"]["code"] == -32601 and "no such tool" in got[4]["error"]["message"] and got[5]["result"]["serverInfo"]


def test_embedders():
    a, b = HashingEmbedder(8).embed(["one two", "one two"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and HashingEmbedder(4).embed([""]) == [[0.0] * 4]
    assert not HttpEmbedder("http://127.0.0.1:9", "m", probe_timeout=0.2).health()


def files_of(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_a_change_writes_only_itself(index, tmp_path):
    index.sync()
    root = config.Path(index.store.root)
    before = files_of(root)
    write(tmp_path, "a.md", "# A\nsomething else\n")
    index.sync()
    after = files_of(root)
    assert before.items() <= after.items()  # what was there isn't touched
    assert index.store.manifest()["parts"]["chunks"] == [[1, False], [2, True]]
    fresh = index.spark.read.parquet(f"{root}/v=2/chunks/rows")
    assert [r.path for r in fresh.collect()] == ["a.md"]
    assert sorted(r.path for r in index.store.read("chunks").collect()) == ["a.md", "b.md", "sub dir/_c.md"]
    index.store.merge = 2
    for n in range(3):  # folders are merged, and old ones go
        write(tmp_path, "b.md", f"# B\nversion {n}\n")
        assert index.sync()["processed"] == 1
    parts = index.store.manifest()["parts"]["chunks"]
    assert len(parts) <= 2 and not (root / "v=1/chunks").exists()
    assert sorted(r.text for r in index.store.read("chunks").collect()) == ["dentist appointment [[b|see]]", "something else", "version 2"]
    assert {r.term for r in index.store.read("postings").where("term in ('1', '2', 'hello')").collect()} == {"2"}
    assert index.store.read("lengths").count() == index.store.read("vectors").count() == 3


def test_several_files(index, tmp_path):
    index.sync()
    write(tmp_path, "a.md", "# A\nnew a\n")
    write(tmp_path, "b.md", "# B\nnew b\n")
    write(tmp_path, "sub dir/_c.md", "# C\nnot looked at\n")
    assert index.sync_files(["a.md", "b.md", "none.md"]) == {"processed": 2, "skipped": 0, "deleted": 0, "errors": []}
    assert sorted(r.text for r in index.store.read("chunks").collect()) == ["dentist appointment [[b|see]]", "new a", "new b"]
    rows = index.spark.createDataFrame([("a.md", "modified", 1.0), ("sub dir/_c.md", "modified", 2.0)], "path string, kind string, mtime double")
    from marginalia.streaming.watch import apply_batch

    assert apply_batch(index, rows) == {"processed": 1, "skipped": 1, "deleted": 0, "errors": []}


def test_vectors_of_another_length_are_refused(index, tmp_path):
    index.sync()
    index.embedder = HashingEmbedder(8)
    write(tmp_path, "a.md", "# A\nchanged\n")
    with pytest.raises(Exception, match="16 dimensions"):
        index.sync()
    assert index.store.version() == 1 and index.search("planning")["hits"]


def test_no_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from marginalia import session

    empty = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://h:7077", getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)))
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(SimpleNamespace(sparkContext=context))


def test_a_run_without_news_holds_no_notes(index, monkeypatch):
    from marginalia import service

    held = []
    monkeypatch.setattr(service, "cut", lambda df, cut=service.cut: held.append(df.columns) or cut(df))
    assert index.sync()["processed"] == 3
    assert sum("body" in c or "text" in c for c in held) == 3
    held.clear()
    assert index.sync() == {"processed": 0, "skipped": 3, "deleted": 0, "errors": []}
    assert len(held) == 5 and not any("body" in c or "text" in c for c in held)
    assert index.status()["index_size"] == 3


def test_small_jobs_run_at_once(spark):
    import threading

    from marginalia.session import together

    met = threading.Barrier(2, timeout=20)
    assert together(spark, lambda: (met.wait(), spark.range(3).count())[1], lambda: (met.wait(), 7)[1]) == [3, 7]
    assert together(spark) == []
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: 1 / 0, lambda: 1)
