"""Ingest and search end to end, through the engine, the CLI and RPC."""

import io
import json
import subprocess
import sys
import uuid
from pathlib import Path

import pytest

import tidemark
from tidemark import cli, daemon, rpc
from tidemark.config import load_config
from tidemark.engine import Engine
from tidemark.operators import embed as E
from tidemark.operators.embed import ModelEmbedder
from tidemark.operators.search import EmptyIndexError
from tidemark.sources import files as sources
from tidemark.sources.pdf import EncryptedPdfError


def constant(size=16):
    return ModelEmbedder(lambda: lambda texts: [[1.0] * size for _ in texts], size)


@pytest.fixture
def files(tmp_path):
    contents = {
        "a.txt": "hello   world\n\n\nline2",
        "b.md": "# Knots\n\n| Knot | Use |\n|------|-----|\n| reef | join |\n\nEnd.",
        "c d.html": "<html><body><p>Intro</p><table><tr><th>A</th></tr></table><p>End</p></body></html>",
        ".hidden.txt": "hidden words",
        "[x]{y}*.txt": "odd name",
        "empty.txt": "",
    }
    for name, text in contents.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return {name: tmp_path / name for name in contents}


def test_ingest_all_kinds(spark, work, config, files):
    engine = Engine(spark, config)
    inputs = [*files.values(), files["a.txt"]]
    report = engine.ingest(inputs).collect()
    assert [r.source_path for r in report] == [str(p.resolve()) for p in inputs]
    assert [r.source_kind for r in report] == ["txt", "md", "html", "txt", "txt", "txt", "txt"]
    first = report[0]
    assert first.metadata.content_hash == "4c43eef4f8cf5af06dcc7520054d0b762c64a6a53ce90fe570214a39199aa90f"
    assert (first.metadata.byte_size, first.metadata.char_count, first.metadata.line_count) == (21, 18, 3)
    status = engine.status()
    assert status["documents_count"] == 6 and status["points_count"] == 5
    chunks = {r.source_path: r.chunk_text for r in engine.tables.chunks().collect()}
    assert chunks[str(files["c d.html"])] == "Intro.\n\nEnd"
    assert "Knot: reef.\n\nUse: join" in chunks[str(files["b.md"])]
    hit = engine.search("hello world", 1).first()
    assert hit.source_path == str(files["a.txt"]) and hit.score > 0.5
    assert engine.document(first.document_id)["metadata"]["file_suffix"] == ".txt"
    assert engine.document("nope") is None
    # Again: same ids, nothing new. Edited: a second document next to the first.
    engine.ingest([files["a.txt"]])
    assert engine.status() == status
    files["a.txt"].write_text("goodbye")
    engine.ingest([files["a.txt"]])
    assert engine.status()["documents_count"] == 7 and engine.status()["points_count"] == 6


def test_search_filters_and_pages(spark, work, config, tmp_path):
    from pyspark.sql import functions as F
    from tidemark.operators.search import cursor_of

    for i in range(12):
        kind = "md" if i % 3 == 0 else "txt"
        (tmp_path / f"{i}.{kind}").write_text(f"harbour {'ship ' * (i % 4)}number {i}")
    engine = Engine(spark, config)
    engine.ingest(sorted(p for p in tmp_path.iterdir() if p.suffix in (".md", ".txt")))
    whole = engine.search("harbour ship", 12).collect()
    pages, after = [], None
    while page := engine.search("harbour ship", 5, after=after).collect():
        pages += page
        after = cursor_of(page[-1])
    assert [r.source_path for r in pages] == [r.source_path for r in whole] and len(pages) == 12
    only = engine.search("harbour ship", 12, F.col("source_path").endswith(".md")).collect()
    assert [r.source_path for r in only] == [r.source_path for r in whole if r.source_path.endswith(".md")]


def test_bad_input_stops_before_any_write(spark, work, config, files, tmp_path):
    engine = Engine(spark, config, constant())
    (tmp_path / "x.csv").write_text("a,b")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    for path, error in [
        (tmp_path / "missing.txt", FileNotFoundError),
        (tmp_path, ValueError),
        (tmp_path / "x.csv", ValueError),
        (tmp_path / "bad.txt", Exception),
    ]:
        with pytest.raises(error):
            engine.ingest([files["a.txt"], path])
    assert engine.status()["documents_count"] == 0


def test_pdf_reader(spark, work, config, tmp_path):
    pdf = tmp_path / "x.pdf"
    pdf.write_bytes(b"%PDF page one")
    with pytest.raises(Exception, match="No PDF backend"):
        Engine(spark, config, constant()).ingest([pdf])

    def locked(content):
        raise EncryptedPdfError("Encrypted PDF is not supported")

    with pytest.raises(Exception, match="Encrypted PDF is not supported: .*x.pdf"):
        Engine(spark, config, constant(), pdf_reader=locked).ingest([pdf])
    engine = Engine(spark, config, constant(), pdf_reader=lambda c: c.decode()[5:])
    assert engine.ingest([pdf]).first().source_kind == "pdf"
    assert engine.tables.chunks().first().chunk_text == "page one"


def test_failed_document_keeps_its_metadata(spark, work, config, files):
    def encode(texts):
        if any("odd" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0, 0.0] for _ in texts]

    engine = Engine(spark, config, ModelEmbedder(lambda: encode, 2))
    engine.ingest([files["a.txt"], files["[x]{y}*.txt"]])
    assert engine.status()["documents_count"] == 2 and engine.status()["points_count"] == 1


def test_search_needs_an_index_of_the_same_size(spark, work, config, files):
    engine = Engine(spark, config, constant(16))
    with pytest.raises(EmptyIndexError):
        engine.search("x")
    engine.ingest([files["a.txt"]])
    with pytest.raises(RuntimeError, match="dimension mismatch"):
        Engine(spark, config, constant(8)).search("x")


def test_streaming_equals_batch(spark, work, config, tmp_path):
    from tidemark.streaming.ingest import ingest_stream, read_folder

    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text(f"document {i}")
    engine = Engine(spark, config)
    ingest_stream(engine, read_folder(spark, str(folder)), uuid.uuid4().hex).awaitTermination()
    streamed = sorted((r.chunk_id, r.chunk_text) for r in engine.tables.chunks().collect())
    assert [t for _, t in sorted(streamed, key=lambda x: x[1])] == [f"document {i}" for i in range(3)]
    engine.ingest(sorted(folder.iterdir()))
    assert sorted((r.chunk_id, r.chunk_text) for r in engine.tables.chunks().collect()) == streamed


# -- command line -------------------------------------------------------------------


@pytest.fixture
def run(spark, work, tmp_path, capsys):
    path = tmp_path / "config.toml"
    path.write_text(f'[paths]\ndata_dir = "{tmp_path}/data"\n')

    def call(*argv, embedder=None):
        code = cli.main(["--config", str(path), *map(str, argv)], spark, embedder)
        out, err = capsys.readouterr()
        return code, out, err

    call.config = path
    return call


def test_cli_round_trip(run, files):
    code, out, err = run("search", "x")
    assert code == 1 and "No documents indexed yet" in err
    code, out, _ = run("ingest", files["a.txt"], "--json")
    (item,) = json.loads(out)
    assert code == 0 and item["source_kind"] == "txt" and item["metadata"]["char_count"] == 18
    code, out, _ = run("search", "hello", "--limit", 3, "--json")
    assert list(json.loads(out)[0]) == ["score", "document_id", "source_path", "chunk_index", "chunk_text"]
    code, _, err = run("search", "hello")
    assert code == 0 and "a.txt" in err
    code, out, _ = run("status", "--json")
    status = json.loads(out)
    assert len(status) == 17 and status["documents_count"] == status["qdrant_points_count"] == 1
    code, out, _ = run("storage", "--json")
    usage = json.loads(out)
    assert usage["total_bytes"] == usage["sqlite_bytes"] + usage["qdrant_bytes"] > 0
    code, out, _ = run("reset", "--force", "--json")
    assert json.loads(out) == {"status": "reset_complete", "deleted": ["sqlite", "qdrant"]}


def test_cli_storage_sizes(run, tmp_path):
    run("version")
    store = load_config(run.config).paths
    assert json.loads(run("storage", "--json")[1])["total_bytes"] == 0
    Path(store.metadata_path).write_bytes(b"x" * 1024)
    (Path(store.vector_path) / "sub").mkdir(parents=True)
    (Path(store.vector_path) / "sub" / "data").write_bytes(b"x" * 2048)
    usage = json.loads(run("storage", "--json")[1])
    assert (usage["sqlite_bytes"], usage["qdrant_bytes"], usage["total_bytes"]) == (1024, 2048, 3072)
    assert "3.0 KB" in run("storage")[2]


def test_cli_reset_can_be_refused(run, monkeypatch):
    store = Path(load_config(run.config).paths.vector_path)
    monkeypatch.setattr("sys.stdin", io.StringIO("n\n"))
    assert run("reset")[0] != 0 and store.exists()
    monkeypatch.setattr("sys.stdin", io.StringIO("y\n"))
    assert run("reset")[0] == 0 and not store.exists()


def test_cli_small_commands(run, monkeypatch):
    assert json.loads(run("version", "--json")[1]) == {"version": tidemark.__version__}
    assert run("doctor")[0] == 0 and "complete" in run("doctor")[2]
    assert run("reindex")[0] == 0 and "compacted" in run("reindex")[2]
    assert "model.backend" in run("models", "show")[2]
    assert run("models", "validate")[0] == 0
    monkeypatch.setattr(cli, "validate_model", lambda *a: (False, "no such model"))
    code, out, _ = run("models", "bootstrap", "--json")
    assert code == 2 and json.loads(out)["detail"] == "no such model"


def test_missing_libraries_are_reported(config):
    import dataclasses

    from tidemark.models import validate_model

    for backend in ("sentence_transformers", "mlx"):
        changed = dataclasses.replace(config, model=dataclasses.replace(config.model, backend=backend))
        ok, detail = validate_model(changed, offline_only=True)
        assert not ok and "not installed" in detail


# -- RPC ----------------------------------------------------------------------------


def ask(dispatcher, *lines):
    replies = io.BytesIO()
    body = "".join(line if isinstance(line, str) else json.dumps(line) + "\n" for line in lines)
    dispatcher.serve(io.BytesIO(body.encode()), replies)
    return [json.loads(x) for x in replies.getvalue().splitlines()]


def test_rpc(spark, work, config):
    engine = Engine(spark, config)
    engine.initialize()
    call = {"jsonrpc": "2.0", "id": 1}
    health, status, stub, unknown, *bad = ask(
        rpc.Dispatcher(engine),
        call | {"method": "healthcheck"},
        "\n",
        call | {"method": "status", "id": "s"},
        call | {"method": "search", "params": {"q": 1}},
        call | {"method": "nope"},
        "not json\n",
        {"jsonrpc": "1.0", "id": 1, "method": "status"},
        call | {"method": ""},
        call | {"method": "status", "params": []},
        [1],
    )
    assert health["result"]["status"] == "ok" and health["id"] == 1
    assert set(health["result"]) == {"status", "app_name", "model", "socket_path"}
    assert status["id"] == "s" and status["result"]["qdrant_points_count"] == 0 and len(status["result"]) == 7
    assert stub["result"]["status"] == "scaffolded" and stub["result"]["params"] == {"q": 1}
    assert unknown["error"] == {"code": -32601, "message": "Method not found: nope"}
    assert len(bad) == 5 and all(b["id"] is None and b["error"]["code"] == -32600 for b in bad)


def test_rpc_survives_bad_bytes(config):
    reply = json.loads(rpc.Dispatcher(None).answer(b"\xff\n"))
    assert reply["id"] is None and reply["error"]["code"] == -32600


def test_daemon_stops_when_the_model_is_missing(run, monkeypatch):
    run.config.write_text(run.config.read_text() + "[model]\npreload_on_start = true\n")
    monkeypatch.setattr(daemon, "validate_model", lambda *a, **k: (False, "missing"))
    assert daemon.main(["--config", str(run.config)], spark=object()) == 2


def test_package_is_not_needed_on_executors():
    """Functions travel by value: a process without the package can run them."""
    from pyspark import cloudpickle

    from tidemark.operators.extract import _project

    program = "import pickle, sys; print(pickle.load(sys.stdin.buffer)('<h1>a</h1><p>b'))"
    run = subprocess.run(
        [sys.executable, "-c", program], input=cloudpickle.dumps(_project), cwd="/", capture_output=True
    )
    assert run.stdout.decode().split("\n")[:2] == ["# a", "b"], run.stderr.decode()


def test_uri_is_the_file_it_names(spark, work, config):
    engine = Engine(spark, config)
    (work / "a.txt").write_text("some words")
    (work / "empty.txt").write_text("")
    names = [f"file://{work}/a.txt", f"file:{work}/a.txt", f"{work}/a.txt", f"file:{work}/empty.txt"]
    rows = sources.scan_files(spark, names).orderBy("source_path").collect()
    assert [(r.source_path, r.byte_size) for r in rows] == [(f"{work}/a.txt", 10), (f"{work}/empty.txt", 0)]
    report = engine.ingest(names[:1]).collect()
    assert [r.source_path for r in report] == [f"{work}/a.txt"]
    assert engine.status()["documents_count"] == 1
    with pytest.raises(FileNotFoundError):
        engine.ingest([f"file://{work}/missing.txt"])


def test_wrong_vector_size_stops_before_any_write(spark, work, config):
    wrong = E.ModelEmbedder(lambda: lambda texts: [[1.0, 2.0]] * len(texts), vector_size=3)
    (work / "a.txt").write_text("some words")
    engine = Engine(spark, config, wrong)
    with pytest.raises(Exception, match="2 dimensions"):
        engine.ingest([work / "a.txt"])
    assert engine.stores() == {}


def test_missing_text_has_no_vector(spark):
    df = spark.createDataFrame([("x",), (None,)], "t string")
    rows = E.HashingEmbedder(4).embed(df, "t").collect()
    assert rows[0].embedding and rows[1].embedding is None
