"""Atomic changes, compaction and clean-up of the stored index."""

import pytest
from test_tables import chunk_rows, document, ids, texts
from tidemark.operators import tables as module
from tidemark.operators.tables import IndexTables
from tidemark.operators.versions import ConcurrentChangeError, Pointer, Version


@pytest.fixture
def paths(tmp_path):
    return f"{tmp_path}/meta", f"{tmp_path}/vec"


@pytest.fixture
def tables(spark, paths):
    t = IndexTables(spark, *paths)
    t.migrate()
    t.ensure_collection(4)
    return t


class Killed(Exception):
    pass


def state(tables):
    documents = sorted((r.document_id, r.source_path) for r in tables.documents().collect())
    return documents, texts(tables)


@pytest.mark.parametrize("moment", ["rows", "second table", "publish"])
def test_a_killed_change_leaves_the_old_index(spark, tables, paths, monkeypatch, moment):
    with tables.change():
        tables.upsert_documents(document(spark, ("aa1", "x", "2024-01-01")))
        tables.replace_chunks(chunk_rows(spark, ("c1", "aa1", "old")), ids(spark, "aa1"))
    before = state(tables)
    assert before == ([("aa1", "x")], ["old"])

    def update(t):
        with t.change():
            t.upsert_documents(document(spark, ("aa1", "y", "2024-02-02"), ("bb1", "z", "2024-02-02")))
            t.replace_chunks(chunk_rows(spark, ("c2", "aa1", "new"), ("c3", "bb1", "more")), ids(spark, "aa1", "bb1"))

    def killed(*_):
        raise Killed

    with monkeypatch.context() as patch:
        if moment == "publish":
            patch.setattr(Pointer, "publish", killed)
        else:
            write = IndexTables._write
            stop_at = {"rows": "documents", "second table": "chunks"}[moment]

            def stopping(self, rows, table, layer):
                write(self, rows, table, layer)  # all of its files are there
                if table == stop_at:
                    raise Killed

            patch.setattr(IndexTables, "_write", stopping)
        with pytest.raises(Killed):
            update(tables)
    for reader in (tables, IndexTables(spark, *paths)):
        assert state(reader) == before
    # The same change again, by a fresh process.
    again = IndexTables(spark, *paths)
    update(again)
    assert state(again) == state(tables) == ([("aa1", "y"), ("bb1", "z")], ["more", "new"])
    created = {r.document_id: str(r.created_at.date()) for r in again.documents().collect()}
    assert created == {"aa1": "2024-01-01", "bb1": "2024-02-02"}


def test_a_replace_writes_only_what_it_brings(spark, tables):
    rows = [(f"c{k}", f"aa{k}", f"t{k}") for k in range(3)]
    tables.replace_chunks(chunk_rows(spark, *rows), ids(spark, *[d for _, d, _ in rows]))
    first = tables.version()
    tables.replace_chunks(chunk_rows(spark, ("c0", "aa0", "again")), ids(spark, "aa0"))
    layer = tables.version().of("chunks")[-1]
    assert tables.version().of("chunks")[:-1] == first.of("chunks")
    stored = spark.read.parquet(f"{tables._paths['chunks'][0]}/layer={layer}")
    assert [r.chunk_text for r in stored.collect()] == ["again"]
    assert texts(tables) == ["again", "t1", "t2"]
    # New documents need no tombstones, so reading them needs no join.
    tables.replace_chunks(chunk_rows(spark, ("c9", "bb9", "new")), ids(spark, "bb9"))
    assert len(tables.version().of("chunks_gone")) == 1


def test_compaction_and_vacuum(spark, tables, paths):
    for k in range(4):
        tables.replace_chunks(chunk_rows(spark, ("c1", "aa1", f"v{k}"), (f"n{k}", f"bb{k}", f"b{k}")), ids(spark, "aa1", f"bb{k}"))
    tables.delete_chunks(ids(spark, "bb0"))
    want = ["b1", "b2", "b3", "v3"]
    assert texts(tables) == want and len(tables.version().of("chunks")) == 4
    old = tables.chunks()  # planned on the version before
    tables.compact(everything=True)
    assert len(tables.version().of("chunks")) == 1 and tables.version().of("chunks_gone") == ()
    assert texts(tables) == want
    assert sorted(r.chunk_text for r in old.collect()) == want
    assert tables.vacuum(keep=1) > 0
    assert texts(IndexTables(spark, *paths)) == want
    tables.replace_chunks(chunk_rows(spark, ("c1", "aa1", "last")), ids(spark, "aa1"))
    assert texts(tables) == ["b1", "b2", "b3", "last"]


def test_partial_compaction_keeps_tombstones_for_older_layers(spark, tables, monkeypatch):
    many = [(f"c{k}", f"aa{k}", "first") for k in range(3)]
    tables.replace_chunks(chunk_rows(spark, *many), ids(spark, *[d for _, d, _ in many]))
    tables.replace_chunks(chunk_rows(spark, ("c0", "aa0", "second")), ids(spark, "aa0"))
    tables.delete_chunks(ids(spark, "aa1"))
    tables.replace_chunks(chunk_rows(spark, ("c0", "aa0", "third")), ids(spark, "aa0"))
    names = sorted({*tables.version().of("chunks"), *tables.version().of("chunks_gone")})
    monkeypatch.setattr(IndexTables, "_tier", lambda self, table, _: tuple(names[1:]) if table == "chunks" else ())
    tables.compact()
    assert len(tables.version().of("chunks")) == 2 and len(tables.version().of("chunks_gone")) == 1
    assert texts(tables) == ["first", "third"]


def test_many_small_changes_compact_by_themselves(spark, tables, monkeypatch):
    monkeypatch.setattr(module, "MOST_LAYERS", 3)
    for k in range(5):
        tables.replace_chunks(chunk_rows(spark, ("c1", "aa1", f"v{k}")), ids(spark, "aa1"))
    assert texts(tables) == ["v4"] and len(tables.version().of("chunks")) <= 4


def test_two_writers_from_one_version(spark, tables, paths):
    other = IndexTables(spark, *paths)
    with pytest.raises(ConcurrentChangeError):
        with tables.change():
            tables.replace_chunks(chunk_rows(spark, ("c1", "aa1", "slow")), ids(spark, "aa1"))
            other.replace_chunks(chunk_rows(spark, ("c2", "bb1", "fast")), ids(spark, "bb1"))
    assert texts(tables) == texts(other) == ["fast"]


def test_pointer_ignores_unfinished_files(spark, tmp_path):
    pointer = Pointer(spark, f"{tmp_path}/p")
    assert pointer.current() is None
    one = pointer.publish(Version(layers={"t": ("a",)}, settings={"hex_digits": 1}))
    (tmp_path / "p" / ".half").write_text("{")
    assert pointer.current() == one and one.number == 1
    with pytest.raises(ConcurrentChangeError):
        pointer.publish(Version())
