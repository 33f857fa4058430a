"""Golden sequences on the stored tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import upsert as U
from tidemark.operators.tables import IndexTables
from tidemark.schemas import DOCUMENTS

CHUNK = "chunk_id string, point_id string, document_id string, source_path string, chunk_index int, chunk_text string, embedding array<float>, updated_at timestamp"
UNIT = ([1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0])


@pytest.fixture
def tables(spark, tmp_path):
    t = IndexTables(spark, f"{tmp_path}/meta", f"{tmp_path}/vec")
    t.migrate()
    t.ensure_collection(4)
    return t


def chunk_rows(spark, *rows):
    full = [(c, "p" + c, d, "s", i, text, UNIT[i], None) for i, (c, d, text) in enumerate(rows)]
    return spark.createDataFrame(full, CHUNK)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "document_id string")


def texts(tables):
    return sorted(r.chunk_text for r in tables.chunks().collect())


def test_fresh_store(tables):
    status = tables.status().first()
    assert (status.schema_version, status.points_count, status.documents_count) == (1, 0, 0)
    assert tables.ingestion_jobs().count() == 0
    tables.migrate()
    assert tables.migrations().count() == 1


def test_changes_work_out_their_rows_once(spark, tables):
    """Several jobs read what comes in; extracting it again for each was most of an upsert."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    moment = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    numbered = spark.range(40).select(F.sha2(F.col("id").cast("string"), 256).alias("document_id"))
    known = numbered.mapInArrow(count, "document_id string")
    values = [F.lit(None).cast(f.dataType).alias(f.name) for f in DOCUMENTS.fields[1:-2]]
    rows = known.select("document_id", *values, moment.alias("created_at"), moment.alias("updated_at"))
    tables.upsert_documents(rows)
    assert seen.value == 40 and tables.documents().count() == 40
    tables.upsert_documents(rows)
    assert seen.value == 80 and tables.documents().count() == 40
    tables.delete_chunks(known)
    assert seen.value == 120
    tables.delete_documents(known)
    assert seen.value == 160 and tables.documents().count() == 0


def test_replace_and_delete(spark, tables):
    tables.replace_chunks(chunk_rows(spark, ("c1", "aa1", "old")), ids(spark, "aa1"))
    assert texts(tables) == ["old"]
    new = chunk_rows(spark, ("c2", "aa1", "new1"), ("c3", "aa1", "new2"))
    tables.replace_chunks(new, ids(spark, "aa1"))
    assert texts(tables) == ["new1", "new2"]
    # Another document of the same partition and one of another partition stay.
    other = chunk_rows(spark, ("c4", "aa2", "near"), ("c5", "bb1", "far"))
    tables.replace_chunks(other, ids(spark, "aa2", "bb1"))
    tables.delete_chunks(ids(spark, "aa1"))
    assert texts(tables) == ["far", "near"]
    # The last rows of a partition can go too.
    tables.delete_chunks(ids(spark, "bb1", "zz9"))
    assert texts(tables) == ["near"]
    # A document may end up without chunks.
    tables.replace_chunks(chunk_rows(spark).limit(0), ids(spark, "aa2"))
    assert texts(tables) == []
    assert tables.status().first().points_count == 0


def test_mixed_new_and_known(spark, tables):
    tables.replace_chunks(chunk_rows(spark, ("c1", "aa1", "a"), ("c2", "bb1", "b")), ids(spark, "aa1", "bb1"))
    again = chunk_rows(spark, ("c1", "aa1", "a2"), ("c9", "cc1", "c"), ("c8", "aa9", "d"))
    for _ in range(2):  # running it again changes nothing
        tables.replace_chunks(again, ids(spark, "aa1", "cc1", "aa9"))
        assert texts(tables) == ["a2", "b", "c", "d"]


def test_dimension_guard(spark, tables):
    tables.ensure_collection(4)
    with pytest.raises(RuntimeError, match="collection has 4-dim vectors but current model produces 8-dim"):
        tables.ensure_collection(8)
    short = spark.createDataFrame([("c", "p", "aa", "s", 0, "t", [1.0], None)], CHUNK)
    with pytest.raises(Exception, match="dimension mismatch"):
        tables.replace_chunks(short, ids(spark, "aa"))
    assert texts(tables) == []


def document(spark, *rows):
    from pyspark.sql import functions as F

    meta = F.struct(
        F.lit(1).cast("long").alias("byte_size"), F.lit(2).cast("long").alias("char_count"),
        F.lit("h").alias("content_hash"), F.lit("n").alias("file_name"), F.lit(".txt").alias("file_suffix"),
        F.lit(3).cast("long").alias("line_count"), F.lit("text/plain").alias("mime_type"),
    )
    base = spark.createDataFrame(rows, "document_id string, source_path string, moment string")
    extracted = base.select("document_id", "source_path", F.lit("txt").alias("source_kind"), meta.alias("metadata"), "moment")
    rows = U.document_rows(extracted, F.lit(None).cast("timestamp"))
    moment = base.select("document_id", F.col("moment").cast("timestamp").alias("at"))
    joined = rows.drop("created_at", "updated_at").join(moment, "document_id")
    return joined.withColumn("created_at", F.col("at")).withColumn("updated_at", F.col("at")).drop("at")


def test_upsert_keeps_created_at(spark, tables):
    tables.upsert_documents(document(spark, ("aa1", "x", "2024-01-01"), ("aa2", "y", "2024-01-01")))
    tables.upsert_documents(document(spark, ("aa1", "z", "2024-02-02"), ("bb1", "w", "2024-02-02")))
    rows = {r.document_id: r for r in tables.documents().collect()}
    assert {k: (r.source_path, str(r.created_at.date()), str(r.updated_at.date())) for k, r in rows.items()} == {
        "aa1": ("z", "2024-01-01", "2024-02-02"),
        "aa2": ("y", "2024-01-01", "2024-01-01"),
        "bb1": ("w", "2024-02-02", "2024-02-02"),
    }
    found = tables.find_document("aa1")
    assert found.count() == 1 and found.first().metadata.file_name == "n"
    assert tables.find_document("zz").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(document_id), EqualTo(document_id,aa1)]" in plan


def test_pairing_needs_equal_lengths(spark):
    schema = "document_id string, chunk_texts array<string>, embeddings array<array<float>>"
    ok = spark.createDataFrame([("d", ["a", "b"], [UNIT[0], UNIT[1]])], schema)
    assert [(r.chunk_index, r.chunk_text) for r in U.pair_chunks(ok).collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(Exception, match="Mismatch: 1 chunks but 0 embeddings"):
        U.pair_chunks(spark.createDataFrame([("d", ["a"], [])], schema)).collect()


def test_repeated_documents_are_merged(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "document_id string, text string")
    assert sorted(r.document_id for r in U.unique_documents(df).collect()) == ["a", "b"]
    assert U.unique_documents(df.where("document_id = 'b'")).count() == 1
