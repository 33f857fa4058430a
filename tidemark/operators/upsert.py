"""Keyed changes as DataFrame to DataFrame functions.

Each takes the current rows and the incoming rows and gives the rows that
should be there afterwards. ``tables.py`` applies them to the stored tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import CHUNKS, DOCUMENTS

_DOCUMENT_VALUES = [
    f for f in DOCUMENTS.fieldNames() if f not in ("document_id", "created_at", "updated_at")
]


def utc_now() -> Column:
    return F.date_trunc("second", F.current_timestamp())


def document_rows(extracted: DataFrame, now: Column) -> DataFrame:
    """Extracted documents as rows of the documents table (text is not kept)."""
    meta = F.col("metadata")
    return extracted.select(
        "document_id",
        "source_path",
        "source_kind",
        *[meta[c].alias(c) for c in ("content_hash", "byte_size", "char_count", "line_count")],
        "metadata",
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def unique_documents(extracted: DataFrame) -> DataFrame:
    """One row per ``document_id``: the same path and content is one document.

    Repeats are found on the ids alone. Usually there are none, and then no
    text is shuffled; otherwise only the repeated documents are.
    """
    counted = extracted.groupBy("document_id").agg(F.count("*").alias("n"))
    repeated = counted.where(F.col("n") > 1).select("document_id")
    if repeated.isEmpty():
        return extracted
    once = extracted.join(repeated, "document_id", "left_anti")
    merged = extracted.join(repeated, "document_id", "left_semi").dropDuplicates(["document_id"])
    return once.unionByName(merged)


def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or overwrite by ``document_id``; the first ``created_at`` stays.

    One full outer join on the key. ``incoming`` must hold each key once.
    """
    old, new = current.alias("old"), incoming.alias("new")
    joined = old.join(new, F.col("old.document_id") == F.col("new.document_id"), "full_outer")
    is_new = F.col("new.document_id").isNotNull()

    def latest(name: str) -> Column:
        value = F.when(is_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        return value.alias(name)

    return joined.select(
        F.coalesce("new.document_id", "old.document_id").alias("document_id"),
        *[latest(name) for name in _DOCUMENT_VALUES],
        F.coalesce("old.created_at", "new.created_at").alias("created_at"),
        latest("updated_at"),
    )


def delete_by_document(current: DataFrame, document_ids: DataFrame) -> DataFrame:
    """Rows whose ``document_id`` is not listed."""
    return current.join(document_ids.select("document_id"), "document_id", "left_anti")


def replace_chunks(current: DataFrame, incoming: DataFrame, document_ids: DataFrame) -> DataFrame:
    """Drop every chunk of the listed documents, then add the incoming ones.

    Listing the documents apart from their chunks lets a document end up with
    no chunks at all.
    """
    return delete_by_document(current, document_ids).unionByName(incoming)


def chunk_rows(embedded: DataFrame, now: Column) -> DataFrame:
    """Embedded chunks as rows of the chunks table."""
    return embedded.withColumn("updated_at", now).select(*CHUNKS.fieldNames())


def check_dimension(df: DataFrame, vector_size: int) -> DataFrame:
    """Fail the job on any embedding of another size."""
    found = F.size("embedding")
    message = F.concat(
        F.lit(f"Vector dimension mismatch: collection has {vector_size}-dim vectors but got "),
        found.cast("string"),
        F.lit("-dim."),
    )
    checked = F.when(found == vector_size, F.col("embedding")).otherwise(F.raise_error(message))
    return df.withColumn("embedding", checked)


def pair_chunks(document: DataFrame) -> DataFrame:
    """``chunk_texts`` and ``embeddings`` arrays side by side, one row each.

    Arrays of different length are an error, as no chunk may lack its vector.
    """
    n_texts, n_vectors = F.size("chunk_texts"), F.size("embeddings")
    message = F.concat(
        F.lit("Mismatch: "),
        n_texts.cast("string"),
        F.lit(" chunks but "),
        n_vectors.cast("string"),
        F.lit(" embeddings"),
    )
    pairs = F.when(n_texts == n_vectors, F.arrays_zip("chunk_texts", "embeddings")).otherwise(
        F.raise_error(message)
    )
    kept = [c for c in document.columns if c not in ("chunk_texts", "embeddings")]
    rows = document.select(*kept, F.posexplode(pairs).alias("chunk_index", "_pair"))
    return rows.select(
        *kept,
        "chunk_index",
        F.col("_pair.chunk_texts").alias("chunk_text"),
        F.col("_pair.embeddings").alias("embedding"),
    )
