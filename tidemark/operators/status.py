"""Inventory of an index as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_status(
    documents: DataFrame, chunks: DataFrame, migrations: DataFrame, collection: str
) -> DataFrame:
    """Counts as scalar subqueries of a one-row relation; no join.

    Each count reads Parquet footers or a single column.
    """
    version = migrations.agg(F.coalesce(F.max("version"), F.lit(0)).cast("int")).scalar()
    one = documents.sparkSession.range(1)
    return one.select(
        version.alias("schema_version"),
        F.lit(collection).alias("collection_name"),
        chunks.agg(F.count("*")).scalar().alias("points_count"),
        documents.agg(F.count("*")).scalar().alias("documents_count"),
    )


def dimension_counts(points: DataFrame) -> DataFrame:
    return points.groupBy(F.size("embedding").cast("long").alias("dim")).agg(
        F.count("*").alias("n")
    )


def find_document(documents: DataFrame, document_id: str) -> DataFrame:
    return documents.where(F.col("document_id") == document_id)
