"""Fixed schemas of the stored tables and of the search output."""

from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("byte_size", T.LongType()),
        T.StructField("char_count", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_suffix", T.StringType()),
        T.StructField("line_count", T.LongType()),
        T.StructField("mime_type", T.StringType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("source_kind", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("byte_size", T.LongType()),
        T.StructField("char_count", T.LongType()),
        T.StructField("line_count", T.LongType()),
        T.StructField("metadata", METADATA),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("point_id", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

COLLECTIONS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("vector_size", T.IntegerType()),
        T.StructField("distance", T.StringType()),
    ]
)

SCHEMA_MIGRATIONS = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("applied_at", T.TimestampType()),
    ]
)

INGESTION_JOBS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("payload_json", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# Columns of one search hit, in output order.
SEARCH_RESULT = ("score", "document_id", "source_path", "chunk_text", "chunk_index")
