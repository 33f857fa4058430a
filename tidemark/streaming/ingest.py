"""Continuous ingest of a folder: the batch ingest, once per micro-batch.

Identifiers are deterministic and changes replace by document, so a micro-batch
that is run again after a failure leaves the same index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.engine import Engine
from tidemark.functions import paths as P
from tidemark.session import work_dir
from tidemark.sources.files import plain_path

_BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def read_folder(spark, folder: str, max_files: int = 10_000) -> DataFrame:
    """New files of a folder as a stream of source rows."""
    stream = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY_FILE)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )
    path = plain_path(F.col("path"))
    return stream.select(
        path.alias("source_path"),
        P.source_kind(path).alias("source_kind"),
        "content",
        F.col("length").alias("byte_size"),
    )


def ingest_stream(
    engine: Engine, source: DataFrame, name: str = "ingest", trigger: dict | None = None
) -> StreamingQuery:
    """Start ingesting ``source``; by default what is there now, then stop."""

    def ingest_batch(batch: DataFrame, _: int) -> None:
        engine.ingest_frame(batch)

    engine.initialize()
    return (
        source.writeStream.foreachBatch(ingest_batch)
        .option("checkpointLocation", f"{work_dir(engine.spark)}/streams/{name}")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
