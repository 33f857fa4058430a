"""Ingest, search and inventory over one index."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.config import Config
from tidemark.operators import chunk as C
from tidemark.operators import embed as E
from tidemark.operators import extract as X
from tidemark.operators import search as Q
from tidemark.operators import upsert as U
from tidemark.operators.tables import IndexTables
from tidemark.session import Staging, file_system, work_dir
from tidemark.sources import files
from tidemark.sources.pdf import PdfReader

log = logging.getLogger(__name__)


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        config: Config,
        embedder=None,
        pdf_reader: PdfReader | None = None,
    ):
        self.spark = spark
        self.config = config
        self.embedder = embedder or E.create_embedder(config)
        self.pdf_reader = pdf_reader
        self._size: int | None = None
        self.tables = IndexTables(
            spark,
            config.paths.metadata_path,
            config.paths.vector_path,
            hex_digits=config.runtime.partition_hex_digits,
        )

    def initialize(self) -> dict:
        size = self.measured_size()
        self.tables.migrate()
        self.tables.ensure_collection(size)
        return self.status()

    def measured_size(self) -> int:
        """Dimensions of the model, asked of the model itself, once; they must be those it
        was configured with."""
        if self._size is None:
            size = len(self.embed_query("size"))
            if size != self.embedder.vector_size:
                raise E.WrongVectorSize(
                    f"The model produces {size} dimensions, configured are {self.embedder.vector_size}."
                )
            self._size = size
        return self._size

    # -- ingest -----------------------------------------------------------

    def ingest(self, inputs: Iterable[str | Path]) -> DataFrame:
        """Ingest files; one report row per input, in input order.

        Any unreadable input stops the call before anything is written.
        """
        paths = [files.locate(self.spark, p)[0] for p in inputs]
        self.initialize()
        documents = self.ingest_frame(files.scan_files(self.spark, paths))
        order = self.spark.createDataFrame(list(enumerate(paths)), "ordinal long, source_path string")
        report = order.join(documents, "source_path").orderBy("ordinal")
        log.info("ingest_complete", extra={"event": "ingest_complete"})
        return report.select("document_id", "source_path", "source_kind", "metadata")

    def ingest_frame(self, source: DataFrame) -> DataFrame:
        """Ingest ``source_path, source_kind, content, byte_size`` rows.

        Extraction and embedding each run once, into the shared folder; the
        writes that follow read the columns they need from there. Returns the
        metadata of each document; texts and vectors are removed again.
        """
        staging = self._staging()
        try:
            rows = self._ingest(source, staging)
        except BaseException:
            staging.discard()
            raise
        staging.discard("extracted", "known", "embedded")
        return rows.select("document_id", "source_path", "source_kind", "metadata")

    def _staging(self) -> Staging:
        return Staging(self.spark, work_dir(self.spark, f"{self.config.paths.data_dir}/work"))

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` written once to the shared folder and read back."""
        return self._staging().write(rows, name)

    def _ingest(self, source: DataFrame, staging: Staging) -> DataFrame:
        extracted = staging.write(X.extract(source, self.pdf_reader), "extracted")
        unique = U.unique_documents(extracted)
        now = U.utc_now()
        rows = staging.write(U.document_rows(unique.drop("text"), now), "documents")
        # Only a document stored before can have chunks to replace; asked of the
        # documents table first, so that new ones never cost a scan of the chunks.
        known = staging.write(self.tables.stored_ids(rows), "known")
        chunked = C.chunk_documents(unique.select("document_id", "source_path", "text"))
        embedded = staging.write(self.embedder.embed(chunked, "chunk_text"), "embedded")
        failed = E.failed_documents(embedded)
        complete = embedded
        if count := failed.count():
            complete = U.delete_by_document(embedded, failed)
            log.warning(
                "embedding_failed for %d documents, metadata saved",
                count,
                extra={"event": "embedding_failed"},
            )
        chunk_rows = U.chunk_rows(complete, now)
        ids = chunk_rows.select("document_id").distinct()
        # Documents and their chunks become visible together.
        with self.tables.change():
            self.tables.upsert_documents(rows, known)
            self.tables.replace_chunks(chunk_rows, ids, known)
        return rows

    # -- search -----------------------------------------------------------

    def embed_query(self, query: str) -> list[float]:
        one = self.spark.createDataFrame([(query,)], "query string")
        vector = self.embedder.embed(one, "query").first()["embedding"]
        if vector is None:
            raise RuntimeError("The query could not be embedded.")
        return vector

    def search_vector(
        self, query: list[float], limit: int = Q.DEFAULT_TOP_K, where: Column | None = None,
        after: tuple[float, str] | None = None,
    ) -> DataFrame:
        return Q.search_points(self.tables.chunks(), query, limit, self.tables.chunks_of, where, after)

    def search(
        self, query: str, limit: int = Q.DEFAULT_TOP_K, where: Column | None = None,
        after: tuple[float, str] | None = None,
    ) -> DataFrame:
        """The ``limit`` chunks closest to ``query``, best first; ``where`` filters stored columns
        before the ranking, ``after`` continues behind a (score, point_id)."""
        vector = self.embed_query(query)
        self.tables.migrate()
        self.tables.ensure_collection(self.measured_size())
        if self.tables.chunks().isEmpty():
            raise Q.EmptyIndexError("No documents indexed yet. Run 'ingest <files>' first.")
        return self.search_vector(vector, limit, where, after)

    # -- inventory --------------------------------------------------------

    def status(self) -> dict:
        return self.tables.status().first().asDict()

    def document(self, document_id: str) -> dict | None:
        row = self.tables.find_document(document_id).first()
        return row.asDict(recursive=True) if row else None

    def path_bytes(self, path: str) -> int:
        """Size of a file or folder: one name-node call, not a job."""
        fs, target = file_system(self.spark, path)
        return fs.getContentSummary(target).getLength() if fs.exists(target) else 0

    def storage_usage(self) -> dict:
        p = self.config.paths
        metadata, vectors = self.path_bytes(p.metadata_path), self.path_bytes(p.vector_path)
        return {
            "sqlite_path": p.metadata_path,
            "sqlite_bytes": metadata,
            "qdrant_path": p.vector_path,
            "qdrant_bytes": vectors,
            "total_bytes": metadata + vectors,
        }

    def stores(self) -> dict[str, str]:
        """The stores that exist, by the name used in reports."""
        p = self.config.paths
        named = {"sqlite": p.metadata_path, "qdrant": p.vector_path}
        found = {}
        for name, path in named.items():
            fs, target = file_system(self.spark, path)
            if fs.exists(target):
                found[name] = path
        return found

    def reset(self) -> list[str]:
        """Delete both stores; the names of those that existed."""
        deleted = []
        for name, path in self.stores().items():
            fs, target = file_system(self.spark, path)
            fs.delete(target, True)
            deleted.append(name)
        return deleted
