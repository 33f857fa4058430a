"""The stored index: tables of immutable layers, partitioned by a prefix of the document hash.

A change writes a new layer holding nothing but its own rows, and the ids of the stored documents
it replaces or deletes (tombstones). The new state becomes visible when one version file is
published (``versions.py``); until then readers and restarts see the old one. A row counts if no
later layer names its document as gone, so a replace costs what it brings, not the partitions it
falls into. ``compact`` merges layers of like size and drops what they bury; ``vacuum`` deletes the
folders that no kept version names.

Identifiers are deterministic; running a change again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas as S
from tidemark.functions import identity as I
from tidemark.operators import status as ST
from tidemark.operators import upsert as U
from tidemark.operators.versions import Pointer, Version, new_layer, sequence_of
from tidemark.session import Staging, file_system, work_dir
from tidemark.sources.files import glob_literal

SCHEMA_VERSION = 1
DEFAULT_COLLECTION = "document_chunks"
GONE = T.StructType([T.StructField("document_id", T.StringType())])
_PLACE = [T.StructField("layer", T.StringType()), T.StructField("bucket", T.StringType())]
# A table is compacted when it has more layers than this.
MOST_LAYERS = 16
# A layer joins a merge if it is at most this many times the younger ones in it.
TIER = 2


def _sequence(layer: Column) -> Column:
    return F.split_part(layer, F.lit("-"), F.lit(1)).cast("long")


class IndexTables:
    """``metadata_path`` holds documents and bookkeeping, ``vector_path`` the
    collections. ``hex_digits`` of the document hash name the partition: 2 give
    256 partitions, 3 give 4096. An existing index keeps its own number."""

    def __init__(
        self,
        spark: SparkSession,
        metadata_path: str,
        vector_path: str,
        collection: str = DEFAULT_COLLECTION,
        hex_digits: int = 2,
    ):
        self.spark = spark
        self.collection = collection
        self._new_hex_digits = hex_digits
        self._metadata = metadata_path
        self._pointer = Pointer(spark, f"{metadata_path}/versions")
        self._open: Version | None = None
        self._paths = {
            "documents": (f"{metadata_path}/documents", S.DOCUMENTS),
            "documents_gone": (f"{metadata_path}/documents_gone", GONE),
            "schema_migrations": (f"{metadata_path}/schema_migrations", S.SCHEMA_MIGRATIONS),
            "ingestion_jobs": (f"{metadata_path}/ingestion_jobs", S.INGESTION_JOBS),
            "collections": (f"{vector_path}/collections", S.COLLECTIONS),
            "chunks": (f"{vector_path}/{collection}", S.CHUNKS),
            "chunks_gone": (f"{vector_path}/{collection}_gone", GONE),
        }

    # -- reading ----------------------------------------------------------

    def version(self) -> Version:
        """What is visible: the last published version, or within a change what it has done."""
        return self._open or self._pointer.current() or Version(settings={"hex_digits": self._new_hex_digits})

    @property
    def hex_digits(self) -> int:
        return self.version().settings["hex_digits"]

    def _plain(self, table: str) -> DataFrame | None:
        path, schema = self._paths[table]
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _read(self, table: str) -> DataFrame:
        stored = self._plain(table)
        return self.spark.createDataFrame([], self._paths[table][1]) if stored is None else stored

    def _layers(self, table: str, names: Iterable[str], buckets: Iterable[str] | None = None) -> DataFrame | None:
        """Rows of some layers with ``layer`` and ``bucket``; of some buckets only those
        folders are listed."""
        path, schema = self._paths[table]
        paths = []
        for name in names:
            folder = f"{path}/layer={name}"
            if buckets is not None:
                wanted = ",".join(sorted(map(glob_literal, buckets)))
                folder = f"{folder}/bucket={{{wanted}}}"
                fs, pattern = file_system(self.spark, folder)
                if not fs.globStatus(pattern):
                    continue
            paths.append(folder)
        if not paths:
            return None
        full = T.StructType([*schema.fields, *_PLACE])
        return self.spark.read.option("basePath", path).schema(full).parquet(*paths)

    def _live(self, table: str, buckets: Iterable[str] | None = None, layers: Iterable[str] | None = None) -> DataFrame:
        """The rows of a table that no later layer has replaced, with ``layer`` and ``bucket``."""
        version = self.version()
        names = version.of(table) if layers is None else tuple(layers)
        buckets = None if buckets is None else set(buckets)
        rows = self._layers(table, names, buckets)
        if rows is None:
            empty = self.spark.createDataFrame([], self._paths[table][1])
            return empty.withColumns({"layer": F.lit(""), "bucket": F.lit("")})
        # Only tombstones younger than some row can bury anything.
        oldest = min(map(sequence_of, names))
        later = [n for n in version.of(f"{table}_gone") if sequence_of(n) > oldest]
        gone = self._layers(f"{table}_gone", later, buckets)
        if gone is None:
            return rows
        gone = gone.groupBy("document_id").agg(F.max(_sequence(F.col("layer"))).alias("_gone"))
        alive = F.col("_gone").isNull() | (_sequence(F.col("layer")) >= F.col("_gone"))
        return rows.join(gone, "document_id", "left").where(alive).select(*rows.columns)

    def documents(self) -> DataFrame:
        return self._live("documents").select(*S.DOCUMENTS.fieldNames())

    def chunks(self) -> DataFrame:
        return self._live("chunks").select(*S.CHUNKS.fieldNames())

    def chunks_of(self, document_ids: list[str]) -> DataFrame:
        """Chunks of a few documents: their partitions, then row groups by min / max."""
        digits = self.hex_digits
        buckets = sorted({i[:digits] for i in document_ids})
        stored = self._live("chunks", buckets).where(F.col("bucket").isin(buckets))
        return stored.where(F.col("document_id").isin(document_ids)).select(*S.CHUNKS.fieldNames())

    def collections(self) -> DataFrame:
        return self._read("collections")

    def migrations(self) -> DataFrame:
        return self._read("schema_migrations")

    def ingestion_jobs(self) -> DataFrame:
        return self._read("ingestion_jobs")

    def find_document(self, document_id: str) -> DataFrame:
        """Point lookup: one partition, then row groups by min / max."""
        bucket = document_id[: self.hex_digits]
        stored = self._live("documents", [bucket]).where(F.col("bucket") == bucket)
        return ST.find_document(stored, document_id).select(*S.DOCUMENTS.fieldNames())

    def status(self) -> DataFrame:
        return ST.index_status(
            self.documents(), self.chunks(), self.migrations(), self.collection
        )

    def catalog(self) -> DataFrame:
        """``name, layers, row_count, bucket_count, bytes`` of the current version's tables: rows
        are counted from the stored columns' metadata, bytes come from listing the folders."""
        version, parts = self.version(), None
        for name in ("documents", "documents_gone", "chunks", "chunks_gone"):
            names = version.of(name)
            size = sum(self._bytes(name, layer) for layer in names)
            rows = self._layers(name, names)
            rows = self.spark.createDataFrame([], T.StructType(_PLACE)) if rows is None else rows
            counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
            part = counts.agg(
                F.lit(name).alias("name"), F.lit(len(names)).alias("layers"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("*").alias("bucket_count"),
                F.lit(size).cast("long").alias("bytes"),
            )
            parts = part if parts is None else parts.unionByName(part)
        return parts

    # -- set-up -----------------------------------------------------------

    def migrate(self) -> None:
        """Create what is missing; a second run changes nothing."""
        if self._plain("schema_migrations") is None:
            row = self.spark.range(1).select(
                F.lit(SCHEMA_VERSION).alias("version"), U.utc_now().alias("applied_at")
            )
            row.write.mode("ignore").parquet(self._paths["schema_migrations"][0])
        if self._plain("ingestion_jobs") is None:
            empty = self.spark.createDataFrame([], S.INGESTION_JOBS)
            empty.write.mode("ignore").parquet(self._paths["ingestion_jobs"][0])

    def ensure_collection(self, vector_size: int) -> None:
        """Create the collection, or check that it holds vectors of this size."""
        here = F.col("name") == self.collection
        row = self.collections().where(here).select("vector_size").first()
        if row is None:
            self.spark.createDataFrame(
                [(self.collection, vector_size, "cosine")], S.COLLECTIONS
            ).write.mode("append").parquet(self._paths["collections"][0])
        elif row["vector_size"] != vector_size:
            raise RuntimeError(
                f"Vector dimension mismatch: collection has {row['vector_size']}-dim vectors but "
                f"current model produces {vector_size}-dim. Reset the index before another model fills it."
            )

    def vector_size(self) -> int | None:
        row = self.collections().where(F.col("name") == self.collection).first()
        return row["vector_size"] if row else None

    # -- changes ----------------------------------------------------------

    @contextmanager
    def change(self) -> Iterator[None]:
        """Everything done inside becomes visible together, at the end, or not at all."""
        if self._open is not None:  # part of a larger change
            yield
            return
        before = self.version()
        self._open = before
        try:
            yield
            if self._open is not before:
                self._pointer.publish(replace(self._open, number=before.number))
        finally:
            self._open = None
        if max(len(self.version().of(t)) for t in ("documents", "chunks")) > MOST_LAYERS:
            self.compact()

    @contextmanager
    def _staged(self) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
        """Writes rows aside for the time of a change, so that what they come from runs once."""
        staging = Staging(self.spark, work_dir(self.spark, f"{self._metadata}/work"))
        try:
            yield staging.write
        finally:
            staging.discard()

    def _bucket(self) -> Column:
        return I.bucket(F.col("document_id"), self.hex_digits)

    def _buckets(self, df: DataFrame) -> set[str]:
        """Partitions the rows fall into: at most 16 ** hex_digits short strings."""
        return {r[0] for r in df.select(self._bucket().alias("b")).distinct().collect()}

    def _write(self, rows: DataFrame, table: str, layer: str) -> None:
        """Rebalancing splits an oversized bucket (one huge document) over
        tasks; sorting keeps the min / max of the id narrow per row group."""
        path, schema = self._paths[table]
        order = [c for c in ("bucket", "document_id", "chunk_index") if c in [*schema.fieldNames(), "bucket"]]
        (
            rows.withColumn("bucket", self._bucket())
            .select(*schema.fieldNames(), "bucket")
            .hint("rebalance", "bucket")
            .sortWithinPartitions(*order)
            .write.partitionBy("bucket")
            .parquet(f"{path}/layer={layer}")
        )

    def _filled(self, table: str, layer: str) -> bool:
        fs, pattern = file_system(self.spark, f"{self._paths[table][0]}/layer={layer}/bucket=*")
        return bool(fs.globStatus(pattern))

    def _append(self, table: str, rows: DataFrame | None, gone: DataFrame | None) -> None:
        """One layer more: new rows, and the ids of documents whose older rows no longer count."""
        with self.change():
            version = self._open
            sequences = [sequence_of(n) for t in (table, f"{table}_gone") for n in version.of(t)]
            layer, layers = new_layer(max(sequences, default=0) + 1), dict(version.layers)
            for name, part in ((f"{table}_gone", gone), (table, rows)):
                if part is not None:
                    self._write(part, name, layer)
                    if self._filled(name, layer):
                        layers[name] = (*version.of(name), layer)
            if layers != version.layers:
                self._open = replace(version, layers=layers)

    def stored_ids(self, ids: DataFrame, table: str = "documents") -> DataFrame:
        """The rows of ``table`` with one of these document ids, ids only."""
        stored = self._live(table, self._buckets(ids)).select("document_id")
        return stored.join(ids.select("document_id"), "document_id", "left_semi")

    def upsert_documents(self, incoming: DataFrame, known: DataFrame | None = None) -> None:
        """``known``: the incoming ids that are stored; looked up if not given.

        What is not given is worked out once: incoming rows (they hold no text) and the known ids
        are written aside, as several jobs read them.
        """
        with self._staged() as once:
            if known is None:
                incoming = once(incoming.select(*S.DOCUMENTS.fieldNames()), "incoming")
                known = once(self.stored_ids(incoming), "known")
            known = known.select("document_id")
            held = self._buckets(known)
            if held:
                current = self._live("documents", held).select(*S.DOCUMENTS.fieldNames())
                current = current.join(known, "document_id", "left_semi")
                # Stored rows among them only lend their first moment.
                incoming = U.upsert_documents(current, incoming)
            self._append("documents", incoming, known.distinct() if held else None)

    def replace_chunks(
        self, incoming: DataFrame, document_ids: DataFrame, known: DataFrame | None = None
    ) -> None:
        """``known``: ids that may have chunks already; looked up among all
        stored chunks if not given."""
        size = self.vector_size()
        checked = incoming if size is None else U.check_dimension(incoming, size)
        known = self.stored_ids(document_ids, "chunks") if known is None else known
        gone = known.select("document_id").join(document_ids.select("document_id"), "document_id", "left_semi")
        self._append("chunks", checked, gone.distinct())

    def delete_chunks(self, document_ids: DataFrame) -> None:
        with self._staged() as once:
            ids = once(document_ids.select("document_id"), "ids")
            self._append("chunks", None, self.stored_ids(ids, "chunks").distinct())

    def delete_documents(self, document_ids: DataFrame) -> None:
        """Remove documents and their chunks in one change."""
        with self._staged() as once, self.change():
            ids = once(document_ids.select("document_id"), "ids")
            self._append("documents", None, self.stored_ids(ids).distinct())
            self.delete_chunks(ids)

    def versions_of(self, paths: DataFrame) -> DataFrame:
        """``document_id, source_path`` of all stored documents with one of these source paths."""
        stored = self.documents().select("document_id", "source_path")
        return stored.join(paths.select("source_path").distinct(), "source_path", "left_semi")

    # -- upkeep -----------------------------------------------------------

    def _bytes(self, table: str, layer: str) -> int:
        fs, target = file_system(self.spark, f"{self._paths[table][0]}/layer={layer}")
        return fs.getContentSummary(target).getLength() if fs.exists(target) else 0

    def _tier(self, table: str, everything: bool) -> tuple[str, ...]:
        """The youngest layers worth one merge: each at most ``TIER`` times what comes after it."""
        names = tuple(sorted({*self.version().of(table), *self.version().of(f"{table}_gone")}, key=sequence_of))
        if everything:
            return names
        total, take = 0, 0
        for name in reversed(names):
            size = self._bytes(table, name) + self._bytes(f"{table}_gone", name)
            if take >= 2 and size > TIER * total:
                break
            total, take = total + size, take + 1
        return names[-take:] if take else ()

    def compact(self, everything: bool = False) -> None:
        """Merge young layers of like size, or all of them, into one per table.

        The merged layer takes the sequence of its youngest part. Its tombstones stay only while
        older layers remain for them to bury. Readers of the version before are not disturbed.
        """
        with self.change():
            for table in ("documents", "chunks"):
                merged = self._tier(table, everything)
                if len(merged) < 2 and not (everything and self._open.of(f"{table}_gone")):
                    continue
                version = self._open
                layer = new_layer(max(map(sequence_of, merged)))
                rows = [n for n in version.of(table) if n in merged]
                gone = [n for n in version.of(f"{table}_gone") if n in merged]
                older = [n for n in version.of(table) if n not in merged]
                layers = {**version.layers, table: tuple(older)}
                layers[f"{table}_gone"] = tuple(n for n in version.of(f"{table}_gone") if n not in merged)
                if rows:
                    self._write(self._live(table, layers=rows), table, layer)
                    if self._filled(table, layer):
                        layers[table] = (*older, layer)
                buried = self._layers(f"{table}_gone", gone) if older else None
                if buried is not None:
                    self._write(buried.select("document_id").distinct(), f"{table}_gone", layer)
                    layers[f"{table}_gone"] += (layer,)
                self._open = replace(version, layers=layers)

    def vacuum(self, keep: int = 2) -> int:
        """Delete layers that none of the ``keep`` newest versions names; how many."""
        gone, deleted = self._pointer.forget(keep), 0
        for table in ("documents", "documents_gone", "chunks", "chunks_gone"):
            for name in gone:
                fs, target = file_system(self.spark, f"{self._paths[table][0]}/layer={name}")
                deleted += bool(fs.delete(target, True))
        return deleted

    def missing_layers(self) -> list[str]:
        """Folders the current version names that are not there."""
        out = []
        for table, names in self.version().layers.items():
            for name in names:
                folder = f"{self._paths[table][0]}/layer={name}"
                fs, target = file_system(self.spark, folder)
                if not fs.exists(target):
                    out.append(folder)
        return out
