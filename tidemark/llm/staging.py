"""Results written once to the folder that all machines share, and read back."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import file_system

PACKAGE = Path(__file__).resolve().parent.parent


BATCH_BYTES = 4 << 20
ROWS_A_TASK = 100_000  # of narrow tables
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that they need no copy of it,
    and bound what a batch of rows takes in a Python worker and on its way there."""
    context = spark.sparkContext
    spark.conf.set(BATCH_CONF, BATCH_BYTES)
    if getattr(context, "_tidemark_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, f"{PACKAGE.name}/{file.relative_to(PACKAGE)}")
    context.addPyFile(str(target))
    context._tidemark_shipped = True


def give_back() -> None:
    """Return freed memory of a Python worker to the system: a worker waits for its next task with
    what the allocator kept, and several of them share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another allocator; nothing is lost but memory


_KEPT: dict[str, dict] = {}


def kept_by(operator: str) -> dict:
    """What tasks of ``operator`` keep in this Python worker for the next of them. A worker serves one
    operator after another: what the others kept is given back, as workers share an executor's memory."""
    others = [name for name in _KEPT if name != operator]
    for name in others:
        del _KEPT[name]
    if others:
        gc.collect()
        give_back()
    return _KEPT.setdefault(operator, {})


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is named, as in tests, a temporary folder is named for the session; that is
    refused on a cluster, whose executors could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach.")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Stage:
    """A fresh folder below the shared one for the tables of one run.

    Reading a staged table back cuts the lineage: a lost executor costs a re-read, and no
    step before it runs twice. ``drop`` removes what later steps no longer read. ``options``
    are those of the Parquet writer.
    """

    def __init__(self, spark: SparkSession, name: str, options: dict[str, str] | None = None):
        self.spark, self.options = spark, options or {}
        self.root = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"

    def inside(self, name: str) -> Stage:
        """A folder of its own below this one, dropped by ``drop(name)``."""
        inner = Stage(self.spark, name, self.options)
        inner.root = self.path(name)
        return inner

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df`` as written and read back. Of narrow tables that have ``rows`` rows at most, a few are
        written by few tasks, however many partitions a shuffle has."""
        if rows is not None:
            parts = max(self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
            if parts < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
                df = df.coalesce(parts)
        df.write.options(**self.options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, target = file_system(self.spark, self.path(name))
            fs.delete(target, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
