"""Files and tables as one DataFrame shape.

Every source yields ``source_path, source_kind, content, byte_size`` where
``content`` is binary. Nothing is read on the driver except file names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.session import file_system


_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:")


def local_path(path: str | Path) -> str:
    """``file:`` URIs as the path they name; anything else unchanged."""
    return re.sub(r"\A(?i:file):/+", "/", str(path))


def is_uri(path: str) -> bool:
    """Does the path name a file system other than the local one?"""
    return bool(_SCHEME.match(local_path(path)))


def resolve_path(path: str | Path) -> str:
    """Absolute path of a local file, or the URI as given.

    Local paths must be existing files with an accepted suffix. A URI is
    checked by the file system that serves it (``locate``).
    """
    text = local_path(path)
    if is_uri(text):
        if Path(text).suffix.lower() not in P.KIND_BY_SUFFIX:
            raise ValueError(P.unsupported_message(text))
        return text
    resolved = Path(text).expanduser().resolve()
    if not resolved.exists():
        raise FileNotFoundError(f"File not found: {resolved}")
    if not resolved.is_file():
        raise ValueError(f"Path is not a file: {resolved}")
    if resolved.suffix.lower() not in P.KIND_BY_SUFFIX:
        raise ValueError(P.unsupported_message(str(resolved)))
    return str(resolved)


def locate(spark: SparkSession, path: str | Path) -> tuple[str, int]:
    """The path under which a scan lists the file, and its size in bytes.

    For a URI both come from its file system, which also says if it is missing.
    """
    resolved = resolve_path(path)
    if not is_uri(resolved):
        return resolved, Path(resolved).stat().st_size
    fs, target = file_system(spark, resolved)
    if not fs.exists(target):
        raise FileNotFoundError(f"File not found: {resolved}")
    status = fs.getFileStatus(target)
    if status.isDirectory():
        raise ValueError(f"Path is not a file: {resolved}")
    found = status.getPath().toString()
    if status.getLen() and Path(found).name[0] in "._":
        raise ValueError(f"Spark does not list files whose name starts with . or _: {found}")
    return local_path(found), status.getLen()


def plain_path(uri: Column) -> Column:
    """``file:/a/b`` as ``/a/b``; any other scheme unchanged."""
    return F.regexp_replace(uri, r"\Afile:/+", "/")


def _read_directly(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        names = batch.column("source_path").to_pylist()
        contents = [Path(n).read_bytes() for n in names]
        yield pa.RecordBatch.from_pydict(
            {
                "source_path": names,
                "content": pa.array(contents, pa.binary()),
                "byte_size": pa.array([len(c) for c in contents], pa.int64()),
            }
        )


def glob_literal(path: str) -> str:
    """Escape the characters Hadoop would expand in a path."""
    return "".join("\\" + ch if ch in "\\{}[]*?" else ch for ch in path)


def scan_files(spark: SparkSession, paths: Iterable[str | Path]) -> DataFrame:
    """Binary scan of the given files, each once."""
    located = dict(locate(spark, p) for p in paths)
    if not located:
        raise ValueError("No input files.")
    # The binary source passes over empty files and names like ``.x`` or ``_x``.
    empty = [p for p, size in located.items() if not size]
    direct = [p for p, size in located.items() if size and Path(p).name[0] in "._"]
    passed_over = {*empty, *direct}
    listed = [p for p in located if p not in passed_over]
    scans = []
    if listed:
        scans.append(scan_folder(spark, *map(glob_literal, listed)).drop("source_kind"))
    if empty:
        names = spark.createDataFrame([(p,) for p in empty], "source_path string")
        nothing = F.lit(b"").alias("content"), F.lit(0).cast("long").alias("byte_size")
        scans.append(names.select("source_path", *nothing))
    if direct:
        names = spark.createDataFrame([(p,) for p in direct], "source_path string")
        scans.append(
            names.mapInArrow(_read_directly, "source_path string, content binary, byte_size long")
        )
    found = scans[0]
    for other in scans[1:]:
        found = found.unionByName(other)
    return found.withColumn("source_kind", P.source_kind(F.col("source_path")))


def scan_folder(spark: SparkSession, *patterns: str) -> DataFrame:
    """Binary scan of folders or glob patterns, listed and read by the cluster."""
    files = spark.read.format("binaryFile").load(list(patterns))
    path = plain_path(F.col("path"))
    return files.select(
        path.alias("source_path"),
        P.source_kind(path).alias("source_kind"),
        "content",
        F.col("length").alias("byte_size"),
    )


def spread(scan: DataFrame) -> DataFrame:
    """Use every core for a source too small to be split into enough tasks.

    A source with at least one partition per core, as any large one has, is
    left as it is: no shuffle. Only for a plain scan; asking a plan with
    shuffles for its partitions would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def from_table(df: DataFrame, source_path: Column, source_kind: Column, text: Column) -> DataFrame:
    """Rows that already carry their text or markup in a string column."""
    content = text.cast("binary")
    return df.select(
        source_path.alias("source_path"),
        source_kind.alias("source_kind"),
        content.alias("content"),
        F.octet_length(content).cast("long").alias("byte_size"),
    )
