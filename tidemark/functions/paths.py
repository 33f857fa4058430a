"""File name, suffix, kind and media type of a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted suffixes and what they are.
KIND_BY_SUFFIX = {
    ".txt": "txt",
    ".md": "md",
    ".markdown": "md",
    ".html": "html",
    ".htm": "html",
    ".pdf": "pdf",
}
MIME_BY_SUFFIX = {
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".html": "text/html",
    ".htm": "text/html",
    ".pdf": "application/pdf",
}
DEFAULT_MIME = "application/octet-stream"


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_suffix(path: Column) -> Column:
    """Lower-cased last suffix; a leading dot does not start one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def mime_type(path: Column) -> Column:
    return F.coalesce(_lookup(file_suffix(path), MIME_BY_SUFFIX), F.lit(DEFAULT_MIME))


def unsupported_message(path: str) -> str:
    suffixes = ", ".join(sorted(KIND_BY_SUFFIX))
    return f"Unsupported file type for {path}. Supported suffixes: {suffixes}"


def source_kind(path: Column, strict: bool = True) -> Column:
    """Kind of document; an unknown suffix raises, or gives NULL if not strict."""
    kind = _lookup(file_suffix(path), KIND_BY_SUFFIX)
    if not strict:
        return kind
    before, after = unsupported_message("\0").split("\0")
    return F.coalesce(kind, F.raise_error(F.concat(F.lit(before), path, F.lit(after))))
