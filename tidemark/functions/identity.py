"""Deterministic identifiers and size statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the DNS namespace of RFC 4122.
_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_id(source_path: Column, text_hash: Column) -> Column:
    return F.sha2(F.concat(source_path, F.lit(":"), text_hash), 256)


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    return F.sha2(F.concat(document_id, F.lit(":"), chunk_index.cast("string")), 256)


def point_id(name: Column) -> Column:
    """RFC 4122 version 5 UUID of ``name`` in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_DNS_NAMESPACE)), name.cast("binary")))
    # The variant digit keeps its two low bits and gets 10 as its high bits.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def char_count(text: Column) -> Column:
    return F.char_length(text).cast("long")


def line_count(text: Column) -> Column:
    newlines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(newlines + 1).cast("long")


def bucket(document_id: Column, hex_digits: int) -> Column:
    """Partition key of the stored tables: a prefix of the (uniform) hash."""
    return F.substring(document_id, 1, hex_digits)
