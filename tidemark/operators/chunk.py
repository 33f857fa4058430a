"""Documents to overlapping chunks.

The split is a left-to-right fold over one text, so it runs as an Arrow UDF on
the text column; rows, order and identifiers are then plain DataFrame work.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import identity as I

CHUNK_SIZE = 300
CHUNK_OVERLAP = 50
# Coarse to fine; the empty one cuts between characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def _cuts(text: str, lo: int, hi: int, separator: str) -> list[int]:
    """Piece boundaries of ``text[lo:hi]``; a separator starts its piece."""
    if not separator:
        return list(range(lo, hi + 1))
    cuts = [lo]
    at = text.find(separator, lo, hi)
    while at != -1:
        if at > lo:
            cuts.append(at)
        at = text.find(separator, at + len(separator), hi)
    cuts.append(hi)
    return cuts


def _long_piece(separator: str, size: int) -> re.Pattern:
    """Matches where a piece may reach ``size`` characters, its separator included."""
    return re.compile(f"[^{separator}]{{{size - 1},}}")


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Chunks of at most ``size`` characters that share up to ``overlap``.

    Pieces keep their separators, so any run of pieces is one slice of the
    text: the whole split works on offsets and copies only finished chunks.
    """
    chunks: list[str] = []

    def emit(lo: int, hi: int) -> None:
        chunk = text[lo:hi].strip()
        if chunk:
            chunks.append(chunk)

    def pack(cuts: list[int]) -> None:
        """Fill windows with the pieces between ``cuts``."""
        first = 0
        for k in range(len(cuts) - 1):
            stop = cuts[k + 1]
            if first < k and stop - cuts[first] > size:
                emit(cuts[first], cuts[k])
                while first < k and (cuts[k] - cuts[first] > overlap or stop - cuts[first] > size):
                    first += 1
        emit(cuts[first], cuts[-1])

    def pack_short(lo: int, hi: int, separator: str) -> None:
        """``pack`` when every occurrence of a one-character separator is a cut
        and no piece is too long: jumps from window to window by search."""
        start = lo
        while hi - start > size:
            cut = text.rfind(separator, start + 1, start + size + 1)
            emit(start, cut)
            stop = text.find(separator, cut + 1, hi)
            floor = max(cut - overlap, (hi if stop == -1 else stop) - size, start + 1)
            start = text.find(separator, floor, cut + 1)
        emit(start, hi)

    def walk(lo: int, hi: int, level: int) -> None:
        while SEPARATORS[level] and text.find(SEPARATORS[level], lo, hi) == -1:
            level += 1
        separator = SEPARATORS[level]
        if len(separator) == 1 and not _long_piece(separator, size).search(text, lo, hi):
            pack_short(lo, hi, separator)
            return
        cuts = _cuts(text, lo, hi, separator)
        run = [lo]
        for start, stop in zip(cuts, cuts[1:]):
            if stop - start < size:
                run.append(stop)
                continue
            if len(run) > 1:
                pack(run)
            walk(start, stop, level + 1)
            run = [stop]
        if len(run) > 1:
            pack(run)

    if text:
        walk(0, len(text), 0)
    return chunks


@F.arrow_udf(T.ArrayType(T.StringType()))
def split_chunks(text: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else split_text(t) for t in text.to_pylist()], pa.list_(pa.string())
    )


def chunk_texts(text: Column) -> Column:
    return split_chunks(text)


def chunk_documents(documents: DataFrame) -> DataFrame:
    """One row per chunk; a document without text gives none.

    Needs ``document_id`` and ``text``; other columns are carried along.
    """
    kept = [c for c in documents.columns if c != "text"]
    exploded = documents.select(
        *kept, F.posexplode(chunk_texts(F.col("text"))).alias("chunk_index", "chunk_text")
    )
    ided = exploded.withColumn("chunk_id", I.chunk_id(F.col("document_id"), F.col("chunk_index")))
    return ided.withColumn("point_id", I.point_id(F.col("chunk_id")))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per document: how many chunks, the longest, the last index."""
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("n_chunks"),
        F.max(F.char_length("chunk_text")).cast("long").alias("max_chars"),
        F.max("chunk_index").cast("long").alias("last_index"),
    )
