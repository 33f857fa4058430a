"""Content to normalised text, identifiers and metadata.

One pass over the source for all kinds of document. Plain text never leaves the
JVM. Markup goes through a single Arrow UDF; rows of other kinds reach it as
NULL and cost nothing. Everything before and after that (Markdown tables,
normalisation, hashing, counting) is built-in expressions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import identity as I
from tidemark.functions import paths as P
from tidemark.functions import text as X
from tidemark.sources.html import html_blocks
from tidemark.sources.markdown import markdown_to_html
from tidemark.sources.pdf import EncryptedPdfError, PdfReader, installed_pdf_text

# The line prefix of each projected tag.
LINE_PREFIX = {"h1": "# ", "h2": "## ", "h3": "### ", "li": "- ", "p": ""}


def _project(markup: str | None) -> str | None:
    """One line per non-empty block, marked as heading or list item."""
    if markup is None:
        return None
    return "\n".join(LINE_PREFIX[tag] + text for tag, text in html_blocks(markup) if text)


# A type object, not a DDL string: the module can be imported before a session exists.
@F.arrow_udf(T.StringType())
def markup_to_text(kind: pa.Array, markup: pa.Array) -> pa.Array:
    """Projected text of HTML rows and of Markdown rows; NULL for NULL."""
    html = (
        markdown_to_html(m) if k == "md" and m is not None else m
        for k, m in zip(kind.to_pylist(), markup.to_pylist())
    )
    return pa.array([_project(m) for m in html], pa.string())


def _pdf_text(content: Column, path: Column, reader: PdfReader) -> Column:
    @F.arrow_udf("string")
    def read(contents: pa.Array, paths: pa.Array) -> pa.Array:
        texts = []
        for c, p in zip(contents.to_pylist(), paths.to_pylist()):
            try:
                texts.append(None if c is None else reader(bytes(c)))
            except EncryptedPdfError as exc:
                raise EncryptedPdfError(f"{exc}: {p}") from None
        return pa.array(texts, pa.string())

    return read(content, path)


def raw_text(df: DataFrame, pdf_reader: PdfReader | None = None) -> DataFrame:
    """Add ``raw_text``: what each document says before normalisation.

    Bytes that are not valid UTF-8 fail the job, as does an unreadable PDF.
    ``_markup`` is read twice on purpose: that keeps its projection apart from
    the one with the UDF, whose arguments must not contain lambda functions.
    """
    kind = F.col("source_kind")
    decoded = X.unify_newlines(F.decode(F.col("content"), "UTF-8"))
    prepared = df.withColumn("_plain", F.when(kind.isin("txt", "md", "html"), decoded)).withColumn(
        "_markup",
        F.when(kind == "md", X.linearize_markdown_tables(F.col("_plain"))).when(
            kind == "html", F.col("_plain")
        ),
    )
    pdf = _pdf_text(
        F.when(kind == "pdf", F.col("content")), F.col("source_path"), pdf_reader or installed_pdf_text
    )
    return (
        prepared.withColumn("_projected", markup_to_text(kind, F.col("_markup")))
        .withColumn("_pdf", pdf)
        .withColumn(
            "raw_text",
            F.when(F.col("_markup").isNotNull(), F.col("_projected"))
            .when(kind == "pdf", F.col("_pdf"))
            .otherwise(F.col("_plain")),
        )
        .drop("_plain", "_markup", "_projected", "_pdf")
    )


def describe(df: DataFrame) -> DataFrame:
    """``raw_text`` to the extracted document: text, identifiers, metadata."""
    path = F.col("source_path")
    return (
        df.withColumn("text", X.final_text(F.col("raw_text")))
        .withColumn("content_hash", I.content_hash(F.col("text")))
        .select(
            I.document_id(path, F.col("content_hash")).alias("document_id"),
            "source_path",
            "source_kind",
            "text",
            F.struct(
                F.col("byte_size"),
                I.char_count(F.col("text")).alias("char_count"),
                F.col("content_hash"),
                P.file_name(path).alias("file_name"),
                P.file_suffix(path).alias("file_suffix"),
                I.line_count(F.col("text")).alias("line_count"),
                P.mime_type(path).alias("mime_type"),
            ).alias("metadata"),
        )
    )


def extract(df: DataFrame, pdf_reader: PdfReader | None = None) -> DataFrame:
    """``source_path, source_kind, content, byte_size`` to extracted documents."""
    return describe(raw_text(df, pdf_reader))


def extract_plain(df: DataFrame) -> DataFrame:
    """The same for a source known to hold plain text only: no Python stage."""
    decoded = X.unify_newlines(F.decode(F.col("content"), "UTF-8"))
    return describe(df.withColumn("raw_text", decoded))
