"""The functions and the splitter under SQL names.

Scalar functions are registered as SQL functions whose body is the SQL text of the same column
expression, so Catalyst inlines them and no row leaves the JVM. The splitter is a table function:
``SELECT * FROM docs, LATERAL split_chunks(text)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import display, identity, paths, text
from tidemark.operators.chunk import split_text

# Name: (function of columns, types of its arguments).
FUNCTIONS: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    "nfkc": (text.nfkc, ("STRING",)),
    "sentence_spacing": (text.sentence_spacing, ("STRING",)),
    "split_sections": (text.split_sections, ("STRING",)),
    "strip_markdown_inline": (text.strip_markdown_inline, ("STRING",)),
    "content_hash": (identity.content_hash, ("STRING",)),
    "document_id": (identity.document_id, ("STRING", "STRING")),
    "chunk_id": (identity.chunk_id, ("STRING", "INT")),
    "point_id": (identity.point_id, ("STRING",)),
    "char_count": (identity.char_count, ("STRING",)),
    "line_count": (identity.line_count, ("STRING",)),
    "file_name": (paths.file_name, ("STRING",)),
    "file_suffix": (paths.file_suffix, ("STRING",)),
    "mime_type": (paths.mime_type, ("STRING",)),
    "source_kind": (lambda path: paths.source_kind(path, strict=False), ("STRING",)),
    "score_band": (display.score_band, ("DOUBLE",)),
    "human_size": (display.human_size, ("BIGINT",)),
}


def _define(spark: SparkSession, name: str, types: tuple[str, ...], body: str, result: str) -> None:
    arguments = ", ".join(f"p{i} {kind}" for i, kind in enumerate(types))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")


def _register(spark: SparkSession, name: str, function: Callable[..., Column], types: tuple[str, ...]) -> None:
    """A SQL function with the SQL text of ``function``, which must not use lambda functions."""
    nulls = ", ".join(f"CAST(NULL AS {kind}) AS p{i}" for i, kind in enumerate(types))
    columns = [F.col(f"p{i}") for i in range(len(types))]
    plan = spark.sql(f"SELECT {nulls} FROM range(1)").select(function(*columns).alias("r"))._jdf.queryExecution().analyzed()
    body = plan.projectList().head().child().sql()
    _define(spark, name, types, body, plan.schema().apply(0).dataType().sql())


class SplitChunks:
    """``chunk_index, chunk_text`` of one text; a null or empty text gives no row."""

    def eval(self, value: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(split_text(value or ""))


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Register everything for this session, with a prefix if wanted; the names."""
    for name, (function, types) in FUNCTIONS.items():
        _register(spark, prefix + name, function, types)
    # Normalisation is a chain: each step is a function, the whole calls them inside out.
    body = f"{prefix}nfkc(p0)"
    for k, step in enumerate(text.normalization_steps()):
        _register(spark, f"{prefix}normalize_step_{k}", step, ("STRING",))
        body = f"{prefix}normalize_step_{k}({body})"
    _define(spark, f"{prefix}normalize_text", ("STRING",), body, "STRING")
    _define(spark, f"{prefix}final_text", ("STRING",), f"{prefix}sentence_spacing({prefix}normalize_text(p0))", "STRING")
    spark.udtf.register(
        f"{prefix}split_chunks", F.udtf(SplitChunks, returnType="chunk_index int, chunk_text string", useArrow=True)
    )
    more = ("normalize_text", "final_text", "split_chunks")
    return [prefix + name for name in (*FUNCTIONS, *more)]
