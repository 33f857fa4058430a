"""Vector expressions.

Two forms of the same arithmetic, both in double precision:

* ``dot`` / ``norm`` / ``cosine`` are built-in higher-order functions, for
  expressions over two columns;
* ``score_against`` compares a column with one fixed query vector and is what a
  search over a large table uses: a batch of vectors becomes one matrix-vector
  product, and only the vector column crosses into Python.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """Scale to unit length; the zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(
        F.transform(a, lambda x: x.cast("double"))
    )


def as_matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of a list<float> Arrow array as a double matrix (no Python lists)."""
    if vectors.null_count:
        raise ValueError("NULL embedding in the vector column")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != size).any():
        raise ValueError(f"Vector dimension mismatch: query has {size} dimensions")
    return flat.astype(np.float64).reshape(len(vectors), size)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def score_against(embedding: Column, query: Sequence[float]) -> Column:
    """Cosine similarity of a vector column with one query vector."""
    wanted = unit_rows(np.asarray(query, dtype=np.float64).reshape(1, -1))[0]
    size = len(wanted)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        matrix = as_matrix(vectors, size)
        lengths = np.linalg.norm(matrix, axis=1)
        raw = matrix @ wanted
        return pa.array(np.divide(raw, lengths, out=np.zeros_like(raw), where=lengths > 0))

    return score(embedding)
