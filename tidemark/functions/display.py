"""Presentation helpers used by reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("B", "KB", "MB", "GB", "TB")


def score_band(score: Column) -> Column:
    return (
        F.when(score > 0.8, F.lit("green"))
        .when(score > 0.5, F.lit("yellow"))
        .otherwise(F.lit("red"))
    )


def human_size(n_bytes: Column) -> Column:
    """Bytes with one decimal in the largest unit that keeps the value >= 1.

    ``bround`` first: ties go to the even digit, as in C and Python, while
    ``format_string`` alone would round them up.
    """
    size = n_bytes.cast("double")

    def shown(power: int) -> Column:
        value = F.bround(size / 1024.0**power, 1)
        return F.format_string(f"%.1f {_UNITS[power]}", value)

    text = shown(len(_UNITS) - 1)
    for power in range(len(_UNITS) - 2, -1, -1):
        text = F.when(size < 1024.0 ** (power + 1), shown(power)).otherwise(text)
    return text


def short_id(document_id: Column) -> Column:
    return F.concat(F.substring(document_id, 1, 16), F.lit("..."))


def human_size_of(n_bytes: int) -> str:
    """Driver-side twin of :func:`human_size` for a single number."""
    size = float(n_bytes)
    for unit in _UNITS[:-1]:
        if size < 1024:
            return f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} {_UNITS[-1]}"
