"""Greedy re-ranking of each query's candidates for relevance and diversity.

Candidates are the bounded result of a search (k rows a query), so each query is one small group;
queries are spread over tasks. Every step takes the candidate with the largest
``trade * score - (1 - trade) * (largest cosine to what was taken)``; equal values (to nine
decimals) go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import as_matrix, unit_rows
from tidemark.operators.search import RANK_DECIMALS, rank_key

TRADE = 0.5
MOST_CANDIDATES = 1000


def greedy(scores: np.ndarray, vectors: np.ndarray, k: int, trade: float) -> list[int]:
    """Places of the chosen candidates in the order they were taken; ``scores`` come sorted so
    that of equal values the first wins."""
    unit = unit_rows(vectors)
    nearest = np.full(len(scores), -np.inf)
    chosen: list[int] = []
    left = np.ones(len(scores), bool)
    for _ in range(min(k, len(scores))):
        away = np.where(np.isneginf(nearest), 0.0, nearest)
        value = np.round(trade * scores - (1 - trade) * away, RANK_DECIMALS)
        best = int(np.where(left, value, -np.inf).argmax())
        chosen.append(best)
        left[best] = False
        nearest = np.maximum(nearest, unit @ unit[best])
    return chosen


def diversify(candidates: DataFrame, k: int = 5, trade: float = TRADE, most: int = MOST_CANDIDATES) -> DataFrame:
    """``query_id, rank, id, score`` from ``candidates(query_id, id, score, embedding)``.

    More than ``most`` candidates of a query are cut to its best first, so a group stays small.
    Vectors of one query have one length; a null vector is an error.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(rank_key(), "id"))
    best = candidates.withColumn("place", place).where(F.col("place") <= most)
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        vectors = t["embedding"].combine_chunks()
        taken = greedy(t["score"].to_numpy(), as_matrix(vectors, len(vectors[0])), k, trade)
        out = t.select(["query_id", "id", "score"]).take(pa.array(taken))
        return out.add_column(1, "rank", pa.array(range(1, len(taken) + 1), pa.int32()))

    return best.drop("place").groupBy("query_id").applyInArrow(
        choose, f"query_id {kinds['query_id']}, rank int, id {kinds['id']}, score double"
    )
