"""Exact cosine top-k.

One query is a scan, a score and a ``TakeOrderedAndProject``: every task keeps
its own k rows, nothing is shuffled. Many queries at once keep k rows per query
and task before anything moves.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import as_matrix, score_against, unit_rows
from tidemark.schemas import SEARCH_RESULT

DEFAULT_TOP_K = 5
# Equal vectors may differ in the last bits of their product depending on where
# they sit in a batch; ranking on this many decimals makes ties real ties.
RANK_DECIMALS = 9
# Query vectors are sent to every task only up to this size.
MAX_BROADCAST_BYTES = 32 << 20
# Rows of one block of the block join.
BLOCK_ROWS = 20_000
# Entries of one matrix of scores in a task.
SCORE_CELLS = 4 << 20


class EmptyIndexError(RuntimeError):
    pass


def rank_key(score: str = "score"):
    return F.round(F.col(score), RANK_DECIMALS).desc()


def with_score(points: DataFrame, query: Sequence[float]) -> DataFrame:
    return points.withColumn("score", score_against(F.col("embedding"), query))


def behind(after: tuple[float, object], key: str) -> Column:
    """Rows that rank behind the one with this score and key: a cursor that stays valid when
    rows are added or removed."""
    here, last = F.round("score", RANK_DECIMALS), F.round(F.lit(after[0]), RANK_DECIMALS)
    return (here < last) | ((here == last) & (F.col(key) > F.lit(after[1])))


def top_k(
    points: DataFrame,
    query: Sequence[float],
    k: int = DEFAULT_TOP_K,
    key: str = "point_id",
    after: tuple[float, object] | None = None,
) -> DataFrame:
    """The k best rows of ``points`` for one query vector, best first; with ``after``, the k best
    behind that (score, key)."""
    ranked = with_score(points, query).drop("embedding")
    if after is not None:
        ranked = ranked.where(behind(after, key))
    return ranked.orderBy(rank_key(), F.col(key)).limit(k)


def cursor_of(hit: Row) -> tuple[float, str]:
    """Where the page after this hit begins: its score and its point's id, which follows from its
    document and place."""
    chunk = hashlib.sha256(f"{hit.document_id}:{hit.chunk_index}".encode()).hexdigest()
    return hit.score, str(uuid.uuid5(uuid.NAMESPACE_DNS, chunk))


def search_points(
    points: DataFrame,
    query: Sequence[float],
    k: int = DEFAULT_TOP_K,
    stored: Callable[[list[str]], DataFrame] | None = None,
    where: Column | None = None,
    after: tuple[float, str] | None = None,
) -> DataFrame:
    """Search the stored chunks; the columns of a search hit, best first.

    ``where`` is a filter on any column of the rows, part of the scan and applied before the
    ranking; ``after`` the (score, point_id) of the last hit of the page before (``cursor_of``).

    Only ids and vectors are scanned for the ranking. The k hits, by then known, are looked up
    by document, with ``stored(document ids)`` where the caller can find rows by id.
    """
    filtered = points if where is None else points.where(where)
    ranked = top_k(filtered.select("point_id", "document_id", "embedding"), query, k, after=after)
    best = [(place, *row) for place, row in enumerate(ranked.collect())]
    kinds = "place int, point_id string, document_id string, score double"
    hits = points.sparkSession.createDataFrame(best, kinds)
    documents = sorted({row[2] for row in best})
    rows = stored(documents) if stored else points.where(F.col("document_id").isin(documents))
    found = rows.drop("embedding").join(F.broadcast(hits), ["point_id", "document_id"])
    return found.orderBy("place").select(*SEARCH_RESULT)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best columns of each row.

    Ties are broken by id, so the choice does not depend on batch layout.
    """
    rounded = np.round(scores, RANK_DECIMALS)
    n = scores.shape[1]
    if n > k:
        kth = -np.partition(-rounded, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(rounded >= kth[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
    order = np.lexsort((ids[cols], -rounded[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    # Position of each entry within its row.
    starts = np.searchsorted(rows, np.arange(len(scores)))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep]


def _local_hits(
    qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, point id and score of the k best points per query, scoring a
    slab of queries at a time so that the score matrix stays small."""
    slab = max(1, SCORE_CELLS // max(1, len(ids)))
    parts = []
    for at in range(0, len(qids), slab):
        scores = queries[at : at + slab] @ points.T
        rows, cols = _best(scores, ids, k)
        parts.append((qids[at : at + slab][rows], ids[cols], scores[rows, cols]))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _merge_hits(hits: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best per query of several sets of hits."""
    qids, ids, scores = (np.concatenate(part) for part in zip(*hits))
    order = np.lexsort((ids, -np.round(scores, RANK_DECIMALS), qids))
    qids, ids, scores = qids[order], ids[order], scores[order]
    first = np.searchsorted(qids, qids)
    keep = np.arange(len(qids)) - first < k
    return qids[keep], ids[keep], scores[keep]


def _hit_batch(hits: tuple, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(a, t) for a, t in zip(hits, schema.types)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _scan_with_queries(points: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """Local top k per query in every task; the queries travel with the task."""
    kinds = pa.schema(
        [
            ("query_id", queries.schema.field("query_id").type),
            ("vec_id", pa.int64()),
            ("score", pa.float64()),
        ]
    )
    vectors = queries["embedding"].combine_chunks()
    size = len(vectors[0]) if len(vectors) else 0
    qids = queries["query_id"].to_numpy()
    matrix = unit_rows(as_matrix(vectors, size)) if size else np.zeros((0, 0))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows or not len(qids):
                continue
            rows = unit_rows(as_matrix(batch.column("embedding"), size))
            ids = batch.column("vec_id").to_numpy()
            hits = [_local_hits(qids, matrix, ids, rows, k)]
            best = _merge_hits(hits + ([best] if best else []), k)
        if best:
            yield _hit_batch(best, kinds)

    return points.select("vec_id", "embedding").mapInArrow(
        scan, "query_id long, vec_id long, score double"
    )


def _block_join(points: DataFrame, queries: DataFrame, k: int, n_points: int, n_queries: int):
    """Local top k for every (block of queries, block of points).

    Each side is cut into blocks of about ``BLOCK_ROWS`` by a hash of its
    unique id, so no block can grow with the data or with a hot value. Rows are
    replicated once per block of the other side; no pair is ever a row.
    """
    point_blocks = max(1, -(-n_points // BLOCK_ROWS))
    query_blocks = max(1, -(-n_queries // BLOCK_ROWS))

    def block(df: DataFrame, key: str, vector: str, own: str, n_own: int, other: str, n_other: int):
        return df.select(
            F.pmod(F.xxhash64(key), F.lit(n_own).cast("long")).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))).alias(other),
            key,
            # Fresh columns: both sides may come from the same table.
            F.col("embedding").alias(vector),
        )

    left = block(points, "vec_id", "point", "pb", point_blocks, "qb", query_blocks)
    right = block(queries, "query_id", "query", "qb", query_blocks, "pb", point_blocks)
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def score(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return kinds.empty_table()
        vectors = q["query"].combine_chunks()
        size = len(vectors[0])
        matrix = unit_rows(as_matrix(vectors, size))
        rows = unit_rows(as_matrix(p["point"].combine_chunks(), size))
        qids, ids = q["query_id"].to_numpy(), p["vec_id"].to_numpy()
        hits = _local_hits(qids, matrix, ids, rows, k)
        return pa.Table.from_batches([_hit_batch(hits, kinds)])

    return (
        left.groupBy("pb", "qb")
        .cogroup(right.groupBy("pb", "qb"))
        .applyInArrow(score, "query_id long, vec_id long, score double")
    )


def top_k_many(
    points: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_TOP_K,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best points of every query.

    ``points(vec_id long, embedding)``, ``queries(query_id long, embedding)``.
    Few queries (their vectors measured against ``max_broadcast_bytes``) are
    sent to the tasks that scan the points; any larger set takes the block join.
    """
    sizes = queries.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("values"),
    ).first()
    if sizes["values"] * 8 <= max_broadcast_bytes:
        local = _scan_with_queries(points, queries.select("query_id", "embedding").toArrow(), k)
    else:
        local = _block_join(points, queries, k, points.count(), sizes["n"])
    order = Window.partitionBy("query_id").orderBy(rank_key(), F.col("vec_id"))
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
