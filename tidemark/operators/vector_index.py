"""A stored, partitioned index for cosine search: one partition a cell, bounds a cell.

Coarse centres are learned by Lloyd rounds that are Spark jobs (tasks send back sums a cell), every
vector is stored in the partition of its nearest centre, sorted by its angle to it. A small table
holds the cells' centres, row counts, largest angles and norm ranges.

*Exact* search reads few cells and can prove it: angles obey the triangle inequality, so no vector
of a cell is nearer to the query than ``angle(query, centre) - radius``, and within a cell only
vectors whose angle to the centre differs by at most the best angle so far can be. Cells are opened
nearest first; what is left unread is bounded below the k-th hit. *Probing* reads the nearest
``probes`` cells only; ``calibrate`` measures its recall on a bounded sample of stored vectors and
keeps the smallest number of probes that reaches the wanted recall.

Versions are immutable folders behind a pointer, as for the other stored tables: rebuilding never
disturbs a reader. Rows whose vector is null, empty, zero, not finite or of another length than most
are not indexed and never found. Ids are unique longs.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vectors import as_matrix, unit_rows
from tidemark.operators.search import _hit_batch, _local_hits, rank_key, top_k
from tidemark.operators.versions import Pointer, Version, new_layer
from tidemark.session import Staging, file_system, work_dir

MOST_CELLS = 4096
ROUNDS = 8
# Rows of one task of a cell, and rows the first centres are taken from.
BLOCK_ROWS = 20_000
SEED_ROWS = 20_000
# Entries of one matrix of angles, and rows handed on at once, when queries or vectors meet all cells.
ANGLES, ASKED = 1 << 20, 1 << 14
# Vectors a calibration searches with.
CALIBRATION_QUERIES = 200
# Angles are compared with this much room for rounding; scores that tie after rounding are one.
ROOM, TIE = 1e-7, 2e-9
HIT = "query_id long, vec_id long, score double"
_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _searchable(vector: Column, size: int) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ok = (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def _within(score: float) -> float:
    """The angle within which lies everything that may rank with ``score`` or before it."""
    return float(_angles(np.array(score - TIE)))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unit row's closest centre and its cosine, a bounded number of products at a time."""
    cell, cosine = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    slab = max(1, ANGLES // max(1, len(centres)))
    for at in range(0, len(rows), slab):
        products = rows[at : at + slab] @ centres.T
        cell[at : at + slab] = products.argmax(axis=1)
        cosine[at : at + slab] = products.max(axis=1)
    return cell, cosine


def learn_centres(points: DataFrame, cells: int, size: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centres by spherical k-means over all rows. The first ones come from a bounded sample;
    a round sends one sum a cell and task, and the driver holds cells x dimensions numbers."""
    shuffled = F.xxhash64("vec_id", F.lit(seed))
    sample = points.orderBy(shuffled).limit(max(cells, min(SEED_ROWS, 4 * cells))).select("embedding").toArrow()
    pool = unit_rows(as_matrix(sample["embedding"].combine_chunks(), size))
    centres = pool[:cells].copy()

    for _ in range(rounds):
        now = centres

        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(now), np.zeros(len(now), np.int64)
            for batch in batches:
                rows = unit_rows(as_matrix(batch.column(0), size))
                cell, _ = _nearest(rows, now)
                count += np.bincount(cell, minlength=len(now))
                if len(cell):
                    order = np.argsort(cell, kind="stable")
                    own, at = np.unique(cell[order], return_index=True)
                    total[own] += np.add.reduceat(rows[order], at)
            own = np.flatnonzero(count)
            flat = pa.array(list(total[own]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), flat], ["cell", "total"])

        parts = points.select("embedding").mapInArrow(sums, "cell int, total array<double>")
        numbered = parts.select("cell", F.posexplode("total").alias("i", "value"))
        whole = numbered.groupBy("cell", "i").agg(F.sum("value").alias("value")).toArrow()
        centres = np.zeros_like(now)
        centres[whole["cell"].to_numpy(), whole["i"].to_numpy()] = whole["value"].to_numpy()
        empty = np.flatnonzero(~centres.any(axis=1))
        # A cell that lost its rows starts again from another sampled vector.
        centres[empty] = pool[np.random.default_rng(seed).integers(0, len(pool), len(empty))]
        centres = unit_rows(centres)
    return centres


def build(points: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
    """Index ``points(vec_id long, embedding, other columns)`` below ``path``."""
    spark = points.sparkSession
    lengths = points.where(_searchable(F.col("embedding"), F.size("embedding"))).groupBy(F.size("embedding").alias("d"))
    most = lengths.count().orderBy(F.desc("count"), F.desc("d")).first()
    size = most.d if most else 0
    usable = points.where(_searchable(F.col("embedding"), size))
    n = usable.count()
    if cells is None:
        cells = max(1, min(MOST_CELLS, math.isqrt(n)))
    centres = learn_centres(usable, cells, size) if n else np.zeros((0, size))

    @F.arrow_udf("cell int, angle double, norm double")
    def place(vectors: pa.Array) -> pa.Array:
        rows = as_matrix(vectors, size)
        norms = np.linalg.norm(rows, axis=1)
        cell, cosine = _nearest(unit_rows(rows), centres)
        angle = _angles(cosine)
        columns = [pa.array(cell, pa.int32()), pa.array(angle), pa.array(norms)]
        return pa.StructArray.from_arrays(columns, ["cell", "angle", "norm"])

    layer = new_layer((Pointer(spark, f"{path}/versions").current() or Version()).number + 1)
    placed = usable.withColumn("_p", place("embedding")).select(*usable.columns, "_p.*")
    stored = f"{path}/cells/{layer}"
    placed.hint("rebalance", "cell").sortWithinPartitions("cell", "angle").write.partitionBy("cell").parquet(stored)
    back = spark.read.schema(placed.schema).parquet(stored)
    bounds = back.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("angle").alias("radius"),
        F.min("norm").alias("least_norm"), F.max("norm").alias("most_norm"),
    )
    named = [(c, v.tolist()) for c, v in enumerate(centres)]
    table = spark.createDataFrame(named, "cell int, centre array<double>")
    bounds.join(F.broadcast(table), "cell").coalesce(1).write.parquet(f"{path}/bounds/{layer}")
    settings = {"size": size, "rows": n, "probes": max(1, cells // 8), "schema": placed.schema.json()}
    pointer = Pointer(spark, f"{path}/versions")
    pointer.publish(Version((pointer.current() or Version()).number, {"cells": (layer,)}, settings))
    return VectorIndex(spark, path)


class VectorIndex:
    """The current version of an index, fixed when it is opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._pointer = Pointer(spark, f"{path}/versions")
        version = self._pointer.current()
        if version is None:
            raise FileNotFoundError(f"No vector index at {path}.")
        self.version, self.layer = version, version.of("cells")[0]
        self.size, self.rows, self.probes = (version.settings[k] for k in ("size", "rows", "probes"))

    @cached_property
    def bounds(self) -> pa.Table:
        """One row a cell: at most ``MOST_CELLS`` unless more were asked for."""
        return self.spark.read.parquet(f"{self.path}/bounds/{self.layer}").orderBy("cell").toArrow()

    @cached_property
    def centres(self) -> np.ndarray:
        return as_matrix(self.bounds["centre"].combine_chunks(), self.size)

    def _column(self, name: str) -> np.ndarray:
        return self.bounds[name].to_numpy()

    def points(self) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.version.settings["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/cells/{self.layer}")

    def _away(self, queries: np.ndarray) -> np.ndarray:
        """Angle of every query to every cell's centre."""
        return _angles(unit_rows(queries) @ self.centres.T)

    # -- one query ----------------------------------------------------------------

    def _readable(self, away: np.ndarray, reach: float, beyond: float) -> Column:
        """The rows whose angle to the query may lie in ``beyond`` to ``reach``: whole cells by
        their radius, and in the others by the range of angles to the centre. The ranges are two
        arrays indexed by cell, so that the filter has one size however many cells there are."""
        cells, radius = self._column("cell"), self._column("radius")
        ok = (away - radius <= reach + ROOM) & (away + radius >= beyond - ROOM)
        if not ok.any():
            return F.lit(False)
        least = np.full(int(cells.max()) + 1, math.inf)
        most = np.full(len(least), -math.inf)
        least[cells[ok]] = np.maximum(away[ok] - reach, beyond - away[ok]) - ROOM
        most[cells[ok]] = away[ok] + reach + ROOM
        angle, cell = F.col("angle"), F.col("cell")
        pushed = cell.isin(cells[ok].tolist()) & angle.between(float(least.min()), float(most.max()))
        return pushed & (angle >= F.lit(least)[cell]) & (angle <= F.lit(most)[cell])

    def search(
        self, query: Sequence[float], k: int = 5, where: Column | None = None, after: tuple[float, int] | None = None,
        probes: int | None = None, exact: bool = True,
    ) -> DataFrame:
        """The k best rows, best first: exactly, or among the nearest ``probes`` cells.

        ``where`` filters rows before they are ranked, as part of the scan. ``after`` is the
        (score, id) of the last hit of the page before: only what ranks behind it is returned,
        and cells that lie wholly before it are not read. The first job reads the nearest cells;
        its k-th angle says which others, and which of their rows, the second job must read. Too
        few hits in the first job leave every cell in reach.
        """
        points = self.points() if where is None else self.points().where(where)
        kept = [c for c in points.columns if c not in ("cell", "angle", "norm")]
        if not self.rows:
            return points.select(*kept, F.lit(0.0).alias("score")).drop("embedding").limit(0)
        away = self._away(np.asarray(query, float).reshape(1, -1))[0]
        # What ranks behind the cursor is no nearer than it, up to a tie.
        beyond = float(_angles(np.array(after[0] + TIE))) if after else 0.0
        far_enough = away + self._column("radius") >= beyond - ROOM
        order = np.argsort(np.where(far_enough, away, np.inf), kind="stable")
        order = order[: probes or self.probes]
        near = points.where(F.col("cell").isin(self._column("cell")[order].tolist()))
        if exact:
            hits = top_k(near.select(*kept), query, k, "vec_id", after).select("score").collect()
            reach = _within(hits[-1]["score"]) if len(hits) == k else math.pi
            near = points.where(self._readable(away, reach, beyond))
        return top_k(near.select(*kept), query, k, "vec_id", after)

    def pages(self, query: Sequence[float], k: int, where: Column | None = None) -> Iterator[list]:
        """Pages of k rows until nothing is left, each from where the one before ended."""
        after = None
        while page := self.search(query, k, where, after).collect():
            yield page
            after = (page[-1]["score"], page[-1]["vec_id"])

    # -- many queries ------------------------------------------------------------

    def _scan(self, asked: DataFrame, k: int) -> DataFrame:
        """Local hits of ``asked(cell, query_id, query, lo, hi)``: each query against the rows of
        the cell whose angle lies in its range. Both sides of a large cell are dealt in blocks."""
        size = self.size
        cells = self.spark.createDataFrame(
            [(int(c), max(1, -(-int(n) // BLOCK_ROWS))) for c, n in zip(self._column("cell"), self._column("n"))],
            "cell int, blocks int",
        )
        waiting = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("slices"))
        shape = F.broadcast(cells.join(waiting, "cell"))
        points = self.points().join(shape, "cell").select(
            "cell", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("b"),
            F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s"), "vec_id", "embedding", "angle",
        )
        queries = asked.join(shape, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"),
            F.pmod(F.xxhash64("query_id"), "slices").cast("int").alias("s"), "query_id", "query", "lo", "hi",
        )

        def score(p: pa.Table, q: pa.Table) -> pa.Table:
            if not p.num_rows or not q.num_rows:
                return _HIT.empty_table()
            rows = unit_rows(as_matrix(p["embedding"].combine_chunks(), size))
            matrix = unit_rows(as_matrix(q["query"].combine_chunks(), size))
            # The rows within the widest range of these queries; they are sorted into it once.
            angle = p["angle"].to_numpy()
            keep = (angle >= q["lo"].to_numpy().min()) & (angle <= q["hi"].to_numpy().max())
            hits = _local_hits(q["query_id"].to_numpy(), matrix, p["vec_id"].to_numpy()[keep], rows[keep], k)
            return pa.Table.from_batches([_hit_batch(hits, _HIT)]) if keep.any() else _HIT.empty_table()

        keys = ["cell", "b", "s"]
        return points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(score, HIT)

    def _ask(self, queries: DataFrame, cells_of: Callable, vectors: bool = True) -> DataFrame:
        """``cell, query_id, query, lo, hi``, from ``cells_of(angles, rows)`` per slab of queries;
        ``query`` is left empty unless ``vectors``. A slab's angles and the rows handed on at once
        are bounded, as every query may ask every cell."""
        size, number, centres = self.size, self._column("cell"), self.centres
        kinds = "cell int, query_id long, query array<double>, lo double, hi double"
        slab, kind = max(1, ANGLES // max(1, len(centres))), pa.list_(pa.float64())

        def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, slab):
                    batch = whole.slice(start, slab)
                    matrix = as_matrix(batch.column("query"), size)
                    away = _angles(unit_rows(matrix) @ centres.T)
                    rows, cells, lows, highs = cells_of(away, batch)
                    for at in range(0, len(rows), ASKED):
                        row, cell = rows[at : at + ASKED], cells[at : at + ASKED]
                        lo, hi = lows[at : at + ASKED], highs[at : at + ASKED]
                        ids = batch.column("query_id").take(pa.array(row))
                        asked = pa.nulls(len(row), kind)
                        if vectors:
                            offsets = pa.array(np.arange(len(row) + 1, dtype=np.int32) * size)
                            asked = pa.ListArray.from_arrays(offsets, pa.array(matrix[row].ravel()))
                        columns = [pa.array(number[cell], pa.int32()), ids, asked, pa.array(lo), pa.array(hi)]
                        yield pa.RecordBatch.from_arrays(columns, ["cell", "query_id", "query", "lo", "hi"])

        return queries.mapInArrow(ask, kinds)

    def search_many(self, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = True) -> DataFrame:
        """``query_id, rank, vec_id, score`` for ``queries(query_id long, embedding)``.

        Probing is one pass over the nearest cells of every query. The exact mode adds a second
        over the cells that the k-th angle of the first leaves in reach.
        """
        if not self.rows:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        count, radius = min(probes or self.probes, len(self.centres)), self._column("radius")
        asking = queries.where(_searchable(F.col("embedding"), self.size))
        asking = asking.select(F.col("query_id").cast("long"), F.col("embedding").alias("query"))

        def nearest(away: np.ndarray, _) -> tuple:
            cell = np.argsort(away, axis=1, kind="stable")[:, :count].ravel()
            row = np.repeat(np.arange(len(away)), count)
            return row, cell, np.full(len(row), -1.0), np.full(len(row), math.pi + 1)

        hits = self._best(self._scan(self._ask(asking, nearest), k), k)
        if exact:
            hits = Staging(self.spark, work_dir(self.spark, f"{self.path}/work")).write(hits, "first")
            reach = hits.where(F.col("rank") == k).select("query_id", "score")
            known = asking.join(reach, "query_id", "left").select(
                "query_id", "query", F.coalesce("score", F.lit(-1.0)).alias("score")
            )

            def others(away: np.ndarray, batch: pa.RecordBatch) -> tuple:
                far = _angles(batch.column("score").to_numpy(zero_copy_only=False) - TIE)[:, None]
                read = away - radius <= far + ROOM
                first = np.argsort(away, axis=1, kind="stable")[:, :count]
                np.put_along_axis(read, first, False, axis=1)
                row, cell = np.nonzero(read)
                a, f = away[row, cell], far[row, 0]
                return row, cell, a - f - ROOM, a + f + ROOM

            more = self._scan(self._ask(known, others), k)
            hits = self._best(hits.select("query_id", "vec_id", "score").unionByName(more), k)
        return hits.select("query_id", "rank", "vec_id", "score")

    def _best(self, hits: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(rank_key(), F.col("vec_id"))
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # -- recall -------------------------------------------------------------------------

    def recall(self, queries: DataFrame, k: int, probes: int) -> float:
        """The share of the exact k best that probing finds."""
        found = self.search_many(queries, k, probes, exact=False).select("query_id", "vec_id")
        true = self.search_many(queries, k).select("query_id", "vec_id")
        both = true.join(found.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
        row = both.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
        return row.hits / row.n if row.n else 1.0

    def calibrate(self, k: int = 5, wanted: float = 0.95) -> float:
        """Set the smallest number of probes that reaches ``wanted`` recall for a bounded sample of
        stored vectors; the recall measured. The number becomes part of a new version."""
        shuffled = F.xxhash64("vec_id", F.lit(23))
        sample = self.points().orderBy(shuffled).limit(CALIBRATION_QUERIES)
        sample = sample.select(F.col("vec_id").alias("query_id"), "embedding")
        true = self.search_many(sample, k).select("query_id", "vec_id", "rank")
        # In which place of a query's list of cells does each true neighbour's cell stand?
        places = self._ask(sample.withColumnRenamed("embedding", "query"), _ordered, False).select("query_id", "cell", "lo")
        homes = self.points().select("vec_id", "cell")
        stands = true.join(homes, "vec_id").join(places, ["query_id", "cell"]).groupBy("lo").count().orderBy("lo")
        rows = stands.collect()
        total, seen = sum(r["count"] for r in rows), 0
        probes, recall = 1, 1.0
        for r in rows:
            seen += r["count"]
            probes, recall = int(r.lo) + 1, seen / total
            if recall >= wanted:
                break
        settings = {**self.version.settings, "probes": probes}
        self.version = self._pointer.publish(Version(self.version.number, self.version.layers, settings))
        self.probes = probes
        return recall

    def vacuum(self) -> None:
        """Delete what only older versions name."""
        for name in self._pointer.forget(1):
            for part in ("cells", "bounds"):
                fs, target = file_system(self.spark, f"{self.path}/{part}/{name}")
                fs.delete(target, True)


def _ordered(away: np.ndarray, _) -> tuple:
    """Every cell of every query, with its place by distance."""
    n, cells = away.shape
    order = np.argsort(away, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.tile(np.arange(cells), (n, 1)), axis=1)
    row = np.repeat(np.arange(n), cells)
    return row, np.tile(np.arange(cells), n), place.ravel().astype(float), np.zeros(n * cells)
