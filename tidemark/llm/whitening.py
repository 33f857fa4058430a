"""Embedding whitening by a Jacobi-Davidson eigensolver whose products are Spark jobs.

Vectors are put on a whole-number grid (``x = floor(64 * c) + 1000000``) so that counts, sums and
deviations are exact. Each distinct grid vector is fitted once. Nothing but small blocks ever
reaches the driver: the covariance is not formed, it is only applied to a block of d x k numbers
by one pass over the fit list (``Fit.product``), every row centred as ``(n * x - S) / n`` from
exact whole numbers before it is multiplied.

The solver (``leading_pairs``) keeps an orthonormal subspace and its image, takes Ritz pairs from
it, and grows it by corrections: for every wanted pair that has not converged, the projected
equation ``(I - QQ') (V - theta) (I - QQ') t = -r`` is solved roughly by MINRES, all of them in
step so that each step is one pass. Converged pairs are locked; it stops when the residuals of
all pairs are at the rounding level of the products.

Defined cases. Rows are dropped whose vector is null or empty, holds a null or a value that is not
finite, lies off the grid (beyond 2**52), or has another length than most rows (of equally frequent
lengths, the longest). Repeated rows and ids are each returned, an id may be null, and vectors that
fall on one grid point get equal results. With fewer than two fit vectors, or no spread at all, there
are no components and no rows; a covariance of rank r gives at most r components. ``deviation`` is
null where it fits no long. Equal eigenvalues may come in any rotation. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import Stage, ship

GRID, OFFSET, FARTHEST = 64, 1_000_000, float(1 << 52)
COMPONENTS = 16
GUARD = 4  # Ritz pairs improved beside the wanted ones
INNER_STEPS = 6  # MINRES steps to a correction
INNER_GAIN = 1e-2  # or until its residual has fallen to this share
SUBSPACES = 6  # columns of the subspace, in blocks of wanted pairs, before it restarts
ROUNDING = 128 * np.finfo(float).eps  # a residual of this share of the largest eigenvalue has converged
MOST_ROUNDS = 200


def grid_rows(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, x``: the usable rows on the grid."""
    rows = vectors.select(F.col(key).alias(key), F.col(vector).alias("_v")).where(
        (F.size("_v") > 0)
        & F.forall("_v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * GRID <= FARTHEST), F.lit(False)))
    )
    return rows.select(
        key, F.transform("_v", lambda c: F.floor(c.cast("double") * GRID).cast("long") + OFFSET).alias("x")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Fit:
    """The fit list, written once: its size, exact sums and covariance products.

    Every pass sends back one row per entry of a d x k block, summed in the tasks first, so a
    task and the driver hold blocks, never rows.
    """

    def __init__(self, rows: DataFrame, stage: Stage):
        self.stage = stage
        self.list = stage.table(rows.select("x").distinct(), "fit")
        self.n = self.list.count()

    @cached_property
    def sums(self) -> list[int]:
        """S: the exact sum of every dimension."""

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    # Sums of a batch stay below 2**63: 2**53 an entry would need 1,024 rows, so
                    # high and low halves are summed apart.
                    x = _matrix(batch.column(0))
                    parts = [(x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)]
                    columns = [np.arange(x.shape[1]), *parts]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["i", "high", "low"])

        whole = F.col("high").cast("decimal(38,0)") * (1 << 26) + F.col("low")
        halves = self.list.mapInArrow(add, "i long, high long, low long")
        rows = halves.groupBy("i").agg(F.sum(whole.cast("decimal(38,0)")).alias("s")).orderBy("i")
        return [int(r.s) for r in rows.collect()]

    @cached_property
    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """Grid rows to ``x - S/n`` in doubles, exact up to the last rounding."""
        n, sums = self.n, self.sums
        middle = np.array([s // n for s in sums], np.int64)
        rest = np.array([s % n for s in sums], np.float64) / n

        def centre(x: np.ndarray) -> np.ndarray:
            # A whole difference from the whole part of the mean, less the rest below one.
            return (x - middle).astype(np.float64) - rest

        return centre

    def _summed(self, block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum of ``block(centred rows)`` over the fit list, divided by n."""
        centre = self.centre

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = lost = None
            for batch in batches:
                if batch.num_rows:
                    part = block(centre(_matrix(batch.column(0))))
                    if total is None:
                        total, lost = part, np.zeros_like(part)
                    else:  # compensated, so that many batches round like one
                        part = part - lost
                        after = total + part
                        total, lost = after, (after - total) - part
            if total is not None:
                columns = [pa.array(np.arange(total.size)), pa.array(total.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["i", "value"])

        sums = self.list.mapInArrow(add, "i long, value double").groupBy("i").agg(F.sum("value").alias("v"))
        out = np.zeros(shape[0] * shape[1])
        for row in sums.collect():
            out[row.i] = row.v
        return out.reshape(shape) / self.n

    def product(self, z: np.ndarray) -> np.ndarray:
        """V z for a block of columns z."""
        return self._summed(lambda c: c.T @ (c @ z), z.shape)

    @cached_property
    def trace(self) -> float:
        return float(self._summed(lambda c: np.array([[np.einsum("ij,ij->", c, c)]]), (1, 1))[0, 0])

    def identity_error(self, vectors: np.ndarray, values: np.ndarray) -> float:
        """Largest entry of the whitened fit list's covariance minus the identity."""
        scaled, k = vectors / np.sqrt(values), len(values)

        def block(c: np.ndarray) -> np.ndarray:
            w = c @ scaled
            return np.vstack([w.T @ w, w.sum(axis=0)])

        sums = self._summed(block, (k + 1, k))
        covariance = sums[:k] - np.outer(sums[k], sums[k])
        return float(np.abs(covariance - np.eye(k)).max())


def orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns of ``block`` outside the span of ``against``; columns that hold
    nothing new are left out."""
    kept: list[np.ndarray] = []
    fixed = np.hstack([a for a in against if a.shape[1]] or [np.zeros((len(block), 0))])
    for column in block.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            column = column - fixed @ (fixed.T @ column)
            for other in kept:
                column = column - other * (other @ column)
        length = np.linalg.norm(column)
        if length > 1e-8:
            column = column / length
            column = column - fixed @ (fixed.T @ column)
            for other in kept:
                column = column - other * (other @ column)
            kept.append(column / np.linalg.norm(column))
    return np.array(kept).T if kept else np.zeros((len(block), 0))


def corrections(
    product: Callable, theta: np.ndarray, residual: np.ndarray, span: np.ndarray, steps: int
) -> np.ndarray:
    """Rough solutions of ``P (V - theta_j) P t_j = -r_j`` with ``P = I - span span'``.

    MINRES for every column at once: a Lanczos recurrence per column and its QR by rotations,
    one product with V a step.
    """

    def project(z: np.ndarray) -> np.ndarray:
        return z - span @ (span.T @ z)

    right = project(-residual)
    beta = np.linalg.norm(right, axis=0)
    start = np.where(beta > 0, beta, 1)
    v, before = right / start, np.zeros_like(right)
    t, direction, older = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    phi, off = beta.copy(), np.zeros_like(beta)
    c0, s0, c1, s1 = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    live = beta > 0
    for _ in range(steps):
        w = project(product(v)) - theta * v - off * before
        alpha = np.einsum("ij,ij->j", v, w)
        w = project(w - alpha * v)
        off_next = np.linalg.norm(w, axis=0)
        # The column (off, alpha, off_next) of the tridiagonal matrix under the last two rotations.
        far, near = s0 * off, c0 * off
        mid = c1 * near + s1 * alpha
        diagonal = c1 * alpha - s1 * near
        pivot = np.hypot(diagonal, off_next)
        ok = live & (pivot > 0)
        safe = np.where(ok, pivot, 1)
        c, s = np.where(ok, diagonal / safe, 1), np.where(ok, off_next / safe, 0)
        step = np.where(ok, (v - mid * direction - far * older) / safe, 0)
        t += np.where(ok, c * phi, 0) * step
        phi = np.where(ok, -s * phi, phi)
        older, direction = direction, step
        c0, s0, c1, s1 = c1, s1, c, s
        live = ok & (off_next > 1e-14 * np.abs(theta).max()) & (np.abs(phi) > INNER_GAIN * beta)
        if not live.any():
            break
        before, v = v, w / np.where(off_next > 0, off_next, 1)
        off = off_next
    return project(t)


def leading_pairs(product: Callable, size: int, wanted: int = COMPONENTS, seed: int = 7):
    """The ``wanted`` largest eigenvalues, falling, their unit vectors as columns, and the
    largest residual as a share of the largest eigenvalue.

    The subspace starts from a random block, which meets every eigenvector; it restarts from its
    best Ritz vectors when it is full. Once the subspace and the locked vectors span the whole
    space the Ritz pairs are exact up to rounding.
    """
    wanted = min(wanted, size)
    block = min(size, wanted + GUARD)
    most = max(SUBSPACES * wanted, block + wanted)
    basis = orthonormal(np.random.default_rng(seed).standard_normal((size, block)))
    image = product(basis)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    worst = 0.0
    for _ in range(MOST_ROUNDS):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_image = basis @ turn, image @ turn
        scale = max(np.abs(theta).max(initial=0), np.abs(values).max(initial=0), np.finfo(float).tiny)
        residual = ritz_image - ritz * theta
        if locked.shape[1]:
            residual = residual - locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0) / scale
        full = basis.shape[1] + locked.shape[1] >= size
        missing = wanted - len(values)
        done = 0
        while done < missing and done < len(theta) and sizes[done] <= ROUNDING:
            done += 1
        if full and done < missing:  # nothing is left to add: what remains is rounding
            if sizes[:missing].max() > 1e4 * ROUNDING:
                raise RuntimeError("The products of the covariance are not symmetric.")
            done = missing
        if done:
            worst = max(worst, sizes[:done].max())
            locked = np.hstack([locked, ritz[:, :done]])
            values = np.concatenate([values, theta[:done]])
            basis, image = ritz[:, done:], ritz_image[:, done:]
            theta, residual = theta[done:], residual[:, done:]
        else:
            basis, image = ritz, ritz_image
        if len(values) >= wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order], worst
        open_pairs = min(wanted - len(values), basis.shape[1])
        if basis.shape[1] + open_pairs > most:
            basis, image = basis[:, :block], image[:, :block]
            theta, residual = theta[:block], residual[:, :block]
        span = np.hstack([locked, basis[:, :open_pairs]])
        more = corrections(product, theta[:open_pairs], residual[:, :open_pairs], span, INNER_STEPS)
        fresh = orthonormal(np.hstack([more, residual[:, :open_pairs]]), locked, basis)[:, :open_pairs]
        if not fresh.shape[1]:
            fresh = orthonormal(
                np.random.default_rng(seed + len(values)).standard_normal((size, open_pairs)), locked, basis
            )
        basis, image = np.hstack([basis, fresh]), np.hstack([image, product(fresh)])
    raise RuntimeError("The eigenvectors did not converge.")


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: every usable row on
    the leading components of the fit list, see the module's text."""
    spark = vectors.sparkSession
    ship(spark)
    stage = Stage(spark, "whitening")
    rows = grid_rows(vectors, key, vector)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kinds = (
        f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    if lengths is None:
        return spark.createDataFrame([], kinds)
    rows = rows.where(F.size("x") == lengths.d)
    fit = Fit(rows, stage)
    trace = fit.trace if fit.n > 1 else 0.0
    if not trace > 0:
        return spark.createDataFrame([], kinds)
    values, axes, _ = leading_pairs(fit.product, lengths.d, components)
    spread = values > 1e3 * np.finfo(float).eps * lengths.d * values[0]
    values, axes = values[spread], axes[:, spread]
    error, n, sums = fit.identity_error(axes, values), fit.n, fit.sums
    explained, scaled, centre = values / trace, axes / np.sqrt(values), fit.centre
    stage.drop("fit")
    k = len(values)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1))
                m = len(x)
                whitened = centre(x) @ scaled
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(project, kinds)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of ``(n * x - S) ** 2``; None where no long holds it."""
    shifted, rest = x - OFFSET, [s - n * OFFSET for s in sums]
    about = np.square(n * shifted.astype(np.float64) - np.array(rest, np.float64)).sum(axis=1)
    if about.max() < 1 << 60 and max(map(abs, rest)) + n * int(np.abs(shifted).max()) < 1 << 62:
        off = shifted * n - np.array(rest, np.int64)
        return np.einsum("ij,ij->i", off, off).tolist()
    out: list[int | None] = [None] * len(x)
    for i in np.flatnonzero(about < 1.01 * (1 << 63)):
        total = sum((n * v - s) ** 2 for v, s in zip(shifted[i].tolist(), rest))
        out[i] = total if total < 1 << 63 else None
    return out
