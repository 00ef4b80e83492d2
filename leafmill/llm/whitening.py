"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers, ``x = floor(scale * c) + offset``; the fit list holds each distinct x once. With A the centred fit
rows, alternating products ``u = A v`` and ``A^T u`` build orthonormal v's and u's in which A is upper bidiagonal. The small
bidiagonal matrix is decomposed on the driver: its singular values give the deviations along the components, its right
vectors, turned back by the v's, the components.

Every u lies in the range of A and is kept as the vector w with ``u = A w``, so the driver holds vectors of the dimension
only and no task keeps state. One pass over the rows forms ``u = A w`` for a block, then ``A^T u``, and the products of u with all
earlier u's, formed anew from their w's. Both sides are orthogonalised against all before them. Where the iteration
ends early (equal singular values, fewer dimensions than columns) it starts again in a direction not yet covered.

Sums and squares of whole numbers are exact; rows are centred as ``(n x - S) / n`` before anything is multiplied. The fit rows are
written once as blocks of raw numbers; a pass reads those. Partial sums are added up by about the square root of the
number of blocks in tasks before they reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.tables import written

BLOCK_BYTES = 1 << 21
#: Entries beyond this are held at it, so that whole numbers stay far inside 64 bits.
MOST = float(1 << 40)
#: Directions with less than this part of the largest singular value are rounding, residuals below the second too.
LEAST, ROUNDING = 1e-11, 1e-15
#: Spaces of up to so many dimensions are used up whatever the residuals.
EXHAUST = 512


@dataclass
class Whitening:
    """``n`` fit rows with column sums ``sums``; ``components`` (a row each, by falling eigenvalue), their ``eigenvalues``, the
    ``trace`` of the covariance and the largest error of the whitened covariance against the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    scale: int
    offset: int


def whole_vectors(table: DataFrame, id_column: str, vector_column: str, scale: int, offset: int, dims: int | None = None) -> DataFrame:
    """``id, x`` of the vectors without null or non-finite entries; with ``dims`` only those of that length."""
    v = F.col(vector_column).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    held = lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c))
    rows = table.select(F.col(id_column).alias("id"), v.alias("v")).where(good & (F.size("v") > 0))
    rows = rows if dims is None else rows.where(F.size("v") == dims)
    return rows.select("id", F.transform("v", lambda c: F.floor(held(c) * scale) + F.lit(offset).cast("long")).alias("x"))


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _blocks(dims: int):
    most = max(1, BLOCK_BYTES // (8 * dims))

    def run(batches):
        have, rows = [], 0
        for batch in batches:
            have.append(_matrix(batch.column("x"), dims))
            rows += len(have[-1])
            if rows >= most:
                yield pa.record_batch({"x": pa.array([np.concatenate(have).tobytes()], pa.binary())})
                have, rows = [], 0
        if rows:
            yield pa.record_batch({"x": pa.array([np.concatenate(have).tobytes()], pa.binary())})

    return run


def _added(blocks: DataFrame, each, zero: np.ndarray, few: int) -> np.ndarray:
    """The sum of ``each(block of whole numbers)`` over all blocks, whole numbers or doubles as ``zero`` says."""
    name, arrow = ("long", pa.int64()) if zero.dtype == np.int64 else ("double", pa.float64())

    def send(total):
        return pa.record_batch({"s": pa.array([total], pa.list_(arrow))})

    def partial(batches):
        total, some = zero.copy(), False
        for batch in batches:
            for raw in batch.column("x"):
                total += each(np.frombuffer(raw.as_buffer(), np.int64))
                some = True
        if some:
            yield send(total)

    def join(batches):
        total = zero.copy()
        for batch in batches:
            total += _matrix(batch.column("s"), len(zero)).sum(0)
        yield send(total)

    sums = blocks.mapInArrow(partial, f"s array<{name}>").repartition(few).mapInArrow(join, f"s array<{name}>")
    return np.array([r["s"] for r in sums.collect()], dtype=object if name == "long" else float).sum(0)  # ``few`` rows


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` without loss: 64 bits where they hold it, else Python's numbers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(raw: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_differences(raw.reshape(-1, len(sums)), n, sums) / n).astype(np.float64)


def bidiagonalise(product, dims: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of A by size and their right vectors (rows), the ``wanted`` largest to rounding.

    ``product(w, earlier)`` gives, for ``u = A w`` and the rows of ``earlier``: ``A^T u``, the products of u with each
    ``A earlier[i]``, and ``u . u``.
    """
    rng = np.random.default_rng(seed)
    vs, ws, zs = np.zeros((0, dims)), np.zeros((0, dims)), np.zeros((0, dims))
    alphas: list[float] = []
    betas: list[float] = []
    largest = 0.0

    def fresh():
        while True:
            v = rng.standard_normal(dims)
            for _ in range(3):
                v = v / np.sqrt(v @ v)
                v = v - vs.T @ (vs @ v)
            if v @ v > 0.25:
                return v / np.sqrt(v @ v)

    v, beta = fresh(), 0.0
    while True:
        vs = np.vstack([vs, v])
        w = v - beta * ws[-1] if beta else v
        z, h, uu = product(w, ws)
        w, z = w - ws.T @ h, z - zs.T @ h
        alpha = math.sqrt(max(0.0, uu - h @ h))
        largest = max(largest, alpha, beta)
        if alpha <= LEAST * largest or alpha == 0:
            alpha, w, z, r = 0.0, np.zeros(dims), np.zeros(dims), np.zeros(dims)
        else:
            w, z = w / alpha, z / alpha
            r = z - alpha * v
            for _ in range(2):
                r = r - vs.T @ (vs @ r)
        ws, zs = np.vstack([ws, w]), np.vstack([zs, z])
        alphas.append(alpha)
        beta = math.sqrt(r @ r)
        if len(vs) == dims:
            break
        if beta <= LEAST * largest:
            beta, v = 0.0, fresh()
        else:
            v = r / beta
            if dims > EXHAUST and len(vs) >= wanted:
                left, values, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
                if (beta * np.abs(left[-1, :wanted]) <= ROUNDING * values[0]).all():
                    break
        betas.append(beta)
    _, values, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
    keep = [i for i in range(min(wanted, len(values))) if values[i] > LEAST * values[0]]
    return values[keep], right[keep] @ vs


def fit_whitening(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_column: str = "vec_id", vector_column: str = "embedding") -> Whitening | None:
    """Fit on the distinct vectors of a table; None where no vector can be used.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor do those whose length is not the most frequent
    one (of equally frequent ones the longest). Entries beyond 2^40 are held at it. Components without deviation are left out, so equal vectors or
    a single one have none.
    """
    length = whole_vectors(vectors, id_column, vector_column, scale, offset).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return None
    dims = length["d"]
    distinct = whole_vectors(vectors, id_column, vector_column, scale, offset, dims).select("x").distinct()
    blocks = written(distinct.mapInArrow(_blocks(dims), "x binary"), "fit")
    few = max(1, math.isqrt(blocks.count()))

    def halves(raw):
        x = raw.reshape(-1, dims)
        return np.r_[len(x), (x >> 24).sum(0), (x & 0xFFFFFF).sum(0)]

    told = _added(blocks, halves, np.zeros(1 + 2 * dims, np.int64), few)
    n = int(told[0])
    sums = [(int(a) << 24) + int(b) for a, b in zip(told[1 : dims + 1], told[dims + 1 :])]

    def product(w, earlier):
        def each(raw):
            a = _centred(raw, n, sums)
            u = a @ w
            return np.r_[a.T @ u, (a @ earlier.T).T @ u, u @ u]

        got = _added(blocks, each, np.zeros(dims + len(earlier) + 1), few)
        return got[:dims], got[dims:-1], float(got[-1])

    values, right = bidiagonalise(product, dims, components)
    eigenvalues = values**2 / n
    k = len(values)

    def whitened(raw):
        a = _centred(raw, n, sums)
        y = a @ right.T / np.sqrt(eigenvalues)
        return np.r_[(y.T @ y).ravel(), y.sum(0), (a * a).sum()]

    seen = _added(blocks, whitened, np.zeros(k * k + k + 1), few) / n
    mean = seen[k * k : k * k + k]
    error = np.abs(seen[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0)
    return Whitening(n, sums, right, eigenvalues, float(seen[-1]), float(error), scale, offset)


def whiten(vectors: DataFrame, model: Whitening | None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each usable row and component.

    ``deviation`` is the sum over dimensions of ``(n x - S)^2``, exact; null where 64 bits do not hold it. Rows that repeat an id or a
    vector are separate rows; a null id stays null. Without a model, or without components, there are no rows. Other columns are ignored.
    """
    if model is None:
        model = Whitening(0, [0], np.zeros((0, 1)), np.zeros(0), 0.0, 0.0, 1, 0)
    dims, k = len(model.sums), len(model.eigenvalues)
    rows = whole_vectors(vectors, id_column, vector_column, model.scale, model.offset, dims)
    kind = rows.schema["id"].dataType.simpleString()

    def project(batches):
        for batch in batches:
            if not k:
                continue
            d = _differences(_matrix(batch.column("x"), dims), model.n, model.sums)
            wide = d if d.dtype == object or int(np.abs(d).max(initial=0)) ** 2 * dims < 1 << 63 else d.astype(object)
            deviation = (wide * wide).sum(1)
            if deviation.dtype == object:
                deviation = [x if x < 1 << 63 else None for x in deviation]
            y = (d / model.n).astype(np.float64) @ model.components.T / np.sqrt(model.eigenvalues)
            m = len(y)
            yield pa.record_batch(
                {
                    "vec_id": batch.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    "n": pa.array(np.full(m * k, model.n), pa.int64()),
                    "deviation": pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    "whitened": pa.array(y.ravel()),
                    "explained": pa.array(np.tile(model.eigenvalues / model.trace, m)),
                    "identity_error": pa.array(np.full(m * k, model.identity_error)),
                }
            )

    return rows.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
