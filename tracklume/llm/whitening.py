"""Whitening of embeddings by a bidiagonal qd solver.

Vectors become integers ``x = floor(scale * c)``; the distinct ones are the fit list.  Its sums are exact.  The centred rows are reduced
by blockwise QR: each task keeps one triangle, triangles are merged a few at a time.  The last triangle is brought to
bidiagonal form by Householder reflections, the dqds algorithm finds its singular values to high relative accuracy, and twisted
factorisations give the singular vectors of the largest ones, the whitening directions.  The covariance matrix itself is never formed.

Vectors of different lengths are different spaces: each length has its own fit list.  Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.sources.tables import stored

BLOCK_BYTES = 1 << 22
MERGED = 8  # triangles in one task
#: relative distance below which eigenvalues are a cluster, whose vectors are made orthogonal
CLUSTER = 1e-3

_EPS = np.finfo(np.float64).eps


def integer_vector(vector: str, scale: int = 256) -> Column:
    """``floor(scale * c)`` of every entry as a long; NULL if the vector is null, or an entry is null, not finite or too large for a long."""
    scaled = F.transform(F.col(vector), lambda c: F.lit(float(scale)) * c.cast("double"))
    fine = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(scaled, lambda c: F.floor(c).cast("long")))


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right transformation ``V`` with ``r = U B V'`` by Householder reflections; ``r`` is square."""
    a = r.astype(np.float64).copy()
    n = len(a)
    right = np.eye(n)
    for k in range(n):
        _reflect(a[k:, k:])
        if k + 2 < n:
            _reflect(a[k:, k + 1 :].T, right[:, k + 1 :].T)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflect(a: np.ndarray, along: np.ndarray | None = None) -> None:
    """Bring the first column of ``a`` to a multiple of the first unit vector, in place; the same reflection on the rows of ``along``."""
    v = a[:, 0].copy()
    length = np.linalg.norm(v)
    if length == 0 or not v[1:].any():
        return
    v[0] += np.copysign(length, v[0])
    v /= np.linalg.norm(v)
    a -= 2 * np.outer(v, v @ a)
    if along is not None:
        along -= 2 * np.outer(v, v @ along)


def _least_bound(q: np.ndarray, e: np.ndarray) -> float:
    """A lower bound of the least eigenvalue of ``B'B`` that is close once it stands apart: one over the trace of the inverse."""
    total, row = 0.0, 0.0
    for i in range(len(q) - 1, -1, -1):
        if q[i] <= 0:
            return 0.0
        row = (1 + (e[i] * row if i < len(e) else 0.0)) / q[i]
        total += row
    return (1 - 8 * len(q) * _EPS) / total if np.isfinite(total) else 0.0


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential quotient-difference step with a shift; None if the shift was too large."""
    new_q, new_e = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        if new_q[i] == 0:  # a zero row: what follows stands alone
            new_e[i], d = 0.0, q[i + 1] - shift
            continue
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e


def singular_squares(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, by dqds."""
    if not len(diagonal):
        return np.zeros(0)
    found = []
    segments = [(diagonal**2, upper**2, 0.0)]
    while segments:
        q, e, moved = segments.pop()
        while len(q):
            small = np.flatnonzero(e <= _EPS**2 * (np.minimum(q[:-1], q[1:]) + moved))
            if len(small):  # two matrices that have nothing to do with each other
                cut = int(small[-1])
                segments.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 1:  # also the last one, once its coupling is negligible
                found.append(q[0] + moved)
                break
            shift = _least_bound(q, e)
            step = _dqds_step(q, e, shift)
            while step is None:  # rounding made the bound too large
                shift = shift / 2 if shift > _EPS**2 * moved else 0.0
                step = _dqds_step(q, e, shift)
            moved += shift
            q, e = step
    return np.sort(np.asarray(found))[::-1]


def _twisted(q: np.ndarray, e: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stationary and progressive factors of ``B'B - value``: multipliers and pivots downwards, upwards, and the twist values."""
    n = len(q)
    diagonal = q + np.concatenate([[0.0], e])  # of B'B
    off = q[:-1] * e  # squares of its off-diagonal entries
    tiny = _EPS * max(float(diagonal.max()), 1e-300) * 1e-3
    down, up = np.empty(n), np.empty(n)
    # differential forms: s and p carry what the subtraction of nearly equal numbers would lose
    s = -value
    for i in range(n):
        down[i] = q[i] + s
        if down[i] == 0:
            down[i] = tiny
        if i < n - 1:
            s = e[i] * (s / down[i]) - value
    p = q[n - 1] - value
    for i in range(n - 1, -1, -1):
        if i == n - 1:
            up[i] = p + (e[i - 1] if n > 1 else 0.0)
        else:
            previous = up[i + 1] if up[i + 1] != 0 else tiny
            p = q[i] * (p / previous) - value
            up[i] = p + (e[i - 1] if i else 0.0)
    up[up == 0] = tiny
    gamma = down + up - (diagonal - value)
    return diagonal, off, down, up, gamma


def _by_twist(diagonal, root, down, up, twist: int) -> np.ndarray:
    """The vector of a twisted factorisation: one at the twist, the rest by products of multipliers."""
    n = len(diagonal)
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -(root[i] / down[i]) * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -(root[i] / up[i + 1]) * z[i]
        if abs(z[i + 1]) > 1e150:
            z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def _solve(diagonal: np.ndarray, root: np.ndarray, down: np.ndarray, up: np.ndarray, gamma: np.ndarray, twist: int, rhs: np.ndarray) -> np.ndarray:
    """Solve with a twisted factorisation: eliminate from both ends to the twist, substitute back outwards."""
    n, y = len(rhs), rhs.copy()
    for i in range(twist):
        y[i + 1] -= root[i] / down[i] * y[i]
    for i in range(n - 1, twist, -1):
        y[i - 1] -= root[i - 1] / up[i] * y[i]
    z = np.empty(n)
    z[twist] = y[twist] / (gamma[twist] if gamma[twist] != 0 else _EPS * np.abs(diagonal).max())
    for i in range(twist - 1, -1, -1):
        z[i] = (y[i] - root[i] * z[i + 1]) / down[i]
    for i in range(twist, n - 1):
        z[i + 1] = (y[i + 1] - root[i] * z[i]) / up[i + 1]
    return z / np.linalg.norm(z)


def singular_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of an upper bidiagonal matrix for some squared singular values, falling.

    A value apart from the others gives its vector by one twisted factorisation, twisted where its remainder is least.  Within a
    cluster the same factorisation serves for inverse iteration with vectors kept orthogonal to the earlier ones.
    """
    q, e = diagonal**2, upper**2
    root = diagonal[:-1] * upper
    out = np.zeros((len(q), len(values)))
    for j, value in enumerate(values):
        full, _, down, up, gamma = _twisted(q, e, float(value))
        twist = int(np.abs(gamma).argmin())
        near = [k for k in range(j) if abs(values[k] - value) <= CLUSTER * values[0]]
        z = _by_twist(full, root, down, up, twist)
        if near or np.linalg.norm(_residual(full, root, z, value)) > 1e3 * _EPS * values[0]:
            rng = np.random.default_rng(j)
            z = rng.normal(size=len(q)) if near else z
            for _ in range(4):
                z -= out[:, near] @ (out[:, near].T @ z)
                z = _solve(full, root, down, up, gamma, twist, z / np.linalg.norm(z))
            for _ in range(2):
                z -= out[:, near] @ (out[:, near].T @ z)
                z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def _residual(diagonal: np.ndarray, root: np.ndarray, z: np.ndarray, value: float) -> np.ndarray:
    out = (diagonal - value) * z
    out[:-1] += root * z[1:]
    out[1:] += root * z[:-1]
    return out


def directions(triangle: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors (rows) of the covariance for the first ``k`` components, and its trace.

    The largest entry of a vector is positive.  A component without any spread has the eigenvalue 0 and no direction (zeros).
    """
    diagonal, upper, right = bidiagonal(triangle)
    squares = singular_squares(diagonal, upper)[:k]
    if len(squares) and squares[0] > 0:
        squares = np.where(squares <= (8 * len(diagonal) * _EPS) ** 2 * squares[0], 0.0, squares)
    vectors = np.zeros((len(squares), len(diagonal)))
    vectors[squares > 0] = (right @ singular_vectors(diagonal, upper, squares[squares > 0])).T
    largest = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]
    return squares / n, vectors, float((triangle**2).sum() / n)


_BLOCKS = "d int, ids array<long>, cells binary"


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows ``vec_id, x`` as blocks of a few megabytes of one vector length: ``d``, ``ids``, ``cells`` (64-bit integers, row by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            lengths, ids = np.diff(offsets), batch.column("vec_id")
            for d in np.unique(lengths).tolist():
                here = np.flatnonzero(lengths == d)
                step = max(1, BLOCK_BYTES // max(8, 8 * d))
                for at in range(0, len(here), step):
                    part = here[at : at + step]
                    cells = values[(offsets[part][:, None] + np.arange(d)).ravel()].astype(np.int64)
                    keys = ids.take(pa.array(part)).to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([cells.tobytes()], pa.binary())], ["d", "ids", "cells"]
                    )

    return rows.select("vec_id", "x").mapInArrow(run, _BLOCKS)


def _block(row: dict) -> np.ndarray:
    return np.frombuffer(row["cells"], np.int64).reshape(len(row["ids"]), row["d"])


def _sums(fit: DataFrame) -> DataFrame:
    """``d``, ``n`` and exact ``sums`` per place of the fit list of each vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x = _block(row)
                kept = total.setdefault(row["d"], [0, np.zeros(row["d"], object)])
                kept[0] += len(x)
                # halves of 32 bits cannot overflow within a block
                kept[1] = kept[1] + ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        for d, (n, sums) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["d", "n", "sums"]
            )

    parts = fit.mapInArrow(run, "d int, n long, sums array<string>")
    count = parts.groupBy("d").agg(F.sum("n").alias("n"))
    placed = parts.select("d", F.posexplode("sums").alias("place", "s")).groupBy("d", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    listed = placed.groupBy("d").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda p: p["s"].cast("string")).alias("sums"))
    return count.join(listed, "d")  # a row per vector length; a vector without entries has no place and no component


def _triangles(fit: DataFrame) -> DataFrame:
    """One triangle per task and vector length of the centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            for row in batch.to_pylist():
                mean = np.asarray([int(s) / row["n"] for s in row["sums"]])
                centred = _block(row) - mean
                d = row["d"]
                # as many rows at a time as a triangle has keep the work linear in the rows
                for at in range(0, len(centred), max(d, 1024)):
                    kept[d] = np.linalg.qr(np.vstack([kept.get(d, np.zeros((0, d))), centred[at : at + max(d, 1024)]]), mode="r")
        for d, r in kept.items():
            yield _triangle_row(d, part, r)

    return fit.mapInArrow(run, "d int, part int, r binary")


def _triangle_row(d: int, part: int, r: np.ndarray) -> pa.RecordBatch:
    square = np.zeros((d, d))
    square[: len(r)] = r
    return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), pa.array([square.tobytes()], pa.binary())], ["d", "part", "r"])


def _merged(table: pa.Table) -> pa.Table:
    rows = table.sort_by("part").to_pylist()
    d, r = rows[0]["d"], np.zeros((0, rows[0]["d"]))
    for row in rows:
        r = np.linalg.qr(np.vstack([r, np.frombuffer(row["r"], np.float64).reshape(d, d)]), mode="r")
    return pa.Table.from_batches([_triangle_row(d, rows[0]["part"] // MERGED, r)])


def fitted(fit: DataFrame, k: int = 4) -> DataFrame:
    """Per vector length ``d``: ``n``, ``sums`` and the first ``k`` components (``values``, ``vectors`` row by row, ``trace``) of a fit list in blocks."""
    sums = stored(_sums(fit), "sums")
    triangles = stored(_triangles(fit.join(sums, "d")), "triangles")  # a block meets one row of sums; the shorter side is a row per length
    last = triangles.agg(F.max("part")).first()[0] or 0
    merged = triangles
    while last > 0:
        merged = merged.groupBy("d", F.floor(F.col("part") / MERGED).alias("group")).applyInArrow(_merged, "d int, part int, r binary")
        last //= MERGED

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                triangle = np.frombuffer(row["r"], np.float64).reshape(row["d"], row["d"])
                values, vectors, trace = directions(triangle, row["n"], k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["d"]], pa.int32()), pa.array([row["n"]], pa.int64()), pa.array([row["sums"]], pa.list_(pa.string())),
                        pa.array([values.tolist()], pa.list_(pa.float64())), pa.array([vectors.ravel().tolist()], pa.list_(pa.float64())), pa.array([trace]),
                    ],
                    ["d", "n", "sums", "values", "vectors", "trace"],
                )

    model = merged.join(sums, "d").select("d", "n", "sums", "r").mapInArrow(solve, "d int, n long, sums array<string>, values array<double>, vectors array<double>, trace double")
    return stored(model, "directions")


def _projected(x: np.ndarray, row: dict) -> np.ndarray:
    """Whitened values, rows x components; NaN for a component without spread."""
    mean = np.asarray([int(s) / row["n"] for s in row["sums"]])
    values = np.asarray(row["values"])
    vectors = np.asarray(row["vectors"]).reshape(len(values), -1)
    scores = (x - mean) @ vectors.T
    return np.where(values > 0, scores / np.sqrt(np.where(values > 0, values, 1.0)), np.nan)


def _deviations(x: np.ndarray, n: int, sums: list[str]) -> list[int | None]:
    """Exact sums of ``(n * x - S) ** 2``; None where the sum is no long."""
    total = np.asarray([int(s) for s in sums], object)
    most = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in total), default=0)
    if most * most * max(1, x.shape[1]) < 1 << 63:
        gap = n * x - total.astype(np.int64)
        return (gap * gap).sum(1).tolist()
    gap = n * x.astype(object) - total
    exact = (gap * gap).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _identity_error(fit: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """Per vector length the largest absolute entry of the whitened fit list's covariance less the identity."""
    names = [f"w{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = _projected(_block(row), row)
                columns = [pa.array(w[:, i], mask=np.isnan(w[:, i])) if i < w.shape[1] else pa.nulls(len(w), pa.float64()) for i in range(k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), row["d"]), pa.int32()), *columns], ["d", *names])

    rows = fit.join(model, "d").mapInArrow(run, "d int, " + ", ".join(f"{c} double" for c in names))
    gaps = [F.abs(F.covar_pop(a, b) - F.lit(float(a == b))) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy("d").agg((F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("identity_error"))


def whitened(vectors: DataFrame, k: int = 4, scale: int = 256) -> DataFrame:
    """Rows ``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector and component up to ``k``.

    A vector that is null, or holds a null, a non-finite entry or one whose integer is no long, is left out; a row with a null id stays with a
    null id; repeated rows are each answered and count once in the fit list.  A vector with fewer than ``k`` entries has as many components.
    Each vector length has a fit list of its own.  Where the fit list has no spread along a component, ``whitened`` is null and ``explained`` 0 (null if it
    has none at all).  ``deviation`` is null where it is too large for a long.  An empty table gives no row.  Other columns are not read.
    """
    rows = vectors.select("vec_id", integer_vector("embedding", scale).alias("x")).where(F.col("x").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    distinct = rows.groupBy("x").agg(F.lit(None).cast("long").alias("vec_id"))  # copies meet before the shuffle and after it
    fit = stored(_in_blocks(distinct), "fit")
    model = fitted(fit, k)
    facts = stored(model.join(_identity_error(fit, model, k), "d", "left"), "model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _block(row)
                w, many = _projected(x, row), len(row["values"])
                deviation = _deviations(x, row["n"], row["sums"])
                share = [v / row["trace"] if row["trace"] > 0 else None for v in row["values"]]
                flat = w.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i in row["ids"] for _ in range(many)], pa.int64()),
                        pa.array(np.tile(np.arange(1, many + 1), len(x)), pa.int32()),
                        pa.array(np.full(len(flat), row["n"]), pa.int64()),
                        pa.array([v for v in deviation for _ in range(many)], pa.int64()),
                        pa.array(flat, mask=np.isnan(flat)),
                        pa.array(share * len(x), pa.float64()),
                        pa.array([row["identity_error"]] * len(flat), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return _in_blocks(rows).join(facts, "d").mapInArrow(run, result)
