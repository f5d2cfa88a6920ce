"""Whitening of vectors by a bidiagonal qd solver.

The fit list is every distinct vector of whole numbers, once.  Its sums are exact.
Rows centred as ``(n*x - S) / n`` go through blockwise QR: each task folds its
rows into one triangle, and a tree of grouped merges makes one ``R`` of them.
Householder reflections bring ``R`` to bidiagonal form; differential qd sweeps
with shifts find its singular values to high relative accuracy; and a twisted
factorisation for each value gives the right singular vector, of which those of
close values are made orthogonal.  Singular values squared over ``n`` are the
eigenvalues of the covariance, which itself is never formed.  A last pass over the
fit list measures how far the whitened covariance is from the identity.

Null vectors and those with null or non-finite components are dropped.  Vectors of
each length are fitted apart.  Components without variance (as far as doubles
tell) are left out, so one distinct vector gives no rows, and vectors without
components give none.  Rows that repeat count once in the fit and get rows each.
Components of ``2**62 / scale`` and more are taken as that.  A deviation beyond a
long is null.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vector_codes import LARGE, whole_vectors

EPS = float(np.finfo(np.float64).eps)


# ---- the small solver --------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor ``Q`` of ``U^T r Q``, by Householder reflections."""
    a, d = r.astype(np.float64).copy(), r.shape[0]
    q = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        v, norm = x.copy(), float(np.linalg.norm(x))
        if norm == 0:
            return v, 0.0
        v[0] += math.copysign(norm, x[0])
        return v / np.linalg.norm(v), 2.0

    for k in range(d):
        v, tau = reflector(a[k:, k])
        a[k:, k:] -= tau * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, tau = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= tau * np.outer(a[k:, k + 1 :] @ v, v)
            q[:, k + 1 :] -= tau * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd transform; None if the shift was too large."""
    n, d = len(q), q[0] - shift
    least, new_q, new_e = d, [], []
    for k in range(n - 1):
        top = d + e[k]
        if d < 0 or top <= 0:
            return None
        t = q[k + 1] / top
        new_q.append(top)
        new_e.append(e[k] * t)
        d = d * t - shift
        least = min(least, d)
    if d < 0:
        return None
    return [*new_q, d], new_e, least


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by dqds."""
    scale = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(above).max(initial=0)))
    if scale == 0 or not len(diagonal):
        return np.zeros(len(diagonal))
    found = []
    tiny = np.finfo(np.float64).tiny / EPS
    blocks = [([float(x / scale) ** 2 for x in diagonal], [float(x / scale) ** 2 for x in above], 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        sweeps, most = 0, 100 * len(q) + 500
        while len(q) > 1:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= (32 * EPS) ** 2 * (min(q[k], q[k + 1]) + moved) + tiny), None)
            if cut is not None:
                if cut < len(q) - 2:  # the upper part goes on apart
                    blocks.append((q[: cut + 1], e[:cut], moved))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                else:
                    found.append(q.pop() + moved)
                    e.pop()
                continue
            sweeps += 1
            if 1.5 * q[0] < q[-1]:  # graded the wrong way round: the reversed array has the same values
                q, e = q[::-1], e[::-1]
            if sweeps > most:
                raise ArithmeticError("singular values did not settle")
            # The smaller eigenvalue of the last two rows is close to the least one in the end.
            a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], math.sqrt(q[-2] * e[-1])
            mid, half = (a + b) / 2, math.hypot((a - b) / 2, c)
            low = max((q[-2] + (e[-2] if len(e) > 1 else 0.0)) * q[-1] / (mid + half), 0.0) if mid + half else 0.0
            shift = min(low, q[-1]) * (1 - 1e-3 if e[-1] > 1e-8 * q[-1] else 1 - 4 * EPS)
            done = None
            for s in (shift, shift * 0.75, shift * 0.25, 0.0):
                if (done := _sweep(q, e, s)) is not None:
                    break
            if done is None:  # a zero on the diagonal
                s, done = 0.0, ([x if x > 0 else tiny for x in q], e, 0.0)
                q, e = done[0], done[1]
                continue
            q, e, _ = done
            moved += s
        found += [x + moved for x in q]
    return np.sort(np.array(found))[::-1] * scale * scale


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """A unit eigenvector of ``B^T B`` for a close eigenvalue, by a twisted factorisation of its shifted form."""
    n = len(diagonal)
    tiny = EPS * EPS * max(float((diagonal**2).max()), 1e-300)
    a = np.where(np.abs(diagonal) < math.sqrt(tiny), math.sqrt(tiny), diagonal)
    d, low = a * a, above / a[:-1]  # B^T B = L D L^T
    plus, minus, s, p = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
    lp, um = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0] = -value
    for k in range(n - 1):
        plus[k] = s[k] + d[k]
        if abs(plus[k]) < tiny:
            plus[k] = -tiny
        lp[k] = d[k] * low[k] / plus[k]
        s[k + 1] = lp[k] * low[k] * s[k] - value
    p[n - 1] = d[n - 1] - value
    for k in range(n - 2, -1, -1):
        minus[k + 1] = d[k] * low[k] ** 2 + p[k + 1]
        if abs(minus[k + 1]) < tiny:
            minus[k + 1] = -tiny
        t = d[k] / minus[k + 1]
        um[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    at = int(np.abs(s + p + value).argmin())
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -lp[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -um[k] * z[k]
    return z / np.linalg.norm(z)


def principal_axes(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Falling squared singular values of ``r``, up to ``most`` that aren't rounding, their right vectors, and the sum of all."""
    diagonal, above, back = bidiagonal(r)
    values = squared_singular_values(diagonal, above)
    rank = int((values > (EPS * len(values)) ** 2 * values[0]).sum()) if len(values) else 0
    take = min(most, rank)
    axes = np.zeros((len(diagonal), take))
    for k in range(take):
        z = twisted_vector(diagonal, above, values[k])
        # Vectors of close values are told apart against each other; what is left of one that was
        # there already is replaced by a start that is not.
        close = [j for j in range(k) if values[j] - values[k] <= 1e-3 * values[k]]
        for again in range(3):
            for j in close * 2:
                z = z - (axes[:, j] @ z) * axes[:, j]
            size = float(np.linalg.norm(z))
            if size > 1e-2:
                z = z / size
                break
            z = _solved(diagonal, above, values[k] * (1 + (again + 1) * 8 * EPS), np.random.default_rng(k + again).standard_normal(len(z)), [axes[:, j] for j in close])
        axes[:, k] = z
    return values, back @ axes, float(values.sum())


def _solved(diagonal: np.ndarray, above: np.ndarray, value: float, start: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """Inverse iteration from a start at right angles to vectors already found."""
    b = np.diag(diagonal) + np.diag(above, 1)
    m = b.T @ b - value * np.eye(len(diagonal))
    m += np.eye(len(m)) * EPS * np.abs(m).max()
    for _ in range(4):
        for v in against * 2:
            start = start - (v @ start) * v
        start = np.linalg.solve(m, start)
        start = start / np.linalg.norm(start)
    return start


# ---- on Spark ----------------------------------------------------------------


def packed(x: np.ndarray, offset: int) -> list[bytes]:
    """Whole vectors as bytes in the smallest width that holds them; equal vectors, equal bytes."""
    x = x - offset
    size = np.abs(x).max(1, initial=0)
    width = np.select([size < 2**7, size < 2**15, size < 2**31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for i, row in zip(at.tolist(), x[at].astype(f"<i{w}")):
            out[i] = bytes([w]) + row.tobytes()
    return out


def unpacked(rows: list[bytes], offset: int) -> np.ndarray:
    return np.array([np.frombuffer(r, f"<i{r[0]}", offset=1) for r in rows], np.int64) + offset


def _whole(batches: Iterator[pa.RecordBatch], scale: float, offset: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, x in whole_vectors(batch.column(1), scale, offset):
            if len(at) and x.shape[1]:
                cols = [batch.column(0).take(pa.array(at)), pa.array([x.shape[1]] * len(at), pa.int32()), pa.array(packed(x, offset), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "dim", "x"])


def _matrices(batches: Iterator[pa.RecordBatch], offset: int, rows: int = 2048) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield unpacked(batch.column(0).slice(at, rows).to_pylist(), offset)


def _sums(batches: Iterator[pa.RecordBatch], offset: int) -> Iterator[pa.RecordBatch]:
    """A task's rows and sums, per dimension."""
    n, sums = 0, 0
    for x in _matrices(batches, offset):
        big = int(np.abs(x).max()) >= LARGE // max(len(x), 1)
        n, sums = n + len(x), sums + (x.astype(object) if big else x).sum(0).astype(object)
    if n:
        at = pa.array(range(len(sums)), pa.int32())
        # Exact in two halves, so that no sum of them overflows.
        yield pa.RecordBatch.from_arrays([at, pa.array([n] * len(sums), pa.int64()), pa.array([int(s) >> 31 for s in sums], pa.int64()), pa.array([int(s) & (2**31 - 1) for s in sums], pa.int64())], names=["at", "n", "high", "low"])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n*x - S``, exact."""
    if n * int(np.abs(x).max(initial=0)) < LARGE:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _triangle(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


def _reduced(batches: Iterator[pa.RecordBatch], offset: int, n: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's centred rows as one triangle."""
    r = np.zeros((0, len(sums)))
    for x in _matrices(batches, offset):
        r = _triangle(r, centred(x, n, sums).astype(np.float64) / n)
    if len(r):
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])


def _merged(rows: pd.DataFrame, dim: int) -> pd.DataFrame:
    rows = rows.sort_values("part")
    r = np.zeros((0, dim))
    for b in rows["r"]:
        r = _triangle(r, np.frombuffer(b).reshape(-1, dim))
    return pd.DataFrame({"part": rows["to"].iloc[:1], "r": [r.tobytes()]})


def _spread(batches: Iterator[pa.RecordBatch], offset: int, model: tuple) -> Iterator[pa.RecordBatch]:
    """A task's rows, sums and products of whitened components."""
    rows, total, cross = 0, 0, 0
    for x in _matrices(batches, offset):
        w = whitened(x, model)
        rows, total, cross = rows + len(x), total + w.sum(0), cross + w.T @ w
    if rows:
        k = len(total)
        at = [(i, j) for i in range(k) for j in range(k)]
        cols = [pa.array([a[i] for a in at], pa.int32()) for i in (0, 1)] + [pa.array([float(v) for v in c], pa.float64()) for c in ([total[i] for i, _ in at], [total[j] for _, j in at], cross.ravel())]
        yield pa.RecordBatch.from_arrays(cols, names=["i", "j", "si", "sj", "sij"])


def whitened(x: np.ndarray, model: tuple) -> np.ndarray:
    n, sums, axes, eigen = model
    return centred(x, n, sums).astype(np.float64) / n @ axes / np.sqrt(eigen)


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def _applied(batches: Iterator[pa.RecordBatch], scale: float, offset: int, model: tuple, explained: list[float]) -> Iterator[pa.RecordBatch]:
    n, sums, axes, _ = model
    dim, k = axes.shape
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            for at, x in whole_vectors(part.column(1), scale, offset):
                if x.shape[1] != dim or not len(at):
                    continue
                off = centred(x, n, sums)
                if off.dtype != object and dim * int(np.abs(off).max()) ** 2 >= 2**63:
                    off = off.astype(object)
                dev = [v if v < 2**63 else None for v in map(int, (off * off).sum(1))]
                ids = part.column(0).take(pa.array(np.repeat(at, k)))
                cols = [ids, pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(np.full(len(at) * k, n), pa.int64())]
                cols.append(pa.array(dev, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))))
                cols += [pa.array(whitened(x, model).ravel()), pa.array(np.tile(explained, len(at)))]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in OUT.split(", ")])


def whitening(
    vectors: DataFrame,
    components: int = 16,
    scale: float = 64.0,
    offset: int = 1_000_000,
    fan_in: int = 16,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every kept row and component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = rows.mapInArrow(partial(_whole, scale=scale, offset=offset), "vec_id long, dim int, x binary")
    fit = stored(whole.select("dim", "x").distinct(), "fit")
    out = spark.createDataFrame([], f"{OUT}, identity_error double")
    for dim in sorted(r["dim"] for r in fit.select("dim").distinct().collect()):
        own = fit.filter(F.col("dim") == dim).select("x")
        per = own.mapInArrow(partial(_sums, offset=offset), "at int, n long, high long, low long")
        per = per.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("at").collect()
        n, sums = per[0]["n"], np.array([(r["high"] << 31) + r["low"] for r in per], object)
        # Triangles of the tasks, then of `fan_in` triangles each, until one is left.
        parts = own.rdd.getNumPartitions()
        found = own.mapInArrow(partial(_reduced, offset=offset, n=n, sums=sums), "part int, r binary")
        while parts > 1:
            merge = partial(_merged, dim=dim)
            found = found.withColumn("to", F.expr(f"part div {fan_in}").cast("int")).groupBy("to").applyInPandas(merge, "part int, r binary")
            parts = -(-parts // fan_in)
        r = np.frombuffer(found.first()["r"]).reshape(-1, dim)
        r = np.vstack([r, np.zeros((dim - len(r), dim))]) if len(r) < dim else r
        values, axes, total = principal_axes(r, components)
        if not axes.shape[1]:
            continue
        eigen = values[: axes.shape[1]] / n
        model, explained = (n, sums, axes, eigen), (eigen / (total / n)).tolist()
        spread = own.mapInArrow(partial(_spread, offset=offset, model=model), "i int, j int, si double, sj double, sij double")
        spread = spread.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("si", "sj", "sij")])
        off = F.abs(F.col("sij") / n - F.col("si") / n * F.col("sj") / n - (F.col("i") == F.col("j")).cast("int"))
        error = spread.agg(F.max(off)).first()[0]
        applied = rows.mapInArrow(partial(_applied, scale=scale, offset=offset, model=model, explained=explained), OUT)
        out = out.union(applied.withColumn("identity_error", F.lit(float(error))))
    return out
