"""Models of lagged values from one table of cross moments.

Unit-root tests, causality between all ordered pairs, vector autoregressions with
their impulse responses and cointegration ranks are all least squares on the
present and lagged values of a few series.  Their rows are read once: each task
adds up the products of its rows' columns, one grouped sum makes the moments of
the table, and every regression, lag and pair is solved from those.  Moments are
kept apart for the first rows of a series, where some lags lack, so a model with
fewer lags uses all the rows it can.

Series are centred and scaled first; results are scaled back where that matters.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import incomplete_beta
from .ranges import lagged


def _products(frames: Iterator[pd.DataFrame], keys: list[str], columns: list[str]) -> Iterator[pd.DataFrame]:
    held: dict[tuple, np.ndarray] = {}
    for frame in frames:
        for name, part in frame.groupby([*keys, "_from"], dropna=False):
            x = np.nan_to_num(part[columns].to_numpy(float))
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            name = name if isinstance(name, tuple) else (name,)
            held[name] = held.get(name, 0) + x.T @ x
    at = np.array([(i, j) for i in range(len(columns) + 1) for j in range(i, len(columns) + 1)])
    for name, m in held.items():
        out = pd.DataFrame({"i": at[:, 0], "j": at[:, 1], "v": m[at[:, 0], at[:, 1]]})
        for k, v in reversed(list(zip([*keys, "_from"], name))):
            out.insert(0, k, v)
        yield out


def moments(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], lags: int) -> DataFrame:
    """``keys, _from, i, j, v``: sums of products of the columns (0 is the constant) over rows that have ``_from`` rows before them, ``lags`` at most."""
    keys, columns = list(keys), list(columns)
    rows = rows.withColumn("_from", F.least("position", F.lit(lags)).cast("int")).select(*keys, "_from", *columns)
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keys)
    found = rows.mapInPandas(partial(_products, keys=keys, columns=columns), f"{types}_from int, i int, j int, v double")
    return found.groupBy(*keys, "_from", "i", "j").agg(F.sum("v").alias("v"))


def scaled(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns centred and scaled by key, and ``_scale_<column>``, what they were divided by; a constant stays 0."""
    found = df.groupBy(*keys).agg(*[c for x in columns for c in (F.avg(x).alias(f"_m_{x}"), F.stddev_pop(x).alias(f"_s_{x}"))])
    df = df.join(found, list(keys)) if keys else df.join(found)  # one row
    df = df.withColumns({f"_scale_{x}": F.when(F.col(f"_s_{x}") > 0, F.col(f"_s_{x}")).otherwise(1.0) for x in columns})
    return df.withColumns({x: (F.col(x) - F.col(f"_m_{x}")) / F.col(f"_scale_{x}") for x in columns}).drop(*[f"_{k}_{x}" for k in "ms" for x in columns])


class Moments:
    """Sums of products of the constant and named columns, by the least number of rows before."""

    def __init__(self, frame: pd.DataFrame, columns: Sequence[str], lags: int):
        self.at = {c: i for i, c in enumerate(["1", *columns])}
        k = len(self.at)
        by = np.zeros((lags + 2, k, k))
        f, i, j, v = (frame[c].to_numpy() for c in ("_from", "i", "j", "v"))
        by[f, i, j] = v
        by[f, j, i] = v
        self.sums = np.cumsum(by[::-1], 0)[::-1]  # rows with so many rows before or more

    def of(self, least: int, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
        return self.sums[least][np.ix_([self.at[c] for c in left], [self.at[c] for c in right])]

    def rows(self, least: int) -> int:
        return int(round(self.sums[least][0, 0]))

    def regression(self, least: int, y: Sequence[str], x: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coefficients of y on x, residual products of y, and the inverse of x's products."""
        xx, xy = self.of(least, x, x), self.of(least, x, y)
        inverse = np.linalg.pinv(xx, rcond=1e-13, hermitian=True)
        b = inverse @ xy
        return b, self.of(least, y, y) - xy.T @ b - b.T @ xy + b.T @ xx @ b, inverse


def f_tail(f: float, d1: int, d2: int) -> float:
    """The chance of a larger F statistic."""
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def unit_root_p(t: float) -> float:
    """Approximate p-value of the test with a constant, from response surfaces of 1994 (fixed values)."""
    if t > 2.74:
        return 1.0
    if t < -18.83:
        return 0.0
    c = (2.1659, 1.4412, 0.038269) if t <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    return 0.5 * math.erfc(-sum(k * t**i for i, k in enumerate(c)) / math.sqrt(2))


def unit_roots(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: int | None = None, choose: bool = True, ranges: int | None = None) -> DataFrame:
    """``keys, statistic, lags, p, n``: augmented Dickey-Fuller tests with a constant.

    Up to ``lags`` lagged differences (by default as many as 12 times the fourth
    root of a hundredth of the longest series), of which Akaike's criterion chooses on common
    rows unless ``choose`` is false.  Series too short for a test have nulls.
    """
    keys = list(keys)
    df = scaled(df.filter(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("v")), keys, ["v"]).drop("_scale_v")
    if lags is None:
        longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
        lags = int(math.ceil(12 * (longest / 100) ** 0.25))
    rows = lagged(df, keys, order, ["v"], lags + 1, ranges)
    name = lambda k: "v" if k == 0 else f"v_{k}"
    diffs = {f"d{k}": F.col(name(k)) - F.col(name(k + 1)) for k in range(lags + 1)}
    columns = ["v_1", *diffs]
    found = moments(rows.withColumns(diffs), keys, columns, lags + 1)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        m, best = Moments(frame, columns, lags + 1), None
        most = min(lags, m.rows(1) // 2 - 2)
        x = lambda k: ["1", "v_1", *[f"d{i}" for i in range(1, k + 1)]]
        for k in range(most + 1) if choose else [most]:
            if most < 0 or m.rows(most + 1) <= k + 2:
                continue
            n, ssr = m.rows(most + 1), max(float(m.regression(most + 1, ["d0"], x(k))[1][0, 0]), 1e-300)
            score = n * math.log(ssr / n) + 2 * (k + 2)
            best = min(best or (math.inf, 0), (score, k))
        out = {c: frame[c].iloc[0] for c in keys} | {"statistic": None, "lags": None, "p": None, "n": m.rows(1)}
        if best is not None:
            k = best[1]
            b, ssr, inverse = m.regression(k + 1, ["d0"], x(k))
            n = m.rows(k + 1)
            variance = float(ssr[0, 0]) / (n - k - 2) * inverse[1, 1]
            if variance > 0:
                t = float(b[1, 0]) / math.sqrt(variance)
                out |= {"statistic": t, "lags": k, "p": unit_root_p(t), "n": n}
        return pd.DataFrame([out])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in keys)
    return found.groupBy(*keys).applyInPandas(solve, f"{types}statistic double, lags int, p double, n long")


def lag_moments(wide: DataFrame, order: Sequence[str], names: Sequence[str], lags: int, ranges: int | None = None) -> tuple[DataFrame, list[str], dict[str, float]]:
    """Moments of complete rows of the named columns and their lags; their columns; the scales."""
    names = list(names)
    df = scaled(wide.select(*order, *[F.col(c).cast("double").alias(c) for c in names]).dropna(), [], names)
    scales = df.agg(*[F.max(f"_scale_{c}").alias(c) for c in names]).first().asDict()
    rows = lagged(df.drop(*[f"_scale_{c}" for c in names]), [], order, names, lags, ranges)
    columns = [*names, *[f"{c}_{k}" for c in names for k in range(1, lags + 1)]]
    return moments(rows, [], columns, lags), columns, {c: v or 1.0 for c, v in scales.items()}


def solved(found: DataFrame, columns: list[str], lags: int, schema: str, solve: Callable[[Moments], list[tuple]]) -> DataFrame:
    """A small solution from a table of moments, in one task: its size is that of the moments."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(solve(Moments(frame, columns, lags)), columns=[c.split()[0] for c in schema.split(", ")])

    return found.groupBy().applyInPandas(run, schema)


def causality(wide: DataFrame, order: Sequence[str], names: Sequence[str], lags: int = 10, ranges: int | None = None) -> DataFrame:
    """``cause, effect, lag, f, p, n``: whether so many lags of one column help its own lags to foretell another, for all ordered pairs."""
    found, columns, _ = lag_moments(wide, order, names, lags, ranges)

    def solve(m: Moments) -> list[tuple]:
        out = []
        for effect in names:
            for k in range(1, lags + 1):
                n, own = m.rows(k), ["1", *[f"{effect}_{i}" for i in range(1, k + 1)]]
                if n <= 2 * k + 1:
                    continue
                without = float(m.regression(k, [effect], own)[1][0, 0])
                for cause in names:
                    if cause == effect:
                        continue
                    both = max(float(m.regression(k, [effect], own + [f"{cause}_{i}" for i in range(1, k + 1)])[1][0, 0]), 1e-300)
                    f = max(without - both, 0.0) / k / (both / (n - 2 * k - 1))
                    out.append((cause, effect, k, f, f_tail(f, k, n - 2 * k - 1), n))
        return out

    return solved(found, columns, lags, "cause string, effect string, lag int, f double, p double, n long", solve)


def best_lags(tests: DataFrame) -> DataFrame:
    """The lag with the least p-value of each pair, the shorter on ties."""
    best = F.struct(F.col("p"), F.col("lag"), F.col("f"), F.col("n"))
    return tests.groupBy("cause", "effect").agg(F.min(best).alias("b")).select("cause", "effect", "b.lag", "b.f", "b.p", "b.n")


def autoregression(m: Moments, names: list[str], lags: int) -> tuple[list[np.ndarray], np.ndarray, int]:
    """Coefficient matrices (effect by cause) of a vector autoregression, residual products, rows."""
    x = ["1", *[f"{c}_{k}" for k in range(1, lags + 1) for c in names]]
    b, products, _ = m.regression(lags, names, x)
    k = len(names)
    return [b[1 + i * k : 1 + (i + 1) * k].T for i in range(lags)], products, m.rows(lags)


def impulse_responses(wide: DataFrame, order: Sequence[str], names: Sequence[str], lags: int = 10, days: int = 20, ranges: int | None = None) -> DataFrame:
    """``shock, target, day, response, orthogonal, order``: what a unit, or a typical own, shock to one column does to each.

    Akaike's criterion on common rows chooses the order, of at least one.
    Orthogonal shocks come in the order of the names.
    """
    names, k = list(names), len(names)
    found, columns, scales = lag_moments(wide, order, names, lags, ranges)
    scale = np.array([scales[c] for c in names])

    def solve(m: Moments) -> list[tuple]:
        best, most = None, min(lags, (m.rows(0) - 2) // (k + 1))
        for p in range(1, most + 1):
            n = m.rows(most)
            x = ["1", *[f"{c}_{i}" for i in range(1, p + 1) for c in names]]
            if n <= len(x) + k:
                continue
            sign, size = np.linalg.slogdet(m.regression(most, names, x)[1] / n)
            if sign > 0:
                best = min(best or (math.inf, 1), (size + 2 * (p * k * k + k) / n, p))
        if best is None:
            return []
        p = best[1]
        a, products, n = autoregression(m, names, p)
        root = np.linalg.cholesky(products / max(n - k * p - 1, 1))
        powers = [np.eye(k)]
        for day in range(1, days):
            powers.append(sum(a[i] @ powers[day - 1 - i] for i in range(min(p, day))))
        out = []
        for day, now in enumerate(powers):
            own = scale[:, None] * now / scale[None, :]
            orthogonal = scale[:, None] * (now @ root)
            out += [(names[j], names[i], day, float(own[i, j]), float(orthogonal[i, j]), p) for i in range(k) for j in range(k)]
        return out

    return solved(found, columns, lags, "shock string, target string, day int, response double, orthogonal double, lags int", solve)


#: 95 % critical values of the trace statistic with a constant, by the number of relations left (fixed values).
TRACE = {1: 3.8415, 2: 15.4943, 3: 29.7961, 4: 47.8545, 5: 69.8189, 6: 95.7542}


def residual_moments(m: Moments, names: list[str], lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Products of differences and of earlier levels, each less what ``lags`` lagged differences explain."""
    least = lags + 1
    z = ["1", *[f"d_{c}_{i}" for i in range(1, lags + 1) for c in names]]
    now, before = [f"d_{c}" for c in names], [f"{c}_1" for c in names]
    zz = np.linalg.pinv(m.of(least, z, z), rcond=1e-13, hermitian=True)
    part = lambda a, b: m.of(least, a, b) - m.of(least, a, z) @ zz @ m.of(least, z, b)
    n = m.rows(least)
    return part(now, now) / n, part(now, before) / n, part(before, before) / n, n


def cointegration(wide: DataFrame, order: Sequence[str], names: Sequence[str], lags: int = 2, ranges: int | None = None) -> DataFrame:
    """``relation, eigenvalue, trace, critical, found, name, weight, adjustment, n``: cointegrating relations of levels.

    A row for each possible relation and column: the trace statistic of "no more
    than so many before", whether that is rejected, the column's weight in the
    relation (its first column's is 1) and how it adjusts to a gap.
    """
    names, k = list(names), len(names)
    df = scaled(wide.select(*order, *[F.col(c).cast("double").alias(c) for c in names]).dropna(), [], names)
    scales = df.agg(*[F.max(f"_scale_{c}").alias(c) for c in names]).first().asDict()
    scale = np.array([scales[c] or 1.0 for c in names])
    rows = lagged(df.drop(*[f"_scale_{c}" for c in names]), [], order, names, lags + 1, ranges)
    at = lambda c, i: c if i == 0 else f"{c}_{i}"
    diffs = {(f"d_{c}" if i == 0 else f"d_{c}_{i}"): F.col(at(c, i)) - F.col(at(c, i + 1)) for c in names for i in range(lags + 1)}
    columns = [*[f"{c}_1" for c in names], *diffs]
    found = moments(rows.withColumns(diffs), [], columns, lags + 1)

    def solve(m: Moments) -> list[tuple]:
        s00, s01, s11, n = residual_moments(m, names, lags)
        if n <= k * (lags + 2) + 1:
            return []
        root = np.linalg.cholesky(s11 + np.eye(k) * 1e-14 * np.trace(s11))
        inner = np.linalg.solve(root, s01.T @ np.linalg.pinv(s00) @ s01)
        values, vectors = np.linalg.eigh((lambda x: (x + x.T) / 2)(np.linalg.solve(root, inner.T)))
        values, vectors = np.clip(values[::-1], 0, 1 - 1e-15), np.linalg.solve(root.T, vectors[:, ::-1])
        out, still = [], True
        for r in range(k):
            trace = -n * float(np.log1p(-values[r:]).sum())
            still = still and trace > TRACE[k - r]
            beta = vectors[:, r]
            adjust = s01 @ beta  # the relation has unit variance
            weight = beta / scale
            first = weight[0] if abs(weight[0]) > 1e-300 else 1.0
            out += [(r + 1, float(values[r]), trace, TRACE[k - r], bool(still), c, float(w / first), float(d * s * first), n) for c, w, d, s in zip(names, weight, adjust, scale)]
        return out

    if k > max(TRACE):
        raise ValueError(f"critical values are known for {max(TRACE)} series at most")
    return solved(found, columns, lags + 1, "relation int, eigenvalue double, trace double, critical double, found boolean, name string, weight double, adjustment double, n long", solve)
