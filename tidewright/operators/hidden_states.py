"""Hidden Markov states of long series, range by range.

A row's step from one state distribution to the next is a small matrix, transition
times density.  Products of these matrices are associative: each range reports
the product over its rows (scaled, with the logarithm of what was taken out), the
products in order give the distribution that each range starts from and what
follows its end, and each range then runs forward and backward on its own.  The
most likely path goes the same way with maxima for sums.  Fits are
expectation-maximisation with two such passes a round; of each series the driver
holds a few numbers per state.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .ranges import PART, ROW, carried, cut, folded, within

Params = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # start, transition, means, variances


def log_densities(x: np.ndarray, params: Params) -> np.ndarray:
    _, _, mean, var = params
    return -0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)


def steps(x: np.ndarray, first: bool, params: Params) -> tuple[np.ndarray, float]:
    """Each row's matrix, scaled so that its densities are at most 1, and the logarithm of all scales."""
    d = log_densities(x, params)
    top = d.max(1, keepdims=True)
    m = params[1][None] * np.exp(d - top)[:, None, :]
    if first and len(x):  # the first row of a series has no step before it
        m[0] = np.diag(np.exp(d[0] - top[0]))
    return m, float(top.sum())


def product(m: np.ndarray) -> tuple[np.ndarray, float]:
    """The product of matrices in order, by halves, and the logarithm of what was taken out."""
    taken = 0.0
    while len(m) > 1:
        if len(m) % 2:
            m = np.concatenate([m, np.eye(m.shape[1])[None]])
        m = m[::2] @ m[1::2]
        top = m.max((1, 2), keepdims=True)
        m, taken = m / top, taken + float(np.log(top).sum())
    return m[0], taken


def forward_backward(x: np.ndarray, first: bool, before: np.ndarray, after: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each row's state, expected transitions into the rows, and the logarithm of the rows' likelihood.

    ``before`` is the state distribution before the first row (of the start, if that
    is the series' first); ``after`` weighs each state at the end by what follows.
    """
    m, scale = steps(x, first, params)
    n, k = len(x), len(before)
    alpha, beta, likelihood = np.empty((n + 1, k)), np.empty((n + 1, k)), scale
    alpha[0], beta[n] = before, after / after.sum()
    for t in range(n):
        a = alpha[t] @ m[t]
        size = a.sum()
        alpha[t + 1], likelihood = a / size, likelihood + math.log(size)
    for t in range(n - 1, -1, -1):
        b = m[t] @ beta[t + 1]
        beta[t] = b / b.sum()
    gamma = alpha[1:] * beta[1:]
    gamma /= gamma.sum(1, keepdims=True)
    joint = alpha[:-1, :, None] * m * beta[1:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return gamma, joint[1 if first else 0 :].sum(0), likelihood


def best_product(m: np.ndarray) -> np.ndarray:
    """The product in which a path's logarithms add and the best path wins."""
    while len(m) > 1:
        if len(m) % 2:
            one = np.full(m.shape[1:], -np.inf)
            np.fill_diagonal(one, 0.0)
            m = np.concatenate([m, one[None]])
        m = (m[::2, :, :, None] + m[1::2, None, :, :]).max(2)
    return m[0]


def log_steps(x: np.ndarray, first: bool, params: Params) -> np.ndarray:
    d = log_densities(x, params)
    with np.errstate(divide="ignore"):
        m = np.log(params[1])[None] + d[:, None, :]
    if first and len(x):
        m[0] = -np.inf
        np.fill_diagonal(m[0], d[0])
    return m


def best_path(m: np.ndarray, before: np.ndarray, end: int) -> np.ndarray:
    """The best path through the rows that ends in a given state."""
    n = len(m)
    score, back = before, np.empty(m.shape[:2], int)
    for t in range(n):
        ways = score[:, None] + m[t]
        back[t], score = ways.argmax(0), ways.max(0)
    path = np.empty(n, int)
    for t in range(n - 1, -1, -1):
        path[t] = end
        end = back[t, end]
    return path


# ---- on Spark ----------------------------------------------------------------


def prepared(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """Rows with a value, cut into ranges; ``_first`` marks the first row of a series."""
    rows = cut(df.filter(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double")), keys, order, ranges)
    rows = carried(rows, keys, {"_before": F.count("*")})
    return stored(rows.withColumn("_first", (F.col("_before") == 0) & (F.row_number().over(within(keys)) == 1)).drop("_before"), "series")


def _key(row, keys: list[str]) -> tuple:
    return tuple(row[k] for k in keys)


def first_guess(rows: DataFrame, keys: list[str], states: int) -> dict[tuple, Params]:
    """Means at quantiles, one variance, and states that mostly stay."""
    at = F.array(*[F.lit((i + 0.5) / states) for i in range(states)])
    found = rows.groupBy(*keys).agg(F.percentile_approx("_x", at, F.lit(10_000)).alias("q"), F.var_pop("_x").alias("v")).collect()
    stay = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(stay, 0.9 if states > 1 else 1.0)
    return {_key(r, keys): (np.full(states, 1 / states), stay, np.array(r["q"], float), np.full(states, max(r["v"], 1e-12))) for r in found if r["q"] is not None}


def _matrix_columns(k: int, name: str) -> str:
    return ", ".join(f"{name}{i} double" for i in range(k))


def expectations(rows: DataFrame, keys: Sequence[str], params: dict[tuple, Params]) -> DataFrame:
    """For each range: sums of posteriors, of values under them, of expected transitions, and the likelihood's logarithm."""
    keys = list(keys)
    k = len(next(iter(params.values()))[0])

    def summary(frame: pd.DataFrame) -> dict:
        m, _ = product(steps(frame["_x"].to_numpy(), bool(frame["_first"].iloc[0]), params[_key(frame.iloc[0], keys)])[0])
        return {f"m{i}": v for i, v in enumerate((m / m.max()).ravel())}

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        m = frame[[f"m{i}" for i in range(k * k)]].to_numpy().reshape(-1, k, k)
        before, after = np.empty((len(m), k)), np.empty((len(m), k))
        a, b = params[_key(frame.iloc[0], keys)][0], np.ones(k)
        for i in range(len(m)):
            before[i] = a
            a = a @ m[i]
            a = a / a.sum()
        for i in range(len(m) - 1, -1, -1):
            after[i] = b
            b = m[i] @ b
            b = b / b.sum()
        return pd.DataFrame({f"a{i}": before[:, i] for i in range(k)} | {f"b{i}": after[:, i] for i in range(k)})

    def finish(frame: pd.DataFrame, start: dict) -> pd.DataFrame:
        x, one = frame["_x"].to_numpy(), bool(frame["_first"].iloc[0])
        before, after = (np.array([start[f"{c}{i}"] for i in range(k)]) for c in "ab")
        gamma, joint, likelihood = forward_backward(x, one, before, after, params[_key(frame.iloc[0], keys)])
        out = {c: frame[c].iloc[0] for c in keys} | {"likelihood": likelihood}
        out |= {f"g{i}": v for i, v in enumerate(gamma.sum(0))} | {f"x{i}": v for i, v in enumerate(gamma.T @ x)} | {f"y{i}": v for i, v in enumerate(gamma.T @ x**2)}
        out |= {f"j{i}": v for i, v in enumerate(joint.ravel())} | {f"p{i}": v if one else 0.0 for i, v in enumerate(gamma[0])}
        return pd.DataFrame([out])

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in keys)
    schema = f"{types}likelihood double, {_matrix_columns(k, 'g')}, {_matrix_columns(k, 'x')}, {_matrix_columns(k, 'y')}, {_matrix_columns(k * k, 'j')}, {_matrix_columns(k, 'p')}"
    return folded(rows, keys, summary, _matrix_columns(k * k, "m"), combine, f"{_matrix_columns(k, 'a')}, {_matrix_columns(k, 'b')}", finish, schema)


def fit_states(rows: DataFrame, keys: Sequence[str], states: int = 3, rounds: int = 20, tolerance: float = 1e-4) -> tuple[dict[tuple, Params], dict[tuple, list[float]]]:
    """Parameters of each series of :func:`prepared` rows by expectation-maximisation, and its log-likelihoods round by round."""
    keys = list(keys)
    params, seen = first_guess(rows, keys, states), {}
    if not params:
        return params, seen
    for _ in range(rounds):
        found = expectations(rows, keys, params)
        sums = [c for c in found.columns if c not in keys]
        moved = False
        for r in found.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).collect():
            of = lambda c, n=states: np.array([r[f"{c}{i}"] for i in range(n)])  # noqa: E731, B023
            g, joint = np.maximum(of("g"), 1e-12), of("j", states * states).reshape(states, states) + 1e-12
            mean = of("x") / g
            var = np.maximum(of("y") / g - mean**2, 1e-10)
            key = _key(r, keys)
            params[key] = (of("p") / of("p").sum(), joint / joint.sum(1, keepdims=True), mean, var)
            seen.setdefault(key, []).append(r["likelihood"])
            moved |= len(seen[key]) < 2 or seen[key][-1] - seen[key][-2] > tolerance * abs(seen[key][-2])
        if not moved:
            break
    return params, seen


def most_likely(rows: DataFrame, keys: Sequence[str], params: dict[tuple, Params]) -> DataFrame:
    """Adds ``state`` of the most likely path to :func:`prepared` rows; states count from the lowest mean."""
    keys = list(keys)
    k = len(next(iter(params.values()))[0]) if params else 1

    def summary(frame: pd.DataFrame) -> dict:
        m = best_product(log_steps(frame["_x"].to_numpy(), bool(frame["_first"].iloc[0]), params[_key(frame.iloc[0], keys)]))
        return {f"m{i}": v for i, v in enumerate(m.ravel())}

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        m = frame[[f"m{i}" for i in range(k * k)]].to_numpy().reshape(-1, k, k)
        with np.errstate(divide="ignore"):
            score = np.log(params[_key(frame.iloc[0], keys)][0])
        before, ends = np.empty((len(m), k)), np.empty(len(m), int)
        for i in range(len(m)):
            before[i] = score
            score = (score[:, None] + m[i]).max(0)
        end = int(score.argmax())
        for i in range(len(m) - 1, -1, -1):
            ends[i] = end
            end = int((before[i] + m[i][:, end]).argmax())
        return pd.DataFrame({f"a{i}": before[:, i] for i in range(k)} | {"end": ends})

    def finish(frame: pd.DataFrame, start: dict) -> pd.DataFrame:
        own = params[_key(frame.iloc[0], keys)]
        m = log_steps(frame["_x"].to_numpy(), bool(frame["_first"].iloc[0]), own)
        path = best_path(m, np.array([start[f"a{i}"] for i in range(k)]), int(start["end"]))
        rank = np.argsort(np.argsort(own[2], kind="stable"), kind="stable")
        return frame[columns].assign(state=rank[path].astype(np.int32))

    columns = [c for c in rows.columns if c not in (PART, ROW, "_x", "_first")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns) + ", state int"
    return folded(rows, keys, summary, _matrix_columns(k * k, "m"), combine, f"{_matrix_columns(k, 'a')}, end int", finish, schema)
