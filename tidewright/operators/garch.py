"""GARCH(1,1) variances of long series, range by range and for many candidates at once.

The next variance is an affine function of the present one, and affine functions
compose: each range reports its slope and offset for every candidate set of
parameters, their composition in order gives the variance each range starts with,
and each range then adds up its likelihood.  A fit evaluates a grid of candidates
in two passes over the rows, moves to the best and refines the grid there; the
driver holds the grid and a likelihood for each of its points.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .ranges import PART, ROW, cut, folded

Candidates = np.ndarray  # rows: constant, weight of the last square, weight of the last variance


def affine(squares: np.ndarray, candidates: Candidates) -> tuple[np.ndarray, np.ndarray]:
    """Slope and offset that the rows' squares make of a variance, for each candidate."""
    slope, offset = np.ones(len(candidates)), np.zeros(len(candidates))
    for e in squares:
        slope = slope * candidates[:, 2]
        offset = candidates[:, 0] + candidates[:, 1] * e + candidates[:, 2] * offset
    return slope, offset


def likelihoods(squares: np.ndarray, start: np.ndarray, candidates: Candidates) -> np.ndarray:
    """Log-likelihood of the rows for each candidate, from the variance of the first row."""
    h, total = start.copy(), np.zeros(len(candidates))
    for e in squares:
        total -= 0.5 * (math.log(2 * math.pi) + np.log(h) + e / h)
        h = candidates[:, 0] + candidates[:, 1] * e + candidates[:, 2] * h
    return total


def grid(variance: float, centre: tuple[float, float, float] | None, reach: float) -> Candidates:
    """Candidates around a centre: long-run variance over ``variance``, persistence and the squares' share of it, on stretched scales."""
    logit = lambda p: math.log(p / (1 - p))
    back = lambda x: 1 / (1 + math.exp(-x))
    level, persistence, share = centre or (0.0, logit(0.85), logit(0.15))
    out = []
    for i, j, k in itertools.product((-2, -1, 0, 1, 2), repeat=3):
        v = variance * math.exp(level + 0.4 * reach * i)
        p, s = back(persistence + 1.2 * reach * j), back(share + 1.0 * reach * k)
        out.append((v * (1 - p), p * s, p * (1 - s)))
    return np.array(out)


def point(centre: tuple[float, float, float] | None, reach: float, at: int) -> tuple[float, float, float]:
    """The grid's point of a number as a new centre."""
    steps = list(itertools.product((-2, -1, 0, 1, 2), repeat=3))[at]
    base = centre or (0.0, math.log(0.85 / 0.15), math.log(0.15 / 0.85))
    return tuple(b + w * reach * s for b, w, s in zip(base, (0.4, 1.2, 1.0), steps))


def prepared(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """Rows with a value, less their series' mean and squared, cut into ranges."""
    df = df.filter(F.col(value).isNotNull())
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    df = (df.join(mean, list(keys)) if keys else df.join(mean)).withColumn("_e", (F.col(value) - F.col("_mean")) ** 2).drop("_mean")
    return cut(df, keys, order, ranges)


def _key(row, keys: list[str]) -> tuple:
    return tuple(row[k] for k in keys)


def _passed(rows: DataFrame, keys: list[str], candidates: dict[tuple, Candidates], variances: dict[tuple, float], finish, schema: str) -> DataFrame:
    def summary(frame: pd.DataFrame) -> dict:
        slope, offset = affine(frame["_e"].to_numpy(), candidates[_key(frame.iloc[0], keys)])
        return {"slope": slope.tolist(), "shift": offset.tolist()}

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        key = _key(frame.iloc[0], keys)
        h, out = np.full(len(candidates[key]), variances[key]), []
        for slope, shift in zip(frame["slope"], frame["shift"]):
            out.append(h.tolist())
            h = np.asarray(slope) * h + np.asarray(shift)
        return pd.DataFrame({"start": out})

    return folded(rows, keys, summary, "slope array<double>, shift array<double>", combine, "start array<double>", finish, schema)


def evaluated(rows: DataFrame, keys: Sequence[str], candidates: dict[tuple, Candidates], variances: dict[tuple, float]) -> DataFrame:
    """``keys, at, likelihood``: the log-likelihood of each candidate of each series."""
    keys = list(keys)

    def finish(frame: pd.DataFrame, start: dict) -> pd.DataFrame:
        found = likelihoods(frame["_e"].to_numpy(), np.asarray(start["start"]), candidates[_key(frame.iloc[0], keys)])
        return pd.DataFrame({c: frame[c].iloc[0] for c in keys} | {"at": range(len(found)), "likelihood": found})

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keys)
    found = _passed(rows, keys, candidates, variances, finish, f"{types}at int, likelihood double")
    return found.groupBy(*keys, "at").agg(F.sum("likelihood").alias("likelihood"))


def fit(rows: DataFrame, keys: Sequence[str], rounds: int = 6) -> dict[tuple, tuple[np.ndarray, float]]:
    """For each series of :func:`prepared` rows the best parameters and their log-likelihood; the first variance is the series' own."""
    keys = list(keys)
    found = rows.groupBy(*keys).agg(F.avg("_e").alias("v")).collect()
    variances = {_key(r, keys): max(r["v"], 1e-300) for r in found if r["v"] is not None}
    if not variances:
        return {}
    centres: dict[tuple, tuple | None] = dict.fromkeys(variances)
    best: dict[tuple, tuple[np.ndarray, float]] = {}
    reach = 1.0
    for _ in range(rounds):
        candidates = {k: grid(v, centres[k], reach) for k, v in variances.items()}
        top = evaluated(rows, keys, candidates, variances).groupBy(*keys).agg(F.max_by("at", F.struct("likelihood", "at")).alias("at"), F.max("likelihood").alias("likelihood"))
        for r in top.collect():
            k = _key(r, keys)
            best[k] = (candidates[k][r["at"]], r["likelihood"])
            centres[k] = point(centres[k], reach, r["at"])
        reach *= 0.5
    return best


def variance_path(rows: DataFrame, keys: Sequence[str], fitted: dict[tuple, tuple[np.ndarray, float]]) -> DataFrame:
    """Adds ``variance``, each row's before its value is known, to :func:`prepared` rows."""
    keys = list(keys)
    found = rows.groupBy(*keys).agg(F.avg("_e").alias("v")).collect()
    variances = {_key(r, keys): max(r["v"], 1e-300) for r in found if r["v"] is not None}
    candidates = {k: fitted[k][0][None] for k in variances}
    columns = [c for c in rows.columns if c not in (PART, ROW, "_e")]

    def finish(frame: pd.DataFrame, start: dict) -> pd.DataFrame:
        w, a, b = candidates[_key(frame.iloc[0], keys)][0]
        h, out = float(start["start"][0]), []
        for e in frame["_e"]:
            out.append(h)
            h = w + a * e + b * h
        return frame[columns].assign(variance=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns)
    return stored(_passed(rows, keys, candidates, variances, finish, f"{schema}, variance double"), "variances")
