"""Resampling tests, each run as one task per group, in runs of draws that fit memory.

Samples too long for a task are drawn in :mod:`.bootstrap`.

Draws come from ``numpy.random.default_rng`` with a seed per group, so a result
depends on the group's rows and the seed only.  A group is one study's sample;
its rows are ordered by time first, so partitioning has no effect.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def seed_of(*parts: object, seed: int = 42) -> int:
    return (zlib.crc32("|".join(map(str, parts)).encode()) + seed) % (1 << 32)


def chunks(draws: int, rows: int, most: int = 1 << 21) -> list[tuple[int, int]]:
    """Draws in runs whose matrices of rows stay small."""
    step = max(1, most // max(rows, 1))
    return [(at, min(at + step, draws)) for at in range(0, draws, step)]


def block_bootstrap(sel: np.ndarray, y: np.ndarray, block: int, draws: int, seed: int, least: int = 1) -> dict:
    """Mean of a subset less the mean of all, with a circular block bootstrap.

    A subset of fewer than ``least`` rows has no result.  Draws in which the subset is empty are dropped.  The p-value is two-sided:
    twice the lesser share of draws on either side of 0.
    """
    n = len(y)
    out = {"diff": None, "low": None, "high": None, "p": None, "n_used": 0, "n_dropped": 0}
    if not n or sel.sum() < max(least, 1):
        return out
    rng = np.random.default_rng(seed)
    block = max(1, min(block, n))
    starts = rng.integers(0, n, size=(draws, -(-n // block)))
    d, ok = np.empty(draws), np.empty(draws, bool)
    for a, z in chunks(draws, n):
        at = ((starts[a:z, :, None] + np.arange(block)) % n).reshape(z - a, -1)[:, :n]
        s, v = sel[at], y[at]
        size = s.sum(1)
        ok[a:z] = size > 0
        d[a:z] = np.where(s, v, 0).sum(1) / np.maximum(size, 1) - v.mean(1)
    d = d[ok]
    out |= {"diff": float(y[sel].mean() - y.mean()), "n_used": int(ok.sum()), "n_dropped": int((~ok).sum())}
    if len(d):
        low, high = np.percentile(d, [2.5, 97.5])
        out |= {"low": float(low), "high": float(high), "p": float(min(1.0, 2 * min((d <= 0).mean(), (d >= 0).mean())))}
    return out


def permutation_test(values: np.ndarray, labels: np.ndarray, draws: int, seed: int, statistic=None) -> dict:
    """One-sided permutation test; the observed value counts as a draw."""
    statistic = statistic or between_groups
    observed = statistic(values, labels)
    rng = np.random.default_rng(seed)
    hits = sum(statistic(values, rng.permutation(labels)) >= observed for _ in range(draws))
    return {"observed": float(observed), "p": (hits + 1) / (draws + 1), "n": len(values)}


def between_groups(values: np.ndarray, labels: np.ndarray) -> float:
    """Sum of squares between groups."""
    kinds, codes = np.unique(labels, return_inverse=True)
    sizes = np.bincount(codes, minlength=len(kinds))
    means = np.bincount(codes, values, len(kinds)) / np.maximum(sizes, 1)
    return float((sizes * (means - values.mean()) ** 2).sum())


def mean_difference(values: np.ndarray, labels: np.ndarray) -> float:
    """Mean of the rows labelled true less the mean of the others."""
    labels = labels.astype(bool)
    if labels.all() or not labels.any():
        return 0.0
    return float(values[labels].mean() - values[~labels].mean())


def cluster_bootstrap(values: np.ndarray, clusters: np.ndarray, draws: int, seed: int) -> dict:
    """Mean and interval when whole clusters are drawn, not rows."""
    kinds, codes = np.unique(clusters, return_inverse=True)
    sums, sizes = np.bincount(codes, values), np.bincount(codes)
    rng = np.random.default_rng(seed)
    at = (rng.integers(0, len(kinds), size=(z - a, len(kinds))) for a, z in chunks(draws, len(kinds)))
    means = np.concatenate([sums[i].sum(1) / sizes[i].sum(1) for i in at])
    low, high = np.percentile(means, [2.5, 97.5])
    return {"mean": float(values.mean()), "low": float(low), "high": float(high), "clusters": len(kinds), "n": len(values)}


def event_bootstrap(values: np.ndarray, base: float, draws: int, seed: int) -> dict:
    """Mean, rising share and difference to a fixed base rate when events are drawn again."""
    rng = np.random.default_rng(seed)
    picked = (values[rng.integers(0, len(values), size=(z - a, len(values)))] for a, z in chunks(draws, len(values)))
    means, ups = np.concatenate([[p.mean(1), (p > 0).mean(1)] for p in picked], 1)
    bounds = {n: np.percentile(x, [2.5, 97.5]) for n, x in (("mean", means), ("up", ups), ("diff", means - base))}
    out = {f"{n}_{side}": float(v) for n, pair in bounds.items() for side, v in zip(("low", "high"), pair)}
    return out | {"mean": float(values.mean()), "up": float((values > 0).mean()), "n": len(values)}


def rank_area(y: np.ndarray, codes: np.ndarray) -> float:
    """Area under the ROC curve from dense codes of a score; ties count half."""
    size = int(codes.max()) + 1
    pos, neg = np.bincount(codes[y == 1], minlength=size), np.bincount(codes[y == 0], minlength=size)
    below = np.cumsum(neg) - neg
    return float((pos * (below + neg / 2)).sum() / (pos.sum() * neg.sum()))


def auc_difference(y: np.ndarray, a: np.ndarray, b: np.ndarray, block: int, draws: int, seed: int) -> dict:
    """AUC of one score less that of another, with a circular block bootstrap of the rows under both."""
    n, out = len(y), {"diff": None, "low": None, "high": None, "p": None, "n": len(y)}
    if n < 3 * block or len(np.unique(y)) < 2:
        return out
    codes = [np.unique(x, return_inverse=True)[1] for x in (a, b)]
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, n, size=(draws, -(-n // block)))
    at = (((s[:, None] + np.arange(block)) % n).ravel()[:n] for s in starts)
    d = np.array([rank_area(y[i], codes[0][i]) - rank_area(y[i], codes[1][i]) for i in at if 0 < y[i].sum() < n])
    low, high = np.percentile(d, [2.5, 97.5])
    p = min(1.0, 2 * min((d <= 0).mean(), (d >= 0).mean()))
    return out | {"diff": rank_area(y, codes[0]) - rank_area(y, codes[1]), "low": float(low), "high": float(high), "p": float(p)}


def per_group(df: DataFrame, keys: Sequence[str], order: str, schema: str, test) -> DataFrame:
    """One row per group: ``test(frame in order, seed)`` as a dict."""
    keys = list(keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = [frame[k].iloc[0] for k in keys]
        found = test(frame.sort_values(order, ignore_index=True), seed_of(*names))
        return pd.DataFrame([dict(zip(keys, names)) | found])

    return df.groupBy(*keys).applyInPandas(run, schema)
