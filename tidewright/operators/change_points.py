"""Breaks in the level, or in level and spread, of series: optimal partitioning with pruning.

A segment's cost comes from differences of prefix sums, which Spark carries over
ranges of rows.  The search goes through a series in order and keeps only starts
that can still begin a best segment; series and penalties are searched apart, so
a task has one series' prefix sums and one penalty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .ranges import carried, cut, lagged, within

COSTS = ("level", "spread")


def segment_costs(sums: np.ndarray, squares: np.ndarray, starts: np.ndarray, end: int, cost: str) -> np.ndarray:
    """Costs of the segments from each start to ``end``: squares about the mean, or twice the normal log-likelihood lost."""
    n = end - starts
    s, q = sums[end] - sums[starts], squares[end] - squares[starts]
    about = np.maximum(q - s * s / n, 0.0)
    return about if cost == "level" else n * np.log(np.maximum(about / n, 1e-12))


def breaks(sums: np.ndarray, squares: np.ndarray, penalty: float, least: int, cost: str, pruned: bool = True) -> list[int]:
    """Ends of all but the last segment of the cheapest partition with ``penalty`` for each segment; ``sums`` begin with 0."""
    n = len(sums) - 1
    if n < 2 * least:
        return []
    best, last, out_from = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.full(n + 1, 2 * n)
    best[0] = -penalty
    starts = np.array([0])
    for end in range(least, n + 1):
        if end - least >= least:  # a segment may begin at the start or ``least`` rows after it
            starts = np.append(starts, end - least)
        total = best[starts] + segment_costs(sums, squares, starts, end, cost) + penalty
        at = int(total.argmin())
        best[end], last[end] = total[at], starts[at]
        if pruned:
            # Cutting a segment never makes it dearer: a start that is dearer here even without a penalty loses
            # to a start here, for all ends that leave room for a segment from here.
            worse = starts[total - penalty > best[end]]
            out_from[worse] = np.minimum(out_from[worse], end + least)
            starts = starts[out_from[starts] > end + 1]
    out, end = [], n
    while (end := int(last[end])) > 0:
        out.append(end)
    return out[::-1]


def _searched(frame: pd.DataFrame, keys: list[str], time: str, least: int, cost: str) -> pd.DataFrame:
    frame = frame.sort_values("_position", ignore_index=True)
    sums, squares = (np.concatenate([[0.0], frame[c].to_numpy()]) for c in ("_sum", "_square"))
    n, spread = len(frame), float(frame["_spread"].iloc[0])
    unit = spread if cost == "level" else 1.0
    found = breaks(sums, squares, float(frame["penalty"].iloc[0]) * unit * np.log(max(n, 2)), least, cost)
    edges = [0, *found, n]
    out = pd.DataFrame({"penalty": frame["penalty"].iloc[0], "segment": range(1, len(edges)), "begins": [frame[time].iloc[a] for a in edges[:-1]], "rows": np.diff(edges)})
    out["mean"] = [(sums[b] - sums[a]) / (b - a) for a, b in zip(edges, edges[1:])]
    out["mean"] += frame["_mean"].iloc[0]
    out["deviation"] = [np.sqrt(max((squares[b] - squares[a]) / (b - a) - ((sums[b] - sums[a]) / (b - a)) ** 2, 0.0)) for a, b in zip(edges, edges[1:])]
    for k in reversed(keys):
        out.insert(0, k, frame[k].iloc[0])
    return out


def segments(df: DataFrame, keys: Sequence[str], time: str, value: str, penalties: Sequence[float] = (3.0,), least: int = 6, cost: str = "level", ranges: int | None = None) -> DataFrame:
    """``keys, penalty, segment, begins, rows, mean, deviation`` of the cheapest partition for each penalty.

    A penalty counts in variances of half the mean squared step (``level``) times
    the logarithm of the rows.  Segments have ``least`` rows or more; a series with
    fewer than twice that is one segment.  Missing values are left out.
    """
    keys = list(keys)
    df = df.filter(F.col(value).isNotNull()).select(*keys, time, F.col(value).cast("double").alias("_x"))
    mean = df.groupBy(*keys).agg(F.avg("_x").alias("_mean"))
    df = (df.join(mean, keys) if keys else df.join(mean)).withColumn("_x", F.col("_x") - F.col("_mean"))  # one row a key
    rows = stored(lagged(df, keys, [time], ["_x"], 1, ranges), "steps")
    spread = rows.groupBy(*keys).agg((F.coalesce(F.avg((F.col("_x") - F.col("_x_1")) ** 2), F.lit(0.0)) / 2).alias("_spread"))
    rows = cut(rows, keys, ["position"], ranges)
    rows = carried(rows, keys, {"_s0": F.sum("_x"), "_q0": F.sum(F.col("_x") ** 2)})
    w = within(keys)
    rows = rows.withColumns({"_sum": F.col("_s0") + F.sum("_x").over(w), "_square": F.col("_q0") + F.sum(F.col("_x") ** 2).over(w), "_position": F.col("position")})
    rows = rows.select(*keys, time, "_mean", "_sum", "_square", "_position")
    rows = (rows.join(spread, keys) if keys else rows.join(spread)).withColumn("penalty", F.explode(F.array(*[F.lit(float(p)) for p in penalties])))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + f"penalty double, segment int, begins {types[time]}, rows long, mean double, deviation double"
    return rows.groupBy(*keys, "penalty").applyInPandas(partial(_searched, keys=keys, time=time, least=least, cost=cost), schema)
