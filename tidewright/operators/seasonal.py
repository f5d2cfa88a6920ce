"""Season, trend and rest of long series by robust local regression.

A round smooths each phase of the season over its cycles, takes a low-passed part
of that out, and smooths what is left as the trend; weights that fall with the
size of the rest then make the next round robust.  What a round does at a row
depends on rows within a known distance, so series are cut into stretches with
that much on both sides, which are done apart and give what the whole series
would; between rounds Spark finds the median of the rest, which sets the weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .ranges import positions, quantiles


def local_lines(y: np.ndarray, weights: np.ndarray, span: int, at: np.ndarray) -> np.ndarray:
    """Local linear fits at places (0 is the first value) from the ``span`` nearest values, with tricube weights times the given ones."""
    n = len(y)
    q = min(span, n)
    left = np.clip(np.ceil(at - (q - 1) / 2 - 1e-9).astype(int), 0, n - q)
    near = left[:, None] + np.arange(q)
    away = near - at[:, None]
    reach = np.maximum(at - left, left + q - 1 - at) + max((span - n) // 2, 0)
    size = np.abs(away) / np.maximum(reach, 1e-300)[:, None]
    w = np.where(size <= 0.999, (1 - np.clip(size, 0, 1) ** 3) ** 3, 0.0)
    w = np.where(size <= 0.001, 1.0, w) * weights[near]
    s0, s1, s2 = w.sum(1), (w * away).sum(1), (w * away**2).sum(1)
    t0, t1 = (w * y[near]).sum(1), (w * away * y[near]).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        level = t0 / s0
        spread = s2 / s0 - (s1 / s0) ** 2
        steep = np.sqrt(np.maximum(spread, 0)) > 0.001 * max(n - 1, 0)
        line = level - np.where(steep, (t1 / s0 - level * s1 / s0) / np.where(steep, spread, 1.0) * (s1 / s0), 0.0)
    nearest = y[np.clip(np.rint(at).astype(int), 0, n - 1)]
    return np.where(s0 > 0, line, nearest)


def moving(x: np.ndarray, n: int) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(x)])
    return (sums[n:] - sums[:-n]) / n


def spans(period: int, seasonal: int) -> tuple[int, int]:
    """Usual spans of the trend and of the low-pass fit: odd, from the period and the season's span."""
    trend = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    return trend + (trend % 2 == 0), period + 1 + (period % 2)


def round_of(y: np.ndarray, trend: np.ndarray, weights: np.ndarray, first: int, period: int, seasonal: int, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Season and trend after so many passes; ``first`` is the place of the first row in its series."""
    n, season = len(y), np.zeros(len(y))
    span, low_span = spans(period, seasonal)
    places = np.arange(n, dtype=float)
    for _ in range(passes):
        cycle = np.empty(n + 2 * period)
        for phase in range(period):
            rows = np.arange(phase, n, period)
            if len(rows):
                fit = local_lines((y - trend)[rows], weights[rows], seasonal, np.arange(-1, len(rows) + 1, dtype=float))
                cycle[phase :: period][: len(fit)] = fit
        low = moving(moving(moving(cycle, period), period), 3)
        season = cycle[period : period + n] - local_lines(low, np.ones(n), low_span, places)
        trend = local_lines(y - season, weights, span, places)
    return season, trend


def _stretch(frame: pd.DataFrame, keep: list[str], period: int, seasonal: int, passes: int) -> pd.DataFrame:
    frame = frame.sort_values("_place", ignore_index=True)
    own = (frame["_own"] == frame["_stretch"]).to_numpy()
    if len(frame) < 2 * period:
        season, trend = np.full(len(frame), np.nan), np.full(len(frame), np.nan)
    else:
        season, trend = round_of(*(frame[c].to_numpy() for c in ("_y", "_trend", "_weight")), int(frame["_place"].iloc[0]), period, seasonal, passes)
    return frame[keep].assign(_season=season, _trend=trend)[own]


def decomposed(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    period: int = 12,
    seasonal: int = 7,
    passes: int = 2,
    robust: int = 15,
    stretch: int = 4096,
) -> DataFrame:
    """``keys, time, value, season, trend, rest, weight``: rows must be equally spaced in time.

    ``robust`` rounds follow the first.  Series shorter than two periods have nulls.
    """
    keys = list(keys)
    rows = positions(df.filter(F.col(value).isNotNull()).select(*keys, time, F.col(value).cast("double").alias("_y")), keys, [time], "_place")
    rows = rows.withColumns({"_trend": F.lit(0.0), "_weight": F.lit(1.0)})
    span, low_span = spans(period, seasonal)
    reach = passes * ((seasonal // 2 + 1) * period + period + low_span // 2 + span // 2 + 3)
    reach = -(-reach // period) * period
    # Stretches begin at the same phase, and those at an end are long enough to hold every window that is cut short there.
    stretch = -(-max(stretch, 4 * reach) // period) * period
    keep = [*keys, time, "_y", "_place", "_weight"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", _season double, _trend double"
    run = partial(_stretch, keep=keep, period=period, seasonal=seasonal, passes=passes)
    for turn in range(robust + 1):
        own = F.expr(f"_place div {stretch}")
        others = F.sequence(F.greatest(F.expr(f"(_place - {reach}) div {stretch}"), F.lit(0).cast("long")), F.expr(f"(_place + {reach}) div {stretch}"))
        dealt = rows.withColumn("_own", own).withColumn("_stretch", F.explode(others))
        rows = stored(dealt.groupBy(*keys, "_stretch").applyInPandas(run, schema), "round")
        if turn < robust:
            gap = F.abs(F.col("_y") - F.col("_season") - F.col("_trend"))
            rows = rows.withColumn("_gap", F.when(~F.isnan(gap), gap))
            middle = quantiles(rows, keys, "_gap", {"_middle": 0.5})
            rows = rows.join(middle, keys, "left") if keys else rows.join(middle)  # one row
            u = F.col("_gap") / (6 * F.col("_middle"))
            weight = F.when(u <= 0.001, 1.0).when(u <= 0.999, (1 - u * u) ** 2).otherwise(0.0)
            rows = rows.withColumn("_weight", F.when(F.col("_middle") > 0, weight).otherwise(1.0)).drop("_gap", "_middle", "_season")
    names = {"season": F.col("_season"), "trend": F.col("_trend"), "rest": F.col("_y") - F.col("_season") - F.col("_trend")}
    return rows.select(*keys, time, F.col("_y").alias(value), *[F.when(~F.isnan(c), c).alias(n) for n, c in names.items()], F.col("_weight").alias("weight"))


def seasonal_strength(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, strength, n``: one less the rest's share of the variance of season and rest, 0 at least."""
    both = F.var_pop(F.col("season") + F.col("rest"))
    return parts.groupBy(*keys).agg(F.greatest(F.lit(0.0), 1 - F.try_divide(F.var_pop("rest"), both)).alias("strength"), F.count("season").alias("n"))
