"""Ranks and quantiles of moving and growing frames over long keys.

A key that fits a task is done in one; a longer one is cut.  A moving frame needs
only the rows just before a stretch.  For a growing one, rows are cut both by time
and by value, and the counts of each pair of cuts tell, for each range of time,
which values before it can be a wanted quantile while its own rows come in: those
within as many ranks as it has rows.  Just these are sent there; of the rest the
range gets a number.  A value is one search in a sorted run, not a look at its
whole frame.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import PART, ROW, cut, positions

MOST = 100_000  # rows of a key that one task takes whole


def longest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the longest key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _schema(df: DataFrame, more: Sequence[str]) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` double" for n in more])


def _nullable(values: np.ndarray) -> pd.Series:
    """Null, not NaN, where a value lacks."""
    return pd.Series([None if v != v else v for v in values], dtype=object)


def shares_at_most(x: np.ndarray, n: int) -> np.ndarray:
    """Share of each value's last ``n`` that are at most it; missing where one of them is."""
    held, out = [], np.full(len(x), np.nan)
    for i, v in enumerate(x):
        if v == v:
            insort(held, v)
        if i >= n and (gone := x[i - n]) == gone:
            del held[bisect_right(held, gone) - 1]
        if len(held) == n:
            out[i] = bisect_right(held, v) / n
    return out


def rolling_share(df: DataFrame, keys: Sequence[str], time: str, x: str, n: int, name: str, most: int = MOST) -> DataFrame:
    """Adds the share of the last ``n`` rows' values that are at most the row's own; null until there are ``n``."""
    keys, columns = list(keys), df.columns
    if longest(df, keys) <= most:
        rows, groups = df.withColumn("_own", F.lit(True)), keys
        order = time
    else:
        stretch = max(most, 2 * n)
        rows = positions(df, keys, [time], "_place")
        to = F.expr(f"(_place + {n - 1}) div {stretch}")
        rows = rows.withColumn("_stretch", F.explode(F.sequence(F.expr(f"_place div {stretch}"), to)))
        rows = rows.withColumn("_own", F.expr(f"_place div {stretch}") == F.col("_stretch"))
        groups, order = [*keys, "_stretch"], "_place"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, ignore_index=True)
        found = shares_at_most(frame[x].to_numpy(float, na_value=np.nan), n)
        return frame[columns].assign(**{name: _nullable(found)})[frame["_own"]]

    return rows.groupBy(*groups).applyInPandas(run, _schema(df, [name]))


def _walk(values: np.ndarray, before: list[float], below: int, prior: int, q: float, warm_up: int) -> np.ndarray:
    """The quantile at each row of all values so far: ``prior`` of them earlier, ``below`` of which lie under the sorted ``before``."""
    held, seen, out = before, prior, np.full(len(values), np.nan)
    for i, v in enumerate(values):
        if v == v:
            insort(held, v)
            seen += 1
        if seen >= max(warm_up, 1):
            at = q * (seen - 1)
            low = int(at)
            high = min(low + 1, seen - 1)
            a = held[low - below]
            out[i] = a + (at - low) * (held[high - below] - a)
    return out


def expanding_quantiles(df: DataFrame, keys: Sequence[str], time: str, x: str, quantiles: Mapping[str, float], warm_up: int, most: int = MOST, ranges: int | None = None) -> DataFrame:
    """Adds, under each name, a quantile (linear between ranks) of all values up to and with each row.

    Null until ``warm_up`` values are there.
    """
    keys, columns, names = list(keys), df.columns, list(quantiles)
    schema = _schema(df, names)

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(time, ignore_index=True)
        v = frame[x].to_numpy(float, na_value=np.nan)
        return frame.assign(**{n: _nullable(_walk(v, [], 0, 0, q, warm_up)) for n, q in quantiles.items()})

    if ranges is None and longest(df, keys) <= most:
        return df.groupBy(*keys).applyInPandas(whole, schema)

    rows = cut(df, keys, [time], ranges)
    values = rows.filter(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_v"), F.col(PART).alias("_of"))
    values = cut(values, keys, ["_v", "_of"], ranges).withColumnRenamed(PART, "_bin")
    counts = values.groupBy(*keys, "_of", "_bin").agg(F.count("*").alias("n"))
    counts = counts.unionByName(rows.groupBy(*keys, F.col(PART).alias("_of")).agg(F.lit(0).cast("long").alias("n")).withColumn("_bin", F.lit(0)))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in keys)

    def planned(frame: pd.DataFrame) -> pd.DataFrame:
        """For each range of time and quantile the cuts of values it needs."""
        table = frame.pivot_table(index="_of", columns="_bin", values="n", aggfunc="sum", fill_value=0).sort_index(axis=0).sort_index(axis=1)
        bins, n, out = table.columns.to_numpy(), table.to_numpy(), []
        before = np.cumsum(n, 0) - n
        for r, own, past in zip(table.index, n.sum(1), before):
            prior, ends = int(past.sum()), np.cumsum(past)
            for i, q in enumerate(quantiles.values()):
                low = max(int(q * max(prior - 1, 0)) - int(own) - 1, 0)
                high = min(int(q * (prior + int(own))) + 2, prior - 1)
                if prior:
                    a, b = np.searchsorted(ends, [low, high], "right")
                    below = int(ends[a - 1]) if a else 0
                    out += [(r, i, int(bins[k]), below, prior) for k in range(a, b + 1) if past[k]]
        out = pd.DataFrame(out, columns=["_to", "_q", "_bin", "_below", "_prior"])
        for k in reversed(keys):
            out.insert(0, k, frame[k].iloc[0])
        return out

    plan = counts.groupBy(*keys).applyInPandas(planned, f"{types}_to int, _q int, _bin int, _below long, _prior long")
    for k in keys:
        plan = plan.withColumnRenamed(k, f"_of_{k}")
    same = F.col("_bin") == F.col("_want")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    # A few rows for each range go to all tasks; values that many ranges want are dealt out first.
    dealt = values.repartition("_of", ROW)
    pulled = dealt.join(F.broadcast(plan.withColumnRenamed("_bin", "_want")), same).filter("_of < _to")
    pulled = pulled.select(*keys, F.col("_to").alias(PART), "_q", "_v", "_below", "_prior")

    def finished(own: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(ROW, ignore_index=True)
        v, out = own[x].to_numpy(float, na_value=np.nan), {}
        for i, (name, q) in enumerate(quantiles.items()):
            part = past[past["_q"] == i]
            below, prior = (int(part[c].iloc[0]) if len(part) else 0 for c in ("_below", "_prior"))
            out[name] = _nullable(_walk(v, sorted(part["_v"].tolist()), below, prior, q, warm_up))
        return own[columns].assign(**out)

    by = [*keys, PART]
    return rows.groupBy(*by).cogroup(pulled.groupBy(*by)).applyInPandas(finished, schema)
