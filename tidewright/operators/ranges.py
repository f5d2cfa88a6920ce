"""Long ordered keys cut into ranges, and what one range carries into the next.

Rows are sorted by key and order over many tasks; a range is a task's share, and
one key may fill many.  What must run in order goes by ranges: each is summed up
on its own, the sums are combined in order (a row for each range and key), and
each range is then done with what it starts from.  No task ever holds a whole
key, and none but the combining step sees more than one range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import stored

PART, ROW = "_part", "_row"  # a range's number in order; a row's place in its range


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range and their place in it, written once.

    Rows that agree in keys and order may fall into two ranges, so an order should
    tell rows apart.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    place = F.monotonically_increasing_id()
    dealt = dealt.sortWithinPartitions(*by).withColumn(ROW, place)
    dealt = dealt.withColumn(PART, F.shiftright(ROW, 33).cast("int")).withColumn(ROW, F.col(ROW).bitwiseAND((1 << 33) - 1))
    return stored(dealt, "ranges")


def within(keys: Sequence[str]) -> Window:
    """The rows of one key and range in order."""
    return Window.partitionBy(*keys, PART).orderBy(ROW)


def carried(df: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Adds to every row of :func:`cut` the sums over all earlier ranges of its key, under the given names."""
    names = [*keys, PART]
    totals = df.groupBy(*names).agg(*[c.alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    zero = {n: F.coalesce(F.sum(n).over(before), F.lit(0)) for n in sums}
    totals = totals.select(*[F.col(c).alias(f"_of_{c}") for c in names], *[c.alias(n) for n, c in zero.items()])
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return df.join(totals, same).drop(*[f"_of_{c}" for c in names])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", ranges: int | None = None) -> DataFrame:
    """Adds each row's place in its key, from 0, by counts carried over ranges."""
    rows = carried(cut(df, keys, order, ranges), keys, {"_before": F.count("*")})
    return rows.withColumn(name, F.col("_before") + F.row_number().over(within(keys)) - 1).drop("_before", PART, ROW)


def folded(
    df: DataFrame,
    keys: Sequence[str],
    summary: Callable[[pd.DataFrame], dict],
    summary_schema: str,
    combine: Callable[[pd.DataFrame], pd.DataFrame],
    start_schema: str,
    finish: Callable[[pd.DataFrame, dict], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """A fold over each key's rows in order, range by range.

    ``summary`` sums up a range's rows; ``combine`` gets a key's summaries in
    order and returns as many rows, what each range starts from; ``finish`` gets a
    range's rows and that.
    """
    keys = list(keys)
    names = [*keys, PART]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in names)

    def sums(frame: pd.DataFrame) -> pd.DataFrame:
        own = {c: frame[c].iloc[0] for c in names}
        return pd.DataFrame([own | summary(frame.sort_values(ROW, ignore_index=True))])

    def starts(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(PART, ignore_index=True)
        return pd.concat([frame[names], combine(frame)], axis=1)

    found = stored(df.groupBy(*names).applyInPandas(sums, f"{types}, {summary_schema}"), "summaries")
    start = found.groupBy(*keys).applyInPandas(starts, f"{types}, {start_schema}")

    def finished(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        return finish(rows.sort_values(ROW, ignore_index=True), start.iloc[0].to_dict())

    return df.groupBy(*names).cogroup(start.groupBy(*names)).applyInPandas(finished, schema)


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], lags: int, ranges: int | None = None) -> DataFrame:
    """Adds ``position`` and ``<column>_1`` to ``<column>_<lags>``, the values of the rows before.

    Rows are dealt by stretches of positions that overlap by the number of lags,
    so a long key is spread over tasks.
    """
    rows, stretch = positions(df, keys, order, ranges=ranges), max(8 * lags, 4096)
    own, to = F.expr(f"position div {stretch}"), F.expr(f"(position + {lags}) div {stretch}")
    rows = rows.withColumn("_own", own).withColumn("_stretch", F.explode(F.sequence(own, to)))
    w = Window.partitionBy(*keys, "_stretch").orderBy("position")
    rows = rows.withColumns({f"{c}_{k}": F.lag(c, k).over(w) for c in columns for k in range(1, lags + 1)})
    return rows.filter(F.col("_own") == F.col("_stretch")).drop("_own", "_stretch")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], ranges: int | None = None) -> DataFrame:
    """Exact quantiles of each key, interpolated between neighbours: rows are ranked over ranges, so no task holds a key."""
    rows = positions(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, [value], "_at", ranges)
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = rows.join(n, list(keys)) if keys else rows.join(n)  # one row a key
    out = []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("_n") - 1)
        low = F.max(F.when(F.col("_at") == F.floor(place), F.col(value)))
        high = F.max(F.when(F.col("_at") == F.ceil(place), F.col(value)))
        part = F.max(place - F.floor(place))
        out.append((low + part * (high - low)).alias(name))
    return rows.groupBy(*keys).agg(*out)
