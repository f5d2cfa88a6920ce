"""Runs, clusters and hysteresis episodes, by running sums of boundary rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _order(keys: Sequence[str], time: str):
    return Window.partitionBy(*keys).orderBy(time)


def run_ids(df: DataFrame, label: Column, keys: Sequence[str] = ("asset",), time: str = "date") -> DataFrame:
    """Adds ``run``: the number of the contiguous run of equal labels."""
    w = _order(keys, time)
    turn = (~label.eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    df = df.withColumn("_turn", turn)
    return df.withColumn("run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def run_lengths(df: DataFrame, hit: Column, keys: Sequence[str] = ("asset",), time: str = "date") -> DataFrame:
    """Adds ``streak``: rows so far in the current run of hits, 0 outside one."""
    w = _order(keys, time)
    hit = F.coalesce(hit, F.lit(False))
    df = df.withColumn("_hit", hit.cast("int"))
    df = df.withColumn("_group", F.sum(1 - F.col("_hit")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_group").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("streak", F.sum("_hit").over(inside)).drop("_hit", "_group")


def armed_episodes(
    df: DataFrame, trigger: Column, rearm: Column, keys: Sequence[str] = ("asset",), time: str = "date"
) -> DataFrame:
    """Trigger rows with ``episode`` and ``opens``.

    An episode opens at a trigger and the next can open only after a row that
    re-arms; the triggers between belong to it.
    """
    w = _order(keys, time)
    df = df.withColumn("_reset", F.coalesce(rearm, F.lit(False)).cast("int"))
    df = df.withColumn("_epoch", F.sum("_reset").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hits = df.filter(trigger)
    first = F.min(time).over(Window.partitionBy(*keys, "_epoch"))
    hits = hits.withColumn("opens", F.col(time) == first)
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_epoch"))
    return hits.withColumn("episode", number).drop("_reset", "_epoch")


def clusters(df: DataFrame, position: str, gap: int, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Adds ``cluster``: rows less than ``gap`` positions after the row before share one."""
    w = _order(keys, position)
    start = F.coalesce((F.col(position) - F.lag(position).over(w) >= gap).cast("int"), F.lit(1))
    df = df.withColumn("_start", start)
    return df.withColumn("cluster", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def merged_segments(df: DataFrame, first: str, last: str, gap: int, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Disjoint ordered segments, merged where one starts less than ``gap`` after the last ended."""
    w = _order(keys, first)
    start = F.coalesce((F.col(first) - F.lag(last).over(w) >= gap).cast("int"), F.lit(1))
    df = df.withColumn("_start", start)
    return df.withColumn("cluster", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")
