"""Grouped statistics of returns and ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import quantiles
from .windows import Series


def return_stats(df: DataFrame, r: str, keys: Sequence[str], least: int = 1) -> DataFrame:
    """Up-rate, mean, median, sample deviation and count of non-null returns; groups under ``least`` go."""
    by = df.filter(F.col(r).isNotNull()).groupBy(*keys)
    up = F.avg((F.col(r) > 0).cast("double")).alias("up_rate")
    stats = by.agg(up, F.avg(r).alias("mean"), F.median(r).alias("median"), F.stddev_samp(r).alias("deviation"), F.count("*").alias("n"))
    return stats.filter(F.col("n") >= least)


def by_cohort(df: DataFrame, time: str, since: Mapping[str, str]) -> DataFrame:
    """Each row once for every cohort whose first day it isn't before; cohorts overlap."""
    cohorts = F.array(*[F.struct(F.lit(k).alias("cohort"), F.lit(v).cast("date").alias("since")) for k, v in since.items()])
    df = df.withColumn("_c", F.explode(F.filter(cohorts, lambda c: F.col(time) >= c["since"])))
    return df.withColumn("cohort", F.col("_c.cohort")).drop("_c")


def tagged(df: DataFrame, name: str, flags: Mapping[str, Column]) -> DataFrame:
    """Each row once for every flag that holds, under the flag's name."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    return df.withColumn(name, F.explode(names))


def period_last(df: DataFrame, value: str, unit: str, keys: Sequence[str], time: str = "date") -> DataFrame:
    """The last non-null value of each period, by the period's first day."""
    period = F.date_trunc(unit, time).cast("date").alias("period")
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, period).agg(F.max_by(value, time).alias(value))


def compounded(r: Column | str) -> Column:
    """Compounded return of a group, null without data."""
    r = F.col(r) if isinstance(r, str) else r
    return F.exp(F.sum(F.log1p(r))) - 1


def pairwise(df: DataFrame, key: str, time: str, value: str, **aggs: Column) -> DataFrame:
    """Aggregates over ``x`` and ``y`` of each pair of keys on their common times."""
    df = df.filter(F.col(value).isNotNull())
    left = df.select(key, time, F.col(value).alias("x"))
    right = df.select(F.col(key).alias("other"), time, F.col(value).alias("y"))
    both = left.join(right, time).filter(F.col(key) < F.col("other"))
    return both.groupBy(key, "other").agg(*[c.alias(n) for n, c in aggs.items()])


def right_closed_bin(x: str, edges: Sequence[float]) -> Column:
    """Number of the bin (edge, next edge] that holds x; null outside."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:]), 1):
        hit = (F.col(x) > lo) & (F.col(x) <= hi)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def quantile_bins(df: DataFrame, x: str, n: int, keys: Sequence[str], name: str = "bin") -> DataFrame:
    """Adds the number of the quantile bin of x among its group; the first bin is closed.

    Without keys the table is ranked over ranges, for its values may not fit a task.
    """
    if not keys:
        edges = quantiles(df, [], x, {f"_{i}": i / n for i in range(1, n)})
        df = df.join(edges.select(F.array(*edges.columns).alias("_edges")))  # one row
        return df.withColumn(name, 1 + F.size(F.filter("_edges", lambda e: F.col(x) > e))).drop("_edges")
    edges = df.groupBy(*keys).agg(F.percentile(x, [i / n for i in range(1, n)]).alias("_edges"))
    df = df.join(edges, list(keys))
    return df.withColumn(name, 1 + F.size(F.filter("_edges", lambda e: F.col(x) > e))).drop("_edges")


def likelihood_ratios(df: DataFrame, y: str, flags: Sequence[str]) -> DataFrame:
    """How much likelier y is where a flag holds, on the rows where the flag is known."""
    long = df.select(F.col(y).cast("double").alias("_y"), *flags).unpivot(["_y"], list(flags), "flag", "_on")
    long = long.filter(F.col("_y").isNotNull() & F.col("_on").isNotNull())
    hit = F.when(F.col("_on"), F.col("_y"))
    stats = long.groupBy("flag").agg(F.count(hit).alias("n"), F.avg(hit).alias("rate"), F.avg("_y").alias("base"))
    return stats.withColumn("lift", F.try_divide("rate", "base"))


def holding_periods(df: DataFrame, value: str, horizons: Sequence[int], series: Series) -> DataFrame:
    """Distribution of the return over each horizon."""
    wide = df.select(*series.keys, *[series.forward_change(value, h).alias(str(h)) for h in horizons])
    long = wide.unpivot(list(series.keys), [str(h) for h in horizons], "horizon", "f").filter("f is not null")
    long = long.withColumn("horizon", F.col("horizon").cast("long"))
    quantiles = [F.percentile("f", F.lit(q)).alias(n) for n, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))]
    loss = [F.avg((F.col("f") < x).cast("double")).alias(n) for n, x in (("loss", 0), ("large_loss", -0.2))]
    return long.groupBy(*series.keys, "horizon").agg(F.count("*").alias("n"), *quantiles, *loss)


def latest(df: DataFrame, keys: Sequence[str], order: Column, **values: str) -> DataFrame:
    """State of each key after replaying an append-only log."""
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(n) for n, c in values.items()], F.count("*").alias("changes"))


def stability(df: DataFrame, keys: Sequence[str], order: Sequence[str], verdict: str) -> DataFrame:
    """Snapshots, changes of verdict, and length of the run that still lasts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flip = F.coalesce((F.col(verdict) != F.lag(verdict).over(w)).cast("int"), F.lit(0))
    runs = df.withColumn("_flip", flip).withColumn("_run", F.sum("_flip").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = runs.groupBy(*keys, "_run").agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("snapshots"), F.max("_run").alias("flips"), F.max_by("n", "_run").alias("stable_run"))


def performance(df: DataFrame, r: str, series: Series, per_year: int = 252) -> DataFrame:
    """Total return, annual growth and worst drawdown of the compounded curve."""
    df = df.withColumn("_equity", series.growth(r))
    df = df.withColumn("_dd", series.drawdown("_equity"))
    end = F.max_by("_equity", series.time)
    growth = F.pow(end, per_year / F.count("*")) - 1
    return df.groupBy(*series.keys).agg((end - 1).alias("total"), growth.alias("cagr"), F.min("_dd").alias("worst"))


def snapshot(df: DataFrame, key: str, time: str, value: str, back: Mapping[str, int], high: int = 252, least: int = 1) -> DataFrame:
    """Latest value, changes to the k-th latest row, and distance from the recent high."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))
    df = df.withColumn("_rn", rn)
    at = lambda k: F.max(F.when(F.col("_rn") == k, F.col(value)))
    changes = [(at(1) / at(k) - 1).alias(n) for n, k in back.items()]
    top = F.max(F.when(F.col("_rn") <= high, F.col(value)))
    stats = df.groupBy(key).agg(F.count("*").alias("n"), at(1).alias("last"), *changes, (at(1) / top - 1).alias("from_high"))
    return stats.filter(F.col("n") >= least)
