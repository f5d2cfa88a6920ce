"""Multiple comparisons, rank statistics and scores, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def q_values(df: DataFrame, p: str, family: Sequence[str] = ()) -> DataFrame:
    """Adds Benjamini-Hochberg ``q_bh`` and Benjamini-Yekutieli ``q_by`` within each family.

    A null p-value is left out of its family and has null q-values.
    """
    known = F.col(p).isNotNull()
    part = Window.partitionBy(*family, known)
    m = F.count(p).over(part)
    rank = F.row_number().over(part.orderBy(F.col(p)))
    df = df.withColumn("_m", m).withColumn("_i", rank)
    harmonic = F.sum(1 / F.col("_i")).over(part)
    from_here = part.orderBy("_i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    q = F.least(F.min(F.col(p) * F.col("_m") / F.col("_i")).over(from_here), F.lit(1.0))
    df = df.withColumn("_q", q).withColumn("_c", harmonic)
    df = df.withColumn("q_bh", F.when(known, F.col("_q"))).withColumn("q_by", F.when(known, F.least(F.col("_q") * F.col("_c"), F.lit(1.0))))
    return df.drop("_m", "_i", "_q", "_c")


def verdicts(df: DataFrame, q_family: str, q_pool: str, level: float, expected: int | None = None) -> DataFrame:
    """Adds ``verdict``: survives both, only its family, or neither; fails if the count isn't the declared one."""
    verdict = F.when((F.col(q_family) <= level) & (F.col(q_pool) <= level), "survives").when(F.col(q_family) <= level, "family only").otherwise("noise")
    df = df.withColumn("verdict", verdict)
    if expected is not None:
        total = df.agg(F.count("*").alias("_total"))  # one row
        guard = F.when(F.col("_total") != expected, F.raise_error(F.lit("another number of tests than declared")).cast("string"))
        df = df.join(F.broadcast(total)).withColumn("verdict", F.coalesce(guard, "verdict")).drop("_total")
    return df


def average_rank(x: str, keys: Sequence[str] = ()) -> Column:
    """Rank with ties at their mean."""
    part = Window.partitionBy(*keys)
    return F.rank().over(part.orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums; ``label`` is 0 or 1."""
    df = df.withColumn("_rank", average_rank(score, keys))
    n1, n0 = F.sum(label), F.count("*") - F.sum(label)
    area = F.try_divide(F.sum(F.col("_rank") * F.col(label)) - n1 * (n1 + 1) / 2, n1 * n0)
    return df.groupBy(*keys).agg(area.alias("auc"), F.avg((F.col(score) - F.col(label)) ** 2).alias("brier"), F.count("*").alias("n"))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of complete pairs."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    df = df.withColumn("_x", average_rank(x, keys)).withColumn("_y", average_rank(y, keys))
    return df.groupBy(*keys).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def t_statistic(df: DataFrame, x: str, keys: Sequence[str]) -> DataFrame:
    """One-sample t of the mean against 0, with a normal approximation of its p-value's tail left to the caller."""
    by = df.filter(F.col(x).isNotNull()).groupBy(*keys)
    t = F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))
    return by.agg(t.alias("t"), (F.count(x) - 1).alias("df"), F.avg(x).alias("mean"))


def welch(df: DataFrame, x: str, group: str, keys: Sequence[str]) -> DataFrame:
    """Two-sample t with unequal variances, and its degrees of freedom; ``group`` is boolean."""
    on, off = F.when(F.col(group), F.col(x)), F.when(~F.col(group), F.col(x))
    a, b = F.var_samp(on) / F.count(on), F.var_samp(off) / F.count(off)
    t = F.try_divide(F.avg(on) - F.avg(off), F.sqrt(a + b))
    dof = F.try_divide((a + b) ** 2, a**2 / (F.count(on) - 1) + b**2 / (F.count(off) - 1))
    return df.groupBy(*keys).agg(t.alias("t"), dof.alias("df"))


def conformal_band(df: DataFrame, residual: str, alpha: float, keys: Sequence[str]) -> DataFrame:
    """Half-width of a split-conformal band: the finite-sample rank of the absolute residuals.

    Null where a key has too few residuals for that rank.
    """
    size = F.abs(F.col(residual))
    part = Window.partitionBy(*keys)
    ranked = df.filter(F.col(residual).isNotNull()).withColumn("_i", F.row_number().over(part.orderBy(size)))
    n = F.count("*").over(part)
    ranked = ranked.withColumn("_n", n).withColumn("_at", F.ceil((F.col("_n") + 1) * (1 - alpha)))
    return ranked.groupBy(*keys).agg(F.first("_n").alias("n"), F.max(F.when(F.col("_i") == F.col("_at"), size)).alias("width"))


def expected_calibration_error(df: DataFrame, p: str, label: str, bins: int, keys: Sequence[str]) -> DataFrame:
    """Mean gap between predicted and observed rate over equal-width bins, weighted by rows."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("_bin")
    per = df.groupBy(*keys, at).agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(label)).alias("gap"))
    return per.groupBy(*keys).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
