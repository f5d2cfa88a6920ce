"""Orderings, top-k, set differences and filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def both_tails(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n largest and n smallest values, each found by a top-k; with few rows a row is 'top' first."""
    top = df.orderBy(F.desc(value), tie).limit(n).withColumn("side", F.lit("top"))
    low = df.orderBy(value, tie).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low.join(top.select(tie), tie, "left_anti"))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each key, as one grouped maximum."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, "_row.*")


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows of either side that the other lacks, by ``side``: 'added' or 'dropped'."""
    added = new.subtract(old)
    return added.withColumn("side", F.lit("added")).unionByName(old.subtract(new).withColumn("side", F.lit("dropped")))


def trailing(df: DataFrame, day: str, days: int) -> DataFrame:
    """Rows of the last days before the latest day."""
    end = df.agg(F.max(day).alias("_end"))
    return df.join(end, F.col(day) > F.date_sub("_end", days)).drop("_end")


def has_words(text: Column, words: str) -> Column:
    """Whether the words stand in the text one after the other, as whole words between spaces."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {words} ")


def grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """Every combination of the parameter values; its size is the product of the lists."""
    one = spark.range(1).drop("id")
    return reduce(lambda df, kv: df.withColumn(kv[0], F.explode(F.array(*map(F.lit, kv[1])))), values.items(), one)
