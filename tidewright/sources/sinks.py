"""Writers of results: JSON documents, split tables, guarded overwrites."""

from __future__ import annotations

import os
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(df: DataFrame) -> DataFrame:
    """Every NaN and infinity of the top-level floating columns as null."""
    fix = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return df.withColumns({f.name: fix(f.name) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def json_document(df: DataFrame, *columns: str | Column) -> DataFrame:
    """One JSON text per row, nulls kept, without NaN."""
    return finite(df).select(F.to_json(F.struct(*(columns or ["*"])), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, *folders: str) -> None:
    """The rows as JSON lines in each folder."""
    text = json_document(df)
    for folder in folders:
        text.write.mode("overwrite").text(folder)


def write_split(df: DataFrame, day: str, cutoff: str, folder: str) -> None:
    """Rows before the cutoff and the others, apart, so that readers of the recent part skip the rest."""
    part = F.when(F.col(day) < F.lit(cutoff).cast("date"), "history").otherwise("recent")
    df.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(folder)


def append_daily(df: DataFrame, folder: str, day: str) -> None:
    """Append rows of days that the table doesn't hold yet."""
    spark = df.sparkSession
    try:
        held = spark.read.parquet(folder).select(day).distinct()
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        held = df.select(day).limit(0)
    df.join(held, day, "left_anti").write.mode("append").parquet(folder)


def with_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def replace_table(df: DataFrame, folder: str) -> None:
    """Rewrite a table that the rows may themselves come from: staged beside it, then written over it."""
    staged = folder.rstrip("/") + ".staged"
    df.write.mode("overwrite").parquet(staged)
    df.sparkSession.read.schema(df.schema).parquet(staged).write.mode("overwrite").parquet(folder)


def append_record(df: DataFrame, folder: str) -> None:
    """Add rows to a manifest; what is there is never rewritten."""
    df.write.mode("append").parquet(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV parts with a header; columns keep their order."""
    df.write.mode("overwrite").option("header", True).csv(folder)


def write_bytes(spark: SparkSession, folder: str, name: str, data: bytes) -> None:
    """One file in any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()


def write_symbol_files(df: DataFrame, folder: str) -> None:
    """``<symbol>.csv`` for every symbol, written by the task that holds it, in a folder all workers share."""
    where = folder.removeprefix("file://")

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(where, exist_ok=True)
        name = frame["symbol"].iloc[0]
        frame.sort_values("date")[["date", "value"]].to_csv(f"{where}/{name}.csv", index=False)
        return pd.DataFrame({"symbol": [name], "n": [len(frame)]})

    df.groupBy("symbol").applyInPandas(write, "symbol string, n long").collect()  # one row per file
