"""Where intermediate tables and stream checkpoints lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def own_folder(spark: SparkSession) -> str:
    """This application's folder under the shared one that ``spark.checkpoint.dir`` names.

    Where that is unset: a temporary folder under a local master (tests), else a
    folder of the warehouse, which all executors share.  The folder goes when the
    driver's JVM ends; until then results may still be read from it.
    """
    sc = spark.sparkContext
    if (made := getattr(sc, "_tidewright_folder", None)) is None:
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if where is None:
            local = sc.master.startswith("local")
            where = tempfile.mkdtemp(prefix="scratch-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
            sc.setCheckpointDir(where)
        made = f"{where.rstrip('/')}/{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(made)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        sc._tidewright_folder = made
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as written to the shared scratch folder: work that follows doesn't repeat what made them."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
