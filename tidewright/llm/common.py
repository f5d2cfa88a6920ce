"""What several operators share: scratch tables, components, unit caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import own_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    Cuts lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    own_folder(df.sparkSession)  # sets a checkpoint folder where none is set
    return df.checkpoint(eager=True)


def few_files(df: DataFrame, rows: int, rows_a_task: int = 50_000, even: bool = False) -> DataFrame:
    """``df``, known to have at most about ``rows`` small rows, in partitions that suit them where shuffles make more.

    A file for each shuffle partition costs more than what is in it: Hadoop's
    local file system starts a process for every file it creates, and while one
    starts it counts the whole heap of its executor a second time.  ``even``
    says that partitions are alike (of a grouped result), so that they can be
    joined without a shuffle; else rows are dealt anew, and what a skewed join
    has split stays split.
    """
    tasks = max(4, -(-rows // rows_a_task))
    if tasks >= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.coalesce(tasks) if even else df.repartition(tasks)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` as ``(node, root)``.

    ``root`` is the smallest node of the component.  Alternates large-star and
    small-star steps; each is a grouped minimum, which is pre-aggregated on the
    map side, and an equi-join.  Minima are written before they are joined:
    with plain shuffles on both sides the skew join splits a hub.  Nothing
    passes through the driver but one checksum per round.  Nodes without edges
    do not appear.
    """

    def sum_of(df: DataFrame):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(row)

    def smallest(df: DataFrame) -> DataFrame:
        return stored(few_files(df.groupBy("a").agg(F.min("b").alias("m")), last[0], even=True), "least")

    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = checkpointed(links.filter(F.col("a") != F.col("b")).distinct())
    last = sum_of(links)
    if last[0] == 0:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        # Large star: all larger neighbours of a node move to its smallest one.
        both = links.union(links.select(F.col("b"), F.col("a")))
        low = smallest(both).withColumn("m", F.least("a", "m"))
        large = (
            both.join(low, "a")
            .filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        # Small star: a node and its smaller neighbours move to the smallest.
        large = checkpointed(few_files(large.filter(F.col("a") != F.col("b")), last[0]))
        low = smallest(large)
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        links = checkpointed(few_files(small.filter(F.col("a") != F.col("b")).distinct(), last[0], even=True))
        now = sum_of(links)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        own.select("node", F.col("node").alias("root"))
    )


class UnitCache:
    """Results for text units seen of late, in two generations.

    ``many`` maps a list of units to their results.  When the young generation
    is full it becomes the old one, so memory is bounded by twice ``limit``
    entries while common units stay.  A cache only saves work: what it returns
    never depends on what it holds.
    """

    def __init__(self, many: Callable[[list[str]], list], limit: int = 250_000):
        self.many, self.limit = many, limit
        self.young: dict = {}
        self.old: dict = {}

    def ready(self, units: Iterable[str]) -> dict:
        """A dict that holds at least ``units``."""
        held = self.young
        units = dict.fromkeys(units)
        lacking = [u for u in units if u not in held]
        if lacking:
            if held and len(held) + len(lacking) > self.limit:
                self.old, self.young = held, {}
                lacking = units
            fresh = []
            for u in lacking:
                if (hit := self.old.get(u)) is None:
                    fresh.append(u)
                else:
                    self.young[u] = hit
            if fresh:
                self.young.update(zip(fresh, self.many(fresh)))
        return self.young


def slices(table, rows: int = 128):
    """Record batches in pieces of a few rows, for bounded memory."""
    for at in range(0, table.num_rows, rows):
        yield table.slice(at, rows)


def sized_slices(table, column: int, most_bytes: int = 1 << 24):
    """Record batches in pieces of about ``most_bytes`` of one text column, of a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < table.num_rows:
        gone = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, gone + most_bytes, "right")))
        yield table.slice(at, to - at)
        at = to
