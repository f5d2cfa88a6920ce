"""Append-only ledgers: settlement, transitions, upserts, hash chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .joins import asof_join
from .windows import Series


def settle(picks: DataFrame, prices: DataFrame, key: str, time: str, value: str, hold: int) -> DataFrame:
    """Entry on the first price after each pick, exit ``hold`` rows on.

    Adds entry and exit dates and prices, the return, and a status: settled,
    pending (no exit yet) or waiting (no entry yet).
    """
    s = Series((key,), time)
    priced = prices.select(
        key,
        F.col(time).alias("entry_date"),
        F.col(value).alias("entry_px"),
        F.lead(time, hold).over(s.ordered).alias("exit_date"),
        F.lead(value, hold).over(s.ordered).alias("exit_px"),
    )
    found = asof_join(picks, priced, time, "entry_date", keys=[key], direction="forward", exact=False)
    rows = found.select(*picks.columns, "matched.entry_date", "matched.entry_px", "matched.exit_date", "matched.exit_px")
    status = F.when(F.col("entry_px").isNull(), "waiting").when(F.col("exit_px").isNull(), "pending").otherwise("settled")
    return rows.withColumn("ret", F.try_divide("exit_px", "entry_px") - 1).withColumn("status", status).filter("status <> 'waiting'")


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """Rows whose state differs from the row before, with the state before as ``was``."""
    was = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("was", was).filter(F.col("was").isNotNull() & (F.col("was") != F.col(state)))


def keep_members(actions: DataFrame, keys: Sequence[str], order: str, action: str) -> DataFrame:
    """Keys whose last action is a promotion."""
    last = actions.groupBy(*keys).agg(F.max_by(action, order).alias("_last"))
    return last.filter("_last = 'promote'").drop("_last")


def source_health(df: DataFrame, source: str, day: str, as_of: str, stale_after: int) -> DataFrame:
    """Rows, latest day and age of each source as of a given day, and whether it is stale."""
    stats = df.groupBy(source).agg(F.count("*").alias("n"), F.max(day).alias("latest"))
    stats = stats.withColumn("age", F.datediff(F.lit(as_of).cast("date"), "latest"))
    return stats.withColumn("state", F.when(F.col("age") > stale_after, "stale").otherwise("fresh"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both by key; new rows win."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_row"))
    return best.select(*keys, "_row.*")


def upsert_checked(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """As ``upsert``, but fails if a key's values differ by more than the tolerance."""
    pair = old.select(*keys, F.col(value).alias("_old")).join(new, list(keys), "inner")
    clash = F.abs(F.col("_old") - F.col(value)) > tolerance
    guard = pair.select(F.max(F.when(clash, F.raise_error(F.lit("sources disagree"))).otherwise(F.lit(0))).alias("_ok"))
    # The guard's one row is read by a filter, so that it can't be pruned.
    return upsert(old, new, keys).join(F.broadcast(guard)).filter("_ok is null or _ok = 0").drop("_ok")


def append_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows and those new ones whose key isn't there yet."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def frozen_once_settled(old: DataFrame, new: DataFrame, keys: Sequence[str], settled: str) -> DataFrame:
    """New rows, except that a row once settled stays as it was."""
    done = old.filter(F.col(settled))
    return done.unionByName(new.join(done.select(*keys), list(keys), "left_anti"))


def is_prefix(old: DataFrame, new: DataFrame, position: str) -> DataFrame:
    """Rows of ``old`` that ``new`` doesn't hold unchanged at the same position; none for a legal append."""
    return old.exceptAll(new).select(position)


def canonical(fields: Sequence[str]) -> Column:
    """A row's JSON text: fields by name, values as text, nulls kept."""
    texts = [F.col(c).cast("string").alias(c) for c in sorted(fields)]
    return F.to_json(F.struct(*texts), {"ignoreNullFields": "false"})


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash chains over rows sorted by ledger and order; only the last hash is kept."""
    last, prev = None, ""
    for batch in batches:
        before, hashes = [], []
        for name, text in zip(batch.column("_ledger").to_pylist(), batch.column("_text").to_pylist()):
            if name != last:
                last, prev = name, ""
            before.append(prev)
            prev = hashlib.sha256((prev + text).encode()).hexdigest()
            hashes.append(prev)
        kept = batch.drop_columns(["_ledger", "_text"])
        yield kept.append_column("prev_hash", pa.array(before, pa.string())).append_column("row_hash", pa.array(hashes, pa.string()))


def seal(df: DataFrame, ledger: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Adds the hash chain of each ledger: every hash covers the row and the hash before.

    Spark writes the rows' texts and sorts each ledger within one partition; the
    fold streams over it in batches and holds one hash, so a ledger may be of any
    length.  Ledgers run in parallel.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.StringType()) for n in ("prev_hash", "row_hash"))])
    rows = df.select("*", F.coalesce(F.col(ledger).cast("string"), F.lit("")).alias("_ledger"), canonical(fields).alias("_text"))
    rows = rows.repartition("_ledger").sortWithinPartitions("_ledger", order)
    return rows.mapInArrow(_chained, schema)


def seal_manifest(sealed: DataFrame, ledger: str, order: str, note: str) -> DataFrame:
    """One record per sealed ledger: rows and the hash of the last, which covers all before it."""
    head = F.max_by("row_hash", order).alias("head")
    return sealed.groupBy(ledger).agg(F.count("*").alias("n_rows"), head).withColumn("note", F.lit(note))


def verify_manifest(manifest: DataFrame, current: DataFrame, ledger: str, order: str) -> DataFrame:
    """State of each recorded ledger: intact, extended, truncated, or edited at or before the recorded row."""
    numbered = current.withColumn("_i", F.row_number().over(Window.partitionBy(ledger).orderBy(order)))
    sizes = current.groupBy(ledger).agg(F.count("*").alias("_now"))
    at = numbered.select(ledger, F.col("_i").alias("n_rows"), F.col("row_hash").alias("_hash"))
    x = manifest.join(sizes, ledger, "left").join(at, [ledger, "n_rows"], "left")
    same = F.col("_hash").eqNullSafe(F.col("head"))
    state = F.when(F.coalesce("_now", F.lit(0)) < F.col("n_rows"), "truncated").when(~same, "edited").when(F.col("_now") > F.col("n_rows"), "extended").otherwise("intact")
    return x.select(ledger, "n_rows", state.alias("state"))


def broken_links(sealed: DataFrame, ledger: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Rows whose stored hash isn't the one their content and predecessor give."""
    again = seal(sealed.drop("prev_hash", "row_hash"), ledger, order, fields)
    again = again.select(ledger, order, F.col("row_hash").alias("_expected"))
    return sealed.join(again, [ledger, order]).filter(F.col("row_hash") != F.col("_expected")).drop("_expected")
