"""Streaming forms of the stateful operators, over a table of events.

Sources are ``readStream`` frames; every function is a transformation that also
runs on a batch frame, but for those that keep state of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..scratch import own_folder


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors share."""
    return f"{own_folder(spark)}/stream-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*")
    events = reader.option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a query over all that is there now, and read what it has written.

    In append mode rows go to a Parquet sink with exactly-once files; in the
    other modes each batch replaces the result so far.
    """
    spark = stream.sparkSession
    out, marks = scratch(spark), scratch(spark)
    writer = stream.writeStream.option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Count and sum by event type and window, with a watermark for late rows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    counts = w.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_means(events: DataFrame, width: str = "6 hours", slide: str = "3 hours", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type")
    return w.agg(F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "mean")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """A user's events with no pause of ``gap`` or more between."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of_key(events: DataFrame, late: str = "40 days") -> DataFrame:
    """The first row of each event id; repeats within the watermark go."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def transitions(events: DataFrame) -> DataFrame:
    """A row for each change of a user's event type, by state kept per user.

    Rows of one batch are put in time order; the state is the last type seen.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        was = state.get[0] if state.exists else None
        out = []
        for event, kind in zip(rows["event_id"], rows["event_type"]):
            if was is not None and kind != was:
                out.append((key[0], event, was, kind))
            was = kind
        state.update((was,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "was", "now"])

    schema = "user_id long, event_id long, was string, now string"
    return events.groupBy("user_id").applyInPandasWithState(step, schema, "was string", "append", GroupStateTimeout.NoTimeout)


#: ``event_id`` as text: pandas would round longs beside nulls.
CHUNKS = pa.schema({"event_type": pa.string(), "chunk": pa.int64(), "given": pa.bool_(), "event_id": pa.string(), "value": pa.float64(), "if_armed": pa.bool_(), "if_not": pa.bool_()})


def _chunk_alerts(batches: Iterator[pa.RecordBatch], high: float, low: float) -> Iterator[pa.RecordBatch]:
    """What the rows of each type and chunk of time do, whatever they start from.

    A row with ``given`` is an alert if the chunk starts so, one without in any
    case; a chunk's last row has no ``value`` and tells what each start ends in.
    """
    keys, kept, most = {}, [], np.iinfo(np.int64).max
    for batch in batches:
        kind, chunk, micros, event, value = batch.columns
        x = value.to_numpy(zero_copy_only=False)
        told = np.flatnonzero((x >= high) | (x <= low))
        kind, chunk, micros, event = (c.take(pa.array(told)) for c in (kind, chunk, micros, event))
        codes = [keys.setdefault(k, len(keys)) for k in zip(kind.to_pylist(), chunk.to_pylist())]
        ids, times = (pc.fill_null(c, most).to_numpy() for c in (event, micros))  # nulls come last
        kept.append((np.array(codes, np.int64), times, ids, event.is_null().to_numpy(zero_copy_only=False), x[told]))
    if not keys:
        return
    code, times, ids, lacking, x = map(np.concatenate, zip(*kept))
    order = np.lexsort((lacking, ids, times, code))
    code, ids, lacking, x = code[order], ids[order], lacking[order], x[order]
    names, out = list(keys), []
    starts = np.flatnonzero(np.diff(code, prepend=-1)).tolist()
    for at, to in zip(starts, [*starts[1:], len(code)]):
        name = names[code[at]]
        now = {True: True, False: False}  # whether armed, by what the chunk starts from
        for event, no_id, v in zip(ids[at:to].tolist(), lacking[at:to].tolist(), x[at:to].tolist()):
            told = [start for start, armed in now.items() if armed and v >= high]
            if told:
                out.append((*name, told[0] if len(told) == 1 else None, None if no_id else str(event), v, None, None))
            now = {start: start not in told and (armed or v <= low) for start, armed in now.items()}
        out.append((*name, None, None, None, now[True], now[False]))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), CHUNKS)], schema=CHUNKS)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), CHUNKS)], schema=CHUNKS)


def armed_alerts(events: DataFrame, high: float, low: float, seconds: int = 3600) -> DataFrame:
    """An alert when a type's value reaches ``high``; the next only after one at or under ``low``.

    Rows of one batch are put in time order, by chunks of so many seconds: each is
    walked on its own from both states, so that its alerts after a row at or under
    ``low`` are certain.  A type's step passes these on as they come and holds two
    rows a chunk, however many events a chunk has.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed, held, told = state.get[0] if state.exists else True, [], ["event_type", "event_id", "value"]
        for frame in frames:
            certain = frame["given"].isna() & frame["value"].notna()
            if certain.any():
                yield frame.loc[certain, told]
            held.append(frame[~certain])
        out = []
        for _, rows in pd.concat(held).groupby("chunk", dropna=False):
            out.append(rows.loc[rows["given"] == armed, told])
            armed = bool(rows.loc[rows["value"].isna(), "if_armed" if armed else "if_not"].iloc[0])
        state.update((armed,))
        yield pd.concat(out)

    rows = events.withColumn("_us", F.unix_micros("ts")).withColumn("_chunk", F.expr(f"_us div {seconds * 1_000_000}"))
    rows = rows.select("event_type", "_chunk", "_us", F.col("event_id").cast("long"), F.col("value").cast("double")).repartition("event_type", "_chunk")
    fields = "event_type string, chunk long, given boolean, event_id string, value double, if_armed boolean, if_not boolean"
    chunks = rows.mapInArrow(partial(_chunk_alerts, high=high, low=low), fields).groupBy("event_type")
    found = chunks.applyInPandasWithState(step, "event_type string, event_id string, value double", "armed boolean", "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("event_id", F.col("event_id").cast("long"))


def _in_order(events: DataFrame, key: str, value: str, start, step, out_schema: str, late: str) -> DataFrame:
    """A walk over each key's rows in time order, whatever the batches they come in.

    Rows wait in the key's state until the watermark passes them, so one that is late
    by less than ``late`` takes its place; one that is later is dropped.  What waits
    is a key's rows of the last ``late``; a key without waiting rows keeps one value.
    ``start`` is that value at first, ``step`` takes it and a row's to the next and
    says whether to report the row.
    """
    kind = events.schema[value].dataType.simpleString()
    names = [f.split()[0] for f in out_schema.split(", ")]

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, times, ids, values = state.get if state.exists else (start, [], [], [])
        waiting = list(zip(times, ids, values))
        for frame in frames:
            waiting += zip(frame["_ms"].tolist(), frame["event_id"].tolist(), frame[value].tolist())
        waiting.sort(key=lambda r: r[:2])
        passed, out = state.getCurrentWatermarkMs(), []
        while waiting and waiting[0][0] <= passed * 1000:
            _, event, x = waiting.pop(0)
            now, told = step(was, x)
            if told:
                out.append((keys[0], event, was, x)[: len(names)] if len(names) == 4 else (keys[0], event, x))
            was = now
        state.update((was, *([r[i] for r in waiting] for i in range(3))))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, passed + 1))
        yield pd.DataFrame(out, columns=names)

    first = {str: "string", bool: "boolean"}.get(type(start), "string")
    rows = events.withWatermark("ts", late).withColumn("_ms", F.unix_micros("ts"))
    schema = f"was {first}, times array<long>, ids array<long>, kept array<{kind}>"
    return rows.groupBy(key).applyInPandasWithState(run, out_schema, schema, "append", GroupStateTimeout.EventTimeTimeout)


def ordered_transitions(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """:func:`transitions` for rows that come late over several batches; rows newer than the watermark are still to come."""
    step = lambda was, kind: (kind, was is not None and kind != was)
    return _in_order(events, "user_id", "event_type", None, step, "user_id long, event_id long, was string, now string", late)


def ordered_alerts(events: DataFrame, high: float, low: float, late: str = "2 hours") -> DataFrame:
    """:func:`armed_alerts` for rows that come late over several batches."""

    def step(armed: bool, value: float) -> tuple[bool, bool]:
        if armed and value >= high:
            return False, True
        return armed or value <= low, False

    return _in_order(events, "event_type", "value", True, step, "event_type string, event_id long, value double", late)
