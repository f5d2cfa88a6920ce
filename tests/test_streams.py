"""Streams over several batches with late rows."""

import datetime as dt
import os

import pandas as pd
import pyarrow as pa
import pytest

from tidewright.plans import workers
from tidewright.streaming import events as e

START = dt.datetime(2024, 1, 1)


def made(n=240):
    """Events a minute apart, dealt to batches so that every fifth comes one batch late, and one far too late."""
    rows = [(i, i % 3, "abc"[(i // 4 + i % 3) % 3], START + dt.timedelta(minutes=i), float((i * 37) % 180)) for i in range(n)]
    batches = [[] for _ in range(7)]
    for r in rows:
        at = r[0] // 40
        batches[at + (r[0] % 5 == 2 and r[0] % 40 > 20)].append(r)
    batches[5].append((999, 0, "z", START + dt.timedelta(minutes=3), 179.0))
    batches[6].append((1000, 7, "a", START + dt.timedelta(days=2), 0.0))  # moves the watermark past all others
    return rows, batches


@pytest.fixture()
def stream(spark, tmp_path):
    workers.find_package(spark)
    rows, batches = made()
    folder = tmp_path / "in"
    folder.mkdir()
    for i, batch in enumerate(batches):
        frame = pd.DataFrame(batch, columns=["event_id", "user_id", "event_type", "ts", "value"])
        frame["ts"] = frame["ts"].astype("datetime64[us]").dt.tz_localize("UTC")
        frame.to_parquet(folder / f"{i}.parquet")
    schema = "event_id long, user_id long, event_type string, ts timestamp, value double"
    return rows, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_transitions_in_order_over_batches(stream):
    rows, events = stream
    want, was = [], {}
    for event, user, kind, _, _ in rows:
        if user in was and was[user] != kind:
            want.append((user, event, was[user], kind))
        was[user] = kind
    assert sorted(map(tuple, e.run_to_end(e.ordered_transitions(events, "30 minutes")).collect())) == sorted(want)


def test_alerts_in_order_over_batches(stream):
    rows, events = stream
    want, armed = [], {}
    for event, _, kind, _, value in rows:
        if armed.get(kind, True) and value >= 150:
            want.append((kind, event, value))
            armed[kind] = False
        elif value <= 20:
            armed[kind] = True
    assert sorted(map(tuple, e.run_to_end(e.ordered_alerts(events, 150.0, 20.0, "30 minutes")).collect())) == sorted(want)


@pytest.mark.parametrize("high, low, seconds", [(150.0, 20.0, 600), (150.0, 20.0, 86_400), (60.0, 120.0, 1800)])
def test_alerts_over_chunks_of_time(spark, tmp_path, high, low, seconds):
    """Batches in order, chunks that hold several rows or none that count, ids that pandas' floats would round."""
    workers.find_package(spark)
    rows = [(2**60 + i, "abc"[i % 3], START + dt.timedelta(minutes=i if i < 300 else 5 * i), float((i * 37 + i // 7) % 180)) for i in range(600)]
    want, armed = [], {}
    for event, kind, _, value in rows:
        if armed.get(kind, True) and value >= high:
            want.append((kind, event, value))
            armed[kind] = False
        elif value <= low:
            armed[kind] = True
    for n in range(4):
        frame = pd.DataFrame(rows[150 * n : 150 * (n + 1)][::-1], columns=["event_id", "event_type", "ts", "value"])
        frame["ts"] = frame["ts"].astype("datetime64[us]").dt.tz_localize("UTC")
        frame.to_parquet(tmp_path / f"{n}.parquet")
        os.utime(tmp_path / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    events = spark.readStream.schema("event_id long, event_type string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    assert sorted(map(tuple, e.run_to_end(e.armed_alerts(events, high, low, seconds)).collect())) == sorted(want)


def test_alerts_hold_two_rows_a_chunk(spark):
    """A step gets what is open of each chunk apart from what is certain, however many events there are."""
    many = pa.RecordBatch.from_pydict({"event_type": ["a"] * 9000, "_chunk": [i // 3000 for i in range(9000)], "_us": list(range(9000)), "event_id": list(range(9000)), "value": [float(i % 7 * 30) for i in range(9000)]})
    found = pa.Table.from_batches(e._chunk_alerts(iter([many.slice(0, 4000), many.slice(4000)]), 150.0, 20.0)).to_pylist()
    assert len([r for r in found if r["given"] is not None or r["value"] is None]) <= 6
    assert len(found) > 1000
