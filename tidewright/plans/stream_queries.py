"""Registered streaming queries: each runs over all events and is compared with a batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as e
from .registry import query


@query("""SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""", dates="")
def str01_tumbling(spark, sf_dir):
    out = e.run_to_end(e.tumbling_counts(e.read_events(spark, sf_dir)), "complete")
    return out.select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 3 HOURS, ts) - INTERVAL (3 * k) HOURS AS start FROM events, (VALUES (0), (1)) AS s(k))
SELECT CAST(start AS VARCHAR) AS start, event_type, round(avg(value), 9) AS mean FROM w GROUP BY 1, 2""", dates="")
def str02_sliding(spark, sf_dir):
    out = e.run_to_end(e.sliding_means(e.read_events(spark, sf_dir)), "complete")
    return out.select(F.col("start").cast("string").alias("start"), "event_type", F.round("mean", 9).alias("mean"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us FROM s GROUP BY user_id, k""", dates="")
def str03_sessions(spark, sf_dir):
    out = e.run_to_end(e.sessions(e.read_events(spark, sf_dir)), "complete")
    return out.select("user_id", "n", (F.unix_micros("end") - F.unix_micros("start") - 3_600_000_000).alias("span_us"))


@query("SELECT event_id, user_id FROM events", dates="")
def str04_first_of_key(spark, sf_dir):
    return e.run_to_end(e.first_of_key(e.read_events(spark, sf_dir))).select("event_id", "user_id")


@query("""WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT user_id, event_id, was, event_type AS now FROM x WHERE was IS NOT NULL AND was <> event_type""", dates="")
def str05_transitions(spark, sf_dir):
    return e.run_to_end(e.transitions(e.read_events(spark, sf_dir)))


@query("""WITH x AS (SELECT *, coalesce(sum(CASE WHEN value <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS epoch FROM events)
SELECT event_type, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value FROM x WHERE value >= 150 GROUP BY event_type, epoch""", dates="")
def str06_armed_alerts(spark, sf_dir):
    return e.run_to_end(e.armed_alerts(e.read_events(spark, sf_dir), high=150.0, low=20.0))
