"""Queries on small tables of their own, against their SQL."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from tidewright.plans import registry, watch_queries, workers

from .test_registered_queries import plain


def rows(spark, folder, name, **tables):
    """A query's rows and its SQL's over the given frames."""
    workers.find_package(spark)
    con = duckdb.connect()
    for t, frame in tables.items():
        frame.to_parquet(folder / f"{t}.parquet", coerce_timestamps="us")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = registry.queries()[name](spark, str(folder))
    wanted = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    return plain(found.collect(), found.columns), plain(wanted.fetchall(), names)


def orders(days, price):
    """One order a day and priority; ``price(priority, day)`` is its price."""
    start = dt.datetime(1995, 1, 1)
    made = [(k, k % 7, price(k, d), start + dt.timedelta(days=d), p) for d in range(days) for k, p in enumerate(["1-URGENT", "5-LOW"])]
    frame = pd.DataFrame(made, columns=["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    return frame.assign(o_orderkey=range(len(frame)))


@pytest.mark.parametrize("quiet", [(), (0,), (0, 1)])
def test_alerts_of_series_that_never_leave_their_zone(spark, tmp_path, quiet):
    got, want = rows(spark, tmp_path, "q56_alerts", orders=orders(30, lambda k, d: 1000.0 if k in quiet else 1000.0 + 900 * (d % 3)))
    assert len(want) == 2
    assert got == want


@pytest.mark.parametrize("name", ["q42_follow", "sta21_aftermath"])
def test_asof_joins_see_each_day_once(spark, tmp_path, monkeypatch, name):
    """However many rows a day has, the ordered streams of the as-of joins hold a priority's days."""
    seen, join = [], watch_queries.asof_join

    def counted(left, *rest):
        seen.append(left.count())
        return join(left, *rest)

    monkeypatch.setattr(watch_queries, "asof_join", counted)
    frame = pd.concat([orders(80, lambda k, d: 300_000.0 + 1000 * k + 700 * (d % 9))] * 60, ignore_index=True)
    frame = frame.assign(o_orderkey=range(len(frame)), o_custkey=[i % 2000 for i in range(len(frame))], o_orderstatus=["FPO"[i % 3] for i in range(len(frame))])
    got, want = rows(spark, tmp_path, name, orders=frame)
    assert got == want and want
    assert seen and max(seen) <= 5 * 80
