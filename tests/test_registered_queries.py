"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewright.plans import registry, workers

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES + ["pages"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(rows, columns):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "-"
        return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    workers.find_package(spark)
    found = registry.queries()[name](spark, DATA)
    wanted = sql.execute(registry.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert plain(found.collect(), found.columns) == plain(wanted.fetchall(), names)
