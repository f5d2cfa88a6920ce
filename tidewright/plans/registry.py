"""The registered queries of the library and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Modules of this package that register queries.
MODULES = ["window_queries", "aggregate_queries", "join_queries", "state_queries", "study_queries", "stream_queries", "source_queries", "ledger_queries", "signal_queries", "discovery_queries", "event_queries", "watch_queries", "reader_queries", "model_queries", "report_queries"]


def query(sql: str | None = None, dates: str = "date") -> Callable[[Query], Query]:
    """Register a function under its name, with SQL that gives the same rows.

    The columns named in ``dates`` are reported as text on both sides.
    """

    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(spark, sf_dir)
            return found.withColumns({c: found[c].cast("string") for c in dates.split()}) if dates else found

        _QUERIES[f.__name__] = run
        if sql is not None:
            text = _no_minus_zero(sql)
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split())
            _ORACLES[f.__name__] = f"SELECT * REPLACE ({texts}) FROM ({text})" if dates else text
        return f

    return add


def _no_minus_zero(sql: str) -> str:
    """Every ``round(...)`` of a SQL text plus 0.0, so that none gives a negative zero."""
    out, at = [], 0
    while (found := sql.find("round(", at)) >= 0:
        depth, end = 0, found + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        out.append(sql[at:found] + "(round(" + _no_minus_zero(sql[found + 6 : end]) + " + 0.0)")
        at = end
    return "".join(out) + sql[at:]


def load() -> None:
    for name in MODULES:
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return _ORACLES
