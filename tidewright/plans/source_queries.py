"""Registered queries over text formats, with SQL where the format is simple enough."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as a
from ..sources import readers as r
from ..sources import sinks as k
from .registry import query


@query("SELECT s_suppkey, s_name AS company, 'T' || s_suppkey AS ticker, CAST(s_suppkey AS VARCHAR) AS cik FROM supplier", dates="")
def src18_split_name(spark, sf_dir):
    s = a.table(spark, sf_dir, "supplier")
    shown = F.format_string("%s (T%d) (CIK %010d)", "s_name", "s_suppkey", "s_suppkey")
    return s.select("s_suppkey", shown.alias("shown")).select("s_suppkey", *r.split_name("shown"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ratio FROM events", dates="")
def src12_named_ratio(spark, sf_dir):
    e = a.table(spark, sf_dir, "events")
    payload = F.concat(F.lit('{"ratios": [{"name": "other", "value": "x"}, {"name": "total", "value": "'), F.get_json_object("props", "$.k"), F.lit('"}]}'))
    return e.select("event_id", payload.alias("payload")).select("event_id", r.named_ratio("payload", "total").alias("ratio"))


@query("SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1", dates="")
def src23_hosts(spark, sf_dir):
    p = a.table(spark, sf_dir, "pages")
    return p.groupBy(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("pages"))


@query(dates="")
def src23_table_rows(spark, sf_dir):
    pages = r.table_rows(a.table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", F.size("rows").alias("n_rows"), F.aggregate("rows", F.lit(0), lambda acc, x: acc + F.size(x)).alias("n_cells"))


@query("SELECT upper(p_type) AS symbol FROM (SELECT p_type, min(p_partkey) AS nr FROM part WHERE regexp_matches(upper(p_type), '^[A-Z][A-Z0-9.-]{0,9}$') GROUP BY 1) AS x ORDER BY nr LIMIT 40", dates="")
def src29_request_list(spark, sf_dir):
    lines = a.table(spark, sf_dir, "part").select(F.concat("p_type", F.lit(" # note")).alias("value"), F.col("p_partkey").alias("nr"))
    return r.request_list(lines, 40).select("symbol")


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN NULL ELSE round(ln(c_acctbal), 6) END AS log_balance FROM customer", dates="")
def snk06_finite(spark, sf_dir):
    c = a.table(spark, sf_dir, "customer")
    log = F.when(F.col("c_acctbal") > 0, F.ln("c_acctbal")).otherwise(F.lit(float("nan")))
    return k.finite(c.select("c_custkey", log.alias("log_balance"))).withColumn("log_balance", F.round("log_balance", 6))


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation", dates="")
def snk01_json(spark, sf_dir):
    return k.json_document(a.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("""SELECT source, n, CAST(latest AS VARCHAR) AS latest FROM (SELECT event_type AS source, count(*) AS n, max(CAST(ts AS DATE)) AS latest FROM events GROUP BY 1) AS x""", dates="")
def snk07_health(spark, sf_dir):
    e = a.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"))
    return e.agg(F.count("*").alias("n"), F.max(F.col("ts").cast("date")).cast("string").alias("latest"))
