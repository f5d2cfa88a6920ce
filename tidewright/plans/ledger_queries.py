"""Registered scorecards, ledgers, portfolio and further scalar queries, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as c
from ..functions import scores as f
from ..operators import aggregates as g
from ..operators import episodes as e
from ..operators import ledger as l
from ..operators import significance as s
from ..operators.windows import Series
from ..sources import adapters as a
from .registry import query
from .window_queries import RET, O, _r, _returns

S = Series(("asset",), "date")
sql = a.with_views
ALL = "ROWS UNBOUNDED PRECEDING"


@query(sql("p", f"""{RET}, x AS (SELECT asset, month(date) = 1 AS january, r FROM r WHERE r IS NOT NULL),
g AS (SELECT asset, avg(r) FILTER (january) AS m1, avg(r) FILTER (NOT january) AS m0, var_samp(r) FILTER (january) / count(*) FILTER (january) AS v1, var_samp(r) FILTER (NOT january) / count(*) FILTER (NOT january) AS v0,
count(*) FILTER (january) AS n1, count(*) FILTER (NOT january) AS n0 FROM x GROUP BY asset)
SELECT asset, round((m1 - m0) / sqrt(v1 + v0), 6) AS t, round((v1 + v0) * (v1 + v0) / (v1 * v1 / (n1 - 1) + v0 * v0 / (n0 - 1)), 4) AS df FROM g"""), dates="")
def agg19_two_sample_t(spark, sf_dir):
    x = _returns(spark, sf_dir).filter("r is not null").withColumn("january", F.month("date") == 1)
    return s.welch(x, "r", "january", ["asset"]).select("asset", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query(sql("p", f"""{RET}, w(name, since) AS (VALUES ('all', DATE '1900-01-01'), ('1999+', DATE '1999-01-01'), ('1y', (SELECT max(date) - 365 FROM p)))
SELECT asset, name, count(*) AS n, round(avg(r), 6) AS mean FROM r JOIN w ON date > since WHERE r IS NOT NULL GROUP BY 1, 2"""), dates="")
def agg23_by_window(spark, sf_dir):
    r = _returns(spark, sf_dir)
    end = r.agg(F.max("date").alias("end"))
    flags = {"all": F.col("date") > "1900-01-01", "1999+": F.col("date") > "1999-01-01", "1y": F.col("date") > F.date_sub("end", 365)}
    r = g.tagged(r.join(end).filter("r is not null"), "name", flags)
    return r.groupBy("asset", "name").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean"))


@query("""WITH v AS (SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT segment, CAST(sum(n) AS BIGINT) AS n, arg_max(priority, (n, priority)) AS top, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS share FROM v GROUP BY 1 HAVING sum(n) >= 30""", dates="")
def agg26_top_share(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders").join(a.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    v = o.groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    top = F.max_by("priority", F.struct("n", "priority")).alias("top")
    out = v.groupBy("segment").agg(F.sum("n").alias("total"), top, F.max("n").alias("most")).filter("total >= 30")
    return out.select("segment", F.col("total").alias("n"), "top", F.round(F.col("most") / F.col("total"), 6).alias("share"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT user_id, CAST(ts AS DATE) AS d, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2) AS x GROUP BY 1", dates="")
def agg27_one_per_key(spark, sf_dir):
    ev = a.table(spark, sf_dir, "events")
    one = ev.groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return one.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(sql("p", f"""{RET}, x AS (SELECT least(greatest((r + 1) / 4, 0), 1) AS p, CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END AS y FROM r WHERE r IS NOT NULL),
e AS (SELECT list_transform(range(1, 7), lambda i: i / 7.0) AS qs), q AS (SELECT quantile_cont(p, [1/7.0, 2/7.0, 3/7.0, 4/7.0, 5/7.0, 6/7.0]) AS edges FROM x),
b AS (SELECT p, y, 1 + len(list_filter(edges, lambda v: p > v)) AS bin FROM x, q) SELECT bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS actual FROM b GROUP BY bin"""), dates="")
def agg31_quantile_calibration(spark, sf_dir):
    x = _returns(spark, sf_dir).filter("r is not null")
    x = x.select(F.least(F.greatest((F.col("r") + 1) / 4, F.lit(0.0)), F.lit(1.0)).alias("p"), (F.col("r") > 0).cast("double").alias("y"))
    x = g.quantile_bins(x, "p", 7, []).groupBy(F.col("bin").cast("long").alias("bin"))
    return x.agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("actual"))


@query("""WITH x AS (SELECT c_custkey, [(c_acctbal - 4500) / 5500, c_nationkey / 24.0 - 0.5, 0.2] AS p, [0.5, 0.3, 0.2] AS w FROM customer),
m AS (SELECT c_custkey, (p[1] * w[1] + p[2] * w[2] + p[3] * w[3]) / (w[1] + w[2] + w[3]) AS score FROM x)
SELECT c_custkey, round(score, 6) AS score, CASE WHEN score > 0.4 THEN 'strong' WHEN score > 0.13 THEN 'positive' WHEN score >= -0.13 THEN 'neutral' WHEN score >= -0.4 THEN 'cautious' ELSE 'defensive' END AS stance FROM m""", dates="")
def agg33_weighted_stance(spark, sf_dir):
    push = [(F.col("c_acctbal") - 4500) / 5500, F.col("c_nationkey") / 24.0 - 0.5, F.lit(0.2)]
    cust = a.table(spark, sf_dir, "customer").withColumn("score", f.weighted_mean(push, [0.5, 0.3, 0.2]))
    return cust.select("c_custkey", F.round("score", 6).alias("score"), f.stance("score").alias("stance"))


@query(sql("k", """WITH n AS (SELECT *, close / lag(close) OVER w - 1 AS r, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn, close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1 AS dd FROM k WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, count(r) AS n, round(stddev_pop(r) * sqrt(252.0), 6) AS volatility, round(min(dd), 6) AS worst, round(max(r), 6) AS best_day, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (r IS NOT NULL), 6) AS up_rate FROM n WHERE rn <= 252 GROUP BY ticker"""), dates="")
def agg44_recent_metrics(spark, sf_dir):
    w = Series(("ticker",), "date")
    k = a.ticker_panel(spark, sf_dir)
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    k = k.select("ticker", w.change("close").alias("r"), rn.alias("rn"), (F.col("close") / F.max("close").over(w.last(252)) - 1).alias("dd")).filter("rn <= 252")
    up = F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double")))
    return k.groupBy("ticker").agg(F.count("r").alias("n"), F.round(F.stddev_pop("r") * F.sqrt(F.lit(252.0)), 6).alias("volatility"), F.round(F.min("dd"), 6).alias("worst"), F.round(F.max("r"), 6).alias("best_day"), F.round(up, 6).alias("up_rate"))


@query(sql("t", """WITH n AS (SELECT value, row_number() OVER (ORDER BY date DESC) AS rn FROM t)
SELECT round(CAST(count(*) FILTER (value < (SELECT value FROM n WHERE rn = 1)) AS DOUBLE) / count(*), 6) AS percentile, max(value) - min(value) < 0.01 AS flat FROM n WHERE rn <= 252"""), dates="")
def agg46_latest_percentile(spark, sf_dir):
    recent = a.daily_total(spark, sf_dir).orderBy(F.desc("date")).limit(252)
    latest = recent.agg(F.max_by("value", "date").alias("latest"))
    x = recent.join(latest)
    return x.agg(F.round(F.avg((F.col("value") < F.col("latest")).cast("double")), 6).alias("percentile"), (F.max("value") - F.min("value") < 0.01).alias("flat"))


@query("""SELECT c_nationkey AS nation, round(sum(units * price * rate), 2) AS value, round(sum(units * (price - cost) * rate), 2) AS gain FROM (
SELECT c_nationkey, c_custkey % 7 + 1 AS units, 100 + c_custkey % 13 AS price, 90 + c_custkey % 11 AS cost, 1.5::DOUBLE AS rate FROM customer) AS x GROUP BY 1""", dates="")
def agg47_portfolio_value(spark, sf_dir):
    k = F.col("c_custkey")
    units, price, cost = k % 7 + 1, 100 + k % 13, 90 + k % 11
    by = a.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"))
    return by.agg(F.round(F.sum(units * price * 1.5), 2).alias("value"), F.round(F.sum(units * (price - cost) * 1.5), 2).alias("gain"))


@query("SELECT c_custkey, round(CASE WHEN c_nationkey / 25.0 >= 0.98 THEN 0.5 ELSE greatest((1 - (1 + c_acctbal / 20000.0) * (c_nationkey / 25.0)) / (1 - c_nationkey / 25.0), 0.5) END, 4) AS complement FROM customer", dates="")
def sca06_complement(spark, sf_dir):
    share = F.col("c_nationkey") / 25.0
    x = F.when(share >= 0.98, F.lit(0.5)).otherwise(f.complement(1 + F.col("c_acctbal") / 20000, share))
    return a.table(spark, sf_dir, "customer").select("c_custkey", F.round(x, 4).alias("complement"))


@query("""SELECT c_custkey, round(CASE WHEN c_acctbal <= 0 THEN 10 WHEN c_acctbal <= 2000 THEN 10 + c_acctbal / 2000 * 20 WHEN c_acctbal <= 8000 THEN 30 + (c_acctbal - 2000) / 6000 * 60 ELSE 90 END, 6) AS y FROM customer""", dates="")
def sca08_interpolation(spark, sf_dir):
    return a.table(spark, sf_dir, "customer").select("c_custkey", *_r(y=f.interpolate("c_acctbal", [(0, 10), (2000, 30), (8000, 90)])))


@query("""SELECT c_custkey, round(CASE WHEN c_acctbal > 0 AND c_nationkey > 3 THEN (c_acctbal / 100 + c_nationkey) / 2 WHEN c_acctbal > 0 THEN NULL ELSE NULL END, 6) AS mean FROM customer""", dates="")
def sca12_row_mean(spark, sf_dir):
    subs = [F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 100), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("double"))]
    return a.table(spark, sf_dir, "customer").select("c_custkey", *_r(mean=f.row_mean(*subs)))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date, day(CAST(date_trunc('week', date) AS DATE) + 4) BETWEEN 15 AND 21 AS expiry_week, 'W' || lpad(CAST(week(date) AS VARCHAR), 2, '0') AS label, date_diff('day', date, DATE '2002-01-01') AS age FROM d""")
def sca15_week_labels(spark, sf_dir):
    d = a.daily_total(spark, sf_dir).select("date")
    label = F.concat(F.lit("W"), F.lpad(F.weekofyear("date").cast("string"), 2, "0"))
    return d.select("date", c.expiry_week("date").alias("expiry_week"), label.alias("label"), F.datediff(F.lit("2002-01-01").cast("date"), "date").cast("long").alias("age"))


@query(sql("t", """WITH n AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM t) SELECT x.date, CAST(y.date AS VARCHAR) AS target FROM n AS x LEFT JOIN n AS y ON y.i = x.i + 5"""))
def sca22_add_trading_days(spark, sf_dir):
    one = Series((), "date")
    return a.daily_total(spark, sf_dir).select("date", F.lead("date", 5).over(one.ordered).cast("string").alias("target"))


@query("""SELECT c_custkey, round((110.0 + c_nationkey) / 100 * (0.7 / (0.65 + c_nationkey / 1000.0)) - 1, 6) AS home_return,
round(c_acctbal - greatest(CASE WHEN c_nationkey >= 12 THEN c_acctbal * 0.5 ELSE c_acctbal END, 0) * 0.39, 6) AS after_tax FROM customer""", dates="")
def sca25_currency_and_tax(spark, sf_dir):
    n = F.col("c_nationkey")
    home = f.currency_return(110.0 + n, F.lit(100.0), 0.65 + n / 1000.0, F.lit(0.7))
    return a.table(spark, sf_dir, "customer").select("c_custkey", *_r(home_return=home), F.round(f.after_tax_gain(F.col("c_acctbal"), n, 0.37), 6).alias("after_tax"))


@query(sql("p", "SELECT asset, date, CASE WHEN dd <= -0.4 THEN 'deep' WHEN dd <= -0.25 THEN 'mid' ELSE 'shallow' END AS zone FROM (SELECT asset, date, value / max(value) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM p) AS x"))
def sca29_drawdown_zone(spark, sf_dir):
    dd = S.drawdown("value")
    zone = F.when(dd <= -0.4, "deep").when(dd <= -0.25, "mid").otherwise("shallow")
    return a.daily_prices(spark, sf_dir).select("asset", "date", zone.alias("zone"))


@query("""SELECT event_id, CASE WHEN isodow(ts) > 5 THEN 'closed' WHEN m < 570 THEN 'pre' WHEN m < 960 THEN 'open' ELSE 'closed' END AS state FROM (SELECT event_id, ts, hour(ts) * 60 + minute(ts) AS m FROM events) AS x""", dates="")
def sca34_session_state(spark, sf_dir):
    return a.table(spark, sf_dir, "events").select("event_id", c.session_state("ts").alias("state"))


@query(sql("p", f"""WITH z AS (SELECT asset, date, value / avg(value) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - 1 AS z FROM p),
x AS (SELECT *, sum(CASE WHEN z < 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY date {ALL}) AS epoch FROM z)
SELECT asset, min(date) AS date, CAST(max(date) AS VARCHAR) AS last, count(*) AS n FROM x WHERE z >= 0.8 GROUP BY asset, epoch"""))
def sta05_band_stretches(spark, sf_dir):
    z = a.daily_prices(spark, sf_dir).select("asset", "date", (F.col("value") / F.avg("value").over(S.last(60)) - 1).alias("z"))
    hits = e.armed_episodes(z, F.col("z") >= 0.8, F.col("z") < 0.2).groupBy("asset", "episode")
    return hits.agg(F.min("date").alias("date"), F.max("date").cast("string").alias("last"), F.count("*").alias("n")).select("asset", "date", "last", "n")


@query(sql("p", f"SELECT asset, date, round(lead(value, 1) {O} / value - 1, 6) AS r1, round(lead(value, 5) {O} / value - 1, 6) AS r5, lead(value, 20) {O} IS NULL AS pending FROM p WHERE date < DATE '2001-07-01'"))
def sta11_back_fill(spark, sf_dir):
    final = a.daily_prices(spark, sf_dir).filter("date < date '2001-07-01'")
    return final.select("asset", "date", *_r(r1=S.forward_change("value", 1), r5=S.forward_change("value", 5)), F.lead("value", 20).over(S.ordered).isNull().alias("pending"))


@query(sql("p", f"""{RET}, q AS (SELECT asset, quantile_cont(r, 0.05) AS q FROM r GROUP BY asset), n AS (SELECT asset, date, r, lead(date) {O} AS next_date, lead(r) {O} AS next_r FROM r)
SELECT n.asset, n.date, CAST(next_date AS VARCHAR) AS next_date, round(next_r, 6) AS next_r, next_r > 0 AS hit FROM n JOIN q ON n.asset = q.asset WHERE r <= q"""))
def sta12_next_day(spark, sf_dir):
    r = _returns(spark, sf_dir)
    q = r.groupBy("asset").agg(F.percentile("r", F.lit(0.05)).alias("q"))
    n = r.select("asset", "date", "r", F.lead("date").over(S.ordered).alias("next_date"), F.lead("r").over(S.ordered).alias("next_r"))
    n = n.join(q, "asset").filter("r <= q")
    return n.select("asset", "date", F.col("next_date").cast("string").alias("next_date"), *_r(next_r=F.col("next_r")), (F.col("next_r") > 0).alias("hit"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_totalprice AS v, o_orderstatus = 'F' AS settled FROM orders WHERE o_orderkey % 2 = 0 OR o_orderstatus = 'F')
SELECT o_orderkey AS id, CASE WHEN o.settled THEN o.v ELSE o_totalprice + 1 END AS v FROM orders LEFT JOIN o ON id = o_orderkey""", dates="")
def sta14_frozen_rows(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "F").alias("settled"))
    old = o.filter("id % 2 = 0 or settled")
    return l.frozen_once_settled(old, o.withColumn("v", F.col("v") + 1), ["id"], "settled").select("id", "v")


@query("""SELECT CAST(ts AS DATE) AS date, count(*) AS rules FROM events WHERE value >= 150 OR event_type = 'error' AND value >= 120 GROUP BY 1 HAVING count(*) >= 2""")
def sta22_daily_trigger(spark, sf_dir):
    ev = a.table(spark, sf_dir, "events").filter("value >= 150 or event_type = 'error' and value >= 120")
    return ev.groupBy(F.col("ts").cast("date").alias("date")).agg(F.count("*").alias("rules")).filter("rules >= 2")


@query("""WITH a AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS id, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(a.id, b.id) AS id, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.id = b.id""", dates="")
def snk04_upsert(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return l.upsert(o.filter("id % 3 <> 0"), o.filter("id % 3 <> 1").withColumn("v", F.col("v") * 2), ["id"])


@query("SELECT o_orderpriority AS ledger, count(*) AS broken, min(o_orderkey) AS first FROM orders WHERE o_orderkey >= 5 AND o_orderpriority = (SELECT o_orderpriority FROM orders WHERE o_orderkey = 5) GROUP BY 1", dates="")
def sta03_hash_chain(spark, sf_dir):
    """Seals a ledger per priority, changes a row, and lists what no longer fits."""
    o = a.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ledger"), "o_orderkey", "o_totalprice")
    sealed = l.seal(o, "ledger", "o_orderkey", ["o_orderkey", "o_totalprice"])
    edited = sealed.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 5, 0.0).otherwise(F.col("o_totalprice")))
    return l.broken_links(edited, "ledger", "o_orderkey", ["o_orderkey", "o_totalprice"]).groupBy("ledger").agg(F.count("*").alias("broken"), F.min("o_orderkey").alias("first"))
