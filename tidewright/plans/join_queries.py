"""Registered join, ordering, set and filter queries, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as g
from ..operators import joins as j
from ..operators import ranking as k
from ..operators.windows import Series
from ..sources import adapters as a
from .registry import query
from .window_queries import RET, O, _r, _returns

S = Series(("asset",), "date")
sql = a.with_views


@query(sql("p", """SELECT date, round(max(value) FILTER (asset = '1-URGENT'), 6) AS urgent, round(max(value) FILTER (asset = '2-HIGH'), 6) AS high,
round(max(value) FILTER (asset = '3-MEDIUM'), 6) AS medium FROM p GROUP BY date"""))
def joi01_wide_merge(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    wide = p.groupBy("date").pivot("asset", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.max("value"))
    return wide.select("date", *_r(urgent=F.col("1-URGENT"), high=F.col("2-HIGH"), medium=F.col("3-MEDIUM")))


@query(sql("t p", """WITH m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, arg_max(value, date) AS value FROM t GROUP BY 1)
SELECT x.asset, x.date, round(m.value, 6) AS monthly FROM p AS x ASOF LEFT JOIN m ON x.date >= m.month"""))
def joi02_monthly_to_daily(spark, sf_dir):
    m = a.daily_total(spark, sf_dir).groupBy(F.trunc("date", "month").alias("month")).agg(F.max_by("value", "date").alias("value"))
    p = a.daily_prices(spark, sf_dir).select("asset", "date")
    return j.asof_join(p, m, "date", "month").select("asset", "date", *_r(monthly=F.col("matched.value")))


@query(sql("p wr", "SELECT x.asset, x.date, CAST(w.report_date AS VARCHAR) AS report_date, w.value AS reported FROM p AS x ASOF LEFT JOIN wr AS w ON x.date >= w.usable_from"))
def joi03_asof_knowable(spark, sf_dir):
    p, reports = a.daily_prices(spark, sf_dir).select("asset", "date"), a.weekly_reports(spark, sf_dir)
    found = j.asof_join(p, reports, "date", "usable_from")
    return found.select("asset", "date", F.col("matched.report_date").cast("string").alias("report_date"), F.col("matched.value").alias("reported"))


@query(sql("p ev", """WITH n AS (SELECT asset, date, row_number() OVER (PARTITION BY asset ORDER BY date) AS i FROM p WHERE asset = '1-URGENT'),
m AS (SELECT n.*, e.date AS event, (SELECT count(*) FROM n AS y WHERE y.date < e.date) AS passed FROM n ASOF LEFT JOIN ev AS e ON n.date >= e.date)
SELECT asset, date, CAST(CASE WHEN i - passed <= 5 THEN event END AS VARCHAR) AS event FROM m"""))
def joi04_asof_limited(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir).filter("asset = '1-URGENT'").select("asset", "date")
    ev = a.large_order_days(spark, sf_dir).withColumn("asset", F.lit("1-URGENT"))
    found = j.asof_join(p, ev, "date", "date", keys=["asset"], max_rows=5)
    return found.select("asset", "date", F.col("matched.date").cast("string").alias("event"))


@query(sql("p ev", """WITH d AS (SELECT date, date + 30 AS out_date FROM ev)
SELECT d.date, round(y.value / x.value - 1, 6) AS held FROM d ASOF JOIN (SELECT * FROM p WHERE asset = '2-HIGH') AS x ON d.date >= x.date
ASOF JOIN (SELECT * FROM p WHERE asset = '2-HIGH') AS y ON d.out_date >= y.date"""))
def joi05_entry_and_exit(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir).filter("asset = '2-HIGH'").select("date", "value")
    d = a.large_order_days(spark, sf_dir).withColumn("out_date", F.date_add("date", 30))
    d = j.asof_join(d, p, "date", "date").withColumn("x", F.col("matched.value")).drop("matched")
    d = j.asof_join(d, p, "out_date", "date").withColumn("y", F.col("matched.value"))
    return d.filter("x is not null and y is not null").select("date", *_r(held=F.col("y") / F.col("x") - 1))


@query(sql("p ev", "SELECT e.date, CAST(x.date AS VARCHAR) AS first_day FROM ev AS e ASOF LEFT JOIN (SELECT * FROM p WHERE asset = '2-HIGH') AS x ON e.date <= x.date"))
def joi06_asof_forward(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir).filter("asset = '2-HIGH'").select("date")
    found = j.asof_join(a.large_order_days(spark, sf_dir), p, "date", "date", direction="forward")
    return found.select("date", F.col("matched.date").cast("string").alias("first_day"))


@query(sql("p ev", "SELECT e.date, CAST(x.date AS VARCHAR) AS next_day FROM ev AS e ASOF LEFT JOIN (SELECT * FROM p WHERE asset = '2-HIGH') AS x ON e.date < x.date"))
def joi07_strictly_after(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir).filter("asset = '2-HIGH'").select("date")
    found = j.asof_join(a.large_order_days(spark, sf_dir), p, "date", "date", direction="forward", exact=False)
    return found.select("date", F.col("matched.date").cast("string").alias("next_day"))


@query(sql("p ev", "SELECT e.date, CAST(x.date AS VARCHAR) AS exit_day FROM ev AS e ASOF LEFT JOIN (SELECT * FROM p WHERE asset = '3-MEDIUM') AS x ON e.date + 45 >= x.date"))
def joi08_calendar_exit(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir).filter("asset = '3-MEDIUM'").select("date")
    d = a.large_order_days(spark, sf_dir).withColumn("target", F.date_add("date", 45))
    return j.asof_join(d, p, "target", "date").select("date", F.col("matched.date").cast("string").alias("exit_day"))


@query(sql("p t", "SELECT asset, p.date AS date, round(p.value / t.value, 6) AS share FROM p JOIN t ON p.date = t.date"))
def joi09_inner_on_date(spark, sf_dir):
    t = a.daily_total(spark, sf_dir).withColumnRenamed("value", "total")
    return a.daily_prices(spark, sf_dir).join(t, "date").select("asset", "date", *_r(share=F.col("value") / F.col("total")))


@query(sql("p", f"{RET} SELECT x.date AS date, round(x.r - y.r, 6) AS spread FROM r AS x JOIN r AS y ON x.date = y.date WHERE x.asset = '1-URGENT' AND y.asset = '5-LOW' AND x.r IS NOT NULL AND y.r IS NOT NULL"))
def joi11_complete_pairs(spark, sf_dir):
    r = _returns(spark, sf_dir).filter("r is not null")
    x, y = (r.filter(F.col("asset") == n).select("date", F.col("r").alias(c)) for n, c in (("1-URGENT", "x"), ("5-LOW", "y")))
    return x.join(y, "date").select("date", *_r(spread=F.col("x") - F.col("y")))


@query(sql("k p", "SELECT k.ticker, k.date, round(k.close, 6) AS close FROM k WHERE EXISTS (SELECT 1 FROM ev2 WHERE ev2.ticker = k.ticker AND ev2.date = k.date)").replace("k AS (", "ev2 AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50), k AS (", 1))
def joi12_composite_semi(spark, sf_dir):
    items = a.table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select("l_partkey", F.col("l_shipdate").cast("date").alias("date"))
    big = items.join(a.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("ticker"), "date")
    return a.ticker_panel(spark, sf_dir).join(big, ["ticker", "date"], "left_semi").select("ticker", "date", *_r(close=F.col("close")))


@query(sql("t ev", "SELECT t.date AS date, value FROM t SEMI JOIN ev ON t.date = ev.date"))
def joi13_semi(spark, sf_dir):
    return a.daily_total(spark, sf_dir).join(a.large_order_days(spark, sf_dir), "date", "left_semi").select("date", "value")


@query(sql("t ev", "SELECT t.date AS date, value FROM t ANTI JOIN ev ON t.date = ev.date"))
def joi14_anti(spark, sf_dir):
    return a.daily_total(spark, sf_dir).join(a.large_order_days(spark, sf_dir), "date", "left_anti").select("date", "value")


@query(sql("t ev", "SELECT t.date AS date, CAST(ev.date AS VARCHAR) AS event, date_diff('day', t.date, ev.date) AS days FROM t JOIN ev ON ev.date - t.date BETWEEN 1 AND 3"))
def joi15_days_before_event(spark, sf_dir):
    ev = a.large_order_days(spark, sf_dir).withColumnRenamed("date", "event")
    found = j.range_join(a.daily_total(spark, sf_dir), ev, "date", F.date_sub("event", 3), F.date_sub("event", 1), width=7)
    return found.select("date", F.col("event").cast("string").alias("event"), F.datediff("event", "date").cast("long").alias("days"))


@query("""WITH b(bin, lo, hi) AS (VALUES (1, 0.0, 1000.0), (2, 1000.0, 3000.0), (3, 3000.0, 1e12))
SELECT c_custkey, coalesce((SELECT bin FROM b WHERE c_acctbal > lo AND c_acctbal <= hi), 1) AS bin FROM customer""", dates="")
def joi16_bin_lookup(spark, sf_dir):
    return a.table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(g.right_closed_bin("c_acctbal", [0.0, 1000.0, 3000.0, 1e12]), F.lit(1)).alias("bin"))


@query("SELECT n_name AS nation, r_name AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2", dates="")
def joi18_dimension_lookup(spark, sf_dir):
    c, n, r = (a.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    found = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return found.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("customers"))


@query("SELECT q, h, side FROM (VALUES (1), (5), (10)) AS a(q), (VALUES (1), (5)) AS b(h), (VALUES ('up'), ('down')) AS c(side)", dates="")
def joi19_parameter_grid(spark, sf_dir):
    return k.grid(spark, q=[1, 5, 10], h=[1, 5], side=["up", "down"])


@query(sql("p", f"{RET}, v AS (SELECT x.asset AS a, y.asset AS b, corr(x.r, y.r) AS rho FROM r AS x JOIN r AS y ON x.date = y.date AND x.asset < y.asset GROUP BY 1, 2) SELECT round(avg(rho), 6) AS mean_rho, count(*) AS pairs FROM v"), dates="")
def joi21_average_correlation(spark, sf_dir):
    pairs = g.pairwise(_returns(spark, sf_dir), "asset", "date", "r", rho=F.corr("x", "y"))
    return pairs.agg(F.round(F.avg("rho"), 6).alias("mean_rho"), F.count("*").alias("pairs"))


# ---- order and sets ---------------------------------------------------------


@query(sql("k", """WITH s AS (SELECT ticker, sum(volume) AS v FROM k GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY v DESC, ticker) AS hi, row_number() OVER (ORDER BY v, ticker) AS lo FROM s)
SELECT ticker, CAST(v AS BIGINT) AS v, CASE WHEN hi <= 3 THEN 'top' ELSE 'bottom' END AS side FROM n WHERE hi <= 3 OR lo <= 3"""), dates="")
def top01_both_tails(spark, sf_dir):
    s = a.ticker_panel(spark, sf_dir).groupBy("ticker").agg(F.sum("volume").alias("v"))
    return k.both_tails(s, "v", "ticker", 3).select("ticker", "v", "side")


@query(sql("t", "SELECT date, value FROM t ORDER BY value DESC, date LIMIT 5"))
def top02_best_days(spark, sf_dir):
    return a.daily_total(spark, sf_dir).select("date", "value").orderBy(F.desc("value"), "date").limit(5)


@query(sql("p", """WITH m AS (SELECT asset, CAST(date_trunc('month', date) AS DATE) AS date, arg_max(value, date) AS v FROM p GROUP BY 1, 2),
c AS (SELECT asset, date, v / lag(v, 3) OVER (PARTITION BY asset ORDER BY date) - 1 AS mom FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, asset) AS rank FROM c WHERE mom IS NOT NULL) SELECT date, asset, rank FROM n WHERE rank <= 3"""))
def top03_monthly_leaders(spark, sf_dir):
    m = g.period_last(a.daily_prices(spark, sf_dir), "value", "month", ["asset"])
    m = m.withColumn("mom", Series(("asset",), "period").change("value", 3)).filter("mom is not null")
    top = k.top_per_group(m, ["period"], [F.desc("mom"), "asset"], 3)
    return top.select(F.col("period").alias("date"), "asset", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 25) DESC, p_partkey) AS rn FROM part) AS x WHERE rn <= 2", dates="")
def top04_largest_absolute(spark, sf_dir):
    p = a.table(spark, sf_dir, "part")
    return k.top_per_group(p, ["p_brand"], [F.abs(F.col("p_size") - 25).desc(), "p_partkey"], 2).select("p_brand", "p_partkey")


@query(sql("t", "SELECT date, value FROM t ORDER BY date DESC LIMIT 30"))
def top05_recent_rows(spark, sf_dir):
    return a.daily_total(spark, sf_dir).select("date", "value").orderBy(F.desc("date")).limit(30)


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) AS x WHERE rn = 1 GROUP BY 1, 2", dates="")
def top06_keep_last(spark, sf_dir):
    return k.keep_last(a.table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT prefix, doc_id FROM (SELECT substr(text, 1, 12) AS prefix, min(doc_id) AS doc_id FROM documents GROUP BY 1) AS x ORDER BY doc_id LIMIT 8""", dates="")
def top07_first_of_prefix(spark, sf_dir):
    d = a.table(spark, sf_dir, "documents")
    return d.groupBy(F.substring("text", 1, 12).alias("prefix")).agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id").limit(8)


@query("""SELECT 'added' AS side, c_nationkey AS nation FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AS x
UNION ALL SELECT 'dropped', s_nationkey FROM (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AS y""", dates="")
def set01_differences(spark, sf_dir):
    c = a.table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    s = a.table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return k.differences(s, c).select("side", "nation")


@query("SELECT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '5-LOW'")
def set02_common_dates(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    days = lambda n: p.filter(F.col("asset") == n).select("date")
    return days("1-URGENT").intersect(days("5-LOW"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier", dates="")
def set03_concat(spark, sf_dir):
    c = a.table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = a.table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s)


# ---- filters ----------------------------------------------------------------


@query(sql("t", "SELECT date, value FROM t WHERE isodow(date) < 6"))
def flt04_weekdays(spark, sf_dir):
    return a.daily_total(spark, sf_dir).filter(F.weekday("date") < 5).select("date", "value")


@query(sql("t", "SELECT date, value FROM t WHERE date > (SELECT max(date) FROM t) - 365"))
def flt06_trailing_year(spark, sf_dir):
    return k.trailing(a.daily_total(spark, sf_dir), "date", 365).select("date", "value")


@query(sql("t", "SELECT date, value FROM t WHERE (month(date) = 12 AND day(date) >= 24) OR (month(date) = 1 AND day(date) <= 2) OR (month(date) = 4 AND day(date) BETWEEN 10 AND 15)"))
def flt07_calendar_windows(spark, sf_dir):
    m, d = F.month("date"), F.dayofmonth("date")
    hit = ((m == 12) & (d >= 24)) | ((m == 1) & (d <= 2)) | ((m == 4) & d.between(10, 15))
    return a.daily_total(spark, sf_dir).filter(hit).select("date", "value")


@query(sql("p", f"{RET} SELECT asset, date, round(r, 6) AS r FROM r WHERE value > 0 AND abs(r) < 0.15"))
def flt08_outlier_cap(spark, sf_dir):
    return _returns(spark, sf_dir).filter("value > 0 and abs(r) < 0.15").select("asset", "date", *_r(r=F.col("r")))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\b(the|and)\b') AND NOT regexp_matches(text, '\bwith\b')", dates="")
def flt10_word_scan(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").filter(r"text rlike '\\b(the|and)\\b' and not text rlike '\\bwith\\b'").select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(' ' || lower(text) || ' ', ' of the ')", dates="")
def flt11_word_sequence(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").filter(k.has_words(F.lower("text"), "of the")).select("doc_id")


@query("SELECT doc_id, max(word) AS word FROM documents JOIN (VALUES ('of the'), ('in that'), ('la de')) AS w(word) ON contains(' ' || lower(text) || ' ', ' ' || word || ' ') GROUP BY 1 HAVING count(*) = 1", dates="")
def flt12_unambiguous(spark, sf_dir):
    hits = [F.when(k.has_words(F.lower("text"), w), F.lit(w)) for w in ("of the", "in that", "la de")]
    d = a.table(spark, sf_dir, "documents").withColumn("hits", F.array_compact(F.array(*hits)))
    return d.filter(F.size("hits") == 1).select("doc_id", F.col("hits")[0].alias("word"))


@query(r"SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3]') AND p_brand NOT IN ('Brand#11', 'Brand#33')", dates="")
def flt13_valid_symbol(spark, sf_dir):
    return a.table(spark, sf_dir, "part").filter("p_brand rlike '^Brand#[1-3]' and p_brand not in ('Brand#11', 'Brand#33')").select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE lower(trim(l_returnflag)) IN ('a', 'true', 'yes')", dates="")
def flt14_truthy(spark, sf_dir):
    return a.table(spark, sf_dir, "lineitem").filter("lower(trim(l_returnflag)) in ('a', 'true', 'yes')").select("l_orderkey", "l_linenumber")
