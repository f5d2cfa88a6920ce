"""Registered stateful, ledger and scalar queries, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as c
from ..functions import scores as f
from ..operators import episodes as e
from ..operators import ledger as l
from ..operators.windows import Series
from ..sources import adapters as a
from .registry import query
from .window_queries import O, _r

S = Series(("asset",), "date")
ONE = Series((), "date")
sql = a.with_views
ALL = "ROWS UNBOUNDED PRECEDING"
DD = f"d AS (SELECT asset, date, value / max(value) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - 1 AS dd, row_number() {O} AS i FROM p)"


def _drawdowns(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    high = F.max("value").over(S.last(60))
    return p.select("asset", "date", (F.col("value") / high - 1).alias("dd"), S.position().alias("i"))


@query(sql("p", f"""WITH {DD}, x AS (SELECT *, sum(CASE WHEN dd >= -0.03 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY date {ALL}) AS epoch FROM d),
h AS (SELECT * FROM x WHERE dd <= -0.5) SELECT asset, date, CAST(dense_rank() OVER (PARTITION BY asset ORDER BY epoch) AS BIGINT) AS episode,
date = min(date) OVER (PARTITION BY asset, epoch) AS opens FROM h"""))
def sta01_hysteresis_episodes(spark, sf_dir):
    d = _drawdowns(spark, sf_dir)
    found = e.armed_episodes(d, F.col("dd") <= -0.5, F.col("dd") >= -0.03)
    return found.select("asset", "date", F.col("episode").cast("long").alias("episode"), "opens")


@query(sql("p", f"""WITH r AS (SELECT asset, date, value / lag(value) {O} - 1 AS r FROM p), x AS (SELECT *, sum(CASE WHEN r <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY date {ALL}) AS epoch FROM r)
SELECT asset, min(date) AS date FROM x WHERE r >= 2 GROUP BY asset, epoch"""))
def sta02_spike_events(spark, sf_dir):
    r = a.daily_prices(spark, sf_dir).select("asset", "date", S.change("value").alias("r"))
    return e.armed_episodes(r, F.col("r") >= 2, F.col("r") <= 0).filter("opens").select("asset", "date")


@query(sql("p", f"""WITH m AS (SELECT asset, date, value > avg(value) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS above FROM p),
t AS (SELECT *, CASE WHEN above IS DISTINCT FROM lag(above) {O} OR row_number() {O} = 1 THEN 1 ELSE 0 END AS turn FROM m), n AS (SELECT *, sum(turn) OVER (PARTITION BY asset ORDER BY date {ALL}) AS run FROM t)
SELECT asset, CAST(run AS BIGINT) AS run, any_value(above) AS above, min(date) AS date, count(*) AS n FROM n GROUP BY asset, run"""))
def sta06_runs(spark, sf_dir):
    m = a.daily_prices(spark, sf_dir).withColumn("above", F.col("value") > F.avg("value").over(S.last(20)))
    runs = e.run_ids(m, F.col("above")).groupBy("asset", "run")
    return runs.agg(F.any_value("above").alias("above"), F.min("date").alias("date"), F.count("*").alias("n")).select("asset", F.col("run").cast("long").alias("run"), "above", "date", "n")


@query(sql("p", f"""WITH {DD}, h AS (SELECT * FROM d WHERE dd <= -0.7), s AS (SELECT *, coalesce(i - lag(i) {O} >= 10, true) AS start FROM h),
n AS (SELECT *, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY date {ALL}) AS cluster FROM s)
SELECT asset, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(date) AS date, round(min(dd), 6) AS worst FROM n GROUP BY 1, 2"""))
def sta07_clusters(spark, sf_dir):
    h = e.clusters(_drawdowns(spark, sf_dir).filter("dd <= -0.7"), "i", 10).groupBy("asset", F.col("cluster").cast("long").alias("cluster"))
    return h.agg(F.count("*").alias("n"), F.min("date").alias("date"), F.round(F.min("dd"), 6).alias("worst"))


@query(sql("p", f"""WITH {DD}, h AS (SELECT asset, i FROM d WHERE dd <= -0.7), s AS (SELECT asset, coalesce(i - lag(i) OVER (PARTITION BY asset ORDER BY i) > 21, true) AS start FROM h)
SELECT asset, count(*) FILTER (start) AS episodes FROM s GROUP BY asset"""), dates="")
def sta08_episode_count(spark, sf_dir):
    h = e.clusters(_drawdowns(spark, sf_dir).filter("dd <= -0.7"), "i", 22)
    return h.groupBy("asset").agg(F.count_distinct("cluster").alias("episodes"))


@query(sql("p", f"""WITH r AS (SELECT asset, value / lag(value) {O} - 1 AS r, row_number() {O} AS i FROM p), q AS (SELECT asset, quantile_cont(r, 0.05) AS q FROM r GROUP BY asset),
h AS (SELECT r.asset, i FROM r JOIN q ON r.asset = q.asset WHERE r.r <= q.q), s AS (SELECT asset, coalesce(i - lag(i) OVER (PARTITION BY asset ORDER BY i) > 5, true) AS start FROM h)
SELECT asset, count(*) AS n, round(CAST(count(*) FILTER (start) AS DOUBLE) / count(*), 6) AS extremal_index FROM s GROUP BY asset"""), dates="")
def sta09_extremal_index(spark, sf_dir):
    r = a.daily_prices(spark, sf_dir).select("asset", S.change("value").alias("r"), S.position().alias("i"))
    q = r.groupBy("asset").agg(F.percentile("r", F.lit(0.05)).alias("q"))
    h = e.clusters(r.join(q, "asset").filter("r <= q"), "i", 6)
    index = F.count_distinct("cluster") / F.count("*")
    return h.groupBy("asset").agg(F.count("*").alias("n"), F.round(index, 6).alias("extremal_index"))


@query(sql("p ev", """WITH s AS (SELECT asset, date, value, row_number() OVER (PARTITION BY asset ORDER BY date) AS i FROM p),
k AS (SELECT DISTINCT ev.date AS pick, x.asset, x.date AS entry, x.value AS entry_px, x.i FROM ev CROSS JOIN (SELECT DISTINCT asset FROM p) AS q
  ASOF JOIN s AS x ON q.asset = x.asset AND ev.date < x.date)
SELECT k.asset, k.pick AS date, CAST(k.entry AS VARCHAR) AS entry, round(x.value / k.entry_px - 1, 6) AS ret, CASE WHEN x.value IS NULL THEN 'pending' ELSE 'settled' END AS status
FROM k LEFT JOIN s AS x ON k.asset = x.asset AND x.i = k.i + 20"""))
def sta10_settlement(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    picks = a.large_order_days(spark, sf_dir).crossJoin(p.select("asset").distinct())
    done = l.settle(picks, p, "asset", "date", "value", hold=20)
    return done.select("asset", "date", F.col("entry_date").cast("string").alias("entry"), F.round("ret", 6).alias("ret"), "status")


@query("""WITH f AS (SELECT user_id, min(ts) AS first_ts, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) SELECT user_id, event_type, CAST(first_ts AS VARCHAR) AS first_ts FROM f""", dates="")
def sta15_first_seen(spark, sf_dir):
    ev = a.table(spark, sf_dir, "events")
    first = ev.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return first.select("user_id", "event_type", F.col("first_ts").cast("string").alias("first_ts"))


@query("""WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT user_id, event_id, was, event_type AS now FROM x WHERE was IS NOT NULL AND was <> event_type""", dates="")
def sta17_transitions(spark, sf_dir):
    return l.transitions(a.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "was", F.col("event_type").alias("now"))


@query("""WITH g AS (SELECT o_orderpriority AS source, max(CAST(o_orderdate AS DATE)) AS latest, count(*) AS n FROM orders GROUP BY 1)
SELECT source, n, date_diff('day', latest, DATE '2001-08-10') AS age, CASE WHEN date_diff('day', latest, DATE '2001-08-10') > 9 THEN 'stale' ELSE 'fresh' END AS state FROM g""", dates="")
def sta18_staleness(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").alias("day"))
    return l.source_health(o, "source", "day", as_of="2001-08-10", stale_after=9).select("source", "n", F.col("age").cast("long").alias("age"), "state")


# ---- scalar functions -------------------------------------------------------


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date, (day(date) + isodow(date_trunc('month', date)) - 2) // 7 + 1 AS week_of_month, week(date) AS iso_week, CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS monday,
isodow(date) = 5 AND day(date) BETWEEN 15 AND 21 AS third_friday FROM d""")
def sca01_calendar_fields(spark, sf_dir):
    d = a.daily_total(spark, sf_dir).select("date")
    return d.select("date", c.week_of_month("date").alias("week_of_month"), F.weekofyear("date").cast("long").alias("iso_week"), F.trunc("date", "week").cast("string").alias("monday"), c.third_friday("date").alias("third_friday"))


@query("""WITH y AS (SELECT unnest(range(1990, 2031)) AS y), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a), l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h),
m AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS k FROM l)
SELECT y AS year, CAST(make_date(y, k // 31, k % 31 + 1) AS VARCHAR) AS easter, CAST(make_date(y, k // 31, k % 31 + 1) - 2 AS VARCHAR) AS good_friday,
CAST(make_date(y, 11, 1) + CAST((11 - isodow(make_date(y, 11, 1))) % 7 AS INT) + 21 AS VARCHAR) AS thanksgiving, CAST(make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INT) AS VARCHAR) AS memorial_day FROM m""", dates="")
def sca02_holidays(spark, sf_dir):
    y = spark.range(1990, 2031).withColumnRenamed("id", "year")
    day = lambda d: d.cast("string")
    easter = c.easter(F.col("year"))
    thanks, memorial = c.nth_weekday(F.col("year"), 11, 3, 4), c.last_weekday(F.col("year"), 5, 0)
    return y.select("year", day(easter).alias("easter"), day(F.date_sub(easter, 2)).alias("good_friday"), day(thanks).alias("thanksgiving"), day(memorial).alias("memorial_day"))


@query("""SELECT p_partkey, round(1 + (p_retail - 1) * p_size / (p_size + 50.0), 6) AS shrunk FROM (SELECT p_partkey, p_size, (p_partkey % 37) / 10.0::DOUBLE AS p_retail FROM part) AS x""", dates="")
def sca03_shrink(spark, sf_dir):
    p = a.table(spark, sf_dir, "part").withColumn("lr", (F.col("p_partkey") % 37) / 10.0)
    return p.select("p_partkey", F.round(f.shrink("lr", "p_size", 50), 6).alias("shrunk"))


@query("""WITH x AS (SELECT p_partkey, [(p_partkey % 37) / 10.0, (p_size % 11) / 5.0, 1.1] AS lrs FROM part),
o AS (SELECT p_partkey, ln(0.53 / 0.47) + ln(greatest(lrs[1], 0.01)) + ln(greatest(lrs[2], 0.01)) + ln(greatest(lrs[3], 0.01)) AS o FROM x)
SELECT p_partkey, round(least(greatest(1 / (1 + exp(-o)), 0.02), 0.98), 6) AS p, CASE WHEN least(greatest(1 / (1 + exp(-o)), 0.02), 0.98) >= 0.6 THEN 'high' WHEN least(greatest(1 / (1 + exp(-o)), 0.02), 0.98) >= 0.45 THEN 'mid' ELSE 'low' END AS tier FROM o""", dates="")
def sca05_log_odds(spark, sf_dir):
    lrs = F.array((F.col("p_partkey") % 37) / 10.0, (F.col("p_size") % 11) / 5.0, F.lit(1.1))
    p = a.table(spark, sf_dir, "part").withColumn("p", f.posterior(0.53, lrs))
    return p.select("p_partkey", F.round("p", 6).alias("p"), f.tier("p", {"high": 0.6, "mid": 0.45}, "low").alias("tier"))


@query("SELECT c_custkey, round(least(greatest((c_acctbal + 1000) / 11000 * 100, 0), 100), 6) AS scaled, round(100 - least(greatest((c_acctbal + 1000) / 11000 * 100, 0), 100), 6) AS reversed FROM customer", dates="")
def sca09_linear_scale(spark, sf_dir):
    cust = a.table(spark, sf_dir, "customer")
    return cust.select("c_custkey", *_r(scaled=f.scale("c_acctbal", -1000, 10000), reversed=f.scale("c_acctbal", -1000, 10000, reverse=True)))


@query("""SELECT c_custkey, CASE WHEN s <= 25 THEN 'extreme fear' WHEN s <= 45 THEN 'fear' WHEN s <= 55 THEN 'neutral' WHEN s < 75 THEN 'greed' ELSE 'extreme greed' END AS band
FROM (SELECT c_custkey, least(greatest((c_acctbal + 1000) / 11000 * 100, 0), 100) AS s FROM customer) AS x""", dates="")
def sca11_bands(spark, sf_dir):
    return a.table(spark, sf_dir, "customer").select("c_custkey", f.band(f.scale("c_acctbal", -1000, 10000)).alias("band"))


@query("SELECT p_partkey, substr(p_brand, 1, 3) || '_' || substr(sha1(p_brand || '|' || p_partkey), 1, 10) AS stable_id FROM part", dates="")
def sca16_stable_id(spark, sf_dir):
    return a.table(spark, sf_dir, "part").select("p_partkey", f.stable_id("p_brand", "p_partkey").alias("stable_id"))


@query("SELECT s_suppkey, trim(regexp_replace(regexp_replace(upper(s_name), '[^A-Z0-9 ]', ' ', 'g'), '( (INC|CORP|LTD|CO|PLC))+\\s*$', '')) AS name FROM (SELECT s_suppkey, s_name || ', Inc. Ltd' AS s_name FROM supplier) AS x", dates="")
def sca18_company_name(spark, sf_dir):
    s = a.table(spark, sf_dir, "supplier").withColumn("n", F.concat("s_name", F.lit(", Inc. Ltd")))
    return s.select("s_suppkey", f.company_name("n").alias("name"))


@query("""SELECT doc_id, CASE WHEN u > d THEN 'positive' WHEN d > u THEN 'negative' ELSE 'neutral' END AS polarity FROM (
SELECT doc_id, len(regexp_extract_all(text, '(^| )(the|la|der) ')) AS u, len(regexp_extract_all(text, '(^| )(and|de|und) ')) AS d FROM documents) AS x""", dates="")
def sca21_polarity(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", f.polarity("text", "(^| )(the|la|der) ", "(^| )(and|de|und) ").alias("polarity"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", dates="")
def sca32_json_path(spark, sf_dir):
    return a.table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(None).cast("long")).alias("k"))


@query(sql("p", f"""WITH r AS (SELECT asset, value / lag(value) {O} - 1 AS r FROM p), v AS (SELECT asset, greatest(stddev_samp(r), 0.01) AS v FROM r GROUP BY 1)
SELECT asset, round(pow(1 / v, 0.5) / sum(pow(1 / v, 0.5)) OVER (), 6) AS weight FROM v"""), dates="")
def sca27_inverse_volatility(spark, sf_dir):
    v = a.daily_prices(spark, sf_dir).select("asset", S.change("value").alias("r")).groupBy("asset").agg(F.stddev_samp("r").alias("v"))
    return v.select("asset", *_r(weight=f.inverse_weights("v", 0.5, 0.01)))
