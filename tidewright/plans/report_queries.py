"""Registered queries that exports and reports are made of: rebased series, latest rates, views, states and weeks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.windows import Series
from ..sources import adapters as a
from .registry import query
from .window_queries import RET, O, _returns, last

S = Series(("asset",), "date")
K = Series(("ticker",), "date")
ONE = Series((), "date")
sql = a.with_views

# ---- exports -----------------------------------------------------------------

SINCE = "1996-01-01"


@query(sql("p", f"""WITH w AS (SELECT asset, date_trunc('week', date) + INTERVAL 6 DAY AS week, arg_max(value, date) AS value FROM p WHERE date >= DATE '{SINCE}' GROUP BY 1, 2),
g AS (SELECT a.asset, b.week FROM (SELECT DISTINCT asset FROM w) AS a CROSS JOIN (SELECT DISTINCT week FROM w) AS b), j AS (SELECT g.asset, g.week, w.value FROM g LEFT JOIN w ON w.asset = g.asset AND w.week = g.week),
f AS (SELECT asset, week, last_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY week) AS value FROM j)
SELECT asset, CAST(CAST(week AS DATE) AS VARCHAR) AS week, round(value / first_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 100, 2) AS value FROM f"""), dates="")
def q55_base_100(spark, sf_dir):
    """Each asset's last value of every week, carried over weeks without one, with the first at 100."""
    week = F.date_add(F.date_trunc("week", "date").cast("date"), 6)
    w = a.daily_prices(spark, sf_dir).filter(F.col("date") >= F.lit(SINCE).cast("date")).groupBy("asset", week.alias("week")).agg(F.max_by("value", "date").alias("value"))
    every = w.select("asset").distinct().crossJoin(w.select("week").distinct())  # every asset in every week is wanted
    line = Series(("asset",), "week")
    f = every.join(w, ["asset", "week"], "left").withColumn("value", line.filled("value"))
    start = F.first("value", ignorenulls=True).over(line.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return f.select("asset", F.col("week").cast("string").alias("week"), F.round(F.col("value") / start * 100, 2).alias("value"))


@query(sql("p", f"""WITH n AS (SELECT asset, arg_max(value, date) AS value, max(date) AS date FROM p WHERE value > 100000 AND date >= DATE '1999-06-01' GROUP BY 1), o AS (SELECT asset, arg_max(value, date) AS value, max(date) AS date FROM p WHERE value > 100000 AND date < DATE '1999-06-01' GROUP BY 1)
SELECT o.asset, round(coalesce(n.value, o.value), 6) AS value, CAST(coalesce(n.date, o.date) AS VARCHAR) AS date, n.asset IS NULL AS carried FROM o LEFT JOIN n ON n.asset = o.asset"""), dates="")
def q55_latest_rates(spark, sf_dir):
    """The latest usable value of each asset; one that has none anew keeps that of the export before."""
    usable = a.daily_prices(spark, sf_dir).filter("value > 100000")
    cut = F.lit("1999-06-01").cast("date")

    def latest(rows, prefix):
        return rows.groupBy("asset").agg(F.max_by("value", "date").alias(f"{prefix}_value"), F.max("date").alias(f"{prefix}_date"))

    both = latest(usable.filter(F.col("date") < cut), "old").join(latest(usable.filter(F.col("date") >= cut), "new"), "asset", "left")
    return both.select("asset", F.round(F.coalesce("new_value", "old_value"), 6).alias("value"), F.coalesce("new_date", "old_date").cast("string").alias("date"), F.col("new_date").isNull().alias("carried"))


@query(sql("p t", f"""{RET}, m AS (SELECT date, value / lag(value) OVER (ORDER BY date) - 1 AS m FROM t), j AS (SELECT r.asset, r.date, r, m FROM r JOIN m ON m.date = r.date),
c AS (SELECT asset, date, CASE WHEN count(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) {last(60)} >= 60 THEN corr(r, m) {last(60)} END AS c FROM j), l AS (SELECT asset, date_trunc('week', date) AS week, arg_max(c, date) AS c FROM c WHERE c IS NOT NULL GROUP BY 1, 2)
SELECT asset, CAST(CAST(week AS DATE) AS VARCHAR) AS week, round(c, 4) AS correlation FROM l"""), dates="")
def q55_weekly_correlation(spark, sf_dir):
    """The last rolling correlation of each week with the market's changes."""
    market = a.daily_total(spark, sf_dir).select("date", ONE.change("value").alias("m"))
    c = _returns(spark, sf_dir).join(market, "date").withColumn("c", S.correlation("r", "m", 60)).filter("c is not null")
    found = c.groupBy("asset", F.date_trunc("week", "date").cast("date").alias("week")).agg(F.max_by("c", "date").alias("c"))
    return found.select("asset", F.col("week").cast("string").alias("week"), F.round("c", 4).alias("correlation"))


# ---- views and states --------------------------------------------------------

MOMENTUM_ROWS = 126


@query(sql("k", f"""WITH l AS (SELECT ticker, date, close / lag(close, {MOMENTUM_ROWS}) OVER (PARTITION BY ticker ORDER BY date) - 1 AS m, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM k),
x AS (SELECT ticker, m, row_number() OVER (ORDER BY m DESC, ticker) AS high, row_number() OVER (ORDER BY m, ticker) AS low, count(*) OVER () AS n FROM l WHERE back = 1 AND m IS NOT NULL),
y AS (SELECT *, CASE WHEN n < 6 THEN greatest(1, n // 2) ELSE 3 END AS take FROM x)
SELECT ticker, CASE WHEN high <= take THEN 'leading' ELSE 'trailing' END AS view, round(m * 100, 1) AS momentum FROM y WHERE high <= take OR low <= take"""), dates="")
def q54_outlook(spark, sf_dir):
    """Leaders and laggards of half a year's momentum: three each, or half of the tickers where there are few."""
    k = a.ticker_panel(spark, sf_dir).withColumn("m", F.try_divide("close", F.lag("close", MOMENTUM_ROWS).over(K.ordered)) - 1)
    latest = k.groupBy("ticker").agg(F.max_by("m", "date").alias("m")).filter("m is not null")
    count = latest.agg(F.count("*").alias("n"))
    high, low = Window.orderBy(F.desc("m"), "ticker"), Window.orderBy("m", "ticker")  # a row for each ticker
    x = latest.join(count).withColumns({"high": F.row_number().over(high), "low": F.row_number().over(low)})  # one row
    take = F.when(F.col("n") < 6, F.greatest(F.lit(1), F.expr("n div 2"))).otherwise(3)
    x = x.filter((F.col("high") <= take) | (F.col("low") <= take))
    return x.select("ticker", F.when(F.col("high") <= take, "leading").otherwise("trailing").alias("view"), F.round(F.col("m") * 100, 1).alias("momentum"))


STATE = f"""{RET}, v AS (SELECT asset, date, value, r, CASE WHEN count(r) {last(20)} >= 20 THEN stddev_samp(r) {last(20)} END AS v, value / max(value) {last(252)} - 1 AS dd, CASE WHEN count(value) {last(200)} >= 200 THEN avg(value) {last(200)} END AS m FROM r),
l AS (SELECT asset, max(date) AS date, arg_max(v, date) AS v, arg_max(dd, date) AS dd, arg_max(value, date) AS value, arg_max(m, date) AS m FROM v GROUP BY 1)"""


@query(sql("p", f"""{STATE} SELECT l.asset, CAST(l.date AS VARCHAR) AS date, round(any_value(l.v) * sqrt(252.0) * 100, 4) AS volatility, round(100.0 * count(*) FILTER (v.v < l.v) / count(*), 4) AS below, round(any_value(l.dd) * 100, 4) AS from_high,
CASE WHEN any_value(l.value) > any_value(l.m) THEN 'green' ELSE 'red' END AS trend, CASE WHEN any_value(l.dd) < -0.3 THEN 'red' WHEN any_value(l.dd) < -0.2 THEN 'yellow' ELSE 'green' END AS depth FROM v JOIN l ON l.asset = v.asset GROUP BY l.asset, l.date"""), dates="")
def q54_state(spark, sf_dir):
    """Where each asset stands: volatility and its place among all days, distance from the year's high, and lights for trend and depth."""
    v = _returns(spark, sf_dir).withColumns({"v": S.deviation("r", 20), "dd": F.col("value") / F.max("value").over(S.last(252)) - 1, "m": S.mean("value", 200)})
    now = v.groupBy("asset").agg(F.max("date").alias("at"), *[F.max_by(c, "date").alias(f"now_{c}") for c in ("v", "dd", "value", "m")])
    below = F.sum((F.coalesce(F.col("v") < F.col("now_v"), F.lit(False))).cast("long")) * 100.0 / F.count("*")
    x = v.join(now, "asset").groupBy("asset", "at", "now_v", "now_dd", "now_value", "now_m").agg(below.alias("below"))
    depth = F.when(F.col("now_dd") < -0.3, "red").when(F.col("now_dd") < -0.2, "yellow").otherwise("green")
    trend = F.when(F.col("now_value") > F.col("now_m"), "green").otherwise("red")
    return x.select("asset", F.col("at").cast("string").alias("date"), F.round(F.col("now_v") * F.sqrt(F.lit(252.0)) * 100, 4).alias("volatility"), F.round("below", 4).alias("below"), F.round(F.col("now_dd") * 100, 4).alias("from_high"), trend.alias("trend"), depth.alias("depth"))


LABEL = "CASE WHEN {0} >= 75 THEN 'high' WHEN {0} <= 25 THEN 'low' ELSE 'usual' END"


@query(sql("p", f"""{RET}, v AS (SELECT asset, date, CASE WHEN count(r) {last(20)} >= 20 THEN stddev_samp(r) {last(20)} END AS v FROM r), i AS (SELECT asset, date, round(100 * percent_rank() OVER (PARTITION BY asset ORDER BY v), 6) AS place, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS back FROM v WHERE v IS NOT NULL),
x AS (SELECT asset, max(CASE WHEN back = 1 THEN place END) AS now, max(CASE WHEN back = 21 THEN place END) AS was FROM i GROUP BY 1), l AS (SELECT asset, now, {LABEL.format('now')} AS label, {LABEL.format('was')} AS before FROM x WHERE was IS NOT NULL)
SELECT asset, now AS place, label, before, CASE WHEN label <> before THEN 'changed' WHEN label <> 'usual' THEN 'notable' ELSE 'quiet' END AS watch FROM l"""), dates="")
def q54_watch(spark, sf_dir):
    """States of volatility now and a month of rows ago: what changed, and what is notable without a change."""
    v = _returns(spark, sf_dir).withColumn("v", S.deviation("r", 20)).filter("v is not null")
    place = F.round(100 * F.percent_rank().over(Window.partitionBy("asset").orderBy("v")), 6)
    i = v.withColumns({"place": place, "back": F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))})
    x = i.groupBy("asset").agg(F.max(F.when(F.col("back") == 1, F.col("place"))).alias("now"), F.max(F.when(F.col("back") == 21, F.col("place"))).alias("was")).filter("was is not null")
    label = lambda c: F.when(F.col(c) >= 75, "high").when(F.col(c) <= 25, "low").otherwise("usual")
    watch = F.when(F.col("label") != F.col("before"), "changed").when(F.col("label") != "usual", "notable").otherwise("quiet")
    return x.select("asset", F.col("now").alias("place"), label("now").alias("label"), label("was").alias("before")).withColumn("watch", watch)


@query(sql("p", f"""{RET}, m AS (SELECT asset, month(date) AS month, date < DATE '1998-01-01' AS early, avg(r) AS mean, stddev_samp(r) / sqrt(count(r)) AS se FROM r WHERE r IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT e.asset, CASE WHEN abs(e.mean / e.se) >= 2 AND abs(l.mean / l.se) >= 2 AND sign(e.mean) = sign(l.mean) THEN 'survives' WHEN abs(e.mean / e.se) >= 2 THEN 'faded' ELSE 'noise' END AS verdict FROM m AS e JOIN m AS l ON l.asset = e.asset AND l.month = e.month AND e.early AND NOT l.early)
SELECT asset AS family, count(*) AS tested, count(*) FILTER (verdict = 'survives') AS survives, count(*) FILTER (verdict = 'faded') AS faded, count(*) FILTER (verdict = 'noise') AS noise FROM v GROUP BY 1"""), dates="")
def q54_evidence(spark, sf_dir):
    """How many of each family's tests hold early and late, only early, or never."""
    r = _returns(spark, sf_dir).filter("r is not null").groupBy("asset", F.month("date").alias("month"), (F.col("date") < F.lit("1998-01-01").cast("date")).alias("early"))
    m = r.agg(F.avg("r").alias("mean"), (F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("se")).withColumn("t", F.try_divide("mean", "se"))
    e, late = m.filter("early").select("asset", "month", "t", "mean"), m.filter("not early").select("asset", "month", F.col("t").alias("t2"), F.col("mean").alias("mean2"))
    holds = (F.abs("t") >= 2) & (F.abs("t2") >= 2) & (F.signum("mean") == F.signum("mean2"))
    v = e.join(late, ["asset", "month"]).withColumn("verdict", F.when(holds, "survives").when(F.abs("t") >= 2, "faded").otherwise("noise"))
    counts = [F.sum((F.col("verdict") == x).cast("long")).alias(x) for x in ("survives", "faded", "noise")]
    return v.groupBy(F.col("asset").alias("family")).agg(F.count("*").alias("tested"), *counts)


# ---- weeks -------------------------------------------------------------------

#: Bounds of the degree words of a score: fixed values.
DEGREES = [(0.4, "strongly positive"), (0.13, "mildly positive"), (-0.13, "neutral"), (-0.4, "mildly defensive")]
LEAST_DAYS = 3


@query(sql("t", """WITH z AS (SELECT date, CASE WHEN count(value) OVER w >= 20 THEN round(least(1, greatest(-1, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) / 2)), 9) END AS score FROM t WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
d AS (SELECT date, score, CASE WHEN score >= 0.4 THEN 'strongly positive' WHEN score >= 0.13 THEN 'mildly positive' WHEN score > -0.13 THEN 'neutral' WHEN score > -0.4 THEN 'mildly defensive' ELSE 'strongly defensive' END AS degree FROM z WHERE score IS NOT NULL)
SELECT isoyear(date) || '-W' || lpad(CAST(week(date) AS VARCHAR), 2, '0') AS week, CAST(min(date_trunc('week', date)) AS DATE)::VARCHAR || ' to ' || CAST(min(date_trunc('week', date)) + INTERVAL 6 DAY AS DATE)::VARCHAR AS span, count(*) AS days, string_agg(degree, '; ' ORDER BY date) AS degrees, round(avg(score), 6) AS mean, count(*) < 3 AS too_few FROM d GROUP BY 1"""), dates="")
def q59_week_stances(spark, sf_dir):
    """The days' degree words of every ISO week in order, and whether there are too few days to read."""
    w = ONE.last(20)
    raw = F.try_divide(F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)), F.lit(2))
    d = a.daily_total(spark, sf_dir).withColumn("score", F.when(F.count("value").over(w) >= 20, F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), raw)), 9)))
    at = F.col("score")
    degree = F.when(at >= 0.4, DEGREES[0][1]).when(at >= 0.13, DEGREES[1][1]).when(at > -0.13, DEGREES[2][1]).when(at > -0.4, DEGREES[3][1]).otherwise("strongly defensive")
    d = d.filter("score is not null").withColumns({"degree": degree, "monday": F.date_trunc("week", "date").cast("date")})
    number = F.concat(F.expr("cast(extract(YEAROFWEEK FROM date) as string)"), F.lit("-W"), F.lpad(F.weekofyear("date").cast("string"), 2, "0"))
    span = F.concat(F.min("monday").cast("string"), F.lit(" to "), F.date_add(F.min("monday"), 6).cast("string"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "degree"))), lambda x: x["degree"]), "; ")  # seven days at most
    return d.groupBy(number.alias("week")).agg(span.alias("span"), F.count("*").alias("days"), said.alias("degrees"), F.round(F.avg("score"), 6).alias("mean"), (F.count("*") < LEAST_DAYS).alias("too_few"))


@query("""WITH w AS (SELECT p_type AS sector, p_brand AS ticker, date_trunc('week', l_shipdate) AS week, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
s AS (SELECT split_part(sector, ' ', 1) AS sector, week, CAST(sum(cents) AS DOUBLE) / (sum(q) * 100.0::DOUBLE) AS close FROM w GROUP BY 1, 2), c AS (SELECT sector, week, round(close / lag(close) OVER (PARTITION BY sector ORDER BY week) - 1, 9) AS change FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY change DESC, sector) AS high, row_number() OVER (PARTITION BY week ORDER BY change, sector) AS low FROM c WHERE change IS NOT NULL)
SELECT CAST(CAST(week AS DATE) AS VARCHAR) AS week, string_agg(sector || ' ' || printf('%.1f', change * 100 + 0.0) || '%', ', ' ORDER BY high) FILTER (high <= 3) AS leading, string_agg(sector || ' ' || printf('%.1f', change * 100 + 0.0) || '%', ', ' ORDER BY low) FILTER (low <= 3) AS trailing FROM k GROUP BY week""", dates="")
def q59_sector_movers(spark, sf_dir):
    """Sectors that moved most in every week, without naming tickers."""
    items = a.table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = a.table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ")[0].alias("sector"))
    s = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("sector", F.date_trunc("week", "l_shipdate").cast("date").alias("week"))
    s = s.agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / (F.sum(F.col("l_quantity").cast("long")) * 100.0)).alias("close"))
    c = s.withColumn("change", F.round(Series(("sector",), "week").change("close"), 9)).filter("change is not null")
    rank = {"high": F.row_number().over(Window.partitionBy("week").orderBy(F.desc("change"), "sector")), "low": F.row_number().over(Window.partitionBy("week").orderBy("change", "sector"))}
    text = F.concat("sector", F.lit(" "), F.format_string("%.1f", F.col("change") * 100), F.lit("%"))

    def said(place):
        held = F.collect_list(F.when(F.col(place) <= 3, F.struct(place, text.alias("text"))))  # three at most
        return F.array_join(F.transform(F.array_sort(held), lambda x: x["text"]), ", ")

    found = c.withColumns(rank).groupBy("week").agg(said("high").alias("leading"), said("low").alias("trailing"))
    return found.select(F.col("week").cast("string").alias("week"), "leading", "trailing")
