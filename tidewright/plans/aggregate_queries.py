"""Registered aggregation queries, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as g
from ..operators.windows import Series
from ..sources import adapters as a
from .registry import query
from .window_queries import RET, O, _r, _returns, ahead

S = Series(("asset",), "date")
sql = a.with_views
STATS = "round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS up_rate, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(stddev_samp(r), 6) AS deviation, count(*) AS n"
STAT_COLS = "up_rate mean median deviation".split()


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(sql("p", f"{RET} SELECT asset, month(date) AS month, {STATS} FROM r WHERE r IS NOT NULL GROUP BY 1, 2"), dates="")
def agg01_month_stats(spark, sf_dir):
    r = _returns(spark, sf_dir).withColumn("month", F.month("date").cast("long"))
    return _rounded(g.return_stats(r, "r", ["asset", "month"]), *STAT_COLS)


@query(sql("p", f"{RET} SELECT asset, isodow(date) - 1 AS weekday, {STATS}, round(avg(r) / stddev_samp(r) * sqrt(252.0), 6) AS sharpe FROM r WHERE r IS NOT NULL GROUP BY 1, 2"), dates="")
def agg02_weekday_stats(spark, sf_dir):
    r = _returns(spark, sf_dir).withColumn("weekday", F.weekday("date").cast("long"))
    s = g.return_stats(r, "r", ["asset", "weekday"])
    return _rounded(s.withColumn("sharpe", F.col("mean") / F.col("deviation") * F.sqrt(F.lit(252.0))), *STAT_COLS, "sharpe")


@query(sql("p", f"{RET} SELECT asset, day(date) AS day, {STATS} FROM r WHERE r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10"), dates="")
def agg03_day_of_month(spark, sf_dir):
    r = _returns(spark, sf_dir).withColumn("day", F.dayofmonth("date").cast("long"))
    return _rounded(g.return_stats(r, "r", ["asset", "day"], least=10), *STAT_COLS)


COHORTS = {"all": "1995-01-01", "1997": "1997-01-01", "1999": "1999-01-01"}
COHORT_SQL = "(VALUES " + ", ".join(f"('{k}', DATE '{v}')" for k, v in COHORTS.items()) + ") AS c(cohort, since)"


@query(sql("p", f"{RET} SELECT asset, cohort, month(date) AS month, {STATS} FROM r JOIN {COHORT_SQL} ON date >= since WHERE r IS NOT NULL GROUP BY 1, 2, 3"), dates="")
def agg04_month_by_cohort(spark, sf_dir):
    r = _returns(spark, sf_dir).withColumn("month", F.month("date").cast("long"))
    return _rounded(g.return_stats(g.by_cohort(r, "date", COHORTS), "r", ["asset", "cohort", "month"]), *STAT_COLS)


@query(sql("p", """SELECT asset, unit, CAST(start AS DATE) AS date, round(arg_max(value, date), 6) AS last FROM (
SELECT *, 'month' AS unit, date_trunc('month', date) AS start FROM p UNION ALL SELECT *, 'week', date_trunc('week', date) FROM p
UNION ALL SELECT *, 'year', date_trunc('year', date) FROM p) AS x GROUP BY asset, unit, start"""))
def agg05_period_last(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    parts = [g.period_last(p, "value", u, ["asset"]).withColumn("unit", F.lit(u)) for u in ("month", "week", "year")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("asset", "unit", F.col("period").alias("date"), *_r(last=F.col("value")))


@query(sql("p", f"{RET} SELECT asset, CAST(date_trunc('month', date) AS DATE) AS date, round(exp(sum(ln(1 + r / 100))) - 1, 6) AS compounded FROM r WHERE r IS NOT NULL GROUP BY 1, 2"))
def agg06_compounded(spark, sf_dir):
    r = _returns(spark, sf_dir).withColumn("r", F.col("r") / 100)
    c = r.groupBy("asset", F.trunc("date", "month").alias("month")).agg(g.compounded("r").alias("c")).filter("c is not null")
    return c.select("asset", F.col("month").alias("date"), *_r(compounded=F.col("c")))


@query(sql("p", """WITH y AS (SELECT asset, year(date) AS year, arg_max(value, date) AS value FROM p GROUP BY 1, 2)
SELECT asset, year, round(value / lag(value) OVER (PARTITION BY asset ORDER BY year) - 1, 6) AS annual FROM y
WHERE year < (SELECT max(year(date)) FROM p)"""), dates="")
def agg07_annual_return(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir).withColumn("year", F.year("date").cast("long"))
    y = p.groupBy("asset", "year").agg(F.max_by("value", "date").alias("value"))
    y = y.join(p.agg(F.max("year").alias("current")), F.col("year") < F.col("current"))
    return y.select("asset", "year", *_r(annual=Series(("asset",), "year").change("value")))


@query(sql("p", f"""{RET}, y AS (SELECT asset, year(date) AS year, exp(sum(ln(1 + r / 100))) - 1 AS annual FROM r WHERE r IS NOT NULL GROUP BY 1, 2)
SELECT year % 10 AS digit, count(*) AS n, round(avg(annual), 6) AS mean, round(max(annual), 6) AS best, round(min(annual), 6) AS worst FROM y GROUP BY 1"""), dates="")
def agg08_year_digit(spark, sf_dir):
    r = _returns(spark, sf_dir).withColumn("r", F.col("r") / 100)
    y = r.groupBy("asset", F.year("date").cast("long").alias("year")).agg(g.compounded("r").alias("annual"))
    by = y.groupBy((F.col("year") % 10).alias("digit"))
    return _rounded(by.agg(F.count("*").alias("n"), F.avg("annual").alias("mean"), F.max("annual").alias("best"), F.min("annual").alias("worst")), "mean", "best", "worst")


WINDOWS_SQL = """(VALUES ('first_five', 1, 1, 5), ('mid_month', 0, 10, 15), ('year_end', 12, 24, 31), ('year_start', 1, 1, 2)) AS w(name, m, d1, d2)"""


@query(sql("p", f"{RET} SELECT asset, name, {STATS} FROM r JOIN {WINDOWS_SQL} ON (m = 0 OR month(date) = m) AND day(date) BETWEEN d1 AND d2 WHERE r IS NOT NULL GROUP BY 1, 2"), dates="")
def agg09_calendar_windows(spark, sf_dir):
    r = _returns(spark, sf_dir)
    month, day = F.month("date"), F.dayofmonth("date")
    flags = {
        "first_five": (month == 1) & day.between(1, 5),
        "mid_month": day.between(10, 15),
        "year_end": (month == 12) & day.between(24, 31),
        "year_start": (month == 1) & day.between(1, 2),
    }
    return _rounded(g.return_stats(g.tagged(r, "name", flags), "r", ["asset", "name"]), *STAT_COLS)


@query(sql("p", "SELECT asset, date, nr FROM (SELECT asset, date, row_number() OVER (PARTITION BY asset, year(date) ORDER BY date) AS nr FROM p) AS x WHERE nr <= 5"))
def agg10_first_rows(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    w = Window.partitionBy("asset", F.year("date")).orderBy("date")
    return p.select("asset", "date", F.row_number().over(w).cast("long").alias("nr")).filter("nr <= 5")


@query(sql("p", f"{RET} SELECT asset, (year(date) - 1993) % 4 + 1 AS cycle_year, round(avg(r), 6) AS mean, count(r) AS n FROM r GROUP BY 1, 2"), dates="")
def agg11_four_year_cycle(spark, sf_dir):
    r = _returns(spark, sf_dir)
    year = ((F.year("date") - 1993) % 4 + 1).cast("long").alias("cycle_year")
    return _rounded(r.groupBy("asset", year).agg(F.avg("r").alias("mean"), F.count("r").alias("n")), "mean")


@query(sql("p", f"""{RET}, v AS (SELECT *, CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w END AS v FROM r WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
e AS (SELECT asset, quantile_cont(v, 1.0 / 3) AS lo, quantile_cont(v, 2.0 / 3) AS hi FROM v GROUP BY asset)
SELECT v.asset, CASE WHEN v <= lo THEN 'low' WHEN v <= hi THEN 'mid' ELSE 'high' END AS regime, round(avg(r) * 252, 6) AS annual_mean, count(*) AS n
FROM v JOIN e ON v.asset = e.asset WHERE v IS NOT NULL GROUP BY 1, 2"""), dates="")
def agg12_volatility_regimes(spark, sf_dir):
    v = _returns(spark, sf_dir).withColumn("v", S.deviation("r", 20)).filter("v is not null")
    e = v.groupBy("asset").agg(F.percentile("v", F.lit(1 / 3)).alias("lo"), F.percentile("v", F.lit(2 / 3)).alias("hi"))
    v = v.join(e, "asset").withColumn("regime", F.when(F.col("v") <= F.col("lo"), "low").when(F.col("v") <= F.col("hi"), "mid").otherwise("high"))
    return _rounded(v.groupBy("asset", "regime").agg((F.avg("r") * 252).alias("annual_mean"), F.count("*").alias("n")), "annual_mean")


PAIRS = "j AS (SELECT x.asset AS asset, y.asset AS other, x.date AS date, x.r AS rx, y.r AS ry FROM r AS x JOIN r AS y ON x.date = y.date AND x.asset < y.asset WHERE x.r IS NOT NULL AND y.r IS NOT NULL)"


@query(sql("p", f"{RET}, {PAIRS} SELECT asset, other, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM j GROUP BY 1, 2"), dates="")
def agg13_correlation_pairs(spark, sf_dir):
    return _rounded(g.pairwise(_returns(spark, sf_dir), "asset", "date", "r", rho=F.corr("x", "y"), n=F.count("*")), "rho")


@query(sql("p", f"{RET}, {PAIRS} SELECT asset, other, round(covar_samp(rx, ry) / var_samp(ry), 6) AS beta, round(corr(rx, ry) * corr(rx, ry), 6) AS r2 FROM j GROUP BY 1, 2"), dates="")
def agg14_beta_r2(spark, sf_dir):
    r2 = F.corr("x", "y") * F.corr("x", "y")
    return _rounded(g.pairwise(_returns(spark, sf_dir), "asset", "date", "r", beta=F.covar_samp("x", "y") / F.var_samp("y"), r2=r2), "beta", "r2")


@query(sql("p", f"""{RET}, f AS (SELECT asset, r, lead(value, 5) {O} / value - 1 AS f FROM r)
SELECT CASE WHEN r > -1 AND r <= -0.2 THEN 1 WHEN r > -0.2 AND r <= 0 THEN 2 WHEN r > 0 AND r <= 0.2 THEN 3 WHEN r > 0.2 AND r <= 1000 THEN 4 END AS bin,
round(avg(f), 6) AS mean, round(median(f), 6) AS median, count(*) AS n FROM f WHERE f IS NOT NULL AND r IS NOT NULL GROUP BY 1"""), dates="")
def agg15_fixed_bins(spark, sf_dir):
    f = _returns(spark, sf_dir).withColumn("f", S.forward_change("value", 5)).filter("f is not null and r is not null")
    f = f.withColumn("bin", g.right_closed_bin("r", [-1, -0.2, 0, 0.2, 1000]).cast("long"))
    return _rounded(f.groupBy("bin").agg(F.avg("f").alias("mean"), F.median("f").alias("median"), F.count("*").alias("n")), "mean", "median")


@query(sql("p", f"""{RET}, f AS (SELECT asset, r, lead(value, 5) {O} / value - 1 AS f FROM r), k AS (SELECT * FROM f WHERE f IS NOT NULL AND r IS NOT NULL),
e AS (SELECT asset, quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.5) AS b, quantile_cont(r, 0.75) AS c FROM k GROUP BY asset)
SELECT k.asset, CASE WHEN r <= a THEN 1 WHEN r <= b THEN 2 WHEN r <= c THEN 3 ELSE 4 END AS bin, round(quantile_cont(f, 0.05), 6) AS q05,
round(quantile_cont(f, 0.1), 6) AS q10, round(median(f), 6) AS median, count(*) AS n FROM k JOIN e ON k.asset = e.asset GROUP BY 1, 2"""), dates="")
def agg16_conditional_downside(spark, sf_dir):
    f = _returns(spark, sf_dir).withColumn("f", S.forward_change("value", 5)).filter("f is not null and r is not null")
    f = g.quantile_bins(f, "r", 4, ["asset"])
    aggs = [F.percentile("f", F.lit(q)).alias(n) for n, q in (("q05", 0.05), ("q10", 0.1))]
    return _rounded(f.groupBy("asset", F.col("bin").cast("long").alias("bin")).agg(*aggs, F.median("f").alias("median"), F.count("*").alias("n")), "q05", "q10", "median")


@query(sql("p", f"""WITH f AS (SELECT asset, value, value - lag(value, 10) {O} AS d, lead(value, 10) {O} / value - 1 AS f FROM p), k AS (SELECT * FROM f WHERE d IS NOT NULL AND f IS NOT NULL),
e AS (SELECT asset, quantile_cont(value, 1.0 / 3) AS a, quantile_cont(value, 2.0 / 3) AS b, quantile_cont(d, 1.0 / 3) AS c, quantile_cont(d, 2.0 / 3) AS g FROM k GROUP BY asset)
SELECT k.asset, CASE WHEN value <= a THEN 1 WHEN value <= b THEN 2 ELSE 3 END AS level_bin, CASE WHEN d <= c THEN 1 WHEN d <= e.g THEN 2 ELSE 3 END AS change_bin,
round(avg(f), 6) AS mean, count(*) AS n FROM k JOIN e ON k.asset = e.asset GROUP BY 1, 2, 3"""), dates="")
def agg17_level_and_change(spark, sf_dir):
    f = a.daily_prices(spark, sf_dir).withColumn("d", F.col("value") - S.lagged("value", 10)).withColumn("f", S.forward_change("value", 10))
    f = f.filter("d is not null and f is not null")
    f = g.quantile_bins(f, "value", 3, ["asset"], "level_bin")
    f = g.quantile_bins(f, "d", 3, ["asset"], "change_bin")
    keys = ["asset", F.col("level_bin").cast("long").alias("level_bin"), F.col("change_bin").cast("long").alias("change_bin")]
    return _rounded(f.groupBy(*keys).agg(F.avg("f").alias("mean"), F.count("*").alias("n")), "mean")


FLAGS_SQL = f"""f AS (SELECT asset, lead(value, 5) {O} / value - 1 > 0 AS y, r > 0 AS up, value > CASE WHEN count(value) OVER w >= 50 THEN avg(value) OVER w END AS above, month(date) = 1 AS january
FROM r WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""


@query(sql("p", f"""{RET}, {FLAGS_SQL}, u AS (SELECT 'up' AS flag, y, up AS on_ FROM f UNION ALL SELECT 'above', y, above FROM f UNION ALL SELECT 'january', y, january FROM f)
SELECT flag, count(*) FILTER (on_) AS n, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) FILTER (on_), 6) AS rate, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END), 6) AS base,
round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) FILTER (on_) / avg(CASE WHEN y THEN 1.0 ELSE 0.0 END), 6) AS lift
FROM u WHERE y IS NOT NULL AND on_ IS NOT NULL GROUP BY flag"""), dates="")
def agg18_likelihood_ratios(spark, sf_dir):
    f = _returns(spark, sf_dir)
    f = f.select(
        (S.forward_change("value", 5) > 0).alias("y"),
        (F.col("r") > 0).alias("up"),
        (F.col("value") > S.mean("value", 50)).alias("above"),
        (F.month("date") == 1).alias("january"),
    )
    return _rounded(g.likelihood_ratios(f, "y", ["up", "above", "january"]), "rate", "base", "lift")


HORIZONS = (5, 20, 60)


@query(sql("p", f"""WITH h AS ({' UNION ALL '.join(f"SELECT asset, {h} AS horizon, lead(value, {h}) {O} / value - 1 AS f FROM p" for h in HORIZONS)})
SELECT asset, horizon, count(*) AS n, round(quantile_cont(f, 0.05), 6) AS p5, round(median(f), 6) AS p50, round(quantile_cont(f, 0.95), 6) AS p95,
round(avg(CASE WHEN f < 0 THEN 1.0 ELSE 0.0 END), 6) AS loss, round(avg(CASE WHEN f < -0.2 THEN 1.0 ELSE 0.0 END), 6) AS large_loss FROM h WHERE f IS NOT NULL GROUP BY 1, 2"""), dates="")
def agg20_holding_periods(spark, sf_dir):
    return _rounded(g.holding_periods(a.daily_prices(spark, sf_dir), "value", HORIZONS, S), "p5", "p50", "p95", "loss", "large_loss")


@query(sql("p", f"""WITH s AS (SELECT asset, value > avg(value) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS above, lead(value, 20) {O} / value - 1 AS f, count(*) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS c FROM p)
SELECT asset, above, count(*) AS n, round(avg(f), 6) AS mean, round(median(f), 6) AS median, round(avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END), 6) AS up_rate FROM s WHERE c >= 50 AND f IS NOT NULL GROUP BY 1, 2"""), dates="")
def agg21_forward_by_state(spark, sf_dir):
    s = a.daily_prices(spark, sf_dir).withColumn("above", F.col("value") > S.mean("value", 50)).withColumn("f", S.forward_change("value", 20))
    s = s.filter("above is not null and f is not null").groupBy("asset", "above")
    return _rounded(s.agg(F.count("*").alias("n"), F.avg("f").alias("mean"), F.median("f").alias("median"), F.avg((F.col("f") > 0).cast("double")).alias("up_rate")), "mean", "median", "up_rate")


@query(sql("p", f"""{RET} SELECT CAST(floor(year(date) / 10.0) * 10 AS BIGINT) AS decade, asset, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS up_rate, count(*) AS n FROM r WHERE r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100"""), dates="")
def agg22_decades(spark, sf_dir):
    r = _returns(spark, sf_dir).filter("r is not null")
    decade = (F.floor(F.year("date") / 10) * 10).alias("decade")
    d = r.groupBy(decade, "asset").agg(F.avg((F.col("r") > 0).cast("double")).alias("up_rate"), F.count("*").alias("n"))
    return _rounded(d.filter("n >= 100"), "up_rate")


@query(sql("p", f"""{RET}, s AS (SELECT *, CASE WHEN month(date) >= 11 THEN year(date) + 1 WHEN month(date) <= 4 THEN year(date) END AS season, date_trunc('month', date) AS m FROM r)
SELECT asset, season, round(exp(sum(ln(1 + r / 100))) - 1, 6) AS compounded FROM s WHERE season IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT m) = 6"""), dates="")
def agg25_winter_halves(spark, sf_dir):
    r = _returns(spark, sf_dir).filter("r is not null").withColumn("r", F.col("r") / 100)
    month = F.month("date")
    season = F.when(month >= 11, F.year("date") + 1).when(month <= 4, F.year("date")).cast("long")
    s = r.withColumn("season", season).filter("season is not null")
    s = s.groupBy("asset", "season").agg(g.compounded("r").alias("compounded"), F.count_distinct(F.trunc("date", "month")).alias("m"))
    return _rounded(s.filter("m = 6").drop("m"), "compounded")


@query("""SELECT c_mktsegment AS segment, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS settled,
count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS dropped FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 30""", dates="")
def agg28_scorecard(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders").join(a.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    is_ = lambda s: F.col("o_orderstatus") == s
    by = o.groupBy(F.col("c_mktsegment").alias("segment"))
    s = by.agg(F.count("*").alias("n"), F.avg(is_("F").cast("double")).alias("settled"), F.count_if(is_("O")).alias("pending"), F.count_if(is_("P")).alias("dropped"))
    return _rounded(s.filter("n >= 30"), "settled")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS changes FROM events GROUP BY 1", dates="")
def agg29_latest_status(spark, sf_dir):
    return g.latest(a.table(spark, sf_dir, "events"), ["user_id"], F.struct("ts", "event_id"), status="event_type")


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, coalesce(event_type <> lag(event_type) OVER w, false) AS flip FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(CASE WHEN flip THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
m AS (SELECT user_id, max(run) AS flips, count(*) AS snapshots FROM n GROUP BY 1)
SELECT m.user_id, snapshots, CAST(flips AS BIGINT) AS flips, (SELECT count(*) FROM n WHERE n.user_id = m.user_id AND n.run = m.flips) AS stable_run FROM m""", dates="")
def agg30_stability(spark, sf_dir):
    return g.stability(a.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(sql("p", f"""{RET} SELECT asset, round(product(1 + r / 100) - 1, 6) AS total, round(avg(r) * 252, 6) AS annual_mean, round(stddev_samp(r) * sqrt(252.0), 6) AS annual_deviation,
round(avg(r) / stddev_samp(r) * sqrt(252.0), 6) AS sharpe, count(*) AS n FROM r WHERE r IS NOT NULL GROUP BY asset"""), dates="")
def agg34_curve_stats(spark, sf_dir):
    r = _returns(spark, sf_dir).filter("r is not null").groupBy("asset")
    mean, dev, year = F.avg("r"), F.stddev_samp("r"), F.sqrt(F.lit(252.0))
    s = r.agg(g.compounded(F.col("r") / 100).alias("total"), (mean * 252).alias("annual_mean"), (dev * year).alias("annual_deviation"), (mean / dev * year).alias("sharpe"), F.count("*").alias("n"))
    return _rounded(s, "total", "annual_mean", "annual_deviation", "sharpe")


@query(sql("p", f"""{RET}, q AS (SELECT asset, date, r / 100 AS r, exp(sum(ln(1 + coalesce(r, 0) / 100)) OVER w) AS equity FROM r WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, equity / max(equity) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM q)
SELECT asset, round(arg_max(equity, date) - 1, 6) AS total, round(pow(arg_max(equity, date), 252.0 / count(*)) - 1, 6) AS cagr, round(min(dd), 6) AS worst FROM d GROUP BY asset"""), dates="")
def agg35_performance(spark, sf_dir):
    r = _returns(spark, sf_dir).withColumn("r", F.col("r") / 100)
    return _rounded(g.performance(r, "r", S), "total", "cagr", "worst")


@query(sql("k", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM k)
SELECT ticker, count(*) AS n, round(max(close) FILTER (rn = 1), 6) AS last, round(max(close) FILTER (rn = 1) / max(close) FILTER (rn = 2) - 1, 6) AS d1,
round(max(close) FILTER (rn = 1) / max(close) FILTER (rn = 6) - 1, 6) AS w1, round(max(close) FILTER (rn = 1) / max(close) FILTER (rn = 22) - 1, 6) AS m1,
round(max(close) FILTER (rn = 1) / max(close) FILTER (rn <= 252) - 1, 6) AS from_high FROM n GROUP BY ticker HAVING count(*) >= 130"""), dates="")
def agg36_snapshot(spark, sf_dir):
    return _rounded(g.snapshot(a.ticker_panel(spark, sf_dir), "ticker", "date", "close", {"d1": 2, "w1": 6, "m1": 22}, least=130), "last", "d1", "w1", "m1", "from_high")


@query("SELECT p_brand AS sector, count(*) AS n, round(avg(p_size), 6) AS mean_size FROM part GROUP BY 1", dates="")
def agg38_sector_means(spark, sf_dir):
    return _rounded(a.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("sector")).agg(F.count("*").alias("n"), F.avg("p_size").alias("mean_size")), "mean_size")


@query(sql("k", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM k), m AS (SELECT ticker, count(*) AS n, median(close * volume) AS turnover FROM n WHERE rn <= 60 GROUP BY 1 HAVING count(*) >= 30)
SELECT ticker, n, round(turnover, 4) AS turnover, CASE WHEN turnover >= 50000 THEN 'high' WHEN turnover >= 10000 THEN 'mid' ELSE 'low' END AS tier FROM m"""), dates="")
def agg39_liquidity_tier(spark, sf_dir):
    k = a.ticker_panel(spark, sf_dir)
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    m = k.withColumn("rn", rn).filter("rn <= 60").groupBy("ticker")
    m = m.agg(F.count("*").alias("n"), F.median(F.col("close") * F.col("volume")).alias("turnover")).filter("n >= 30")
    tier = F.when(F.col("turnover") >= 50000, "high").when(F.col("turnover") >= 10000, "mid").otherwise("low")
    return m.select("ticker", "n", F.round("turnover", 4).alias("turnover"), tier.alias("tier"))


@query(sql("p", """WITH m AS (SELECT asset, date_trunc('month', date) AS m, arg_max(value, date) AS v FROM p GROUP BY 1, 2),
d AS (SELECT asset, sign(v - lag(v) OVER w) AS direction, lead(v) OVER w / v - 1 AS next FROM m WINDOW w AS (PARTITION BY asset ORDER BY m))
SELECT asset, CAST(direction AS BIGINT) AS direction, round(avg(next), 6) AS mean, count(*) AS n FROM d WHERE direction IS NOT NULL AND next IS NOT NULL GROUP BY 1, 2"""), dates="")
def agg42_next_by_sign(spark, sf_dir):
    m = g.period_last(a.daily_prices(spark, sf_dir), "value", "month", ["asset"])
    w = Series(("asset",), "period")
    m = m.select("asset", F.signum(F.col("value") - w.lagged("value")).cast("long").alias("direction"), w.forward_change("value", 1).alias("next"))
    m = m.filter("direction is not null and next is not null").groupBy("asset", "direction")
    return _rounded(m.agg(F.avg("next").alias("mean"), F.count("*").alias("n")), "mean")


@query("""WITH u AS (SELECT 'l_returnflag' AS feature, l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem)
SELECT feature, count(DISTINCT v) AS kinds, count(DISTINCT v) >= 2 AS usable FROM u GROUP BY feature""", dates="")
def agg43_usable_features(spark, sf_dir):
    items = a.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    u = items.unpivot([], ["l_returnflag", "l_linestatus"], "feature", "v")
    return u.groupBy("feature").agg(F.count_distinct("v").alias("kinds")).withColumn("usable", F.col("kinds") >= 2)
