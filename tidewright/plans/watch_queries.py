"""Registered watch lists, pick ledgers, portfolios, monitoring and output checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import signals as g
from ..operators.folds import walked
from ..operators.joins import asof_join, by_instant
from ..operators.ranking import has_words
from ..operators.windows import Series
from ..sources import adapters as a
from .discovery_queries import OD, ONE, RT, _market
from .registry import query
from .window_queries import O, RET, _r, _returns

S = Series(("asset",), "date")
K = Series(("ticker",), "date")
sql = a.with_views
OK = "OVER (PARTITION BY ticker ORDER BY date)"
BACK = "OVER (PARTITION BY ticker ORDER BY date DESC)"


def lastk(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# ---- stock statistics -------------------------------------------------------------

RSI = f"100 - 100 / (1 + avg(CASE WHEN r > 0 THEN r WHEN r IS NOT NULL THEN 0.0::DOUBLE END) {lastk(14)} / (avg(CASE WHEN r < 0 THEN -r WHEN r IS NOT NULL THEN 0.0::DOUBLE END) {lastk(14)} + 1e-10))"
PANEL = f"""WITH kr AS (SELECT *, close / lag(close) {OK} - 1 AS r FROM k), mk AS (SELECT date, avg(r) AS m FROM kr WHERE r IS NOT NULL GROUP BY 1),
kx AS (SELECT kr.ticker, kr.date, close, r, m, row_number() OVER (PARTITION BY kr.ticker ORDER BY kr.date DESC) AS back, count(*) OVER (PARTITION BY kr.ticker) AS n, avg(close) {lastk(50).replace('ticker', 'kr.ticker').replace('date ROWS', 'kr.date ROWS')} AS ma50, avg(close) {lastk(200).replace('ticker', 'kr.ticker').replace('date ROWS', 'kr.date ROWS')} AS ma200,
close / max(close) OVER (PARTITION BY kr.ticker ORDER BY kr.date) - 1 AS dd, stddev_samp(r) {lastk(20).replace('ticker', 'kr.ticker').replace('date ROWS', 'kr.date ROWS')} * sqrt(252.0::DOUBLE) AS vol20, {RSI.replace('ticker', 'kr.ticker').replace('date ROWS', 'kr.date ROWS')} AS rsi FROM kr LEFT JOIN mk ON mk.date = kr.date)"""
WATCH = {
    "last": "max(close) FILTER (back = 1)",
    "chg_1d": "max(close) FILTER (back = 1) / max(close) FILTER (back = 2) - 1",
    "chg_5d": "max(close) FILTER (back = 1) / max(close) FILTER (back = 6) - 1",
    "chg_20d": "max(close) FILTER (back = 1) / max(close) FILTER (back = 21) - 1",
    "chg_1y": "max(close) FILTER (back = 1) / max(close) FILTER (back = 253) - 1",
    "ytd": "max(close) FILTER (back = 1) / arg_max(close, date) FILTER (year(date) < year(end_day)) - 1",
    "from_high": "max(close) FILTER (back = 1) / max(close) FILTER (back <= 252) - 1",
    "range_place": "(max(close) FILTER (back = 1) - min(close) FILTER (back <= 252)) / (max(close) FILTER (back <= 252) - min(close) FILTER (back <= 252))",
    "dist_ma200": "max(close) FILTER (back = 1) / max(ma200) FILTER (back = 1) - 1",
    "rsi14": "max(rsi) FILTER (back = 1)",
    "vol20": "max(vol20) FILTER (back = 1)",
    "vol_rank": "avg(CASE WHEN vol20 < last_vol THEN 1.0 ELSE 0.0 END) FILTER (back <= 252)",
    "max_dd": "min(dd)",
    "ret_vol": "(max(close) FILTER (back = 1) / max(close) FILTER (back = 253) - 1) / (stddev_samp(r) FILTER (back <= 252) * sqrt(252.0::DOUBLE))",
    "beta": "regr_slope(r, m) FILTER (back <= 252)",
    "corr": "corr(r, m) FILTER (back <= 252)",
}


@query(sql("k", f"""{PANEL}, ky AS (SELECT *, max(date) OVER (PARTITION BY ticker) AS end_day, max(CASE WHEN back = 1 THEN vol20 END) OVER (PARTITION BY ticker) AS last_vol FROM kx)
SELECT ticker, {', '.join(f'round({x}, 6) AS "{n}"' for n, x in WATCH.items())}, bool_or(back = 1 AND close > ma50) AS above50, bool_or(back = 1 AND close > ma200) AS above200 FROM ky WHERE n >= 260 GROUP BY ticker"""), dates="")
def agg37_watch_stats(spark, sf_dir):
    """Returns, range, trend, volatility and market ties of every series with 260 rows or more."""
    return _watch(spark, sf_dir)


def _watch(spark, sf_dir):
    w = Window.partitionBy("ticker")
    k = a.ticker_panel(spark, sf_dir).withColumn("r", K.change("close"))
    market = k.filter("r is not null").groupBy("date").agg(F.avg("r").alias("m"))
    k = k.withColumn("back", F.row_number().over(w.orderBy(F.desc("date")))).withColumn("n", F.count("*").over(w)).withColumn("end_day", F.max("date").over(w))
    k = k.withColumn("ma50", F.avg("close").over(K.last(50))).withColumn("ma200", F.avg("close").over(K.last(200))).withColumn("dd", F.col("close") / F.max("close").over(K.so_far) - 1)
    k = k.withColumn("vol20", F.stddev_samp("r").over(K.last(20)) * F.sqrt(F.lit(252.0))).withColumn("rsi", K.strength_index("r"))
    k = k.withColumn("last_vol", F.max(F.when(F.col("back") == 1, F.col("vol20"))).over(w)).filter("n >= 260").join(market, "date", "left")
    at = lambda c, b: F.max(F.when(F.col("back") == b, F.col(c)))
    year = F.col("back") <= 252
    within = lambda c: F.when(year, F.col(c))
    now, high, low = at("close", 1), F.max(within("close")), F.min(within("close"))
    stats = {f"chg_{n}": now / at("close", b) - 1 for n, b in (("1d", 2), ("5d", 6), ("20d", 21), ("1y", 253))}
    last_year = F.year("date") < F.year("end_day")
    stats |= {
        "last": now, "ytd": now / F.max_by(F.when(last_year, F.col("close")), F.when(last_year, F.col("date"))) - 1, "from_high": now / high - 1, "range_place": (now - low) / (high - low),
        "dist_ma200": now / at("ma200", 1) - 1, "rsi14": at("rsi", 1), "vol20": at("vol20", 1), "vol_rank": F.avg(F.when(year, (F.col("vol20") < F.col("last_vol")).cast("double"))), "max_dd": F.min("dd"),
        "ret_vol": (now / at("close", 253) - 1) / (F.stddev_samp(within("r")) * F.sqrt(F.lit(252.0))), "beta": F.regr_slope(within("r"), within("m")), "corr": F.corr(within("r"), within("m")),
    }
    above = [F.bool_or((F.col("back") == 1) & (F.col("close") > F.col(c))).alias(n) for n, c in (("above50", "ma50"), ("above200", "ma200"))]
    return k.groupBy("ticker").agg(*_r(**stats), *above)


@query(sql("k", f"""{PANEL}, mo AS (SELECT ticker, date_trunc('week', date) AS w, arg_max(close, date) AS v FROM k GROUP BY 1, 2) SELECT ticker, CAST(w AS DATE) AS date, round(100 * v / first_value(v) OVER (PARTITION BY ticker ORDER BY w), 4) AS normalised FROM mo"""))
def q38_weekly_curve(spark, sf_dir):
    week = a.ticker_panel(spark, sf_dir).groupBy("ticker", F.trunc("date", "week").alias("date")).agg(F.max_by("close", "date").alias("v"))
    return week.select("ticker", "date", F.round(100 * F.col("v") / F.first("v").over(K.ordered), 4).alias("normalised"))


@query(sql("k", f"""{PANEL}, h AS (SELECT *, CASE WHEN back <= n / 2 THEN 'late' ELSE 'early' END AS half FROM kx WHERE r IS NOT NULL AND m IS NOT NULL)
SELECT ticker, half, count(*) AS n, round(regr_slope(r, m), 6) AS beta, round(regr_r2(r, m), 6) AS r2, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.05), 6) AS low5, round(avg(r) / (stddev_samp(r) / sqrt(count(*))), 6) AS t FROM h GROUP BY 1, 2"""), dates="")
def q37_check_up(spark, sf_dir):
    w = Window.partitionBy("ticker")
    k = a.ticker_panel(spark, sf_dir).withColumn("r", K.change("close")).withColumn("back", F.row_number().over(w.orderBy(F.desc("date")))).withColumn("rows", F.count("*").over(w))
    market = k.filter("r is not null").groupBy("date").agg(F.avg("r").alias("m"))
    h = k.filter("r is not null").join(market, "date").withColumn("half", F.when(F.col("back") <= F.col("rows") / 2, "late").otherwise("early")).groupBy("ticker", "half")
    t = F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count("*")))
    return h.agg(F.count("*").alias("n"), *_r(beta=F.regr_slope("r", "m"), r2=F.regr_r2("r", "m"), mean=F.avg("r"), low5=F.percentile("r", F.lit(0.05)), t=t))


@query(sql("k", f"""{PANEL} SELECT ticker, CASE WHEN n >= 1000 THEN 'long' ELSE 'short' END AS pool, round(max(close) FILTER (back = 1) / max(close) FILTER (back = 127) - 1, 6) AS half_year, round(stddev_samp(r) FILTER (back <= 126), 6) AS spread, round(avg(close * 1.0) FILTER (back <= 20), 4) AS mean20 FROM kx WHERE n >= 130 GROUP BY 1, 2"""), dates="")
def q39_universe_metrics(spark, sf_dir):
    w = Window.partitionBy("ticker")
    k = a.ticker_panel(spark, sf_dir).withColumn("r", K.change("close")).withColumn("back", F.row_number().over(w.orderBy(F.desc("date")))).withColumn("n", F.count("*").over(w)).filter("n >= 130")
    at = lambda b: F.max(F.when(F.col("back") == b, F.col("close")))
    by = k.groupBy("ticker", F.when(F.col("n") >= 1000, "long").otherwise("short").alias("pool"))
    near = lambda c, n: F.when(F.col("back") <= n, F.col(c))
    return by.agg(F.round(at(1) / at(127) - 1, 6).alias("half_year"), F.round(F.stddev_samp(near("r", 126)), 6).alias("spread"), F.round(F.avg(near("close", 20)), 4).alias("mean20"))


# ---- pick ledgers -------------------------------------------------------------------

PICKS = f"""WITH kn AS (SELECT *, row_number() {OK} AS i, close / lag(close, 60) {OK} - 1 AS mom, lead(date, 1) {OK} AS in_date, lead(close, 1) {OK} AS in_px, lead(date, 21) {OK} AS out_date, lead(close, 21) {OK} AS out_px FROM k),
mon AS (SELECT max(date) AS date FROM k GROUP BY date_trunc('month', date)), rk AS (SELECT kn.*, row_number() OVER (PARTITION BY kn.date ORDER BY round(mom, 9) DESC, ticker) AS hi, row_number() OVER (PARTITION BY kn.date ORDER BY round(mom, 9), ticker) AS lo FROM kn JOIN mon ON mon.date = kn.date WHERE mom IS NOT NULL),
pk AS (SELECT ticker, date, CASE WHEN hi <= 3 THEN 'long' ELSE 'short' END AS view, round(mom, 9) AS mom, in_date, in_px, out_date, out_px FROM rk WHERE hi <= 3 OR lo <= 3),
st AS (SELECT *, out_px / in_px - 1 AS ret, CASE WHEN in_px IS NULL THEN 'waiting' WHEN out_px IS NULL THEN 'pending' ELSE 'settled' END AS status FROM pk),
be AS (SELECT date, avg(out_px / in_px - 1) AS bench FROM kn WHERE out_px IS NOT NULL GROUP BY 1), sc AS (SELECT st.*, ret - bench AS excess, CASE WHEN view = 'long' THEN ret - bench ELSE bench - ret END AS call FROM st LEFT JOIN be ON be.date = st.date)"""


def _picks(spark, sf_dir):
    """Month-end picks of the three strongest and weakest, entered on the next row, settled 20 rows later against all."""
    k = a.ticker_panel(spark, sf_dir).withColumn("mom", F.round(K.change("close", 60), 9))
    k = k.withColumns({n: F.lead(c, h).over(K.ordered) for n, c, h in (("in_date", "date", 1), ("in_px", "close", 1), ("out_date", "date", 21), ("out_px", "close", 21))})
    ends = k.groupBy(F.trunc("date", "month")).agg(F.max("date").alias("date")).select("date")
    bench = k.filter("out_px is not null").groupBy("date").agg(F.avg(F.col("out_px") / F.col("in_px") - 1).alias("bench"))
    w = Window.partitionBy("date")
    x = k.join(ends, "date").filter("mom is not null").withColumn("hi", F.row_number().over(w.orderBy(F.desc("mom"), "ticker"))).withColumn("lo", F.row_number().over(w.orderBy("mom", "ticker")))
    x = x.filter("hi <= 3 or lo <= 3").withColumn("view", F.when(F.col("hi") <= 3, "long").otherwise("short")).withColumn("ret", F.col("out_px") / F.col("in_px") - 1)
    status = F.when(F.col("in_px").isNull(), "waiting").when(F.col("out_px").isNull(), "pending").otherwise("settled")
    x = x.withColumn("status", status).join(bench, "date", "left").withColumn("excess", F.col("ret") - F.col("bench"))
    return x.withColumn("call", F.when(F.col("view") == "long", F.col("excess")).otherwise(-F.col("excess")))


@query(sql("k", f"{PICKS} SELECT ticker, date, view, round(mom, 6) AS mom, in_date, round(in_px, 4) AS in_px, out_date, round(out_px, 4) AS out_px, round(ret, 6) AS ret, round(call, 6) AS call, call > 0 AS hit, status FROM sc"), dates="date in_date out_date")
def q40_pick_ledger(spark, sf_dir):
    x = _picks(spark, sf_dir)
    prices = [F.round(c, 4).alias(c) for c in ("in_px", "out_px")]
    return x.select("ticker", "date", "view", "in_date", "out_date", *prices, *_r(mom=F.col("mom"), ret=F.col("ret"), call=F.col("call")), (F.col("call") > 0).alias("hit"), "status")


@query(sql("k", f"{PICKS} SELECT year(date) AS year, view, count(*) AS n, round(avg(CASE WHEN call > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(ret), 6) AS ret, round(avg(call), 6) AS call FROM sc WHERE status = 'settled' GROUP BY 1, 2"), dates="")
def q41_pick_trace(spark, sf_dir):
    by = _picks(spark, sf_dir).filter("status = 'settled'").groupBy(F.year("date").cast("long").alias("year"), "view")
    return by.agg(F.count("*").alias("n"), *_r(hit_rate=F.avg((F.col("call") > 0).cast("double")), ret=F.avg("ret"), call=F.avg("call")))


FOLLOW = """WITH o AS (SELECT o_orderkey, o_orderpriority AS asset, o_custkey AS owner, CAST(o_orderdate AS DATE) + 3 AS filed, o_totalprice AS amount FROM orders WHERE o_totalprice >= 300000),
a1 AS (SELECT o.*, p.value AS entry, p.date AS entry_day FROM o ASOF JOIN p ON o.asset = p.asset AND o.filed <= p.date), a2 AS (SELECT a1.*, p.value AS exit FROM a1 ASOF LEFT JOIN p ON a1.asset = p.asset AND a1.filed + 30 >= p.date),
b1 AS (SELECT a2.*, t.value AS bench_in FROM a2 ASOF LEFT JOIN t ON a2.entry_day >= t.date), b2 AS (SELECT b1.*, t.value AS bench_out FROM b1 ASOF LEFT JOIN t ON b1.filed + 30 >= t.date), f AS (SELECT *, exit / entry - 1 - (bench_out / bench_in - 1) AS excess FROM b2 WHERE filed + 30 <= (SELECT max(date) FROM p))"""


@query(sql("p t", f"{FOLLOW} SELECT asset, count(*) AS n, count(DISTINCT owner) AS owners, round(avg(exit / entry - 1), 6) AS ret, round(avg(excess), 6) AS excess, round(avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0.0 END), 6) AS beat FROM f GROUP BY 1"), dates="")
def q42_follow(spark, sf_dir):
    """Large orders followed three days after, held 30 days, against the market."""
    o = a.table(spark, sf_dir, "orders").filter("o_totalprice >= 300000")
    o = o.select(F.col("o_orderpriority").alias("asset"), F.col("o_custkey").alias("owner"), F.date_add(F.col("o_orderdate").cast("date"), 3).alias("filed")).withColumn("due", F.date_add("filed", 30))
    p, t = a.daily_prices(spark, sf_dir), a.daily_total(spark, sf_dir)
    end = p.agg(F.max("date").alias("end"))
    o = o.join(end).filter("due <= end").drop("end")  # one row
    prices, m = p.select("asset", F.col("date").alias("d"), F.col("value").alias("v")), t.select(F.col("date").alias("d"), F.col("value").alias("v"))

    def priced(days):
        x = asof_join(days, prices, "filed", "d", ["asset"], "forward").withColumn("entry", F.col("matched.v")).withColumn("entry_day", F.col("matched.d")).drop("matched").filter("entry is not null")
        x = asof_join(x, prices, "due", "d", ["asset"]).withColumn("exit", F.col("matched.v")).drop("matched")
        x = asof_join(x, m, "entry_day", "d").withColumn("bench_in", F.col("matched.v")).drop("matched")
        return asof_join(x, m, "due", "d").withColumn("bench_out", F.col("matched.v")).drop("matched")

    x = by_instant(o, ["asset", "filed", "due"], priced)
    ret = F.col("exit") / F.col("entry") - 1
    x = x.withColumn("ret", ret).withColumn("excess", ret - (F.col("bench_out") / F.col("bench_in") - 1)).groupBy("asset")
    return x.agg(F.count("*").alias("n"), F.countDistinct("owner").alias("owners"), *_r(ret=F.avg("ret"), excess=F.avg("excess"), beat=F.avg((F.col("excess") > 0).cast("double"))))


CALLS = f"""WITH pr AS (SELECT asset, date, value, CASE WHEN value / lag(value, 5) {O} > 1 THEN 'up' WHEN value / lag(value, 5) {O} < 1 THEN 'down' ELSE 'flat' END AS direction, lead(value, 5) {O} / value - 1 AS ret FROM p),
sc AS (SELECT *, CASE WHEN ret > 0.01 THEN 'up' WHEN ret < -0.01 THEN 'down' WHEN ret IS NOT NULL THEN 'flat' END AS bucket FROM pr)"""


def _calls(spark, sf_dir):
    """Momentum calls of direction, settled after five rows into up, down or flat."""
    p = a.daily_prices(spark, sf_dir)
    ratio = F.col("value") / S.lagged("value", 5)
    direction = F.when(ratio > 1, "up").when(ratio < 1, "down").otherwise("flat")
    x = p.withColumn("direction", direction).withColumn("ret", S.forward_change("value", 5))
    bucket = F.when(F.col("ret") > 0.01, "up").when(F.col("ret") < -0.01, "down").when(F.col("ret").isNotNull(), "flat")
    return x.withColumn("bucket", bucket)


@query(sql("p", f"{CALLS} SELECT asset, direction, count(*) AS n, count(bucket) AS settled, round(avg(CASE WHEN bucket = direction THEN 1.0 ELSE 0.0 END) FILTER (bucket IS NOT NULL), 6) AS hit_rate, round(avg(ret), 6) AS ret FROM sc GROUP BY 1, 2"), dates="")
def q43_direction_score(spark, sf_dir):
    hit = F.when(F.col("bucket").isNotNull(), (F.col("bucket") == F.col("direction")).cast("double"))
    return _calls(spark, sf_dir).groupBy("asset", "direction").agg(F.count("*").alias("n"), F.count("bucket").alias("settled"), *_r(hit_rate=F.avg(hit), ret=F.avg("ret")))


@query(sql("p", f"""{CALLS}, dy AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS back FROM (SELECT DISTINCT date FROM sc WHERE bucket IS NOT NULL) AS x), z AS (SELECT sc.* FROM sc JOIN dy ON dy.date = sc.date WHERE back <= 90 AND bucket IS NOT NULL AND direction <> 'flat')
SELECT coalesce(asset, 'all') AS asset, count(*) AS n, round(avg(CASE WHEN bucket = direction THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN bucket = direction THEN 1.0 ELSE 0.0 END) FILTER (direction = 'up'), 6) AS up_calls FROM z GROUP BY GROUPING SETS ((asset), ())"""), dates="")
def agg45_recent_accuracy(spark, sf_dir):
    """Directional calls of the last 90 settled days, overall and by asset; neutral calls don't count."""
    x = _calls(spark, sf_dir).filter("bucket is not null")
    days = x.select("date").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.desc("date")))).filter("back <= 90").drop("back")
    hit = (F.col("bucket") == F.col("direction")).cast("double")
    z = x.join(days, "date").filter("direction <> 'flat'").rollup("asset").agg(F.count("*").alias("n"), *_r(accuracy=F.avg(hit), up_calls=F.avg(F.when(F.col("direction") == "up", hit))))
    return z.withColumn("asset", F.coalesce("asset", F.lit("all")))


@query(sql("p", f"{CALLS} SELECT asset, CASE WHEN year(date) < 1998 THEN 'v1' ELSE 'v2' END AS version, count(bucket) AS settled, round(avg(CASE WHEN bucket = direction THEN 1.0 ELSE 0.0 END) FILTER (bucket IS NOT NULL), 6) AS hit_rate, min(date) AS first, max(date) AS last FROM sc GROUP BY 1, 2"), dates="first last")
def agg41_by_version(spark, sf_dir):
    hit = F.when(F.col("bucket").isNotNull(), (F.col("bucket") == F.col("direction")).cast("double"))
    by = _calls(spark, sf_dir).groupBy("asset", F.when(F.year("date") < 1998, "v1").otherwise("v2").alias("version"))
    return by.agg(F.count("bucket").alias("settled"), F.round(F.avg(hit), 6).alias("hit_rate"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(sql("p", f"{CALLS}, w AS (SELECT asset, year(date) AS year, CASE WHEN bucket = direction THEN 1.0 WHEN bucket IS NOT NULL THEN 0.0 END AS hit FROM sc), s AS (SELECT asset, year, avg(hit) AS rate, count(hit) AS n FROM w GROUP BY 1, 2) SELECT asset, year, n, round(rate, 6) AS rate, round(rate - lag(rate) OVER (PARTITION BY asset ORDER BY year), 6) AS change FROM s"), dates="")
def q45_scorecard(spark, sf_dir):
    hit = F.when(F.col("bucket").isNotNull(), (F.col("bucket") == F.col("direction")).cast("double"))
    s = _calls(spark, sf_dir).groupBy("asset", F.year("date").cast("long").alias("year")).agg(F.count("bucket").alias("n"), F.avg(hit).alias("rate"))
    return s.select("asset", "year", "n", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - F.lag("rate").over(Window.partitionBy("asset").orderBy("year")), 6).alias("change"))


# ---- portfolios ------------------------------------------------------------------------

ALL = "ROWS UNBOUNDED PRECEDING"
BOOKS = f"""{RET}, x AS (SELECT asset, date, value, r, CASE WHEN count(value) OVER w >= 50 THEN CASE WHEN value > avg(value) OVER w THEN 1 ELSE 0 END ELSE 1 END AS pos FROM r WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, coalesce(lag(pos) {O}, 0) AS held FROM x), eq AS (SELECT 'hold' AS strategy, asset, date, sum(coalesce(ln(1 + r), 0)) OVER (PARTITION BY asset ORDER BY date {ALL}) AS g, 1 AS pos FROM y UNION ALL SELECT 'trend', asset, date, sum(coalesce(ln(1 + r), 0) * held) OVER (PARTITION BY asset ORDER BY date {ALL}), pos FROM y)"""


def _books(spark, sf_dir):
    """Growth of buy-and-hold and of a book that holds while the price is above its mean of 50 rows."""
    x = _returns(spark, sf_dir)
    above = F.when(F.count("value").over(S.last(50)) >= 50, (F.col("value") > F.avg("value").over(S.last(50))).cast("int")).otherwise(1)
    x = x.withColumn("pos", above).withColumn("held", F.coalesce(S.lagged("pos"), F.lit(0)))
    step = F.coalesce(F.log1p("r"), F.lit(0.0))
    x = x.withColumn("hold", F.sum(step).over(S.so_far)).withColumn("trend", F.sum(step * F.col("held")).over(S.so_far))
    both = F.array(F.struct(F.lit("hold").alias("strategy"), F.col("hold").alias("g"), F.lit(1).alias("pos")), F.struct(F.lit("trend").alias("strategy"), F.col("trend").alias("g"), F.col("pos")))
    return x.select("asset", "date", F.inline(both))


@query(sql("p", f"{BOOKS} SELECT strategy, asset, date, round(g, 6) AS log_equity, CASE WHEN pos = lag(pos) OVER (PARTITION BY strategy, asset ORDER BY date) THEN 'HOLD' WHEN pos = 1 THEN 'BUY' WHEN lag(pos) OVER (PARTITION BY strategy, asset ORDER BY date) = 1 THEN 'SELL' ELSE 'HOLD' END AS action FROM eq"))
def q44_paper_books(spark, sf_dir):
    before = F.lag("pos").over(Window.partitionBy("strategy", "asset").orderBy("date"))
    action = F.when(F.col("pos") == before, "HOLD").when(F.col("pos") == 1, "BUY").when(before == 1, "SELL").otherwise("HOLD")
    return _books(spark, sf_dir).select("strategy", "asset", "date", F.round("g", 6).alias("log_equity"), action.alias("action"))


MOMENTUM = f"""WITH me AS (SELECT ticker, date_trunc('month', date) AS m, arg_max(close, date) AS v FROM k GROUP BY 1, 2), mm AS (SELECT *, v / lag(v, 6) OVER (PARTITION BY ticker ORDER BY m) - 1 AS mom, lead(v) OVER (PARTITION BY ticker ORDER BY m) / v - 1 AS next, lead(m) OVER (PARTITION BY ticker ORDER BY m) AS nm FROM me),
tp AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY round(mom, 9) DESC, ticker) AS k FROM mm WHERE mom IS NOT NULL), md AS (SELECT m, avg(next) AS r, string_agg(ticker, ',' ORDER BY ticker) AS holding FROM tp WHERE k <= 3 AND next IS NOT NULL GROUP BY 1)"""


@query(sql("k", f"{MOMENTUM} SELECT CAST(m AS DATE) AS date, holding, round(r, 6) AS next_month, round(exp(sum(ln(1 + r)) OVER (ORDER BY m {ALL})), 6) AS equity FROM md"))
def sta13_portfolio_replay(spark, sf_dir):
    """Monthly rebalancing into the three strongest: months are ranked apart, and equity is a running product of monthly means."""
    w, month = Series(("ticker",), "m"), Window.partitionBy("m")
    k = a.ticker_panel(spark, sf_dir).groupBy("ticker", F.trunc("date", "month").alias("m")).agg(F.max_by("close", "date").alias("v"))
    k = k.withColumn("mom", F.round(w.change("v", 6), 9)).withColumn("next", w.forward_change("v", 1)).filter("mom is not null")
    top = k.withColumn("k", F.row_number().over(month.orderBy(F.desc("mom"), "ticker"))).filter("k <= 3 and next is not null")
    md = top.groupBy("m").agg(F.avg("next").alias("r"), F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("holding"))
    equity = F.exp(F.sum(F.log1p("r")).over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)))
    return md.select(F.col("m").alias("date"), "holding", F.round("r", 6).alias("next_month"), F.round(equity, 6).alias("equity"))


BUYS = "e.side = 'buy' AND a.cash >= e.price"
SELLS = "e.side = 'sell' AND a.units > 0"
ACCOUNTS = f"""WITH RECURSIVE ev AS (SELECT user_id, CASE WHEN event_id % 5 = 0 THEN 'sell' ELSE 'buy' END AS side, abs(value) + 1 AS price, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
a AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 1000.0::DOUBLE AS cash, 0.0::DOUBLE AS units, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS gain FROM ev
UNION ALL SELECT a.user_id, e.i, CASE WHEN {BUYS} THEN a.cash - e.price WHEN {SELLS} THEN a.cash + e.price * a.units ELSE a.cash END, CASE WHEN {BUYS} THEN a.units + 1 WHEN {SELLS} THEN 0 ELSE a.units END,
CASE WHEN {BUYS} THEN (a.cost * a.units + e.price) / (a.units + 1) WHEN {SELLS} THEN 0 ELSE a.cost END, CASE WHEN {SELLS} THEN a.gain + (e.price - a.cost) * a.units ELSE a.gain END FROM a JOIN ev AS e ON e.user_id = a.user_id AND e.i = a.i + 1),
l AS (SELECT user_id, max(i) AS n FROM ev GROUP BY 1) SELECT a.user_id, n, round(cash, 4) AS cash, units, round(cost, 4) AS mean_cost, round(gain, 4) AS realised FROM a JOIN l ON l.user_id = a.user_id AND l.n = a.i"""


@query(ACCOUNTS, dates="")
def sta24_trading_account(spark, sf_dir):
    """Cash, units and mean cost of accounts that buy on clicks and sell all on refunds, folded in order.

    What an event does depends on the cash so far, so an account is a walk; accounts run in parallel.
    """

    def step(state: list, event: tuple) -> None:
        n, cash, units, cost, gain = state
        side, price = event
        if side == "buy" and cash >= price:
            cost = (cost * units + price) / (units + 1)
            units, cash = units + 1, cash - price
        elif side == "sell" and units:
            gain += (price - cost) * units
            cash, units, cost = cash + price * units, 0.0, 0.0
        state[:] = n + 1, cash, units, cost, gain

    e = a.table(spark, sf_dir, "events").filter("value is not null")
    e = e.select(F.col("user_id").cast("long").alias("user_id"), "event_id", "ts", F.when(F.col("event_id") % 5 == 0, "sell").otherwise("buy").alias("side"), (F.abs("value") + 1).alias("price"))
    fields = "n long, cash double, units double, mean_cost double, realised double"
    found = walked(e, ["user_id"], ["ts", "event_id"], ["side", "price"], lambda: [0, 1000.0, 0.0, 0.0, 0.0], step, fields)
    return found.withColumns({c: F.round(c, 4) for c in ("cash", "mean_cost", "realised")})


# ---- offerings: stages, alerts, aftermath ----------------------------------------------

STAGES = "WITH f AS (SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN 'filed' WHEN 'P' THEN 'priced' ELSE 'listed' END AS stage FROM orders), s AS (SELECT cik, stage, min(date) AS first_seen FROM f GROUP BY 1, 2)"


def _stages(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    stage = F.when(F.col("o_orderstatus") == "F", "filed").when(F.col("o_orderstatus") == "P", "priced").otherwise("listed")
    return o.select(F.col("o_custkey").alias("cik"), F.col("o_orderdate").cast("date").alias("date"), stage.alias("stage"))


@query(f"""{STAGES}, k AS (SELECT * FROM s WHERE first_seen < DATE '2000-01-01'), n AS (SELECT s.* FROM s LEFT JOIN k ON k.cik = s.cik AND k.stage = s.stage WHERE k.cik IS NULL)
SELECT cik, stage, first_seen, CASE stage WHEN 'filed' THEN 1 WHEN 'priced' THEN 2 ELSE 3 END AS rank FROM n""", dates="first_seen")
def sta20_stage_alerts(spark, sf_dir):
    """Stages first seen since the ledger was last written: what it holds never alerts again."""
    f = _stages(spark, sf_dir)
    cut = F.lit("2000-01-01").cast("date")
    held = f.filter(F.col("date") < cut).select("cik", "stage").distinct()
    new = f.groupBy("cik", "stage").agg(F.min("date").alias("first_seen")).join(held, ["cik", "stage"], "left_anti")
    return new.select("cik", "stage", "first_seen", g.stage_rank(F.col("stage")).alias("rank"))


@query(sql("p t", f"""{STAGES}, l AS (SELECT cik, first_seen, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][cik % 5 + 1] AS asset FROM s WHERE stage = 'listed'), pn AS (SELECT *, lead(value, 1) {O} AS v1, lead(value, 5) {O} AS v5, lead(value, 20) {O} AS v20, lead(date, 20) {O} AS d20 FROM p),
x AS (SELECT l.*, pn.date, pn.value, v1, v5, v20, d20 FROM l ASOF JOIN pn ON l.asset = pn.asset AND l.first_seen <= pn.date), b AS (SELECT x.*, t.value AS b0 FROM x ASOF LEFT JOIN t ON x.date >= t.date), c AS (SELECT b.*, t.value AS b1 FROM b ASOF LEFT JOIN t ON b.d20 >= t.date)
SELECT cik, asset, date, round(v1 / value - 1, 6) AS d1, round(v5 / value - 1, 6) AS d5, round(v20 / value - 1, 6) AS d20, round(v20 / value - b1 / b0, 6) AS over_market, CASE WHEN v20 IS NOT NULL THEN 'complete' ELSE 'open' END AS state FROM c"""))
def sta21_aftermath(spark, sf_dir):
    """One, five and twenty rows after a first listing, against the market."""
    names = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    listed = _stages(spark, sf_dir).filter("stage = 'listed'").groupBy("cik").agg(F.min("date").alias("first_seen")).withColumn("asset", F.get(names, (F.col("cik") % 5).cast("int")))
    p = a.daily_prices(spark, sf_dir).withColumns({f"v{h}": F.lead("value", h).over(S.ordered) for h in (1, 5, 20)}).withColumn("end", F.lead("date", 20).over(S.ordered))
    t = a.daily_total(spark, sf_dir).select(F.col("date").alias("d"), F.col("value").alias("m"))

    def priced(days):
        x = asof_join(days, p, "first_seen", "date", ["asset"], "forward").select("asset", "first_seen", "matched.*").filter("value is not null")
        x = asof_join(x, t, "date", "d").withColumn("b0", F.col("matched.m")).drop("matched")
        return asof_join(x, t, "end", "d").withColumn("b1", F.col("matched.m")).drop("matched")

    x = by_instant(listed, ["asset", "first_seen"], priced)
    rise = {f"d{h}": F.col(f"v{h}") / F.col("value") - 1 for h in (1, 5, 20)}
    over = F.col("v20") / F.col("value") - F.col("b1") / F.col("b0")
    return x.select("cik", "asset", "date", *_r(**rise, over_market=over), F.when(F.col("v20").isNotNull(), "complete").otherwise("open").alias("state"))


@query("""WITH w(name) AS (VALUES ('supplier 1'), ('supplier 12'), ('supplier')), s AS (SELECT s_suppkey, lower(replace(s_name, '#', ' ')) AS words, s_acctbal FROM supplier), h AS (SELECT s_suppkey, name FROM s JOIN w ON (' ' || words || ' ') LIKE ('% ' || name || ' %')),
m AS (SELECT s_suppkey, count(*) AS hits, min(name) AS name FROM h GROUP BY 1) SELECT s.s_suppkey, CASE WHEN hits = 1 THEN name END AS match, CASE WHEN hits = 1 THEN 'major' WHEN s_acctbal >= 5000 THEN 'notable' ELSE 'rest' END AS tier FROM s LEFT JOIN m ON m.s_suppkey = s.s_suppkey""", dates="")
def q52_offering_tiers(spark, sf_dir):
    """A curated name found as whole words marks an offering; two hits abstain."""
    s = a.table(spark, sf_dir, "supplier").select("s_suppkey", F.lower(F.regexp_replace("s_name", "#", " ")).alias("words"), "s_acctbal")
    names = ("supplier 1", "supplier 12", "supplier")
    hits = F.filter(F.array(*[F.when(has_words(F.col("words"), n), n) for n in names]), lambda x: x.isNotNull())
    s = s.withColumn("hits", hits).withColumn("match", F.when(F.size("hits") == 1, F.col("hits")[0]))
    tier = g.offering_tier(F.col("match").isNotNull(), F.lit(None).cast("double"), F.lit(False), F.col("s_acctbal") * 0.06, F.lit(True), F.lit(False))
    return s.select("s_suppkey", "match", tier.alias("tier"))


# ---- seasons, macro, monitoring, bets, output checks ---------------------------------------


@query(sql("t", f"{RT} SELECT 'month' AS unit, month(date) AS part, count(r) AS n, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS up FROM r WHERE r IS NOT NULL GROUP BY 2 UNION ALL SELECT 'weekday', isodow(date) - 1, count(r), round(avg(r), 6), round(median(r), 6), round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) FROM r WHERE r IS NOT NULL GROUP BY 2"), dates="")
def agg24_season_counts(spark, sf_dir):
    parts = F.array(F.struct(F.lit("month").alias("unit"), F.month("date").cast("long").alias("part")), F.struct(F.lit("weekday").alias("unit"), F.weekday("date").cast("long").alias("part")))
    by = _market(spark, sf_dir).filter("r is not null").select("r", F.inline(parts)).groupBy("unit", "part")
    return by.agg(F.count("r").alias("n"), *_r(mean=F.avg("r"), median=F.median("r"), up=F.avg((F.col("r") > 0).cast("double"))))


@query(sql("t", f"""WITH m AS (SELECT date_trunc('month', date) AS m, arg_max(value, date) AS v FROM t GROUP BY 1), r AS (SELECT year(m) AS year, month(m) AS month, v / lag(v) OVER (ORDER BY m) - 1 AS r FROM m)
SELECT month, count(*) AS n, count(*) FILTER (r > 0) AS rose, round(avg(r), 6) AS mean, round(median(r), 6) AS median, arg_max(year, r) AS best_year, arg_min(year, r) AS worst_year FROM r WHERE r IS NOT NULL GROUP BY 1"""), dates="")
def q48_seasonality(spark, sf_dir):
    m = a.daily_total(spark, sf_dir).groupBy(F.trunc("date", "month").alias("m")).agg(F.max_by("value", "date").alias("v"))
    r = m.select(F.year("m").cast("long").alias("year"), F.month("m").cast("long").alias("month"), Series((), "m").change("v").alias("r")).filter("r is not null").groupBy("month")
    return r.agg(F.count("*").alias("n"), F.count(F.when(F.col("r") > 0, 1)).alias("rose"), *_r(mean=F.avg("r"), median=F.median("r")), F.max_by("year", "r").alias("best_year"), F.min_by("year", "r").alias("worst_year"))


@query(sql("p t", f"""WITH pm AS (SELECT asset, date_trunc('month', date) AS m, arg_max(value, date) AS v FROM p GROUP BY 1, 2), tm AS (SELECT date_trunc('month', date) AS m, arg_max(value, date) AS v FROM t GROUP BY 1),
pc AS (SELECT asset, m, v / lag(v) OVER (PARTITION BY asset ORDER BY m) - 1 AS r, lead(v) OVER (PARTITION BY asset ORDER BY m) / v - 1 AS next FROM pm), tc AS (SELECT m, v / lag(v) OVER (ORDER BY m) - 1 AS f FROM tm)
SELECT asset, CASE WHEN f > 0 THEN 'rising' ELSE 'falling' END AS factor, count(*) AS n, round(avg(next), 6) AS next_month, round(corr(r, f), 6) AS corr, round(avg(CASE WHEN next > 0 THEN 1.0 ELSE 0.0 END), 6) AS up FROM pc JOIN tc ON tc.m = pc.m WHERE f IS NOT NULL AND r IS NOT NULL AND next IS NOT NULL GROUP BY 1, 2"""), dates="")
def q49_macro_factors(spark, sf_dir):
    month = F.trunc("date", "month").alias("m")
    w = Series(("asset",), "m")
    pc = a.daily_prices(spark, sf_dir).groupBy("asset", month).agg(F.max_by("value", "date").alias("v"))
    pc = pc.withColumn("r", w.change("v")).withColumn("next", w.forward_change("v", 1))
    tc = a.daily_total(spark, sf_dir).groupBy(month).agg(F.max_by("value", "date").alias("x")).withColumn("f", Series((), "m").change("x"))
    j = pc.join(tc, "m").filter("f is not null and r is not null and next is not null").groupBy("asset", F.when(F.col("f") > 0, "rising").otherwise("falling").alias("factor"))
    return j.agg(F.count("*").alias("n"), *_r(next_month=F.avg("next"), corr=F.corr("r", "f"), up=F.avg((F.col("next") > 0).cast("double"))))


@query(sql("p", f"""{RET}, z AS (SELECT asset, date, CASE WHEN r > 0.5 THEN 'high' WHEN r < -0.3 THEN 'low' WHEN r IS NOT NULL THEN 'mid' END AS zone FROM r), c AS (SELECT *, lag(zone) {O} AS was FROM z WHERE zone IS NOT NULL),
d AS (SELECT asset, max(date) AS last FROM p GROUP BY 1), e AS (SELECT max(date) AS today FROM p) SELECT c.asset, count(*) FILTER (was <> zone) AS changes, count(*) FILTER (was <> zone AND zone = 'low') AS to_low, max(c.date) FILTER (was <> zone) AS latest, any_value(today - last) > 5 AS stale FROM c JOIN d ON d.asset = c.asset CROSS JOIN e GROUP BY 1"""), dates="latest")
def q56_alerts(spark, sf_dir):
    """Zone changes of every asset and whether its series has gone stale."""
    r = F.col("r")
    z = _returns(spark, sf_dir).withColumn("zone", F.when(r > 0.5, "high").when(r < -0.3, "low").when(r.isNotNull(), "mid")).filter("zone is not null").select("asset", "date", "zone")
    # An asset that never leaves its zone has no changes, but a row.
    turn = S.lagged("zone") != F.col("zone")
    turns = z.withColumn("turn", turn).groupBy("asset").agg(F.count_if("turn").alias("changes"), F.count_if(F.col("turn") & (F.col("zone") == "low")).alias("to_low"), F.max(F.when(F.col("turn"), F.col("date"))).alias("latest"))
    days = a.daily_prices(spark, sf_dir).groupBy("asset").agg(F.max("date").alias("last"))
    today = days.agg(F.max("last").alias("today"))
    return days.join(today).join(turns, "asset").select("asset", "changes", "to_low", "latest", (F.datediff("today", "last") > 5).alias("stale"))


@query(sql("p", f"""WITH mo AS (SELECT asset, date_trunc('month', date) AS m, arg_max(value, date) AS v FROM p GROUP BY 1, 2), b AS (SELECT asset, CAST(m AS DATE) AS date, CASE WHEN v > lag(v) OVER w THEN 'up' ELSE 'down' END AS bet, lead(v) OVER w / v - 1 AS ret FROM mo WINDOW w AS (PARTITION BY asset ORDER BY m))
SELECT asset, date, bet, round(ret, 6) AS ret, CASE WHEN ret IS NULL THEN 'open' WHEN (ret > 0) = (bet = 'up') THEN 'won' ELSE 'lost' END AS state FROM b"""))
def q57_bets(spark, sf_dir):
    w = Series(("asset",), "date")
    mo = a.daily_prices(spark, sf_dir).groupBy("asset", F.trunc("date", "month").alias("date")).agg(F.max_by("value", "date").alias("v"))
    b = mo.withColumn("bet", F.when(F.col("v") > w.lagged("v"), "up").otherwise("down")).withColumn("ret", w.forward_change("v", 1))
    state = F.when(F.col("ret").isNull(), "open").when((F.col("ret") > 0) == (F.col("bet") == "up"), "won").otherwise("lost")
    return b.select("asset", "date", "bet", F.round("ret", 6).alias("ret"), state.alias("state"))


CHECKS = {
    "orders_positive": ("orders", "o_totalprice > 0"), "orders_status": ("orders", "o_orderstatus IN ('F', 'O', 'P')"), "items_discount": ("lineitem", "l_discount BETWEEN 0 AND 1"), "items_dates": ("lineitem", "l_shipdate IS NOT NULL"),
    "events_value": ("events", "value IS NOT NULL"), "events_type": ("events", "event_type <> ''"), "parts_size": ("part", "p_size BETWEEN 1 AND 50"), "customers_segment": ("customer", "c_mktsegment IS NOT NULL"), "documents_text": ("documents", "length(text) > 0"),
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, count(*) FILTER (({x}) IS NOT TRUE) AS failed, count(*) FILTER (({x}) IS NOT TRUE) = 0 AS ok FROM {t}" for n, (t, x) in CHECKS.items()), dates="")
def q58_output_gate(spark, sf_dir):
    """Assertions over tables; all of a table's are counted in one pass."""
    def gate(name):
        checks = {n: x for n, (t, x) in CHECKS.items() if t == name}
        counts = [F.count(F.when(~F.coalesce(F.expr(x), F.lit(False)), 1)).alias(n) for n, x in checks.items()]
        one = a.table(spark, sf_dir, name).agg(F.count("*").alias("rows"), *counts)
        rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("failed")) for n in checks])
        return one.select("rows", F.inline(rows)).select("name", "rows", "failed", (F.col("failed") == 0).alias("ok"))

    return reduce(lambda x, y: x.unionByName(y), map(gate, sorted({t for t, _ in CHECKS.values()})))
