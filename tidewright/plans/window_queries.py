"""Registered queries over windows, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import episodes
from ..operators.order_statistics import expanding_quantiles, rolling_share
from ..operators.windows import Series
from ..sources import adapters as a
from .registry import query

S = Series(("asset",), "date")
ONE = Series((), "date")
sql = a.with_views


def _r(**columns) -> list:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = a.daily_prices(spark, sf_dir)
    return prices.withColumn("r", S.change("value"))


O = "OVER (PARTITION BY asset ORDER BY date)"


def last(n: int) -> str:
    return f"OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ahead(n: int) -> str:
    return f"OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


RET = f"WITH r AS (SELECT *, value / lag(value) {O} - 1 AS r FROM p)"


@query(sql("p", f"SELECT asset, date, round(value / lag(value, 1) {O} - 1, 6) AS c1, round(value / lag(value, 5) {O} - 1, 6) AS c5, round(value / lag(value, 20) {O} - 1, 6) AS c20 FROM p"))
def win01_change(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    return p.select("asset", "date", *_r(c1=S.change("value"), c5=S.change("value", 5), c20=S.change("value", 20)))


@query(sql("p", f"SELECT asset, date, round(ln(value) - ln(lag(value) {O}), 6) AS log_return FROM p"))
def win02_log_return(spark, sf_dir):
    return a.daily_prices(spark, sf_dir).select("asset", "date", *_r(log_return=S.log_change("value")))


@query(sql("p", f"SELECT asset, date, round(lead(value, 5) {O} / value - 1, 6) AS f5, round(lead(value, 20) {O} / value - 1, 6) AS f20 FROM p"))
def win03_forward_return(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    return p.select("asset", "date", *_r(f5=S.forward_change("value", 5), f20=S.forward_change("value", 20)))


def _g(agg: str, n: int, x: str = "value", least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {last(n)} >= {least or n} THEN {agg} {last(n)} END"


@query(sql("p", f"SELECT asset, date, round({_g('avg(value)', 50)}, 6) AS m50, round({_g('avg(value)', 125)}, 6) AS m125, round({_g('avg(value)', 200)}, 6) AS m200 FROM p"))
def win04_moving_average(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    return p.select("asset", "date", *_r(**{f"m{n}": S.mean("value", n) for n in (50, 125, 200)}))


@query(sql("p", f"{RET} SELECT asset, date, round({_g('stddev_samp(r)', 20, 'r')} * sqrt(252.0), 6) AS volatility FROM r"))
def win05_volatility(spark, sf_dir):
    return _returns(spark, sf_dir).select("asset", "date", *_r(volatility=S.volatility("r", 20)))


@query(sql("p", f"""WITH s AS (SELECT *, value - lag(value) {O} AS step FROM p),
g AS (SELECT *, CASE WHEN step IS NOT NULL THEN greatest(step, 0.0) END AS up, CASE WHEN step IS NOT NULL THEN greatest(-step, 0.0) END AS down FROM s)
SELECT asset, date, round(100 - 100 / (1 + {_g('avg(up)', 14, 'up')} / ({_g('avg(down)', 14, 'down')} + 1e-10)), 6) AS rsi FROM g"""))
def win06_strength_index(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir).withColumn("step", F.col("value") - S.lagged("value"))
    return p.select("asset", "date", *_r(rsi=S.strength_index("step", 14)))


@query(sql("p", f"SELECT asset, date, round(value / {_g('max(value)', 252)} - 1, 6) AS below_high, round(value / {_g('min(value)', 252)} - 1, 6) AS above_low FROM p"))
def win07_year_range(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    v = F.col("value")
    return p.select("asset", "date", *_r(below_high=v / S.highest("value", 252) - 1, above_low=v / S.lowest("value", 252) - 1))


@query(sql("p", f"""{RET}, j AS (SELECT x.asset AS asset, y.asset AS other, x.date AS date, x.r AS rx, y.r AS ry FROM r AS x JOIN r AS y ON x.date = y.date AND x.asset < y.asset
WHERE x.r IS NOT NULL AND y.r IS NOT NULL)
SELECT asset, other, date, round(CASE WHEN count(*) OVER w >= 60 THEN corr(rx, ry) OVER w END, 6) AS rho FROM j
WINDOW w AS (PARTITION BY asset, other ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""))
def win08_rolling_correlation(spark, sf_dir):
    r = _returns(spark, sf_dir).filter("r is not null")
    other = r.select(F.col("asset").alias("other"), "date", F.col("r").alias("ry"))
    pairs = r.select("asset", "date", F.col("r").alias("rx")).join(other, "date").filter("asset < other")
    w = Series(("asset", "other"), "date")
    return pairs.select("asset", "other", "date", *_r(rho=w.correlation("rx", "ry", 60)))


@query(sql("p", f"{RET} SELECT asset, date, round({_g('sum(r)', 20, 'r')}, 6) AS momentum FROM r"))
def win09_rolling_sum(spark, sf_dir):
    return _returns(spark, sf_dir).select("asset", "date", *_r(momentum=S.total("r", 20)))


@query(sql("p", f"""WITH n AS (SELECT *, row_number() {O} AS i FROM p)
SELECT x.asset, x.date, round(CASE WHEN count(*) >= 60 THEN sum(CASE WHEN y.value <= x.value THEN 1.0 ELSE 0.0 END) / 60 END, 6) AS share
FROM n AS x JOIN n AS y ON x.asset = y.asset AND y.i BETWEEN x.i - 59 AND x.i GROUP BY x.asset, x.date"""))
def win10_self_percentile(spark, sf_dir):
    p = rolling_share(a.daily_prices(spark, sf_dir), ["asset"], "date", "value", 60, "share")
    return p.select("asset", "date", *_r(share=F.col("share")))


@query(sql("p", f"SELECT asset, date, round((value - {_g('avg(value)', 252)}) / nullif({_g('stddev_pop(value)', 252)}, 0), 6) AS z FROM p"))
def win11_z_score(spark, sf_dir):
    return a.daily_prices(spark, sf_dir).select("asset", "date", *_r(z=S.z_score("value", 252)))


@query(sql("p", f"""{RET} SELECT asset, date, round(CASE WHEN count(r) OVER w >= 250 THEN quantile_cont(r, 0.05) OVER w END, 6) AS q05 FROM r
WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def win12_expanding_quantile(spark, sf_dir):
    r = _returns(spark, sf_dir).select("asset", "date", "r")
    return expanding_quantiles(r, ["asset"], "date", "r", {"q05": 0.05}, 250).select("asset", "date", *_r(q05=F.col("q05")))


@query(sql("k", "SELECT date, ticker, round((rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(*) OVER (PARTITION BY date), 6) AS pct FROM k"))
def win13_average_rank(spark, sf_dir):
    k = a.ticker_panel(spark, sf_dir)
    day, tie = Window.partitionBy("date"), Window.partitionBy("date", "close")
    rank = F.rank().over(day.orderBy("close")) + (F.count("*").over(tie) - 1) / 2
    return k.select("date", "ticker", *_r(pct=rank / F.count("*").over(day)))


@query(sql("p", f"{RET} SELECT asset, date, round(exp(sum(ln(1 + coalesce(r, 0) / 100)) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)), 6) AS equity FROM r"))
def win14_equity_curve(spark, sf_dir):
    return _returns(spark, sf_dir).select("asset", "date", *_r(equity=S.growth(F.col("r") / 100)))


@query(sql("p", "SELECT asset, date, round(value / max(value) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM p"))
def win15_drawdown(spark, sf_dir):
    return a.daily_prices(spark, sf_dir).select("asset", "date", *_r(drawdown=S.drawdown("value")))


@query(sql("p", f"""{RET}, h AS (SELECT *, coalesce(r < 0, false) AS down FROM r),
g AS (SELECT *, sum(CASE WHEN down THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM h)
SELECT asset, date, CAST(sum(CASE WHEN down THEN 1 ELSE 0 END) OVER (PARTITION BY asset, g ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g"""))
def win16_down_streak(spark, sf_dir):
    r = _returns(spark, sf_dir)
    return episodes.run_lengths(r, F.col("r") < 0).select("asset", "date", "streak")


@query(sql("p", """SELECT asset, date, row_number() OVER (PARTITION BY asset, date_trunc('month', date) ORDER BY date) AS nr,
count(*) OVER (PARTITION BY asset, date_trunc('month', date)) AS of_month FROM p"""))
def win17_place_in_month(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir).withColumn("month", F.trunc("date", "month"))
    w = Window.partitionBy("asset", "month")
    nr = F.row_number().over(w.orderBy("date")).cast("long")
    return p.select("asset", "date", nr.alias("nr"), F.count("*").over(w).alias("of_month"))


@query(sql("p", """SELECT asset, date, date = min(date) OVER w AS is_first, date = max(date) OVER w AS is_last FROM p
WINDOW w AS (PARTITION BY asset, date_trunc('month', date))"""))
def win18_month_edges(spark, sf_dir):
    w = Window.partitionBy("asset", F.trunc("date", "month"))
    p = a.daily_prices(spark, sf_dir)
    first, final = F.col("date") == F.min("date").over(w), F.col("date") == F.max("date").over(w)
    return p.select("asset", "date", first.alias("is_first"), final.alias("is_last"))


@query(sql("p", f"{RET} SELECT asset, date, round(CASE WHEN count(r) {ahead(20)} >= 20 THEN stddev_samp(r) {ahead(20)} END * sqrt(252.0), 6) AS volatility FROM r"))
def win19_forward_volatility(spark, sf_dir):
    return _returns(spark, sf_dir).select("asset", "date", *_r(volatility=S.forward_volatility("r", 20)))


@query(sql("p", f"{RET} SELECT asset, date, round(exp(CASE WHEN count(r) {ahead(5)} >= 5 THEN sum(ln(1 + r)) {ahead(5)} END) - 1, 5) AS compounded FROM r"))
def win20_forward_compound(spark, sf_dir):
    r = _returns(spark, sf_dir)
    return r.select("asset", "date", F.round(S.forward_compound("r", 5), 5).alias("compounded"))


GRID = """WITH d AS (SELECT DISTINCT date FROM p), s AS (SELECT DISTINCT asset FROM p),
g AS (SELECT asset, date, value FROM s CROSS JOIN d LEFT JOIN p USING (asset, date))"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asset on every day, null where it has no price."""
    p = a.daily_prices(spark, sf_dir)
    days, assets = p.select("date").distinct(), p.select("asset").distinct()
    return assets.crossJoin(days).join(p, ["asset", "date"], "left")


@query(sql("p", f"""{GRID} SELECT asset, date, round(last_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS filled,
round(last_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS filled2 FROM g"""))
def win21_forward_fill(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return g.select("asset", "date", *_r(filled=S.filled("value"), filled2=S.filled("value", 2)))


@query(sql("p", f"""{RET}, f AS (SELECT asset, date, {_g('avg(value)', 50)} AS m, {_g('stddev_samp(r)', 20, 'r')} AS v FROM r)
SELECT asset, date, round(lag(m) {O}, 6) AS m, round(lag(v) {O}, 6) AS v FROM f"""))
def win22_lagged_features(spark, sf_dir):
    f = _returns(spark, sf_dir).select("asset", "date", S.mean("value", 50).alias("m"), S.deviation("r", 20).alias("v"))
    return f.select("asset", "date", *_r(m=S.lagged("m"), v=S.lagged("v")))


@query(sql("p", f"""WITH s AS (SELECT asset, date, CASE WHEN value > {_g('avg(value)', 50)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pos FROM p)
SELECT asset, date, pos, abs(pos - lag(pos) {O}) AS turnover, round(abs(pos - lag(pos) {O}) * 0.0005::DOUBLE, 6) AS cost FROM s"""))
def win23_turnover(spark, sf_dir):
    s = a.daily_prices(spark, sf_dir).withColumn("pos", F.when(F.col("value") > S.mean("value", 50), 1.0).otherwise(0.0))
    s = s.withColumn("turnover", F.abs(F.col("pos") - S.lagged("pos")))
    return s.select("asset", "date", "pos", "turnover", *_r(cost=F.col("turnover") * 0.0005))


@query(sql("p", f"SELECT asset, date, round(lag(value, 21) {O} / lag(value, 147) {O} - 1, 6) AS momentum FROM p"))
def win24_skip_momentum(spark, sf_dir):
    return a.daily_prices(spark, sf_dir).select("asset", "date", *_r(momentum=S.skip_momentum("value", 21, 147)))


@query(sql("t ev", """WITH n AS (SELECT t.date, value, CASE WHEN ev.date IS NULL THEN 0 ELSE 1 END AS hit FROM t LEFT JOIN ev ON t.date = ev.date)
SELECT date, coalesce(max(hit) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS before_event FROM n"""))
def win25_before_event(spark, sf_dir):
    t, ev = a.daily_total(spark, sf_dir), a.large_order_days(spark, sf_dir)
    n = t.join(ev.withColumn("hit", F.lit(1)), "date", "left")
    return n.select("date", F.coalesce(F.max("hit").over(ONE.ahead(3)), F.lit(0)).alias("before_event"))


@query(sql("p", f"WITH n AS (SELECT *, row_number() {O} AS i FROM p) SELECT asset, date, i AS nr FROM n WHERE (i - 1) % 21 = 0"))
def win26_block_sample(spark, sf_dir):
    n = a.daily_prices(spark, sf_dir).withColumn("nr", S.position().cast("long"))
    return n.filter((F.col("nr") - 1) % 21 == 0).select("asset", "date", "nr")


@query(sql("p", f"""WITH n AS (SELECT *, (row_number() {O} - 1) // 60 AS block FROM p),
d AS (SELECT *, value / max(value) OVER (PARTITION BY asset, block ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd, count(*) OVER (PARTITION BY asset, block) AS c FROM n)
SELECT asset, CAST(block AS BIGINT) AS block, round(min(dd), 6) AS worst FROM d WHERE c = 60 GROUP BY asset, block"""), dates="")
def win27_block_drawdown(spark, sf_dir):
    n = a.daily_prices(spark, sf_dir).withColumn("block", F.floor((S.position() - 1) / 60))
    inside = Series(("asset", "block"), "date")
    d = n.withColumn("dd", inside.drawdown("value"))
    d = d.groupBy("asset", "block").agg(F.min("dd").alias("worst"), F.count("*").alias("c")).filter("c = 60")
    return d.select("asset", "block", *_r(worst=F.col("worst")))


@query("""WITH d AS (SELECT event_type AS asset, CAST(ts AS DATE) AS date, ln(1 + count(*)) AS x FROM events GROUP BY 1, 2)
SELECT asset, date, round(CASE WHEN count(x) OVER w >= 5 THEN (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) END, 6) AS z FROM d
WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def win28_log_count_z(spark, sf_dir):
    e = a.table(spark, sf_dir, "events")
    d = e.groupBy(F.col("event_type").alias("asset"), F.col("ts").cast("date").alias("date")).agg(F.log1p(F.count("*").cast("double")).alias("x"))
    z = F.try_divide(F.col("x") - S.mean("x", 10, 5), F.nullif(S.deviation("x", 10, 5), F.lit(0.0)))
    return d.select("asset", "date", *_r(z=z))


@query(sql("p t", f"""WITH j AS (SELECT p.asset, p.date, p.value, t.value AS bench FROM p JOIN t ON p.date = t.date)
SELECT asset, date, round((lead(value, 5) {O} / value - 1) - (lead(bench, 5) {O} / bench - 1), 6) AS excess FROM j"""))
def win29_forward_excess(spark, sf_dir):
    t = a.daily_total(spark, sf_dir).withColumnRenamed("value", "bench")
    j = a.daily_prices(spark, sf_dir).join(t, "date")
    return j.select("asset", "date", *_r(excess=S.forward_change("value", 5) - S.forward_change("bench", 5)))


@query(sql("p t", f"""WITH j AS (SELECT p.asset, p.date, p.value / lag(p.value) {O.replace('asset', 'p.asset').replace('date', 'p.date')} - 1 AS y, t.value / lag(t.value) {O.replace('asset', 'p.asset').replace('date', 'p.date')} - 1 AS x FROM p JOIN t ON p.date = t.date)
SELECT asset, date, round(CASE WHEN count(y) OVER w >= 36 THEN covar_samp(y, x) OVER w / var_samp(x) OVER w END, 6) AS beta FROM j WHERE y IS NOT NULL
WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)"""))
def win30_rolling_beta(spark, sf_dir):
    t = a.daily_total(spark, sf_dir).withColumnRenamed("value", "bench")
    j = a.daily_prices(spark, sf_dir).join(t, "date")
    j = j.select("asset", "date", S.change("value").alias("y"), S.change("bench").alias("x")).filter("y is not null")
    w = S.last(36)
    beta = F.when(F.count("y").over(w) >= 36, F.covar_samp("y", "x").over(w) / F.var_samp("x").over(w))
    return j.select("asset", "date", *_r(beta=beta))


@query(sql("p", """WITH m AS (SELECT asset, CAST(date_trunc('month', date) AS DATE) AS date, arg_max(value, date) AS value FROM p GROUP BY 1, 2)
SELECT asset, date, round(value / lag(value, 1) OVER w - 1, 6) AS m1, round(value / lag(value, 3) OVER w - 1, 6) AS m3, round(value / lag(value, 12) OVER w - 1, 6) AS m12
FROM m WINDOW w AS (PARTITION BY asset ORDER BY date)"""))
def win31_monthly_changes(spark, sf_dir):
    p = a.daily_prices(spark, sf_dir)
    m = p.groupBy("asset", F.trunc("date", "month").alias("month")).agg(F.max_by("value", "date").alias("value"))
    m = m.withColumnRenamed("month", "date")
    return m.select("asset", "date", *_r(m1=S.change("value"), m3=S.change("value", 3), m12=S.change("value", 12)))
