"""Registered event, risk and regime studies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as f
from ..operators import episodes as e
from ..operators import models as m
from ..operators import resampling as b
from ..operators import significance as s
from ..operators.joins import asof_join
from ..operators.windows import Series
from ..sources import adapters as a
from .discovery_queries import OD, ONE, RT, _market
from .registry import query
from .window_queries import O, RET, _r, _returns, ahead, last

S = Series(("asset",), "date")
sql = a.with_views
UP = "CASE WHEN {0} > 0 THEN 1.0 WHEN {0} IS NOT NULL THEN 0.0 END"

# ---- event studies --------------------------------------------------------------

CAR = f"""{RT}, n AS (SELECT *, row_number() {OD} AS i FROM r), ln1 AS (SELECT *, CASE WHEN count(r) OVER w30 >= 15 THEN exp(sum(ln(1 + r)) OVER w30) - 1 END AS car, avg({UP.format('r')}) OVER w30 AS wr, count(r) OVER w30 AS k FROM n WINDOW w30 AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
hit AS (SELECT ev.date AS event, ln1.date, ln1.car, ln1.wr FROM ev ASOF JOIN ln1 ON ev.date < ln1.date)"""


def _after(spark, sf_dir, days=30):
    """Each event with the compounded return and the share of rising days of the rows after it."""
    w = ONE.rows(0, days - 1)
    up = F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))
    t = _market(spark, sf_dir).withColumn("car", F.when(F.count("r").over(w) >= days // 2, F.exp(F.sum(F.log1p("r")).over(w)) - 1)).withColumn("wr", F.avg(up).over(w))
    ev = a.large_order_days(spark, sf_dir).withColumnRenamed("date", "event")
    found = asof_join(ev, t.select("date", "car", "wr"), "event", "date", direction="forward", exact=False)
    return found.select("event", "matched.*").filter("car is not null")


@query(sql("t ev", f"""{CAR}, base AS (SELECT avg({UP.format('r')}) AS up FROM r WHERE r IS NOT NULL)
SELECT date_part('year', event) AS year, count(*) AS n, round(avg(car), 6) AS mean, round(median(car), 6) AS median, round(avg(wr), 6) AS win_rate, round(avg(wr) / any_value(up), 6) AS ratio FROM hit CROSS JOIN base WHERE car IS NOT NULL GROUP BY 1"""), dates="")
def q24_event_study(spark, sf_dir):
    base = _market(spark, sf_dir).filter("r is not null").agg(F.avg((F.col("r") > 0).cast("double")).alias("up"))
    x = _after(spark, sf_dir).join(base).groupBy(F.year("event").cast("long").alias("year"))  # one row
    return x.agg(F.count("*").alias("n"), *_r(mean=F.avg("car"), median=F.median("car"), win_rate=F.avg("wr"), ratio=F.avg("wr") / F.first("up")))


@query(sql("t ev", f"""{CAR}, pk AS (SELECT car, date, row_number() OVER (ORDER BY md5('window:' || CAST(date AS VARCHAR))) AS k FROM ln1 WHERE i >= 2 AND i <= (SELECT max(i) FROM n) - 30), rw AS (SELECT avg(car) AS base, stddev_pop(car) AS spread, count(*) AS windows FROM pk WHERE k <= 500)
SELECT count(*) AS n, any_value(windows) AS windows, round(avg(car), 6) AS mean, round(any_value(base), 6) AS base, round((avg(car) - any_value(base)) / (stddev_samp(car) / sqrt(count(*))), 6) AS t FROM hit CROSS JOIN rw WHERE car IS NOT NULL"""), dates="")
def udf20_random_windows(spark, sf_dir):
    """Events against 500 windows that a seeded hash of their first day picks."""
    w = ONE.rows(0, 29)
    t = _market(spark, sf_dir).withColumn("i", ONE.position()).withColumn("n", F.count("*").over(Window.partitionBy()))
    t = t.withColumn("car", F.when(F.count("r").over(w) >= 15, F.exp(F.sum(F.log1p("r")).over(w)) - 1)).filter("i >= 2 and i <= n - 30")
    picked = t.withColumn("h", F.md5(F.concat(F.lit("window:"), F.col("date").cast("string")))).orderBy("h").limit(500)  # the null's size
    base = picked.agg(F.avg("car").alias("base"), F.count("*").alias("windows"))
    x = _after(spark, sf_dir).join(base)  # one row
    t = (F.avg("car") - F.first("base")) / (F.stddev_samp("car") / F.sqrt(F.count("*")))
    return x.agg(F.count("*").alias("n"), F.first("windows").alias("windows"), *_r(mean=F.avg("car"), base=F.first("base"), t=t))


@query(dates="")
def udf05_event_bootstrap(spark, sf_dir):
    """Intervals of mean, rising share and difference when events are drawn again, by year."""
    t = _market(spark, sf_dir).withColumn("f", F.when(F.count("r").over(ONE.ahead(30)) >= 30, F.exp(F.sum(F.log1p("r")).over(ONE.ahead(30))) - 1))
    base = t.agg(F.avg("f").alias("base"))

    def test(frame, seed):
        return b.event_bootstrap(frame["car"].to_numpy(), float(frame["base"].iloc[0]), 2000, seed)

    x = _after(spark, sf_dir).join(base).withColumn("year", F.year("event"))  # one row
    schema = "year int, mean double, mean_low double, mean_high double, up double, up_low double, up_high double, diff_low double, diff_high double, n long"
    return b.per_group(x, ["year"], "event", schema, test)


@query(dates="")
def udf19_event_impact(spark, sf_dir):
    """Every asset's gap to its controls after each quarter's start: 120 rows before, 20 after.

    A group is one asset's event with its window of 140 rows, so groups are small
    and as many as there are events.
    """
    r = _returns(spark, sf_dir).filter("r is not null").withColumn("r", F.log1p("r"))
    days = r.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    start = F.trunc("date", "quarter")
    events = days.groupBy(start.alias("event")).agg(F.min("i").alias("at")).filter("at > 120")
    near = events.withColumn("step", F.explode(F.sequence(F.lit(-120), F.lit(19)))).withColumn("i", F.col("at") + F.col("step"))
    rows = near.join(days, "i").join(r.select("date", "asset", "r"), "date").select("event", "step", "asset", "r")
    treated = rows.select("event", F.col("asset").alias("treated")).distinct()
    rows = rows.join(treated, "event")

    def test(frame, seed):
        wide = frame.pivot_table(index="step", columns="asset", values="r").reindex(range(-120, 20)).fillna(0.0)
        name = frame["treated"].iloc[0]
        return m.event_impact(wide[name].to_numpy(), wide.drop(columns=name).to_numpy(), 120, 20, 2000, seed)

    schema = "event date, treated string, effect double, p double, r2 double, n_pre long"
    found = b.per_group(rows, ["event", "treated"], "step", schema, test)
    return found.withColumn("usable", F.col("r2") >= 0.30).withColumn("event", F.col("event").cast("string"))


@query(dates="")
def q25_counterfactual(spark, sf_dir):
    """Events by asset: how many are fitted well enough, how many stand out, and the mean gap of those."""
    x = udf19_event_impact(spark, sf_dir).groupBy("treated")
    usable = F.col("usable")
    notable = usable & (F.col("p") < 0.05)
    return x.agg(F.count("*").alias("events"), F.count(F.when(usable, 1)).alias("usable"), F.count(F.when(notable, 1)).alias("notable"), F.avg(F.when(usable, F.col("effect"))).alias("effect"))


@query(sql("t ev", f"""{RT}, n AS (SELECT *, row_number() {OD} AS i FROM r), x AS (SELECT DISTINCT n.i FROM ev ASOF JOIN n ON ev.date > n.date), l AS (SELECT n.*, n.i IN (SELECT i FROM x) AS eve FROM n WHERE r IS NOT NULL)
SELECT CAST(floor(year(date) / 10.0) * 10 AS BIGINT) AS decade, count(*) FILTER (eve) AS n_eve, round(avg(r) FILTER (eve), 6) AS eve, round(avg(r) FILTER (NOT eve), 6) AS other, round(avg(r) FILTER (eve) - avg(r) FILTER (NOT eve), 6) AS drift FROM l GROUP BY 1"""), dates="")
def q26_drift_before(spark, sf_dir):
    t = _market(spark, sf_dir)
    ev = a.large_order_days(spark, sf_dir).withColumnRenamed("date", "event")
    eves = asof_join(ev, t.select("date"), "event", "date", exact=False).select("matched.date").filter("date is not null").distinct().withColumn("eve", F.lit(True))
    x = t.filter("r is not null").join(eves, "date", "left").withColumn("eve", F.coalesce("eve", F.lit(False)))
    on, off = F.avg(F.when(F.col("eve"), F.col("r"))), F.avg(F.when(~F.col("eve"), F.col("r")))
    by = x.groupBy((F.floor(F.year("date") / 10) * 10).alias("decade"))
    return by.agg(F.count(F.when(F.col("eve"), 1)).alias("n_eve"), *_r(eve=on, other=off, drift=on - off))


# ---- drawdowns, spikes, sentiment, rates, regimes --------------------------------

DROPS = (0.05, 0.10, 0.20, 0.30)
DROP_SQL = f"""d AS (SELECT asset, date, value, value / max(value) {last(252)} - 1 AS dd, lead(value, 60) {O} / value - 1 AS f60, lead(value, 252) {O} / value - 1 AS f252 FROM p)"""


def _dips(spark, sf_dir):
    high = F.max("value").over(S.last(252))
    p = a.daily_prices(spark, sf_dir)
    return p.select("asset", "date", (F.col("value") / high - 1).alias("dd"), S.forward_change("value", 60).alias("f60"), S.forward_change("value", 252).alias("f252"))


@query(sql("p", f"""WITH {DROP_SQL}, x(least) AS (VALUES {', '.join(f'({x})' for x in DROPS)}), w AS (SELECT d.*, least, sum(CASE WHEN dd >= -least / 2 THEN 1 ELSE 0 END) OVER (PARTITION BY asset, least ORDER BY date ROWS UNBOUNDED PRECEDING) AS epoch FROM d CROSS JOIN x),
h AS (SELECT * FROM w WHERE dd <= -least) SELECT asset, least::DOUBLE AS least, count(*) AS days, count(DISTINCT epoch) AS episodes, round(avg(f60), 6) AS f60, round(avg({UP.format('f60')}), 6) AS up60, round(avg(f252), 6) AS f252, round(avg({UP.format('f252')}), 6) AS up252 FROM h GROUP BY 1, 2"""), dates="")
def q28_dip_and_hold(spark, sf_dir):
    x = _dips(spark, sf_dir).withColumn("least", F.explode(F.array(*map(F.lit, DROPS))))
    hits = e.armed_episodes(x, F.col("dd") <= -F.col("least"), F.col("dd") >= -F.col("least") / 2, ("asset", "least"))
    up = lambda c: F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double")))
    by = hits.groupBy("asset", "least")
    return by.agg(F.count("*").alias("days"), F.max("episode").cast("long").alias("episodes"), *_r(f60=F.avg("f60"), up60=up("f60"), f252=F.avg("f252"), up252=up("f252")))


@query(dates="")
def q28_dip_intervals(spark, sf_dir):
    """Mean 60-row return after a 10 % fall, with an interval over episodes."""
    hits = e.armed_episodes(_dips(spark, sf_dir), F.col("dd") <= -0.10, F.col("dd") >= -0.05).filter("f60 is not null")

    def test(frame, seed):
        return b.cluster_bootstrap(frame["f60"].to_numpy(), frame["episode"].to_numpy(), 2000, seed)

    return b.per_group(hits, ["asset"], "date", "asset string, mean double, low double, high double, clusters long, n long", test)


SPIKE_HOLD = (5, 20, 60, 120)


@query(sql("p", f"""{RET}, v AS (SELECT asset, date, value, CASE WHEN count(r) {last(20)} >= 20 THEN stddev_samp(r) {last(20)} END AS v FROM r), q AS (SELECT asset, quantile_cont(v, 0.8) AS q80, quantile_cont(v, 0.95) AS q95 FROM v GROUP BY 1),
c AS (SELECT v.*, q80, q95, lag(v) {O.replace('asset', 'v.asset').replace('date', 'v.date')} AS was, {', '.join(f"lead(value, {h + 1}) OVER (PARTITION BY v.asset ORDER BY v.date) / lead(value, 1) OVER (PARTITION BY v.asset ORDER BY v.date) - 1 AS f{h}" for h in SPIKE_HOLD)} FROM v JOIN q ON q.asset = v.asset),
k AS (SELECT *, 'cross80' AS kind FROM c WHERE v >= q80 AND was < q80 UNION ALL SELECT *, 'cross95' FROM c WHERE v >= q95 AND was < q95 UNION ALL SELECT *, 'jump' FROM c WHERE v >= was * 1.2 AND v >= q80)
SELECT asset, kind, count(*) AS n, {', '.join(f"round(avg(f{h}), 6) AS f{h}, round(avg({UP.format(f'f{h}')}), 6) AS up{h}" for h in SPIKE_HOLD)} FROM k GROUP BY 1, 2"""), dates="")
def q29_volatility_spikes(spark, sf_dir):
    """Returns from the row after a spike on, by kind of spike."""
    x = _returns(spark, sf_dir).withColumn("v", S.deviation("r", 20)).withColumn("was", S.lagged("v"))
    entry = F.lead("value").over(S.ordered)
    x = x.withColumns({f"f{h}": F.lead("value", h + 1).over(S.ordered) / entry - 1 for h in SPIKE_HOLD})
    q = x.groupBy("asset").agg(F.percentile("v", F.lit(0.8)).alias("q80"), F.percentile("v", F.lit(0.95)).alias("q95"))
    v, was = F.col("v"), F.col("was")
    kinds = F.array(
        F.when((v >= F.col("q80")) & (was < F.col("q80")), "cross80"), F.when((v >= F.col("q95")) & (was < F.col("q95")), "cross95"), F.when((v >= was * 1.2) & (v >= F.col("q80")), "jump")
    )
    k = x.join(q, "asset").withColumn("kind", F.explode(F.array_compact(kinds))).groupBy("asset", "kind")
    up = lambda c: F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double")))
    return k.agg(F.count("*").alias("n"), *_r(**{n: x for h in SPIKE_HOLD for n, x in ((f"f{h}", F.avg(f"f{h}")), (f"up{h}", up(f"f{h}")))}))


GREED = f"""{RT}, c1 AS (SELECT date, value, r, CASE WHEN count(value) OVER w125 >= 125 THEN value / avg(value) OVER w125 - 1 END AS trend, CASE WHEN count(r) OVER w20 >= 20 THEN stddev_samp(r) OVER w20 END AS vol, CASE WHEN count(value) OVER w252 >= 252 THEN (value - min(value) OVER w252) / (max(value) OVER w252 - min(value) OVER w252) END AS place, lead(value, 20) {OD} / value - 1 AS f FROM r
WINDOW w125 AS (ORDER BY date ROWS BETWEEN 124 PRECEDING AND CURRENT ROW), w20 AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w252 AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
c2 AS (SELECT *, CASE WHEN trend IS NOT NULL THEN least(greatest(50 + trend * 500, 0), 100) END AS s1, CASE WHEN vol IS NOT NULL THEN (1 - percent_rank() OVER (PARTITION BY vol IS NULL ORDER BY vol)) * 100 END AS s2, place * 100 AS s3 FROM c1),
c3 AS (SELECT *, CASE WHEN (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT >= 2 THEN (coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)) / ((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT) END AS score FROM c2),
c4 AS (SELECT *, round(score, 6) AS sc FROM c3), c5 AS (SELECT *, CASE WHEN sc <= 25 THEN 'extreme fear' WHEN sc <= 45 THEN 'fear' WHEN sc <= 55 THEN 'neutral' WHEN sc < 75 THEN 'greed' WHEN sc IS NOT NULL THEN 'extreme greed' END AS band FROM c4)"""


def _greed(spark, sf_dir):
    """Composite 0-100 of trend, calm and place in the year's range."""
    t = _market(spark, sf_dir).withColumn("vol", ONE.deviation("r", 20)).withColumn("trend", F.col("value") / ONE.mean("value", 125) - 1)
    low, high = ONE.lowest("value", 252), ONE.highest("value", 252)
    known = F.col("vol").isNotNull()
    t = t.withColumn("place", (F.col("value") - low) / (high - low)).withColumn("f", ONE.forward_change("value", 20))
    calm = F.when(known, (1 - F.percent_rank().over(Window.partitionBy(known).orderBy("vol"))) * 100)
    trend = F.when(F.col("trend").isNotNull(), F.least(F.greatest(50 + F.col("trend") * 500, F.lit(0.0)), F.lit(100.0)))
    t = t.withColumn("sc", F.round(f.row_mean(trend, calm, F.col("place") * 100), 6))
    return t.withColumn("band", F.when(F.col("sc").isNotNull(), f.band(F.col("sc"))))


@query(sql("t", f"{GREED} SELECT date, sc AS score, band FROM c5 WHERE sc IS NOT NULL"))
def q30_greed_index(spark, sf_dir):
    return _greed(spark, sf_dir).filter("sc is not null").select("date", F.col("sc").alias("score"), "band")


@query(sql("t", f"{GREED}, b AS (SELECT avg(f) AS base FROM c5 WHERE sc IS NOT NULL AND f IS NOT NULL) SELECT band, count(*) AS n, round(avg(f), 6) AS mean, round(avg(f) - any_value(base), 6) AS over_base, round(avg({UP.format('f')}), 6) AS up FROM c5 CROSS JOIN b WHERE sc IS NOT NULL AND f IS NOT NULL GROUP BY 1"), dates="")
def q30_contrarian(spark, sf_dir):
    x = _greed(spark, sf_dir).filter("sc is not null and f is not null")
    x = x.join(x.agg(F.avg("f").alias("base")))  # one row
    return x.groupBy("band").agg(F.count("*").alias("n"), *_r(mean=F.avg("f"), over_base=F.avg("f") - F.first("base"), up=F.avg((F.col("f") > 0).cast("double"))))


LEVELS = f"""WITH j AS (SELECT p.asset, p.date, p.value, wr.value AS level, wr.report_date FROM p ASOF JOIN wr ON p.date >= wr.usable_from), w AS (SELECT report_date, value - lag(value, 4) OVER (ORDER BY report_date) AS chg FROM wr),
x AS (SELECT j.*, chg, lead(j.value, 20) OVER (PARTITION BY asset ORDER BY date) / j.value - 1 AS f20, lead(j.value, 60) OVER (PARTITION BY asset ORDER BY date) / j.value - 1 AS f60 FROM j JOIN w ON w.report_date = j.report_date),
q AS (SELECT quantile_cont(value, 0.333) AS lo, quantile_cont(value, 0.667) AS hi FROM wr)"""


@query(sql("p wr", f"""{LEVELS} SELECT asset, CASE WHEN level <= lo THEN 'low' WHEN level >= hi THEN 'high' ELSE 'middle' END AS zone, CASE WHEN chg > 0 THEN 'rising' ELSE 'falling' END AS direction, count(*) AS n,
round(avg(f20), 6) AS f20, round(avg({UP.format('f20')}), 6) AS up20, round(avg(f60), 6) AS f60 FROM x CROSS JOIN q WHERE chg IS NOT NULL GROUP BY 1, 2, 3"""), dates="")
def q31_level_and_direction(spark, sf_dir):
    wr = a.weekly_reports(spark, sf_dir)
    wr = wr.withColumn("chg", F.col("value") - F.lag("value", 4).over(Window.orderBy("report_date"))).withColumnRenamed("value", "level")
    q = wr.agg(F.percentile("level", F.lit(0.333)).alias("lo"), F.percentile("level", F.lit(0.667)).alias("hi"))
    x = asof_join(a.daily_prices(spark, sf_dir), wr, "date", "usable_from").select("asset", "date", "value", "matched.level", "matched.chg").filter("level is not null")
    x = x.withColumn("f20", S.forward_change("value", 20)).withColumn("f60", S.forward_change("value", 60)).filter("chg is not null").join(q)  # one row
    zone = F.when(F.col("level") <= F.col("lo"), "low").when(F.col("level") >= F.col("hi"), "high").otherwise("middle")
    up = F.avg(F.when(F.col("f20").isNotNull(), (F.col("f20") > 0).cast("double")))
    by = x.groupBy("asset", zone.alias("zone"), F.when(F.col("chg") > 0, "rising").otherwise("falling").alias("direction"))
    return by.agg(F.count("*").alias("n"), *_r(f20=F.avg("f20"), up20=up, f60=F.avg("f60")))


REGIMES = f"""{RET}, t1 AS (SELECT *, CASE WHEN count(value) {last(50)} >= 50 THEN avg(value) {last(50)} END AS ma, CASE WHEN count(r) {last(20)} >= 20 THEN stddev_samp(r) {last(20)} END AS v, lead(value, 21) {O} / value - 1 AS f21, lead(value, 63) {O} / value - 1 AS f63 FROM r),
t2 AS (SELECT asset, quantile_cont(v, 0.333) AS lo, quantile_cont(v, 0.667) AS hi FROM t1 GROUP BY 1), t3 AS (SELECT t1.*, CASE WHEN value > ma THEN 'up' ELSE 'down' END || '-' || CASE WHEN v <= lo THEN 'calm' WHEN v >= hi THEN 'wild' ELSE 'usual' END AS state FROM t1 JOIN t2 ON t2.asset = t1.asset WHERE ma IS NOT NULL AND v IS NOT NULL),
t4 AS (SELECT *, CASE WHEN state = lag(state) {O} THEN 0 ELSE 1 END AS turn FROM t3)"""


@query(sql("p", f"{REGIMES} SELECT asset, state, count(*) AS n, CAST(sum(turn) AS BIGINT) AS episodes, round(avg(f21), 6) AS f21, round(quantile_cont(f21, 0.05), 6) AS low21, round(avg(f63), 6) AS f63, round(avg({UP.format('f63')}), 6) AS up63 FROM t4 GROUP BY 1, 2"), dates="")
def q32_regime_forward(spark, sf_dir):
    """Six states of trend and volatility, their episodes and what followed."""
    x = _returns(spark, sf_dir).withColumn("ma", S.mean("value", 50)).withColumn("v", S.deviation("r", 20))
    x = x.withColumn("f21", S.forward_change("value", 21)).withColumn("f63", S.forward_change("value", 63))
    q = x.groupBy("asset").agg(F.percentile("v", F.lit(0.333)).alias("lo"), F.percentile("v", F.lit(0.667)).alias("hi"))
    x = x.join(q, "asset").filter("ma is not null and v is not null")
    vol = F.when(F.col("v") <= F.col("lo"), "calm").when(F.col("v") >= F.col("hi"), "wild").otherwise("usual")
    x = x.withColumn("state", F.concat_ws("-", F.when(F.col("value") > F.col("ma"), "up").otherwise("down"), vol))
    x = x.withColumn("turn", F.when(F.col("state") == S.lagged("state"), 0).otherwise(1))
    up = F.avg(F.when(F.col("f63").isNotNull(), (F.col("f63") > 0).cast("double")))
    return x.groupBy("asset", "state").agg(F.count("*").alias("n"), F.sum("turn").alias("episodes"), *_r(f21=F.avg("f21"), low21=F.percentile("f21", F.lit(0.05)), f63=F.avg("f63"), up63=up))


HOLDS = (126, 252, 504)


@query(sql("p", f"""WITH x AS (SELECT asset, unnest([{', '.join(f"{{'h': {h}, 'f': lead(value, {h}) {O} / value - 1}}" for h in HOLDS)}], recursive := true) FROM p)
SELECT asset, h, count(f) AS n, round(avg({UP.format('f')}), 6) AS up, round(avg(f), 6) AS mean, round(median(f), 6) AS median, round(quantile_cont(f, 0.05), 6) AS worst FROM x WHERE f IS NOT NULL GROUP BY 1, 2"""), dates="")
def q34_holding_base_rates(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), S.forward_change("value", h).alias("f")) for h in HOLDS])
    x = a.daily_prices(spark, sf_dir).withColumn("p", pairs).select("asset", F.inline("p")).filter("f is not null").groupBy("asset", "h")
    return x.agg(F.count("*").alias("n"), *_r(up=F.avg((F.col("f") > 0).cast("double")), mean=F.avg("f"), median=F.median("f"), worst=F.percentile("f", F.lit(0.05))))


# ---- risk ------------------------------------------------------------------------

SPLITS = """dd AS (SELECT date, ntile(10) OVER (ORDER BY date) - 1 AS slice FROM (SELECT DISTINCT date FROM r) AS x), aa AS (SELECT DISTINCT asset FROM r), gr AS (SELECT asset, dd.date, slice FROM dd CROSS JOIN aa),
sl AS (SELECT gr.asset, slice, count(*) AS n, sum(coalesce(r, 0)) AS s, sum(coalesce(r, 0) * coalesce(r, 0)) AS q FROM gr LEFT JOIN r ON r.asset = gr.asset AND r.date = gr.date GROUP BY 1, 2),
cb AS (SELECT c FROM (SELECT unnest(range(1024)) AS c) AS x WHERE bit_count(c) = 5), mo AS (SELECT c, asset, (c >> slice) & 1 AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM cb CROSS JOIN sl GROUP BY 1, 2, 3),
sh AS (SELECT c, asset, inside, round(s / n / greatest(sqrt(greatest(q - s * s / n, 0) / (n - 1)), 1e-12), 9) AS sharpe FROM mo), pi AS (SELECT i.c, i.asset, i.sharpe AS i, o.sharpe AS o FROM sh AS i JOIN sh AS o ON o.c = i.c AND o.asset = i.asset WHERE i.inside = 1 AND o.inside = 0),
be AS (SELECT c, arg_max(o, (i, asset)) AS best FROM pi GROUP BY 1), wk AS (SELECT pi.c, count(*) FILTER (o <= best) / (count(*) + 1.0::DOUBLE) AS w FROM pi JOIN be ON be.c = pi.c GROUP BY 1)"""


def _splits(spark, sf_dir, slices=10):
    """Sharpe ratios inside and outside of every symmetric split, from each slice's moments."""
    r = _returns(spark, sf_dir).select("asset", "date", F.coalesce("r", F.lit(0.0)).alias("r"))
    days = r.select("date").distinct().withColumn("slice", F.ntile(slices).over(Window.orderBy("date")) - 1)
    sums = r.join(days, "date").groupBy("asset", "slice").agg(F.sum("r").alias("s"), F.sum(F.col("r") ** 2).alias("q"))
    sizes = days.groupBy("slice").agg(F.count("*").alias("n"))  # days without a row count as 0
    grid = r.select("asset").distinct().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    moments = grid.join(sizes, "slice").join(sums, ["asset", "slice"], "left").fillna(0.0, ["s", "q"])
    chosen = F.filter(F.sequence(F.lit(0), F.lit((1 << slices) - 1)), lambda c: F.bit_count(c) == slices // 2)
    x = moments.withColumn("c", F.explode(chosen)).withColumn("inside", F.expr("shiftright(c, slice) & 1"))
    x = x.groupBy("c", "asset", "inside").agg(*[F.sum(k).alias(k) for k in ("n", "s", "q")])
    spread = F.sqrt(F.greatest(F.col("q") - F.col("s") ** 2 / F.col("n"), F.lit(0.0)) / (F.col("n") - 1))
    x = x.withColumn("sharpe", F.round(F.col("s") / F.col("n") / F.greatest(spread, F.lit(1e-12)), 9))
    on = F.col("inside") == 1
    return x.groupBy("c", "asset").agg(F.max(F.when(on, F.col("sharpe"))).alias("i"), F.max(F.when(~on, F.col("sharpe"))).alias("o"))


def _overfit(spark, sf_dir):
    x = _splits(spark, sf_dir)
    best = x.groupBy("c").agg(F.max_by("o", F.struct("i", "asset")).alias("best"))
    return x.join(best, "c").groupBy("c").agg((F.count(F.when(F.col("o") <= F.col("best"), 1)) / (F.count("*") + 1.0)).alias("w"))


@query(sql("p", f"{RET}, {SPLITS} SELECT round(avg(CASE WHEN w <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pbo, count(*) AS splits, round(median(ln(w / (1 - w))), 6) AS median_logit FROM wk"), dates="")
def udf17_overfit_probability(spark, sf_dir):
    w = F.col("w")
    return _overfit(spark, sf_dir).agg(F.round(F.avg((w <= 0.5).cast("double")), 6).alias("pbo"), F.count("*").alias("splits"), F.round(F.median(F.ln(w / (1 - w))), 6).alias("median_logit"))


@query(sql("p", f"{RET}, {SPLITS}, wi AS (SELECT c, arg_max(asset, (i, asset)) AS asset FROM pi GROUP BY 1) SELECT wi.asset, count(*) AS chosen, round(avg(w), 6) AS mean_rank, round(avg(CASE WHEN w <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS below FROM wi JOIN wk ON wk.c = wi.c GROUP BY 1"), dates="")
def q17_overfitting(spark, sf_dir):
    """Which asset wins in sample, how often, and where it ends up out of sample."""
    won = _splits(spark, sf_dir).groupBy("c").agg(F.max_by("asset", F.struct("i", "asset")).alias("asset"))
    x = won.join(_overfit(spark, sf_dir), "c").groupBy("asset")
    return x.agg(F.count("*").alias("chosen"), F.round(F.avg("w"), 6).alias("mean_rank"), F.round(F.avg((F.col("w") <= 0.5).cast("double")), 6).alias("below"))


VOLS = f"""{RET}, v AS (SELECT asset, date, round(CASE WHEN count(r) {last(20)} >= 20 THEN stddev_samp(r) {last(20)} END, 9) AS v, round(CASE WHEN count(r) {last(60)} >= 60 THEN stddev_samp(r) {last(60)} END, 9) AS v60, CASE WHEN count(r) {ahead(20)} >= 20 THEN stddev_samp(r) {ahead(20)} END AS next FROM r),
q AS (SELECT asset, quantile_cont(next, 0.5) AS q FROM v WHERE date < DATE '1999-01-01' GROUP BY 1), y AS (SELECT v.asset, v, v60, CASE WHEN next > q THEN 1 ELSE 0 END AS y FROM v JOIN q ON q.asset = v.asset WHERE date >= DATE '1999-01-01' AND next IS NOT NULL AND v IS NOT NULL AND v60 IS NOT NULL)"""


def _states(spark, sf_dir):
    """Rows of the holdout with two volatility scores and whether the next 20 rows were wild by the earlier median."""
    v = _returns(spark, sf_dir).withColumn("v", F.round(S.deviation("r", 20), 9)).withColumn("v60", F.round(S.deviation("r", 60), 9)).withColumn("next", S.guarded(F.stddev_samp, "r", S.ahead(20), 20))
    cut = F.lit("1999-01-01").cast("date")
    q = v.filter(F.col("date") < cut).groupBy("asset").agg(F.median("next").alias("q"))
    late = v.filter((F.col("date") >= cut) & F.col("next").isNotNull() & F.col("v").isNotNull() & F.col("v60").isNotNull()).join(q, "asset")
    return late.select("asset", "date", "v", "v60", (F.col("next") > F.col("q")).cast("int").alias("y"))


def _auc_sql(x: str) -> str:
    return f"(SELECT asset, round((sum(k * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc, count(*) AS n FROM (SELECT asset, y, rank() OVER (PARTITION BY asset ORDER BY {x}) + (count(*) OVER (PARTITION BY asset, {x}) - 1) / 2.0 AS k FROM y) AS z GROUP BY asset)"


@query(sql("p", f"{VOLS} SELECT a.asset, a.n, a.auc AS short, b.auc AS long FROM {_auc_sql('v')} AS a JOIN {_auc_sql('v60')} AS b ON b.asset = a.asset"), dates="")
def q18_volatility_state(spark, sf_dir):
    x = _states(spark, sf_dir)
    one = s.auc(x, "v", "y", ["asset"]).select("asset", "n", F.round("auc", 6).alias("short"))
    return one.join(s.auc(x, "v60", "y", ["asset"]).select("asset", F.round("auc", 6).alias("long")), "asset")


@query(dates="")
def udf07_auc_difference(spark, sf_dir):
    """Difference of two scores' AUC with a block bootstrap that draws the same rows for both."""

    def test(frame, seed):
        return b.auc_difference(frame["y"].to_numpy(), frame["v"].to_numpy(), frame["v60"].to_numpy(), 20, 2000, seed)

    return b.per_group(_states(spark, sf_dir), ["asset"], "date", "asset string, diff double, low double, high double, p double, n long", test)


@query(sql("p", f"""{RET}, v AS (SELECT asset, date, value, CASE WHEN count(r) {last(20)} >= 20 THEN stddev_samp(r) {last(20)} END AS v, CASE WHEN count(value) {ahead(20)} >= 20 THEN min(value) {ahead(20)} / value - 1 END AS dip, lead(value, 20) {O} / value - 1 AS f FROM r),
k AS (SELECT *, ntile(4) OVER (PARTITION BY asset ORDER BY v, date) AS bin FROM v WHERE v IS NOT NULL AND f IS NOT NULL AND dip IS NOT NULL) SELECT asset, bin, count(*) AS n, round(quantile_cont(f, 0.05), 6) AS downside, round(avg(dip), 6) AS path_low, round(min(v), 6) AS from_v, round(max(v), 6) AS to_v FROM k GROUP BY 1, 2"""), dates="")
def q19_risk_dashboard(spark, sf_dir):
    """Downside and lowest point of the next 20 rows by quartile of volatility."""
    v = _returns(spark, sf_dir).withColumn("v", S.deviation("r", 20)).withColumn("f", S.forward_change("value", 20))
    v = v.withColumn("dip", S.guarded(F.min, "value", S.ahead(20), 20) / F.col("value") - 1).filter("v is not null and f is not null and dip is not null")
    k = v.withColumn("bin", F.ntile(4).over(Window.partitionBy("asset").orderBy("v", "date")).cast("long")).groupBy("asset", "bin")
    return k.agg(F.count("*").alias("n"), *_r(downside=F.percentile("f", F.lit(0.05)), path_low=F.avg("dip"), from_v=F.min("v"), to_v=F.max("v")))


@query(sql("p", f"""{RET}, v AS (SELECT *, CASE WHEN count(r) {last(20)} >= 20 THEN stddev_samp(r) {last(20)} END AS v, value / max(value) {last(252)} - 1 AS dd FROM r), l AS (SELECT asset, max(date) AS date, arg_max(v, date) AS v, arg_max(dd, date) AS dd FROM v GROUP BY 1)
SELECT l.asset, l.date, round(avg(CASE WHEN v.v <= l.v THEN 1.0 ELSE 0.0 END) FILTER (v.v IS NOT NULL), 6) AS volatility_rank, round(avg(CASE WHEN v.dd <= l.dd THEN 1.0 ELSE 0.0 END), 6) AS drawdown_rank FROM l JOIN v ON v.asset = l.asset GROUP BY 1, 2"""))
def q20_market_regime(spark, sf_dir):
    """Where each asset's last volatility and drawdown stand among all of its own."""
    v = _returns(spark, sf_dir).withColumn("v", S.deviation("r", 20)).withColumn("dd", F.col("value") / F.max("value").over(S.last(252)) - 1)
    newest = v.groupBy("asset").agg(F.max("date").alias("last"), F.max_by("v", "date").alias("lv"), F.max_by("dd", "date").alias("ldd"))
    share = lambda x, y: F.avg(F.when(F.col(x).isNotNull(), (F.col(x) <= F.col(y)).cast("double")))
    return v.join(newest, "asset").groupBy("asset", F.col("last").alias("date")).agg(*_r(volatility_rank=share("v", "lv"), drawdown_rank=share("dd", "ldd")))


@query(sql("p t", f"""{RET}, rm AS (SELECT date, value / lag(value) {OD} - 1 AS m FROM t), j AS (SELECT r.asset, r.date, r.r, m FROM r JOIN rm ON rm.date = r.date WHERE r.r IS NOT NULL AND m IS NOT NULL), c AS (SELECT *, CASE WHEN count(r) {last(60)} >= 60 THEN corr(r, m) {last(60)} END AS c FROM j)
SELECT date, round(avg(c), 6) AS herding, count(c) AS assets FROM c WHERE c IS NOT NULL GROUP BY 1"""))
def q20_herding(spark, sf_dir):
    rm = _market(spark, sf_dir).select("date", F.col("r").alias("m"))
    j = _returns(spark, sf_dir).join(rm, "date").filter("r is not null and m is not null").withColumn("c", S.correlation("r", "m", 60))
    return j.filter("c is not null").groupBy("date").agg(F.round(F.avg("c"), 6).alias("herding"), F.count("c").alias("assets"))


COMPOSITE = f"""{RT}, x AS (SELECT date, sign(value - avg(value) OVER w200) AS trend, sign(value / lag(value, 20) {OD} - 1) AS momentum, -sign(stddev_samp(r) OVER w20 - stddev_samp(r) OVER w200) AS calm, count(r) OVER w200 AS n FROM r
WINDOW w200 AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), w20 AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), y AS (SELECT date, round(0.5 * trend + 0.3 * momentum + 0.2 * calm, 6) AS score FROM x WHERE n >= 200)"""


@query(sql("t", f"{COMPOSITE} SELECT date, score::DOUBLE AS score, CASE WHEN score > 0.4 THEN 'strong' WHEN score > 0.13 THEN 'positive' WHEN score >= -0.13 THEN 'neutral' WHEN score >= -0.4 THEN 'cautious' ELSE 'defensive' END AS stance FROM y"))
def q21_composite_stance(spark, sf_dir):
    t = _market(spark, sf_dir).withColumn("trend", F.signum(F.col("value") - ONE.mean("value", 200, 1))).withColumn("momentum", F.signum(ONE.change("value", 20)))
    calm = -F.signum(F.stddev_samp("r").over(ONE.last(20)) - F.stddev_samp("r").over(ONE.last(200)))
    t = t.withColumn("calm", calm).withColumn("n", F.count("r").over(ONE.last(200))).filter("n >= 200")
    t = t.withColumn("score", F.round(f.weighted_mean([F.col("trend"), F.col("momentum"), F.col("calm")], [0.5, 0.3, 0.2]), 6))
    return t.select("date", "score", f.stance("score").alias("stance"))


@query(sql("p", f"""{RET}, v AS (SELECT asset, date, r, CASE WHEN count(r) {last(20)} >= 20 THEN stddev_samp(r) {last(20)} END AS v, row_number() {O} AS i, count(*) OVER (PARTITION BY asset) AS n FROM r), g AS (SELECT *, i <= n * 7 // 10 AS early FROM v WHERE r IS NOT NULL AND v IS NOT NULL),
q AS (SELECT asset, quantile_cont(v, 0.333) AS lo, quantile_cont(v, 0.667) AS hi FROM g WHERE early GROUP BY 1), z AS (SELECT g.*, CASE WHEN v <= lo THEN 'calm' WHEN v >= hi THEN 'wild' ELSE 'usual' END AS zone FROM g JOIN q ON q.asset = g.asset),
o AS (SELECT asset, zone, abs(r) AS e, row_number() OVER (PARTITION BY asset, zone ORDER BY abs(r), date) AS k, count(*) OVER (PARTITION BY asset, zone) AS m FROM z WHERE early), b AS (SELECT asset, zone, m AS n, e AS width FROM o WHERE k = CAST(ceil((m + 1) * 0.9::DOUBLE) AS BIGINT))
SELECT b.asset, b.zone, any_value(b.n) AS n, round(any_value(width), 6) AS width, round(avg(CASE WHEN abs(r) <= width THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS later FROM b JOIN z ON z.asset = b.asset AND z.zone = b.zone WHERE NOT early GROUP BY 1, 2"""), dates="")
def q22_conformal(spark, sf_dir):
    """Bands from the first 70 % of rows by tercile of volatility, and their coverage later."""
    v = _returns(spark, sf_dir).withColumn("v", S.deviation("r", 20)).withColumn("i", S.position()).withColumn("n", F.count("*").over(Window.partitionBy("asset")))
    g = v.filter("r is not null and v is not null").withColumn("early", F.col("i") <= F.floor(F.col("n") * 7 / 10)).drop("n")
    q = g.filter("early").groupBy("asset").agg(F.percentile("v", F.lit(0.333)).alias("lo"), F.percentile("v", F.lit(0.667)).alias("hi"))
    z = g.join(q, "asset").withColumn("zone", F.when(F.col("v") <= F.col("lo"), "calm").when(F.col("v") >= F.col("hi"), "wild").otherwise("usual"))
    band = s.conformal_band(z.filter("early"), "r", 0.1, ["asset", "zone"]).filter("width is not null")
    by = z.filter("not early").join(band, ["asset", "zone"]).groupBy("asset", "zone")
    return by.agg(F.first("n").alias("n"), F.round(F.first("width"), 6).alias("width"), F.round(F.avg((F.abs("r") <= F.col("width")).cast("double")), 6).alias("coverage"), F.count("*").alias("later"))


@query(dates="")
def q23_cycles(spark, sf_dir):
    """Spectral test of monthly changes of every brand's price, 1,000 surrogates."""
    k = a.ticker_panel(spark, sf_dir).groupBy("ticker", F.trunc("date", "month").alias("m")).agg(F.max_by("close", "date").alias("v"))
    k = k.withColumn("r", Series(("ticker",), "m").log_change("v")).filter("r is not null")

    def test(frame, seed):
        return m.spectral_test(frame["r"].to_numpy(), draws=1000, seed=seed)

    return b.per_group(k, ["ticker"], "m", "ticker string, phi double, peak double, period double, p double, n long", test)


@query(sql("p", f"""{RET}, k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS back FROM r WHERE r IS NOT NULL), pr AS (SELECT a.asset AS a, b.asset AS b, a.r AS x, b.r AS y, a.back <= 60 AS late FROM k AS a JOIN k AS b ON b.date = a.date AND a.asset < b.asset)
SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS corr, round(corr(x, y) FILTER (late), 6) AS recent, round(corr(x, y) FILTER (late) - corr(x, y), 6) AS shift FROM pr GROUP BY 1, 2"""), dates="")
def q36_correlation_shift(spark, sf_dir):
    k = _returns(spark, sf_dir).filter("r is not null").withColumn("back", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date"))))
    x = k.select(F.col("asset").alias("a"), "date", F.col("r").alias("x"), (F.col("back") <= 60).alias("late"))
    pairs = x.join(k.select(F.col("asset").alias("b"), "date", F.col("r").alias("y")), "date").filter("a < b").groupBy("a", "b")
    recent = F.corr(F.when(F.col("late"), F.col("x")), F.when(F.col("late"), F.col("y")))
    return pairs.agg(F.count("*").alias("n"), *_r(corr=F.corr("x", "y"), recent=recent, shift=recent - F.corr("x", "y")))


# ---- per-series checks and models ---------------------------------------------------


@query(dates="")
def udf23_robustness(spark, sf_dir):
    """Weekday effect of each asset: whole, by halves, and lately; 1,000 permutations each."""

    def test(frame, seed):
        v, g = frame["r"].to_numpy(), frame["g"].to_numpy()
        half = len(v) // 2
        p = [b.permutation_test(v[k], g[k], 1000, seed + i)["p"] for i, k in enumerate((slice(None), slice(half), slice(half, None), slice(-250, None)))]
        lead = [max(set(g[k]), key=lambda d: v[k][g[k] == d].mean()) for k in (slice(half), slice(half, None))]
        return {"p": p[0], "p_first": p[1], "p_second": p[2], "p_recent": p[3], "stable": bool(p[1] < 0.05 and p[2] < 0.05 and lead[0] == lead[1]), "n": len(v)}

    r = _returns(spark, sf_dir).filter("r is not null").withColumn("g", F.weekday("date"))
    return b.per_group(r, ["asset"], "date", "asset string, p double, p_first double, p_second double, p_recent double, stable boolean, n long", test)


@query(dates="")
def udf32_canonical_correlation(spark, sf_dir):
    """First canonical correlation of past and next moves of each asset, and the explained share of the next ones."""

    def test(frame, seed):
        return m.canonical(frame[["r", "m5", "m20"]].to_numpy(), frame[["f1", "f5"]].to_numpy())

    x = _returns(spark, sf_dir).withColumn("m5", S.change("value", 5)).withColumn("m20", S.change("value", 20)).withColumn("f1", S.forward_change("value", 1)).withColumn("f5", S.forward_change("value", 5)).dropna()
    return b.per_group(x, ["asset"], "date", "asset string, first double, second double, explained double, n long", test)


@query(dates="")
def udf33_quantile_regression(spark, sf_dir):
    """Slopes of the next return on momentum at five quantiles, by asset."""

    def test(frame, seed):
        x, y = frame["m20"].to_numpy(), frame["f5"].to_numpy()
        fits = {q: m.quantile_line(x, y, q / 100) for q in (5, 25, 50, 75, 95)}
        return {f"slope_{q}": v[1] for q, v in fits.items()} | {"n": len(x)}

    x = _returns(spark, sf_dir).withColumn("m20", S.change("value", 20)).withColumn("f5", S.forward_change("value", 5)).dropna()
    schema = "asset string, slope_5 double, slope_25 double, slope_50 double, slope_75 double, slope_95 double, n long"
    return b.per_group(x, ["asset"], "date", schema, test)


MENTIONS = """WITH e AS (SELECT user_id % 20 AS ticker, CAST(ts AS DATE) AS date, count(*) AS mentions, arg_max(value, (ts, event_id)) AS px FROM events GROUP BY 1, 2), f AS (SELECT *, lead(px, 1) OVER (PARTITION BY ticker ORDER BY date) - px AS f FROM e WHERE px IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY mentions) + (count(*) OVER (PARTITION BY date, mentions) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY f) + (count(*) OVER (PARTITION BY date, f) - 1) / 2.0 AS b FROM f WHERE f IS NOT NULL), c AS (SELECT date, corr(a, b) AS ic, count(*) AS n FROM k GROUP BY 1)"""


def _mentions(spark, sf_dir):
    ev = a.table(spark, sf_dir, "events")
    by = ev.groupBy((F.col("user_id") % 20).alias("ticker"), F.col("ts").cast("date").alias("date"))
    x = by.agg(F.count("*").alias("mentions"), F.max_by("value", F.struct("ts", "event_id")).alias("px")).filter("px is not null")
    return x.withColumn("f", F.lead("px").over(Window.partitionBy("ticker").orderBy("date")) - F.col("px")).filter("f is not null")


@query(f"{MENTIONS} SELECT date, round(ic, 6) AS ic, n FROM c")
def udf37_information_coefficient(spark, sf_dir):
    ic = s.spearman(_mentions(spark, sf_dir), "mentions", "f", ["date"])
    return ic.select("date", F.round("rho", 6).alias("ic"), "n")


@query(f"{MENTIONS} SELECT count(ic) AS days, round(avg(ic), 6) AS mean, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t, CASE WHEN avg(ic) > 0.02 AND avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) > 2 THEN 'go' ELSE 'no-go' END AS decision FROM c WHERE isfinite(ic)", dates="")
def q53_sentiment_decision(spark, sf_dir):
    ic = s.spearman(_mentions(spark, sf_dir), "mentions", "f", ["date"]).filter("rho is not null and not isnan(rho)")
    t = F.avg("rho") / (F.stddev_samp("rho") / F.sqrt(F.count("rho")))
    x = ic.agg(F.count("rho").alias("days"), F.avg("rho").alias("mean"), t.alias("t"))
    return x.select("days", *_r(mean=F.col("mean"), t=F.col("t")), F.when((F.col("mean") > 0.02) & (F.col("t") > 2), "go").otherwise("no-go").alias("decision"))


PARTNER = f"{MENTIONS.replace('WITH e', 'WITH e', 1)}, tk AS (SELECT DISTINCT ticker FROM f), od AS (SELECT ticker, row_number() OVER (ORDER BY md5('partner:' || ticker)) AS k, count(*) OVER () AS n FROM tk), pa AS (SELECT x.ticker, y.ticker AS partner FROM od AS x JOIN od AS y ON y.k = x.k % x.n + 1)"


@query(f"{PARTNER} SELECT f.ticker, pa.partner, count(*) AS n, round(corr(f.mentions, g.f), 6) AS corr FROM f JOIN pa ON pa.ticker = f.ticker JOIN f AS g ON g.ticker = pa.partner AND g.date = f.date WHERE f.f IS NOT NULL AND g.f IS NOT NULL GROUP BY 1, 2", dates="")
def joi20_unrelated_partner(spark, sf_dir):
    """Mentions of one ticker against the moves of another that a seeded order gives it; none is its own partner."""
    x = _mentions(spark, sf_dir)
    names = x.select("ticker").distinct()
    names = names.withColumn("k", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit("partner:"), F.col("ticker").cast("string"))))))
    n = names.agg(F.count("*").alias("n"))
    after = names.join(n).withColumn("k", F.col("k") % F.col("n") + 1).select("ticker", "k")  # one row
    pairs = after.join(names.select(F.col("ticker").alias("partner"), "k"), "k").drop("k")
    other = x.select(F.col("ticker").alias("partner"), "date", F.col("f").alias("g"))
    by = x.join(pairs, "ticker").join(other, ["partner", "date"]).groupBy("ticker", "partner")
    return by.agg(F.count("*").alias("n"), F.round(F.corr("mentions", "g"), 6).alias("corr"))


@query(dates="")
def udf37_placebo(spark, sf_dir):
    """Mean daily rank correlation against one with mentions shuffled within each day, 500 draws."""
    x = s.spearman(_mentions(spark, sf_dir), "mentions", "f", ["date"])
    draws = _mentions(spark, sf_dir).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(500))))
    pick = F.md5(F.concat_ws("|", "draw", "date", "ticker"))
    rank = lambda by: F.row_number().over(Window.partitionBy("draw", "date").orderBy(by))
    draws = draws.withColumn("i", rank("ticker")).withColumn("j", rank(pick))
    shuffled = draws.select("draw", "date", "i", "f").join(draws.select("draw", "date", F.col("j").alias("i"), "mentions"), ["draw", "date", "i"])
    null = s.spearman(shuffled, "mentions", "f", ["draw", "date"]).filter("rho is not null and not isnan(rho)").groupBy("draw").agg(F.avg("rho").alias("ic"))
    seen = x.filter("rho is not null and not isnan(rho)").agg(F.avg("rho").alias("seen"))
    by = null.join(seen)  # one row
    return by.agg(F.first("seen").alias("ic"), ((F.count(F.when(F.col("ic") >= F.col("seen"), 1)) + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("draws"))
