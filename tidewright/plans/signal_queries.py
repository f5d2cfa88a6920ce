"""Registered queries of the daily signal: ratios, tiers, forecast, backtest, timing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as f
from ..functions import signals as g
from ..operators import significance as s
from ..operators.joins import asof_join
from ..operators.windows import Series
from ..sources import adapters as a
from .registry import query
from .window_queries import O, RET, _r, _returns, last

S = Series(("asset",), "date")
sql = a.with_views
UP = "CASE WHEN {0} > 0 THEN 1.0 WHEN {0} IS NOT NULL THEN 0.0 END"

# ---- the calendar in SQL ----------------------------------------------------

HOLIDAYS = """y0 AS (SELECT unnest(range(1990, 2031)) AS y), e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y0),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1), e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS k FROM e3),
fx AS (SELECT y, unnest([make_date(y, 1, 1), make_date(y, 7, 4), make_date(y, 12, 25)]) AS d FROM y0 UNION ALL SELECT y, make_date(y, 6, 19) FROM y0 WHERE y >= 2022),
hol AS (SELECT CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END AS d FROM fx
UNION SELECT make_date(y, k // 31, k % 31 + 1) - 2 FROM e4
UNION SELECT make_date(y, 1, 1) + CAST((8 - isodow(make_date(y, 1, 1))) % 7 + 14 AS INT) FROM y0
UNION SELECT make_date(y, 2, 1) + CAST((8 - isodow(make_date(y, 2, 1))) % 7 + 14 AS INT) FROM y0
UNION SELECT make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INT) FROM y0
UNION SELECT make_date(y, 9, 1) + CAST((8 - isodow(make_date(y, 9, 1))) % 7 AS INT) FROM y0
UNION SELECT make_date(y, 11, 1) + CAST((11 - isodow(make_date(y, 11, 1))) % 7 + 21 AS INT) FROM y0)"""
THANKS = "(make_date(year(date), 11, 1) + CAST((11 - isodow(make_date(year(date), 11, 1))) % 7 + 21 AS INT))"
WEEKDAY_SQL = "CASE isodow(date) WHEN 1 THEN 0.940 WHEN 2 THEN 0.981 WHEN 3 THEN 1.038 WHEN 4 THEN 1.004 WHEN 5 THEN 1.038 ELSE 1.0 END::DOUBLE"
WOM_SQL = "CASE (day(date) + isodow(date_trunc('month', date)) - 2) // 7 + 1 WHEN 1 THEN 1.112 WHEN 2 THEN 0.996 WHEN 3 THEN 1.015 WHEN 4 THEN 0.950 WHEN 5 THEN 0.992 ELSE 1.0 END::DOUBLE"
CALENDAR_SQL = """CASE WHEN month(date) = 4 AND day(date) = 15 THEN 1.242 WHEN month(date) = 4 AND day(date) <= 14 THEN 1.068 WHEN month(date) = 4 THEN 1.0
WHEN month(date) = 12 AND day(date) BETWEEN 11 AND 15 THEN 0.889 WHEN month(date) = 12 AND day(date) BETWEEN 21 AND 25 THEN 1.147
WHEN month(date) IN (1, 7, 10) AND day(date) <= 5 THEN 1.117 ELSE 1.0 END::DOUBLE"""
HOLIDAY_SQL = f"""CASE WHEN date = {THANKS} - 1 THEN 1.457 WHEN date = {THANKS} + 1 THEN 1.357 WHEN month(date) = 12 AND day(date) >= 26 OR month(date) = 1 AND day(date) <= 3 THEN 1.105
WHEN EXISTS (SELECT 1 FROM hol WHERE hol.d - date BETWEEN 1 AND 3) THEN 1.126 WHEN EXISTS (SELECT 1 FROM hol WHERE date - hol.d BETWEEN 1 AND 3) THEN 1.111 ELSE 1.0 END::DOUBLE"""
CAL = f"{HOLIDAYS}, cal AS (SELECT date, {WEEKDAY_SQL} AS dow_lr, {WOM_SQL} AS wom_lr, {HOLIDAY_SQL} AS holiday_lr, {CALENDAR_SQL} AS cal_lr FROM (SELECT DISTINCT date FROM days) AS dd)"


@query(f"WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), {CAL} SELECT * FROM cal")
def sca07_calendar_ratios(spark, sf_dir):
    days = a.daily_total(spark, sf_dir).select("date")
    names = ("dow_lr", "wom_lr", "holiday_lr", "cal_lr")
    return days.select("date", *[x.alias(n) for x, n in zip(g.calendar_ratios("date"), names)])


# ---- Q-01 to Q-05: signal, forecast, calibration, backtest, duel -------------

GAIN = f"CASE WHEN count(r) {last(14)} >= 14 THEN avg(CASE WHEN r > 0 THEN r WHEN r IS NOT NULL THEN 0.0::DOUBLE END) {last(14)} END"
LOSS = f"CASE WHEN count(r) {last(14)} >= 14 THEN avg(CASE WHEN r < 0 THEN -r WHEN r IS NOT NULL THEN 0.0::DOUBLE END) {last(14)} END"
TECH = f"""tech AS (SELECT asset, date, value, r, CASE WHEN count(value) {last(200)} >= 200 THEN avg(value) {last(200)} END AS ma200, value / lag(value, 20) {O} - 1 AS mom20,
CASE WHEN count(r) {last(20)} >= 20 THEN stddev_samp(r) {last(20)} * sqrt(252.0::DOUBLE) END AS vol20, 100 - 100 / (1 + {GAIN} / ({LOSS} + 1e-10)) AS strength FROM r)"""
PRIOR = f"""mo AS (SELECT asset, date_trunc('month', date) AS m, arg_max(value, date) AS v FROM p GROUP BY 1, 2),
mr AS (SELECT asset, month(m) AS month, v / lag(v) OVER (PARTITION BY asset ORDER BY m) - 1 AS mr FROM mo),
prior AS (SELECT asset, month, avg({UP.format('mr')}) AS prior FROM mr WHERE mr IS NOT NULL GROUP BY 1, 2)"""
RATIOS = {
    "trend_lr": "CASE WHEN ma200 IS NULL THEN 1.0 WHEN value > ma200 THEN 1.15 ELSE 0.85 END::DOUBLE",
    "mom_lr": "CASE WHEN mom20 > 0.05 THEN 1.12 WHEN mom20 < -0.05 THEN 0.90 ELSE 1.0 END::DOUBLE",
    "vol_lr": "CASE WHEN vol20 > 0.25 THEN 0.85 WHEN vol20 < 0.15 THEN 1.10 ELSE 1.0 END::DOUBLE",
    "strength_lr": "CASE WHEN strength > 75 THEN 0.85 WHEN strength < 35 THEN 1.10 ELSE 1.0 END::DOUBLE",
}


def _odds(names: str) -> str:
    clip = "least(greatest(prior, 0.02), 0.98)"
    total = " + ".join(f"ln(greatest({n}, 0.01))" for n in names.split())
    return f"least(greatest(1 / (1 + exp(-(ln({clip} / (1 - {clip})) + {total}))), 0.02), 0.98)"


ODDS = _odds("dow_lr wom_lr holiday_lr cal_lr trend_lr mom_lr vol_lr strength_lr")
TIER = "CASE WHEN prob >= 0.8 THEN 5 WHEN prob >= 0.6 THEN 4 WHEN prob >= 0.4 THEN 3 WHEN prob >= 0.2 THEN 2 ELSE 1 END"
SIGNAL = f"""{RET}, {TECH}, {PRIOR}, days AS (SELECT DISTINCT date FROM p), {CAL},
rt AS (SELECT asset, date, value, r, {', '.join(f'{x} AS {n}' for n, x in RATIOS.items())} FROM tech WHERE isodow(date) <= 5),
sg AS (SELECT rt.*, prior, dow_lr, wom_lr, holiday_lr, cal_lr, {ODDS} AS prob FROM rt JOIN cal USING (date) JOIN prior ON prior.asset = rt.asset AND prior.month = month(rt.date)),
signal AS (SELECT *, {TIER} AS tier FROM sg)"""


def _technical(spark, sf_dir):
    x = _returns(spark, sf_dir).withColumn("ma200", S.mean("value", 200)).withColumn("mom20", S.change("value", 20))
    return x.withColumn("vol20", S.volatility("r", 20)).withColumn("strength", S.strength_index("r"))


def _technical_ratios(x):
    trend = F.when(F.col("ma200").isNull(), 1.0).when(F.col("value") > F.col("ma200"), g.TREND[0]).otherwise(g.TREND[1])
    return x.withColumns(
        {
            "trend_lr": trend,
            "mom_lr": g.above_below("mom20", g.MOMENTUM_BOUND, -g.MOMENTUM_BOUND, g.MOMENTUM),
            "vol_lr": g.above_below("vol20", *g.VOLATILITY_BOUNDS, g.VOLATILITY),
            "strength_lr": g.above_below("strength", *g.STRENGTH_BOUNDS, g.STRENGTH),
        }
    )


def _priors(spark, sf_dir):
    """Share of rising months by month of the year."""
    month = F.trunc("date", "month").alias("m")
    ends = a.daily_prices(spark, sf_dir).groupBy("asset", month).agg(F.max_by("value", "date").alias("v"))
    rise = ends.select("asset", F.month("m").alias("month"), Series(("asset",), "m").change("v").alias("mr")).filter("mr is not null")
    return rise.groupBy("asset", "month").agg(F.avg((F.col("mr") > 0).cast("double")).alias("prior"))


RATIO_NAMES = ["dow_lr", "wom_lr", "holiday_lr", "cal_lr", "trend_lr", "mom_lr", "vol_lr", "strength_lr"]


def _rated(days, technical, priors):
    """Probability and tier of days with technical ratios."""
    cal = days.select("date", *[x.alias(n) for x, n in zip(g.calendar_ratios("date"), RATIO_NAMES)])
    x = technical.join(cal, "date").withColumn("month", F.month("date")).join(priors, ["asset", "month"]).drop("month")
    x = x.withColumn("prob", g.probability(F.col("prior"), [F.col(n) for n in RATIO_NAMES]))
    return x.withColumn("tier", g.tier(F.col("prob")))


def _signal(spark, sf_dir):
    days = a.daily_total(spark, sf_dir).select("date")
    return _rated(days, _technical_ratios(_technical(spark, sf_dir)).filter(F.weekday("date") < 5), _priors(spark, sf_dir))


@query(sql("p", f"{SIGNAL} SELECT asset, date, round(prior, 4) AS prior, holiday_lr, cal_lr, round(prob, 6) AS prob, tier, round(r, 6) AS ret FROM signal"))
def q01_daily_signal(spark, sf_dir):
    cols = ["holiday_lr", "cal_lr", F.round("prob", 6).alias("prob"), "tier", F.round("r", 6).alias("ret")]
    return _signal(spark, sf_dir).select("asset", "date", F.round("prior", 4).alias("prior"), *cols)


@query("SELECT p_partkey, CASE WHEN p >= 0.8 THEN 5 WHEN p >= 0.6 THEN 4 WHEN p >= 0.4 THEN 3 WHEN p >= 0.2 THEN 2 ELSE 1 END AS tier FROM (SELECT p_partkey, (p_partkey % 101) / 100.0::DOUBLE AS p FROM part) AS x", dates="")
def sca04_tiers(spark, sf_dir):
    return a.table(spark, sf_dir, "part").select("p_partkey", g.tier((F.col("p_partkey") % 101) / 100.0).alias("tier"))


FORECAST = f"""{RET}, {TECH}, {PRIOR}, lst AS (SELECT max(date) AS last FROM p), days AS (SELECT CAST(unnest(range(last + 1, last + 71, INTERVAL 1 DAY)) AS DATE) AS date FROM lst), {CAL},
fz AS (SELECT asset, {', '.join(f'{x} AS {n}' for n, x in RATIOS.items())} FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS k FROM tech) AS z WHERE k = 1),
nx AS (SELECT *, row_number() OVER (ORDER BY date) AS step FROM cal WHERE isodow(date) <= 5 AND date NOT IN (SELECT d FROM hol)),
fc AS (SELECT fz.asset, nx.date, step, {ODDS} AS prob FROM nx CROSS JOIN fz JOIN prior ON prior.asset = fz.asset AND prior.month = month(nx.date) WHERE step <= 40)"""


def _forecast(spark, sf_dir):
    """The next 40 trading days with the technical ratios of each asset's last row."""
    end = a.daily_total(spark, sf_dir).agg(F.max("date").alias("end"))
    days = end.select(F.explode(F.sequence(F.date_add("end", 1), F.date_add("end", 70))).alias("date"))
    days = days.filter((F.weekday("date") < 5) & ~g.near_holiday("date", 0, 0))
    days = days.withColumn("step", F.row_number().over(Window.orderBy("date"))).filter("step <= 40")
    last_row = _technical_ratios(_technical(spark, sf_dir)).withColumn("k", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))).filter("k = 1")
    frozen = last_row.select("asset", "trend_lr", "mom_lr", "vol_lr", "strength_lr")
    # A row per asset and day: 40 days for each asset.
    wide = frozen.join(days.agg(F.collect_list(F.struct("date", "step")).alias("d"))).select("*", F.explode("d").alias("x")).select("*", "x.date", "x.step").drop("d", "x")
    return _rated(days, wide, _priors(spark, sf_dir))


@query(sql("p", f"{FORECAST} SELECT asset, date, step, round(prob, 6) AS prob, {TIER} AS tier FROM fc"))
def udf39_forecast(spark, sf_dir):
    return _forecast(spark, sf_dir).select("asset", "date", F.col("step").cast("long").alias("step"), F.round("prob", 6).alias("prob"), "tier")


@query(sql("p", f"""{FORECAST}, k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY prob DESC, date) AS hi, row_number() OVER (PARTITION BY asset ORDER BY prob, date) AS lo FROM fc)
SELECT asset, date, round(prob, 6) AS prob, CASE WHEN hi <= 5 THEN 'best' ELSE 'worst' END AS side FROM k WHERE hi <= 5 OR lo <= 5"""))
def q02_forecast_extremes(spark, sf_dir):
    w = Window.partitionBy("asset")
    k = _forecast(spark, sf_dir).withColumn("hi", F.row_number().over(w.orderBy(F.desc("prob"), "date"))).withColumn("lo", F.row_number().over(w.orderBy("prob", "date")))
    return k.filter("hi <= 5 or lo <= 5").select("asset", "date", F.round("prob", 6).alias("prob"), F.when(F.col("hi") <= 5, "best").otherwise("worst").alias("side"))


HORIZONS = (1, 5, 10, 20, 30)
FORWARD = ", ".join(f"lead(value, {h}) {O} / value - 1 AS f{h}" for h in HORIZONS)
LONG = f"""{SIGNAL}, fw AS (SELECT asset, date, {FORWARD} FROM p), js AS (SELECT signal.asset, signal.date, prob, tier, f1, f5, f10, f20, f30 FROM signal JOIN fw ON fw.asset = signal.asset AND fw.date = signal.date WHERE f30 IS NOT NULL),
lg AS ({' UNION ALL '.join(f'SELECT asset, date, prob, tier, {h} AS h, f{h} AS f, {UP.format(f"f{h}")}::DOUBLE AS up FROM js' for h in HORIZONS)})"""


def _backtest(spark, sf_dir):
    """Signals with the forward returns of every horizon, a row each."""
    x = a.daily_prices(spark, sf_dir).select("asset", "date", *[S.forward_change("value", h).alias(f"f{h}") for h in HORIZONS]).filter("f30 is not null")
    x = _signal(spark, sf_dir).select("asset", "date", "prob", "tier").join(x, ["asset", "date"])
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"f{h}").alias("f")) for h in HORIZONS])
    x = x.withColumn("x", F.explode(pairs)).select("asset", "date", "prob", "tier", "x.h", "x.f")
    return x.withColumn("up", (F.col("f") > 0).cast("double"))


T_TEST = "(avg(up) - any_value(base)) / (stddev_samp(up) / sqrt(count(*)))"


def _against_base(df, keys, base_keys):
    """Win rate, returns and one-sample t of the win rate against the base rate."""
    base = df.groupBy(*base_keys).agg(F.avg("up").alias("base"))
    by = df.join(base, base_keys).groupBy(*base_keys, *keys)
    t = F.try_divide(F.avg("up") - F.first("base"), F.stddev_samp("up") / F.sqrt(F.count("*")))
    stats = {"win_rate": F.avg("up"), "mean": F.avg("f"), "median": F.median("f"), "over_base": F.avg("up") - F.first("base"), "t": t}
    return by.agg(F.count("*").alias("n"), *[F.round(x, 6).alias(c) for c, x in stats.items()])


STATS_SQL = f"count(*) AS n, round(avg(up), 6) AS win_rate, round(avg(f), 6) AS mean, round(median(f), 6) AS median, round(avg(up) - any_value(base), 6) AS over_base, round(CASE WHEN stddev_samp(up) > 0 THEN {T_TEST} END, 6) AS t"
BASE = "bs AS (SELECT asset, h, avg(up) AS base FROM lg GROUP BY 1, 2), lb AS (SELECT lg.*, base FROM lg JOIN bs ON bs.asset = lg.asset AND bs.h = lg.h)"


@query(sql("p", f"{LONG}, {BASE} SELECT asset, h, tier, {STATS_SQL}, CASE WHEN stddev_samp(up) > 0 THEN abs({T_TEST}) > 1.645 END AS notable FROM lb GROUP BY asset, h, tier HAVING count(*) >= 15"), dates="")
def q04_backtest_by_tier(spark, sf_dir):
    found = _against_base(_backtest(spark, sf_dir), ["tier"], ["asset", "h"]).filter("n >= 15")
    return found.withColumn("notable", F.abs("t") > 1.645)


EDGES = (0.48, 0.51, 0.54, 0.57, 0.60, 0.63, 0.70, 1.0)


@query(sql("p", f"""{LONG}, {BASE}, e(low, high) AS (VALUES {', '.join(f'({x}, {y})' for x, y in zip(EDGES, EDGES[1:]))})
SELECT asset, h, low::DOUBLE AS low, {STATS_SQL} FROM lb JOIN e ON prob > low AND prob <= high WHERE h = 20 GROUP BY asset, h, low HAVING count(*) >= 20"""), dates="")
def q04_calibration(spark, sf_dir):
    low = F.lit(None).cast("double")
    for x, y in zip(EDGES, EDGES[1:]):
        low = F.when((F.col("prob") > x) & (F.col("prob") <= y), F.lit(x)).otherwise(low)
    rows = _backtest(spark, sf_dir).filter("h = 20").withColumn("low", low)
    return _against_base(rows, ["low"], ["asset", "h"]).filter("n >= 20 and low is not null")


@query(sql("p", f"""{LONG}, k AS (SELECT asset, CASE WHEN tier >= 4 THEN 1 ELSE 0 END AS held, f, up FROM lg WHERE h = 20)
SELECT asset, count(*) FILTER (held = 1) AS n_held, round(avg(up) FILTER (held = 1), 6) AS win_held, round(avg(up), 6) AS win_all, round(avg(f) FILTER (held = 1), 6) AS mean_held, round(avg(f), 6) AS mean_all FROM k GROUP BY asset"""), dates="")
def q04_high_tiers(spark, sf_dir):
    held = F.col("tier") >= 4
    k = _backtest(spark, sf_dir).filter("h = 20").groupBy("asset")
    return k.agg(
        F.count(F.when(held, 1)).alias("n_held"),
        *_r(win_held=F.avg(F.when(held, F.col("up"))), win_all=F.avg("up"), mean_held=F.avg(F.when(held, F.col("f"))), mean_all=F.avg("f")),
    )


@query(sql("p", f"""{LONG}, cv AS (SELECT asset, avg(prob) AS x, avg(up) AS y FROM lg WHERE h = 20 GROUP BY asset, floor(prob * 20)),
sg2 AS (SELECT *, lead(x) OVER (PARTITION BY asset ORDER BY x) AS x1, lead(y) OVER (PARTITION BY asset ORDER BY x) AS y1, row_number() OVER (PARTITION BY asset ORDER BY x) AS k FROM cv),
fl AS (SELECT asset, max(y) - min(y) < 0.01 AS flat FROM cv GROUP BY asset), pb AS (SELECT asset, date, prob FROM lg WHERE h = 20)
SELECT pb.asset, date, round(coalesce(CASE WHEN x1 IS NULL THEN y ELSE y + (prob - x) / (x1 - x) * (y1 - y) END, first_y), 6) AS calibrated, flat
FROM pb JOIN (SELECT asset, y AS first_y FROM sg2 WHERE k = 1) AS fy ON fy.asset = pb.asset JOIN fl ON fl.asset = pb.asset ASOF LEFT JOIN sg2 ON sg2.asset = pb.asset AND pb.prob >= sg2.x"""))
def q03_calibrated(spark, sf_dir):
    b = _backtest(spark, sf_dir).filter("h = 20")
    curve = b.groupBy("asset", F.floor(F.col("prob") * 20).alias("bin")).agg(F.avg("prob").alias("x"), F.avg("up").alias("y")).drop("bin")
    w = Window.partitionBy("asset").orderBy("x")
    parts = curve.withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w))
    ends = curve.groupBy("asset").agg(F.min_by("y", "x").alias("first_y"), (F.max("y") - F.min("y") < 0.01).alias("flat"))
    found = asof_join(b.select("asset", "date", "prob"), parts, "prob", "x", keys=["asset"]).join(ends, "asset")
    m = F.col("matched")
    inside = F.when(m["x1"].isNull(), m["y"]).otherwise(m["y"] + (F.col("prob") - m["x"]) / (m["x1"] - m["x"]) * (m["y1"] - m["y"]))
    return found.select("asset", "date", F.round(F.coalesce(inside, "first_y"), 6).alias("calibrated"), "flat")


FLAGS = {"trend": "value > ma200", "mom_pos": "mom20 > 0.05", "mom_neg": "mom20 < -0.05", "high_vol": "vol20 > 0.25", "strong": "strength > 75", "weak": "strength < 35"}
CUTS = ("1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01", "2001-01-01")
FLAG_SQL = f"""{RET}, {TECH}, fl AS (SELECT asset, date, CASE WHEN lead(value, 20) {O} > value THEN 1 ELSE 0 END AS y, lead(value, 20) {O} AS known, {', '.join(f'CASE WHEN {x} THEN 1 WHEN ({x}) IS NOT NULL THEN 0 END AS {n}' for n, x in FLAGS.items())} FROM tech),
fk AS (SELECT * FROM fl WHERE known IS NOT NULL), fo(fold, cut, stop) AS (VALUES {', '.join(f"({i + 1}, DATE '{x}', DATE '{y}')" for i, (x, y) in enumerate(zip(CUTS, CUTS[1:])))}),
fp AS (SELECT fold, asset, date, y, cut, unnest([{', '.join(f"{{'name': '{n}', 'v': {n}}}" for n in FLAGS)}], recursive := true) FROM fk CROSS JOIN fo WHERE date < stop),
tr AS (SELECT fold, asset, name, count(v) FILTER (v = 1) AS n1, avg(y) FILTER (v = 1) AS up1, avg(y) FILTER (v IS NOT NULL) AS up FROM fp WHERE date < cut - 30 GROUP BY 1, 2, 3),
lr AS (SELECT fold, asset, name, 1 + (up1 / up - 1) * n1 / (n1 + 200.0::DOUBLE) AS lr FROM tr WHERE n1 >= 50 AND up > 0),
br AS (SELECT fold, asset, avg(y) AS base FROM fp WHERE date < cut - 30 AND name = 'trend' GROUP BY 1, 2),
sc AS (SELECT fp.fold, fp.asset, fp.date, any_value(fp.y) AS y, any_value(base) AS base, coalesce(sum(ln(greatest(lr, 0.01))) FILTER (v = 1), 0) AS lo FROM fp JOIN br ON br.fold = fp.fold AND br.asset = fp.asset
LEFT JOIN lr ON lr.fold = fp.fold AND lr.asset = fp.asset AND lr.name = fp.name WHERE fp.date >= cut GROUP BY 1, 2, 3),
pr AS (SELECT fold, asset, date, y, 1 / (1 + exp(-(ln(base / (1 - base)) + lo))) AS p FROM sc)"""


def _learned(spark, sf_dir):
    """Naive-Bayes probabilities of test days of every fold, with ratios learned before its cut."""
    t = _technical(spark, sf_dir).withColumn("known", F.lead("value", 20).over(S.ordered)).filter("known is not null")
    kind = "array<struct<name:string,v:int>>"
    flags = F.array(*[F.struct(F.lit(n).alias("name"), F.expr(x).cast("int").alias("v")).cast(kind[6:-1]) for n, x in FLAGS.items()])
    folds = F.array(*[F.struct(F.lit(i + 1).alias("fold"), F.lit(x).cast("date").alias("cut"), F.lit(y).cast("date").alias("stop")) for i, (x, y) in enumerate(zip(CUTS, CUTS[1:]))])
    x = t.select("asset", "date", (F.col("known") > F.col("value")).cast("int").alias("y"), F.explode(folds).alias("f"), flags.alias("flags"))
    x = x.select("asset", "date", "y", "f.*", "flags").filter("date < stop")
    long = x.select("fold", "asset", "date", "y", "cut", F.inline("flags"))
    train = long.filter(F.col("date") < F.date_sub("cut", 30))  # an embargo before the cut
    on = F.col("v") == 1
    learned = train.groupBy("fold", "asset", "name").agg(F.count(F.when(on, 1)).alias("n1"), F.avg(F.when(on, F.col("y"))).alias("up1"), F.avg(F.when(F.col("v").isNotNull(), F.col("y"))).alias("up"))
    learned = learned.filter("n1 >= 50 and up > 0").withColumn("lr", f.shrink(F.col("up1") / F.col("up"), "n1", 200))
    base = x.filter(F.col("date") < F.date_sub("cut", 30)).groupBy("fold", "asset").agg(F.avg("y").alias("base"))
    test = long.filter(F.col("date") >= F.col("cut")).join(learned.select("fold", "asset", "name", "lr"), ["fold", "asset", "name"], "left")
    logs = F.coalesce(F.sum(F.when(on, F.ln(F.greatest("lr", F.lit(0.01))))), F.lit(0.0))
    scored = test.groupBy("fold", "asset", "date").agg(F.first("y").alias("y"), logs.alias("lo")).join(base, ["fold", "asset"])
    return scored.withColumn("p", 1 / (1 + F.exp(-(F.ln(F.col("base") / (1 - F.col("base"))) + F.col("lo")))))


@query(sql("p", f"{FLAG_SQL} SELECT fold, asset, date, y, round(p, 6) AS p FROM pr"))
def udf26_naive_bayes(spark, sf_dir):
    return _learned(spark, sf_dir).select("fold", "asset", "date", "y", F.round("p", 6).alias("p"))


@query(sql("p", f"""{FLAG_SQL}, pq AS (SELECT fold, asset, y, round(p, 9) AS p FROM pr), rk AS (SELECT *, rank() OVER (PARTITION BY fold, asset ORDER BY p) + (count(*) OVER (PARTITION BY fold, asset, p) - 1) / 2.0 AS k FROM pq)
SELECT fold, asset, count(*) AS n, round((sum(k * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM rk GROUP BY fold, asset"""), dates="")
def q05_walk_forward(spark, sf_dir):
    x = _learned(spark, sf_dir).withColumn("p", F.round("p", 9))
    right = x.groupBy("fold", "asset").agg(F.round(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")), 6).alias("accuracy"))
    return s.auc(x, "p", "y", ["fold", "asset"]).select("fold", "asset", "n", *_r(auc=F.col("auc"), brier=F.col("brier"))).join(right, ["fold", "asset"])


@query(sql("p", f"""{FLAG_SQL}, b AS (SELECT fold, asset, avg((p - y) * (p - y)) AS brier, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(y) AS rate FROM pr GROUP BY 1, 2)
SELECT fold, asset, round(brier, 6) AS brier, round(accuracy, 6) AS accuracy, round(1 - brier / nullif(rate * (1 - rate), 0), 6) AS skill FROM b"""), dates="")
def udf09_brier(spark, sf_dir):
    p, y = F.col("p"), F.col("y")
    b = _learned(spark, sf_dir).groupBy("fold", "asset").agg(F.avg((p - y) ** 2).alias("brier"), F.avg(((p >= 0.5) == (y == 1)).cast("double")).alias("accuracy"), F.avg("y").alias("rate"))
    rate = F.col("rate")
    return b.select("fold", "asset", *_r(brier=F.col("brier"), accuracy=F.col("accuracy"), skill=1 - F.try_divide(F.col("brier"), rate * (1 - rate))))


ONE_HOT = [("month", 1, 13), ("dow", 0, 5), ("wom", 1, 6)]


@query(sql("p", f"""{RET}, {TECH}, c AS (SELECT *, month(date) AS month, isodow(date) - 1 AS dow, (day(date) + isodow(date_trunc('month', date)) - 2) // 7 + 1 AS wom FROM tech)
SELECT asset, date, {', '.join(f'CASE WHEN {n} = {i} THEN 1 ELSE 0 END AS {n}_{i}' for n, x, y in ONE_HOT for i in range(x, y))}, {', '.join(f'CASE WHEN {x} THEN 1 ELSE 0 END AS {n}' for n, x in FLAGS.items())} FROM c"""))
def udf27_design_matrix(spark, sf_dir):
    from ..functions.calendar import week_of_month

    values = {"month": F.month("date"), "dow": F.weekday("date"), "wom": week_of_month("date")}
    hot = [F.when(values[n] == i, 1).otherwise(0).alias(f"{n}_{i}") for n, x, y in ONE_HOT for i in range(x, y)]
    return _technical(spark, sf_dir).select("asset", "date", *hot, *[F.when(F.expr(x), 1).otherwise(0).alias(n) for n, x in FLAGS.items()])


# ---- Q-08 and the timing scores ---------------------------------------------

SELL = f"""{RET}, {TECH}, w AS (SELECT *, value / lag(value, 60) {O} - 1 AS mom60, CASE WHEN count(value) {last(50)} >= 50 THEN avg(value) {last(50)} END AS ma50 FROM tech),
v AS (SELECT *, CASE WHEN vol20 IS NOT NULL THEN (rank() OVER (PARTITION BY asset ORDER BY vol20 NULLS LAST) + (count(*) OVER (PARTITION BY asset, vol20) - 1) / 2.0) / count(vol20) OVER (PARTITION BY asset) END AS vr FROM w),
sc AS (SELECT asset, date, least(greatest(least(greatest((strength - 50) / 50 * 25, 0), 25) + least(greatest(-mom20 * 100, 0), 20) + least(greatest(-mom60 * 50, 0), 15)
+ CASE WHEN ma50 < ma200 THEN 20 ELSE 0 END + least(greatest(vr * 15, 0), 15) + CASE WHEN month(date) IN (6, 9) THEN 5 WHEN month(date) = 8 THEN 2 ELSE 0 END, 0), 100) AS score FROM v WHERE strength IS NOT NULL AND mom20 IS NOT NULL AND mom60 IS NOT NULL AND vr IS NOT NULL)"""


@query(sql("p", f"{SELL} SELECT asset, date, round(score, 4) AS score, CASE WHEN round(score, 4) >= 70 THEN 'sell' WHEN round(score, 4) >= 55 THEN 'reduce' WHEN round(score, 4) >= 40 THEN 'caution' WHEN round(score, 4) >= 25 THEN 'watch' ELSE 'hold' END AS tier FROM sc"))
def sca13_sell_score(spark, sf_dir):
    x = _technical(spark, sf_dir).withColumn("mom60", S.change("value", 60)).withColumn("ma50", S.mean("value", 50))
    known = Window.partitionBy("asset", F.col("vol20").isNotNull())
    rank = F.rank().over(known.orderBy("vol20")) + (F.count("*").over(Window.partitionBy("asset", "vol20")) - 1) / 2
    x = x.withColumn("vr", F.when(F.col("vol20").isNotNull(), rank / F.count("vol20").over(known)))
    x = x.withColumn("score", F.round(g.sell_score("date", F.col("strength"), F.col("mom20"), F.col("mom60"), F.col("ma50") < F.col("ma200"), F.col("vr")), 4))
    return x.filter("score is not null").select("asset", "date", "score", g.sell_tier(F.col("score")).alias("tier"))


BUY_SQL = f"""least(greatest(CASE month(date) {' '.join(f'WHEN {m} THEN {v}' for m, v in g.BUY_PRIOR.items())} END + CASE isodow(date) WHEN 1 THEN -0.02 WHEN 2 THEN 0.01 WHEN 3 THEN 0.01 WHEN 4 THEN 0.02 WHEN 5 THEN 0.01 ELSE 0 END
+ CASE WHEN day(date) <= 3 THEN 0.03 WHEN day(date) >= 28 THEN 0.02 ELSE 0 END, 0.05), 0.95)::DOUBLE * 100"""


@query(sql("t", f"SELECT date, round({BUY_SQL}, 4) AS buy_score, day(date) <= 3 AS month_start, day(date) >= 28 AS month_end, isodow(date) = 5 AND day(date) BETWEEN 15 AND 21 AS expiry FROM t WHERE isodow(date) <= 5"))
def sca14_buy_score(spark, sf_dir):
    from ..functions.calendar import third_friday

    t = a.daily_total(spark, sf_dir).filter(F.weekday("date") < 5)
    dom = F.dayofmonth("date")
    return t.select("date", F.round(g.buy_score("date"), 4).alias("buy_score"), (dom <= 3).alias("month_start"), (dom >= 28).alias("month_end"), third_friday("date").alias("expiry"))


@query(sql("p", f"""{SELL}, b AS (SELECT asset, date, score, {BUY_SQL} AS buy FROM sc WHERE isodow(date) <= 5), f AS (SELECT asset, date, lead(value, 5) {O} / value - 1 AS f FROM p)
SELECT b.asset, year(b.date) AS year, CASE WHEN round(buy, 4) >= 60 THEN 'buy' ELSE 'wait' END AS side, count(*) AS n, round(avg(round(score, 4)), 3) AS sell_score, round(avg(f), 6) AS next5 FROM b JOIN f ON f.asset = b.asset AND f.date = b.date GROUP BY 1, 2, 3"""), dates="")
def q08_timing(spark, sf_dir):
    x = sca13_sell_score(spark, sf_dir).drop("tier").join(a.daily_prices(spark, sf_dir).select("asset", "date", S.forward_change("value", 5).alias("f")), ["asset", "date"])
    x = x.filter(F.weekday("date") < 5).withColumn("side", F.when(F.round(g.buy_score("date"), 4) >= 60, "buy").otherwise("wait"))
    return x.groupBy("asset", F.year("date").cast("long").alias("year"), "side").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("sell_score"), F.round(F.avg("f"), 6).alias("next5"))


# ---- Q-07 and Q-09: correlations, cycles and long-run seasons ------------------


@query(sql("p t", f"""{RET}, rt AS (SELECT date, value / lag(value) OVER (ORDER BY date) - 1 AS m FROM t), j AS (SELECT asset, r.date, r, m FROM r JOIN rt ON rt.date = r.date WHERE r IS NOT NULL AND m IS NOT NULL),
v AS (SELECT *, CASE WHEN count(r) {last(90)} >= 90 THEN corr(r, m) {last(90)} END AS c90 FROM j)
SELECT asset, year(date) AS year, count(*) AS n, round(corr(r, m), 6) AS corr, round(avg(c90), 6) AS rolling, round(min(c90), 6) AS lowest, round(max(c90), 6) AS highest FROM v GROUP BY 1, 2"""), dates="")
def q07_correlation_study(spark, sf_dir):
    m = a.daily_total(spark, sf_dir).select("date", Series((), "date").change("value").alias("m"))
    j = _returns(spark, sf_dir).join(m, "date").filter("r is not null and m is not null").withColumn("c90", S.correlation("r", "m", 90))
    by = j.groupBy("asset", F.year("date").cast("long").alias("year"))
    return by.agg(F.count("*").alias("n"), *_r(corr=F.corr("r", "m"), rolling=F.avg("c90"), lowest=F.min("c90"), highest=F.max("c90")))


WINDOWS = (30, 90, 180, 365)


@query(sql("t ev", f"""WITH w(h) AS (VALUES {', '.join(f'({h})' for h in WINDOWS)}), x AS (SELECT ev.date AS event, h, ev.date + h AS after, ev.date - h AS before FROM ev CROSS JOIN w),
a AS (SELECT x.*, t.value AS base FROM x ASOF JOIN t ON x.event >= t.date), b AS (SELECT a.*, t.value AS va, t.date AS da FROM a ASOF LEFT JOIN t ON a.after <= t.date), c AS (SELECT b.*, t.value AS vb FROM b ASOF LEFT JOIN t ON b.before >= t.date)
SELECT h, count(va) AS n, round(avg(va / base - 1), 6) AS after, round(avg(base / vb - 1), 6) AS before FROM c GROUP BY h"""), dates="")
def q07_around_events(spark, sf_dir):
    t, ev = a.daily_total(spark, sf_dir), a.large_order_days(spark, sf_dir)
    hs = F.explode(F.array(*map(F.lit, WINDOWS))).alias("h")
    x = ev.select(F.col("date").alias("event"), hs).withColumn("later", F.date_add("event", F.col("h"))).withColumn("earlier", F.date_sub("event", F.col("h")))
    named = lambda n: t.select(F.col("date").alias(f"d_{n}"), F.col("value").alias(n))
    x = asof_join(x, named("base"), "event", "d_base").withColumn("base", F.col("matched.base")).drop("matched")
    x = asof_join(x, named("va"), "later", "d_va", direction="forward").withColumn("va", F.col("matched.va")).drop("matched")
    x = asof_join(x, named("vb"), "earlier", "d_vb").withColumn("vb", F.col("matched.vb"))
    return x.filter("base is not null").groupBy("h").agg(F.count("va").alias("n"), *_r(after=F.avg(F.col("va") / F.col("base") - 1), before=F.avg(F.col("base") / F.col("vb") - 1)))


STARTS = (1995, 1996, 1997, 1998, 1999, 2000)


@query(sql("t", f"""WITH m AS (SELECT date_trunc('month', date) AS m, arg_max(value, date) AS v FROM t GROUP BY 1), r AS (SELECT year(m) AS year, month(m) AS month, v / lag(v) OVER (ORDER BY m) - 1 AS r FROM m),
s(start) AS (VALUES {', '.join(f'({y})' for y in STARTS)}) SELECT start, month, count(*) AS n, round(avg({UP.format('r')}), 6) AS up_rate, round(avg(r), 6) AS mean, round(median(r), 6) AS median FROM r JOIN s ON year >= start WHERE r IS NOT NULL GROUP BY 1, 2"""), dates="")
def q09_long_history(spark, sf_dir):
    t = a.daily_total(spark, sf_dir).groupBy(F.trunc("date", "month").alias("m")).agg(F.max_by("value", "date").alias("v"))
    r = t.select(F.year("m").alias("year"), F.month("m").cast("long").alias("month"), Series((), "m").change("v").alias("r")).filter("r is not null")
    r = r.withColumn("start", F.explode(F.filter(F.array(*map(F.lit, STARTS)), lambda y: y <= F.col("year"))))
    return r.groupBy("start", "month").agg(F.count("*").alias("n"), *_r(up_rate=F.avg((F.col("r") > 0).cast("double")), mean=F.avg("r"), median=F.median("r")))


# ---- scalar rules -----------------------------------------------------------


@query(sql("p", f"""{RET}, {TECH} SELECT asset, date, round(CASE WHEN mom20 IS NOT NULL THEN least(greatest(50 + mom20 * 500, 0), 100) END, 6) AS momentum, round((1 - percent) * 100, 6) AS calm, round(50 + term * 10, 6) AS term
FROM (SELECT asset, date, mom20, CASE WHEN vol20 IS NOT NULL THEN percent_rank() OVER (PARTITION BY asset, vol20 IS NULL ORDER BY vol20) END AS percent, value / ma200 - 1 AS term FROM tech) AS x"""))
def sca10_sub_scores(spark, sf_dir):
    known = F.col("vol20").isNotNull()
    percent = F.when(known, F.percent_rank().over(Window.partitionBy("asset", known).orderBy("vol20")))
    x = _technical(spark, sf_dir).withColumn("percent", percent)
    return x.select("asset", "date", *_r(momentum=g.clipped(50 + F.col("mom20") * 500, 0, 100), calm=(1 - F.col("percent")) * 100, term=50 + (F.col("value") / F.col("ma200") - 1) * 10))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 97 = 0 AS curated, o_totalprice / 20000 AS home, o_custkey % 5 = 0 AS spac, o_totalprice / 300 AS amount, o_orderstatus <> 'P' AS parsed, o_custkey % 3 = 0 AS abroad FROM orders)
SELECT o_orderkey, CASE WHEN curated OR home >= 20 THEN 'major' WHEN spac THEN 'rest' WHEN parsed AND amount >= 1000 THEN 'major' WHEN parsed AND amount >= 300 THEN 'notable' WHEN abroad AND NOT parsed THEN 'notable' ELSE 'rest' END AS tier FROM x""", dates="")
def sca19_offering_tier(spark, sf_dir):
    o, price = a.table(spark, sf_dir, "orders"), F.col("o_totalprice")
    tier = g.offering_tier(F.col("o_orderkey") % 97 == 0, price / 20000, F.col("o_custkey") % 5 == 0, price / 300, F.col("o_orderstatus") != "P", F.col("o_custkey") % 3 == 0)
    return o.select("o_orderkey", tier.alias("tier"))


FORMS = ["S-1", "S-1/A", "F-1", "424B4", "8-A12B", "F-6", "S-11", "f-1/a"]


@query(f"""WITH x AS (SELECT p_partkey, [{', '.join(f"'{x}'" for x in FORMS)}][p_partkey % {len(FORMS)} + 1] AS form FROM part), s AS (SELECT p_partkey, CASE WHEN regexp_matches(upper(form), '^[SF]-1(/|$)') THEN 'filed' WHEN upper(form) LIKE '424B%' THEN 'priced' WHEN upper(form) LIKE '8-A12B%' THEN 'listed' END AS stage FROM x)
SELECT p_partkey, stage, CASE stage WHEN 'filed' THEN 1 WHEN 'priced' THEN 2 WHEN 'listed' THEN 3 END AS rank FROM s""", dates="")
def sca20_form_stage(spark, sf_dir):
    form = F.get(F.array(*map(F.lit, FORMS)), (F.col("p_partkey") % len(FORMS)).cast("int"))
    p = a.table(spark, sf_dir, "part").withColumn("stage", g.form_stage(form))
    return p.select("p_partkey", "stage", g.stage_rank(F.col("stage")).alias("rank"))


@query("SELECT date, isoyear(date) || '-W' || lpad(CAST(week(date) AS VARCHAR), 2, '0') AS label, CAST(date_trunc('week', date) AS DATE) AS monday, CAST(date_trunc('week', date) AS DATE) + 6 AS sunday FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) AS x", dates="date monday sunday")
def sca23_week_span(spark, sf_dir):
    d = a.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    monday = F.trunc("date", "week")
    label = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), "date").cast("int"), F.weekofyear("date"))
    return d.select("date", label.alias("label"), monday.alias("monday"), F.date_add(monday, 6).alias("sunday"))


@query("SELECT o_orderkey, DATE '2001-09-01' - CAST(o_orderdate AS DATE) AS age FROM orders", dates="")
def sca24_age(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    stamp = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = o.withColumn("stamp", stamp)  # either form; the day is what counts
    return o.select("o_orderkey", F.datediff(F.lit("2001-09-01").cast("date"), F.substring("stamp", 1, 10).cast("date")).cast("long").alias("age"))


@query("""WITH x AS (SELECT o_orderkey, o_totalprice - 200000 AS gain, o_orderkey % 30 AS months FROM orders)
SELECT o_orderkey, round(gain - greatest(CASE WHEN months >= 12 THEN gain * 0.5 ELSE gain END, 0) * 0.34, 4) AS kept FROM x""", dates="")
def sca26_capital_gains(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(f.after_tax_gain(F.col("o_totalprice") - 200000, F.col("o_orderkey") % 30, 0.32), 4).alias("kept"))


@query("""SELECT c_custkey, round((s1 + s2 + s3) / 3, 6) AS average, CASE WHEN (s1 + s2 + s3) / 3 >= 60 THEN 'bold' WHEN (s1 + s2 + s3) / 3 >= 40 THEN 'balanced' ELSE 'careful' END AS persona FROM (
SELECT c_custkey, (c_custkey % 101)::DOUBLE AS s1, (c_custkey * 7 % 101)::DOUBLE AS s2, least(greatest((c_acctbal + 1000) / 11000 * 100, 0), 100) AS s3 FROM customer) AS x""", dates="")
def sca28_persona(spark, sf_dir):
    key = F.col("c_custkey")
    mean = f.row_mean((key % 101).cast("double"), (key * 7 % 101).cast("double"), f.scale("c_acctbal", -1000, 10000), least=3)
    return a.table(spark, sf_dir, "customer").withColumn("m", mean).select("c_custkey", F.round("m", 6).alias("average"), f.tier("m", {"bold": 60, "balanced": 40}, "careful").alias("persona"))


@query("""WITH x AS (SELECT p_partkey, 0.4 + (p_partkey % 41) / 200.0::DOUBLE AS auc, (p_size - 25) / 500.0::DOUBLE AS gain, (p_partkey % 13) / 40.0::DOUBLE AS p FROM part)
SELECT p_partkey, CASE WHEN auc < 0.485 THEN 'loses' WHEN auc > 0.515 THEN 'beats' ELSE 'ties' END AS by_auc, CASE WHEN gain < -0.02 THEN 'loses' WHEN gain > 0.02 THEN 'beats' ELSE 'ties' END AS by_gain,
CASE WHEN gain < 0 THEN 'loses' WHEN gain > 0 AND p < 0.1 THEN 'beats' ELSE 'ties' END AS by_diff, CASE WHEN p_partkey % 13 < 3 THEN 'insufficient' WHEN gain > 0 THEN 'beats' WHEN gain < 0 THEN 'loses' ELSE 'ties' END AS forward FROM x JOIN (SELECT p_partkey AS k FROM part) AS y ON y.k = x.p_partkey""", dates="")
def sca30_verdicts(spark, sf_dir):
    key = F.col("p_partkey")
    x = a.table(spark, sf_dir, "part").select(key, (0.4 + (key % 41) / 200.0).alias("auc"), ((F.col("p_size") - 25) / 500.0).alias("gain"), ((key % 13) / 40.0).alias("p"))
    gain = F.col("gain")
    cols = {"by_auc": g.auc_verdict(F.col("auc"), F.lit(0.5)), "by_gain": g.gain_verdict(gain), "by_diff": g.difference_verdict(gain, F.col("p")), "forward": g.forward_verdict(key % 13 >= 3, gain)}
    return x.select("p_partkey", *[v.alias(n) for n, v in cols.items()])


@query(sql("p", f"""{RET} SELECT asset, date, CASE WHEN r > 0.01 THEN 'up' WHEN r < -0.01 THEN 'down' WHEN r IS NOT NULL THEN 'flat' END AS bucket, CAST(sign(r) AS INT) AS direction FROM r"""))
def sca31_zones(spark, sf_dir):
    r = F.col("r")
    zone = F.when(r > 0.01, "up").when(r < -0.01, "down").when(r.isNotNull(), "flat")
    return _returns(spark, sf_dir).select("asset", "date", zone.alias("bucket"), F.signum("r").cast("int").alias("direction"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'UP' WHEN o_orderkey % 3 = 1 THEN 'DOWN' ELSE 'FLAT' END AS direction, CAST(o_custkey % 100 AS INT) AS confidence, 'order ' || o_orderkey AS reason FROM orders", dates="")
def sca33_structured_text(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    word = F.when(F.col("o_orderkey") % 3 == 0, "Up").when(F.col("o_orderkey") % 3 == 1, "down").otherwise("FLAT")
    text = F.concat_ws("\n", F.lit("Here is my view."), F.concat(F.lit("Direction: "), word), F.format_string("Confidence: %d%%", F.col("o_custkey") % 100), F.concat(F.lit("Reason:  order "), "o_orderkey"))
    o = o.select("o_orderkey", text.alias("t"))
    part = lambda p: F.regexp_extract("t", p, 1)
    return o.select("o_orderkey", F.upper(part(r"(?im)^direction:\s*(up|down|flat)")).alias("direction"), part(r"(?im)^confidence:\s*(\d{1,3})").cast("int").alias("confidence"), part(r"(?im)^reason:\s*(.+)$").alias("reason"))


# ---- rankings ---------------------------------------------------------------


@query(sql("k", """WITH r AS (SELECT ticker, arg_max(close, date) AS c1, max(date) AS d FROM k GROUP BY 1), b AS (SELECT k.ticker, arg_max(close, k.date) AS c0 FROM k JOIN r ON r.ticker = k.ticker WHERE k.date <= r.d - 7 GROUP BY 1),
m AS (SELECT r.ticker, c1 / c0 - 1 AS chg FROM r JOIN b ON b.ticker = r.ticker), n AS (SELECT *, row_number() OVER (ORDER BY chg DESC, ticker) AS hi, row_number() OVER (ORDER BY chg, ticker) AS lo FROM m)
SELECT ticker, round(chg, 6) AS chg, CASE WHEN hi <= 3 THEN 'top' ELSE 'bottom' END AS side FROM n WHERE hi <= 3 OR lo <= 3"""), dates="")
def top08_movers(spark, sf_dir):
    from ..operators.ranking import both_tails

    k = a.ticker_panel(spark, sf_dir)
    end = k.groupBy("ticker").agg(F.max_by("close", "date").alias("c1"), F.max("date").alias("d"))
    start = k.join(end, "ticker").filter(F.col("date") <= F.date_sub("d", 7)).groupBy("ticker").agg(F.max_by("close", "date").alias("c0"))
    m = end.join(start, "ticker").select("ticker", (F.col("c1") / F.col("c0") - 1).alias("chg"))
    return both_tails(m, "chg", "ticker", 3).select("ticker", F.round("chg", 6).alias("chg"), "side")


@query(sql("k", """WITH r AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r, close / lag(close, 60) OVER (PARTITION BY ticker ORDER BY date) - 1 AS m, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM k),
v AS (SELECT ticker, stddev_samp(r) AS v FROM r WHERE k <= 60 GROUP BY 1), s AS (SELECT r.ticker, 60 * least(greatest(50 + m * 100, 0), 100) / 100 + 40 * least(greatest(100 - v * 100, 0), 100) / 100 AS score FROM r JOIN v ON v.ticker = r.ticker WHERE k = 1)
SELECT ticker, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, ticker) AS rank FROM s ORDER BY score DESC, ticker LIMIT 5"""), dates="")
def top09_recommended(spark, sf_dir):
    w = Series(("ticker",), "date")
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    r = a.ticker_panel(spark, sf_dir).withColumn("r", w.change("close")).withColumn("m", w.change("close", 60)).withColumn("k", back).filter("k <= 60")
    by = r.groupBy("ticker").agg(F.stddev_samp("r").alias("v"), F.max(F.when(F.col("k") == 1, F.col("m"))).alias("m"))
    score = 60 * g.clipped(50 + F.col("m") * 100, 0, 100) / 100 + 40 * g.clipped(100 - F.col("v") * 100, 0, 100) / 100
    best = by.withColumn("score", score).orderBy(F.desc("score"), "ticker").limit(5)  # the report's length
    return best.select("ticker", F.round("score", 4).alias("score"), F.row_number().over(Window.orderBy(F.desc("score"), "ticker")).cast("long").alias("rank"))
