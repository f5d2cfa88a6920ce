"""Registered statistics and study queries; those that draw at random have no SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as g
from ..operators import models as m
from ..operators import resampling as b
from ..operators import significance as s
from ..operators.folds import local_levels
from ..operators.windows import Series
from ..sources import adapters as a
from .registry import query
from .window_queries import RET, O, _r, _returns, ahead, last

S = Series(("asset",), "date")
ONE = Series((), "date")
sql = a.with_views

MONTH_P = """x AS (SELECT asset, month(date) AS month, avg(r) AS mean, stddev_samp(r) / sqrt(count(r)) AS se FROM r GROUP BY 1, 2),
p2 AS (SELECT asset, month, 1 / (1 + (mean / se) * (mean / se)) AS p FROM x)"""


def _month_p(spark, sf_dir):
    """A p-like number for each asset and month, made of exact arithmetic only."""
    r = _returns(spark, sf_dir).groupBy("asset", F.month("date").cast("long").alias("month"))
    x = r.agg(F.avg("r").alias("mean"), (F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("se"))
    z = F.col("mean") / F.col("se")
    return x.select("asset", "month", (1 / (1 + z * z)).alias("p"))


Q_SQL = """i AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY p) AS i, count(*) OVER (PARTITION BY asset) AS m FROM p2),
q AS (SELECT *, least(min(p * m / i) OVER (PARTITION BY asset ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q, sum(1.0 / i) OVER (PARTITION BY asset) AS c FROM i)"""


@query(sql("p", f"{RET}, {MONTH_P}, {Q_SQL} SELECT asset, month, round(p, 6) AS p, round(q, 6) AS q_bh, round(least(q * c, 1.0), 6) AS q_by FROM q"), dates="")
def udf10_q_values(spark, sf_dir):
    return s.q_values(_month_p(spark, sf_dir), "p", ["asset"]).select("asset", "month", *_r(p=F.col("p"), q_bh=F.col("q_bh"), q_by=F.col("q_by")))


@query(sql("p", f"""{RET}, {MONTH_P}, {Q_SQL}, j AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM q),
o AS (SELECT *, least(min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS pool FROM j)
SELECT asset, month, CASE WHEN q <= 0.1 AND pool <= 0.1 THEN 'survives' WHEN q <= 0.1 THEN 'family only' ELSE 'noise' END AS verdict FROM o"""), dates="")
def udf11_verdicts(spark, sf_dir):
    q = s.q_values(_month_p(spark, sf_dir), "p", ["asset"]).withColumnRenamed("q_bh", "q_family").drop("q_by")
    q = s.q_values(q, "p").withColumnRenamed("q_bh", "q_pool")
    return s.verdicts(q, "q_family", "q_pool", 0.1).select("asset", "month", "verdict")


AUC_SQL = f"""f AS (SELECT asset, r AS score, CASE WHEN lead(value, 5) {O} / value - 1 > 0 THEN 1 ELSE 0 END AS y, lead(value, 5) {O} AS known FROM r),
k AS (SELECT * FROM f WHERE known IS NOT NULL AND score IS NOT NULL),
a AS (SELECT *, rank() OVER (PARTITION BY asset ORDER BY score) + (count(*) OVER (PARTITION BY asset, score) - 1) / 2.0 AS rk FROM k)"""


@query(sql("p", f"""{RET}, {AUC_SQL} SELECT asset, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc, round(avg((score - y) * (score - y)), 4) AS brier, count(*) AS n FROM a GROUP BY asset"""), dates="")
def udf08_auc(spark, sf_dir):
    f = _returns(spark, sf_dir).withColumn("f", S.forward_change("value", 5)).filter("f is not null and r is not null")
    f = f.select("asset", F.col("r").alias("score"), (F.col("f") > 0).cast("int").alias("y"))
    return s.auc(f, "score", "y", ["asset"]).select("asset", F.round("auc", 6).alias("auc"), F.round("brier", 4).alias("brier"), "n")


@query(sql("p t", f"""WITH j AS (SELECT p.asset, p.value AS x, t.value AS y FROM p JOIN t ON p.date = t.date),
k AS (SELECT asset, rank() OVER (PARTITION BY asset ORDER BY x) + (count(*) OVER (PARTITION BY asset, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY asset ORDER BY y) + (count(*) OVER (PARTITION BY asset, y) - 1) / 2.0 AS ry FROM j)
SELECT asset, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM k GROUP BY asset"""), dates="")
def udf14_spearman(spark, sf_dir):
    t = a.daily_total(spark, sf_dir).withColumnRenamed("value", "y")
    j = a.daily_prices(spark, sf_dir).withColumnRenamed("value", "x").join(t, "date")
    return s.spearman(j, "x", "y", ["asset"]).select("asset", F.round("rho", 6).alias("rho"), "n")


@query(sql("p", f"{RET} SELECT asset, round(avg(r) / (stddev_samp(r) / sqrt(count(r))), 6) AS t, count(r) - 1 AS df, round(avg(r), 6) AS mean FROM r WHERE r IS NOT NULL GROUP BY asset"), dates="")
def udf13_t_statistic(spark, sf_dir):
    t = s.t_statistic(_returns(spark, sf_dir), "r", ["asset"])
    return t.select("asset", F.round("t", 6).alias("t"), "df", F.round("mean", 6).alias("mean"))


@query(sql("p", f"""{RET}, h AS (SELECT asset, abs(r) AS e, row_number() OVER (PARTITION BY asset ORDER BY abs(r)) AS i, count(*) OVER (PARTITION BY asset) AS n FROM r WHERE r IS NOT NULL)
SELECT asset, n, round(e, 6) AS width FROM h WHERE i = CAST(ceil((n + 1) * 0.9::DOUBLE) AS BIGINT)"""), dates="")
def udf16_conformal(spark, sf_dir):
    band = s.conformal_band(_returns(spark, sf_dir).filter("r is not null"), "r", 0.1, ["asset"])
    return band.select("asset", "n", F.round("width", 6).alias("width"))


@query(sql("p", f"""{RET}, c AS (SELECT asset, least(greatest((r + 1) / 4, 0), 0.999) AS p, CASE WHEN r > 0 THEN 1 ELSE 0 END AS y FROM r WHERE r IS NOT NULL),
b AS (SELECT asset, floor(p * 10) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM c GROUP BY 1, 2) SELECT asset, round(sum(gap * n) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY asset"""), dates="")
def agg32_calibration_error(spark, sf_dir):
    c = _returns(spark, sf_dir).filter("r is not null")
    c = c.select("asset", F.least(F.greatest((F.col("r") + 1) / 4, F.lit(0.0)), F.lit(0.999)).alias("p"), (F.col("r") > 0).cast("int").alias("y"))
    return s.expected_calibration_error(c, "p", "y", 10, ["asset"]).select("asset", F.round("ece", 6).alias("ece"), "n")


@query(sql("p", f"""{RET}, f AS (SELECT asset, month(date) AS grp, r FROM r WHERE r IS NOT NULL), a AS (SELECT asset, sum(r) AS s, count(*) AS n FROM f GROUP BY 1), g AS (SELECT asset, grp, sum(r) AS s, count(*) AS n FROM f GROUP BY 1, 2)
SELECT g.asset, grp AS left_out, round((a.s - g.s) / (a.n - g.n), 6) AS mean FROM g JOIN a ON a.asset = g.asset"""), dates="")
def udf06_leave_one_out(spark, sf_dir):
    per = _returns(spark, sf_dir).filter("r is not null").groupBy("asset", F.month("date").cast("long").alias("left_out")).agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("asset")
    return per.select("asset", "left_out", F.round((F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n")), 6).alias("mean"))


@query(sql("p t", f"""WITH j AS (SELECT p.asset, p.date AS date, p.value AS y, t.value AS x FROM p JOIN t ON p.date = t.date)
SELECT asset, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM j GROUP BY asset"""), dates="")
def udf36_least_squares(spark, sf_dir):
    t = a.daily_total(spark, sf_dir).withColumnRenamed("value", "x")
    j = a.daily_prices(spark, sf_dir).withColumnRenamed("value", "y").join(t, "date").groupBy("asset")
    return j.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


FOLDS = {1: ("1997-01-01", "1998-01-01"), 2: ("1998-01-01", "1999-01-01"), 3: ("1999-01-01", "2000-01-01")}


@query(sql("p", f"""{RET}, f(fold, cut, stop) AS (VALUES {', '.join(f"({k}, DATE '{x}', DATE '{y}')" for k, (x, y) in FOLDS.items())}),
k AS (SELECT fold, asset, avg(r) FILTER (date < cut) AS train, avg(r) FILTER (date >= cut AND date < stop) AS test, count(r) FILTER (date < cut) AS n_train FROM r CROSS JOIN f WHERE date < stop GROUP BY 1, 2)
SELECT fold, asset, round(train, 6) AS train, round(test, 6) AS test, n_train, sign(train) = sign(test) AS same_sign FROM k"""), dates="")
def udf25_walk_forward(spark, sf_dir):
    folds = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(x).cast("date").alias("cut"), F.lit(y).cast("date").alias("stop")) for k, (x, y) in FOLDS.items()])
    r = _returns(spark, sf_dir).withColumn("f", F.explode(folds)).select("asset", "date", "r", "f.*").filter("date < stop")
    inside = F.when(F.col("date") < F.col("cut"), F.col("r"))
    outside = F.when(F.col("date") >= F.col("cut"), F.col("r"))
    k = r.groupBy("fold", "asset").agg(F.avg(inside).alias("train"), F.avg(outside).alias("test"), F.count(inside).alias("n_train"))
    return k.select("fold", "asset", *_r(train=F.col("train"), test=F.col("test")), "n_train", (F.signum("train") == F.signum("test")).alias("same_sign"))


# ---- resampling and models: no SQL ------------------------------------------


def _with_forward(spark, sf_dir, h=5):
    f = _returns(spark, sf_dir).withColumn("f", S.forward_change("value", h))
    return f.filter("f is not null and r is not null").select("asset", "date", "r", "f")


@query(dates="")
def udf01_block_bootstrap(spark, sf_dir):
    def test(frame, seed):
        y, r = frame["f"].to_numpy(), frame["r"].to_numpy()
        return b.block_bootstrap(r <= np.quantile(r, 0.1), y, block=20, draws=2000, seed=seed)

    schema = "asset string, diff double, low double, high double, p double, n_used long, n_dropped long"
    return b.per_group(_with_forward(spark, sf_dir), ["asset"], "date", schema, test)


@query(dates="")
def udf02_permutation(spark, sf_dir):
    def test(frame, seed):
        return b.permutation_test(frame["r"].to_numpy(), frame["label"].to_numpy(), draws=1000, seed=seed)

    r = _with_forward(spark, sf_dir).withColumn("label", F.weekday("date"))
    return b.per_group(r, ["asset"], "date", "asset string, observed double, p double, n long", test)


@query(dates="")
def udf04_cluster_bootstrap(spark, sf_dir):
    def test(frame, seed):
        return b.cluster_bootstrap(frame["f"].to_numpy(), frame["cluster"].to_numpy(), draws=2000, seed=seed)

    r = _with_forward(spark, sf_dir).withColumn("cluster", F.date_format("date", "yyyyMM"))
    return b.per_group(r, ["asset"], "date", "asset string, mean double, low double, high double, clusters long, n long", test)


@query(dates="")
def udf15_tail_risk(spark, sf_dir):
    def test(frame, seed):
        return m.tail_risk(-frame["r"].to_numpy())

    names = ["threshold", "shape", "scale", "var", "es", "shape_low", "shape_high", "loss_5y", "loss_10y", "loss_20y"]
    schema = f"asset string, {', '.join(f'{n} double' for n in names)}, n long"
    return b.per_group(_with_forward(spark, sf_dir), ["asset"], "date", schema, test)


@query(dates="")
def udf18_spectral(spark, sf_dir):
    def test(frame, seed):
        return m.spectral_test(np.log1p(frame["r"].to_numpy()), draws=1000, seed=seed)

    return b.per_group(_with_forward(spark, sf_dir), ["asset"], "date", "asset string, phi double, peak double, period double, p double, n long", test)


LEVEL = sql("p", f"""WITH n AS (SELECT asset, date, value, row_number() {O} AS i FROM p), f AS (SELECT asset, i, date, value, value AS level, 1.1 / 2.1::DOUBLE AS var FROM n WHERE i = 1
UNION ALL SELECT n.asset, n.i, n.date, n.value, f.level + (f.var + 0.1) / (f.var + 1.1) * (n.value - f.level), (f.var + 0.1) / (f.var + 1.1) FROM f JOIN n ON n.asset = f.asset AND n.i = f.i + 1)
SELECT asset, CAST(date AS VARCHAR) AS date, round(level, 6) AS level FROM f""")


@query(LEVEL.replace("WITH", "WITH RECURSIVE", 1), dates="")
def sta19_local_level(spark, sf_dir):
    found = local_levels(a.daily_prices(spark, sf_dir), ["asset"], "date", "value", 0.1)
    return found.select("asset", F.col("date").cast("string").alias("date"), F.round("level", 6).alias("level"))


def _flags(spark, sf_dir):
    f = _returns(spark, sf_dir)
    f = f.withColumn("momentum", S.change("value", 20)).withColumn("z", S.z_score("value", 60)).withColumn("y", (S.forward_change("value", 5) > 0).cast("double"))
    return f.select("asset", "date", "r", "momentum", "z", "y").dropna()


def _split(df):
    cut = "1999-06-01"
    return df.filter(F.col("date") < F.date_sub(F.lit(cut).cast("date"), 20)), df.filter(F.col("date") >= F.lit(cut).cast("date"))


@query(dates="")
def udf28_logistic(spark, sf_dir):
    out = m.logistic(*_split(_flags(spark, sf_dir)), ["r", "momentum", "z"], "y")
    return s.auc(out.withColumn("y", F.col("y").cast("int")), "p", "y", ["asset"])


@query(dates="")
def udf30_forest(spark, sf_dir):
    out = m.trees(*_split(_flags(spark, sf_dir)), ["r", "momentum", "z"], "y", "forest")
    return s.auc(out.withColumn("y", F.col("y").cast("int")), "p", "y", ["asset"])


@query(dates="")
def udf29_boosted_trees(spark, sf_dir):
    out = m.trees(*_split(_flags(spark, sf_dir)), ["r", "momentum", "z"], "y", "boosted")
    return s.auc(out.withColumn("y", F.col("y").cast("int")), "p", "y", ["asset"])


@query(dates="")
def udf31_principal_components(spark, sf_dir):
    assets = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = _returns(spark, sf_dir).groupBy("date").pivot("asset", assets).agg(F.max("r")).fillna(0.0)
    return m.principal_components(wide.drop("date"), assets, 3, "1-URGENT")


Z_SQL = f"(value - avg(value) {last(60)}) / nullif(stddev_pop(value) {last(60)}, 0)"
ISOTONIC = f"""{RET}, z AS (SELECT r, value / lag(value, 20) {O} - 1 AS momentum, CASE WHEN count(value) {last(60)} >= 60 THEN {Z_SQL} END AS z, CASE WHEN lead(value, 5) {O} > value THEN 1.0 WHEN lead(value, 5) {O} IS NOT NULL THEN 0.0 END AS y FROM r),
g AS (SELECT round(z, 1) AS x, avg(y) AS rate, count(*) AS n FROM z WHERE r IS NOT NULL AND momentum IS NOT NULL AND z IS NOT NULL AND y IS NOT NULL GROUP BY 1), h AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(rate) OVER (ORDER BY x) AS s FROM g),
m AS (SELECT a.i AS j, b.i AS k, (b.s - a.s + a.rate) / (b.i - a.i + 1) AS mean FROM h AS a JOIN h AS b ON a.i <= b.i), lo AS (SELECT h.i, m.j, min(mean) AS low FROM h JOIN m ON m.j <= h.i AND m.k >= h.i GROUP BY 1, 2), fit AS (SELECT i, max(low) AS fit FROM lo GROUP BY 1)
SELECT x, rate, n, round(fit, 6) AS calibrated FROM h JOIN fit ON fit.i = h.i"""


@query(sql("p", ISOTONIC), dates="")
def udf12_isotonic(spark, sf_dir):
    f = _flags(spark, sf_dir).groupBy(F.round("z", 1).alias("x")).agg(F.avg("y").alias("rate"), F.count("*").alias("n"))
    return m.isotonic(f, "x", "rate").select("x", "rate", "n", F.round("calibrated", 6).alias("calibrated"))


# ---- studies ----------------------------------------------------------------


@query(sql("t", f"""WITH f AS (SELECT date, CASE WHEN count(*) OVER (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) >= 200 THEN avg(value) OVER (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > avg(value) OVER (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS golden,
lead(value, 20) OVER (ORDER BY date) / value - 1 AS f FROM t), k AS (SELECT * FROM f WHERE golden IS NOT NULL AND f IS NOT NULL)
SELECT CAST(floor(year(date) / 10.0) * 10 AS BIGINT) AS decade, golden, count(*) AS n, round(avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END), 6) AS up_rate, round(avg(f), 6) AS mean FROM k GROUP BY 1, 2"""), dates="")
def q12c_golden_cross(spark, sf_dir):
    t = a.daily_total(spark, sf_dir).withColumn("golden", ONE.mean("value", 50) > ONE.mean("value", 200)).withColumn("f", ONE.forward_change("value", 20))
    k = t.filter("golden is not null and f is not null").groupBy((F.floor(F.year("date") / 10) * 10).alias("decade"), "golden")
    return k.agg(F.count("*").alias("n"), F.round(F.avg((F.col("f") > 0).cast("double")), 6).alias("up_rate"), F.round(F.avg("f"), 6).alias("mean"))


@query(sql("p", f"""{RET}, f AS (SELECT asset, r, lead(value, 1) {O} / value - 1 AS f1, lead(value, 5) {O} / value - 1 AS f5 FROM r), q AS (SELECT asset, quantile_cont(r, 0.05) AS q FROM r GROUP BY asset)
SELECT f.asset, count(*) AS n, round(avg(f1), 6) AS next1, round(avg(f5), 6) AS next5, round(avg(CASE WHEN f5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS up5 FROM f JOIN q ON f.asset = q.asset WHERE r <= q AND f5 IS NOT NULL GROUP BY f.asset"""), dates="")
def q27_overreaction(spark, sf_dir):
    r = _returns(spark, sf_dir)
    f = r.select("asset", "r", S.forward_change("value", 1).alias("f1"), S.forward_change("value", 5).alias("f5"))
    q = r.groupBy("asset").agg(F.percentile("r", F.lit(0.05)).alias("q"))
    k = f.join(q, "asset").filter("r <= q and f5 is not null").groupBy("asset")
    return k.agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("next1"), F.round(F.avg("f5"), 6).alias("next5"), F.round(F.avg((F.col("f5") > 0).cast("double")), 6).alias("up5"))


@query("""WITH b AS (SELECT event_type AS asset, date_trunc('hour', ts) AS hour, arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2),
d AS (SELECT asset, open / lag(close) OVER (PARTITION BY asset ORDER BY hour) - 1 AS overnight, close / open - 1 AS intraday FROM b)
SELECT asset, count(*) AS n, round(avg(overnight) FILTER (abs(overnight) < 0.15), 6) AS overnight, round(avg(intraday), 6) AS intraday FROM d GROUP BY asset""", dates="")
def q10_overnight_intraday(spark, sf_dir):
    w = Series(("asset",), "hour")
    bars = a.bars(spark, sf_dir)
    d = bars.select("asset", (F.try_divide("open", w.lagged("close")) - 1).alias("o"), (F.try_divide("close", "open") - 1).alias("i")).groupBy("asset")
    return d.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.abs("o") < 0.15, F.col("o"))), 6).alias("overnight"), F.round(F.avg("i"), 6).alias("intraday"))


@query(sql("p", f"""{RET}, v AS (SELECT asset, r, CASE WHEN count(r) {last(20)} >= 20 THEN stddev_samp(r) {last(20)} END AS v, CASE WHEN count(r) {ahead(20)} >= 20 THEN stddev_samp(r) {ahead(20)} END AS next FROM r)
SELECT asset, round(corr(v, next), 6) AS persistence, round(regr_slope(next, v), 6) AS slope, count(*) AS n FROM v WHERE v IS NOT NULL AND next IS NOT NULL GROUP BY asset"""), dates="")
def q35_volatility_forecast(spark, sf_dir):
    v = _returns(spark, sf_dir).withColumn("v", S.deviation("r", 20)).withColumn("next", S.guarded(F.stddev_samp, "r", S.ahead(20), 20))
    k = v.filter("v is not null and next is not null").groupBy("asset")
    return k.agg(F.round(F.corr("v", "next"), 6).alias("persistence"), F.round(F.regr_slope("next", "v"), 6).alias("slope"), F.count("*").alias("n"))


@query(sql("p", f"""{RET}, m AS (SELECT *, CASE WHEN count(*) {last(50)} >= 50 THEN avg(value) {last(50)} END AS m FROM r), x AS (SELECT asset, date, r, lag(sign(value - m)) {O} AS pos FROM m),
y AS (SELECT asset, date, r, CASE WHEN pos IS NOT NULL THEN greatest(pos, 0) END AS pos FROM x), n AS (SELECT asset, date, r / 100 AS r, pos, abs(pos - lag(pos) {O}) AS turn FROM y), s AS (SELECT asset, pos * r - coalesce(turn, 0) * 0.0005 AS net, r FROM n WHERE pos IS NOT NULL AND r IS NOT NULL)
SELECT asset, round(exp(sum(ln(1 + net))) - 1, 6) AS overlay, round(exp(sum(ln(1 + r))) - 1, 6) AS hold, round(avg(net) / stddev_samp(net) * sqrt(252.0), 6) AS sharpe, count(*) AS n FROM s GROUP BY asset"""), dates="")
def q33_trend_overlay(spark, sf_dir):
    x = _returns(spark, sf_dir).withColumn("sign", F.signum(F.col("value") - S.mean("value", 50)))
    x = x.withColumn("pos", F.greatest(S.lagged("sign"), F.when(S.lagged("sign").isNotNull(), F.lit(0.0)))).withColumn("r", F.col("r") / 100)
    x = x.withColumn("turn", F.abs(F.col("pos") - S.lagged("pos"))).filter("pos is not null and r is not null")
    x = x.withColumn("net", F.col("pos") * F.col("r") - F.coalesce("turn", F.lit(0.0)) * 0.0005).groupBy("asset")
    sharpe = F.avg("net") / F.stddev_samp("net") * F.sqrt(F.lit(252.0))
    return x.agg(F.round(g.compounded("net"), 6).alias("overlay"), F.round(g.compounded("r"), 6).alias("hold"), F.round(sharpe, 6).alias("sharpe"), F.count("*").alias("n"))
