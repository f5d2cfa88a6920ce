"""Registered discovery studies: candidate triggers by family, their tests, gates and ledgers.

Every family gives rows ``family, key, date, sel, y``: whether the trigger is on
and whether the market rose over the holding period.  Thresholds look back only,
but for the rebound family, whose percentile is that of the whole sample.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as c
from ..functions import signals as g
from ..operators import episodes as e
from ..operators import resampling as b
from ..operators import significance as s
from ..operators.joins import asof_join
from ..operators.ledger import keep_members, transitions
from ..operators.order_statistics import expanding_quantiles, rolling_share
from ..operators.windows import Series
from ..sources import adapters as a
from .registry import query
from .signal_queries import FLAGS, HOLIDAYS, RET, TECH, _technical
from .window_queries import _r

ONE = Series((), "date")
sql = a.with_views
OD = "OVER (ORDER BY date)"
RT = f"WITH r AS (SELECT date, value, value / lag(value) {OD} - 1 AS r FROM t)"


def fwd(h: int) -> str:
    return f"CASE WHEN lead(value, {h}) {OD} > value THEN 1.0 WHEN lead(value, {h}) {OD} IS NOT NULL THEN 0.0 END::DOUBLE"


def _market(spark, sf_dir):
    t = a.daily_total(spark, sf_dir)
    return t.withColumn("r", ONE.change("value"))


def _rose(h):
    ahead = F.lead("value", h).over(ONE.ordered)
    return F.when(ahead.isNotNull(), (ahead > F.col("value")).cast("double"))


# ---- Q-12a: calendar effects ---------------------------------------------------

# Years of world cups.
CUP_YEARS = (1930, 1934, 1938, 1950, 1954, 1958, 1962, 1966, 1970, 1974, 1978, 1982, 1986, 1990, 1994, 1998, 2002, 2006, 2010, 2014, 2018, 2022)
FAMILY = ("pre_holiday", "santa", "winter", "summer_without_cup", "not_september", "january", "turn_of_month", "expiry_week", "quarter_end")
PLACE = "row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS dom, count(*) OVER (PARTITION BY date_trunc('month', date)) AS days"
LABELS = {
    "pre_holiday": "EXISTS (SELECT 1 FROM hol WHERE hol.d - date BETWEEN 1 AND 3) AND coalesce(lead_day, date + 9) > (SELECT min(hol.d) FROM hol WHERE hol.d > date)",
    "santa": "month(date) = 12 AND day(date) >= 26 OR month(date) = 1 AND day(date) <= 3",
    "winter": "month(date) NOT BETWEEN 5 AND 10",
    "summer_without_cup": f"CASE WHEN month(date) BETWEEN 6 AND 8 THEN year(date) NOT IN {CUP_YEARS} END",
    "not_september": "month(date) <> 9",
    "january": "month(date) = 1",
    "turn_of_month": "dom <= 3 OR dom = days",
    "expiry_week": "CAST(date_trunc('week', date) AS DATE) + 4 = CAST(date_trunc('month', CAST(date_trunc('week', date) AS DATE) + 4) AS DATE) + CAST((12 - isodow(date_trunc('month', CAST(date_trunc('week', date) AS DATE) + 4))) % 7 + 14 AS INT)",
    "quarter_end": "month(date) IN (3, 6, 9, 12) AND dom > days - 3",
    **{f"month_{m:02}": f"month(date) = {m}" for m in range(1, 13)},
}
EFFECTS = f"""{RT}, {HOLIDAYS}, pl AS (SELECT *, lead(date) {OD} AS lead_day, {PLACE} FROM r), ef AS ({' UNION ALL '.join(f"SELECT '{n}' AS effect, date, r, CAST(({x}) AS INT) AS lab FROM pl WHERE r IS NOT NULL" for n, x in LABELS.items())}),
ek AS (SELECT * FROM ef WHERE lab IS NOT NULL)"""


def _effects(spark, sf_dir):
    """``effect, date, r, lab``: daily returns under each calendar label."""
    month = Window.partitionBy(F.trunc("date", "month"))
    t = _market(spark, sf_dir).withColumn("next", F.lead("date").over(ONE.ordered))
    t = t.withColumn("dom", F.row_number().over(month.orderBy("date"))).withColumn("days", F.count("*").over(month)).filter("r is not null")
    m, d, y = F.month("date"), F.dayofmonth("date"), F.year("date")
    coming = F.array_min(F.filter(F.concat(c.us_holidays(y), c.us_holidays(y + 1)), lambda h: h > F.col("date")))
    values = {
        "pre_holiday": F.coalesce((F.datediff(coming, "date") <= 3) & (F.coalesce("next", F.date_add("date", 9)) > coming), F.lit(False)),
        "santa": ((m == 12) & (d >= 26)) | ((m == 1) & (d <= 3)),
        "winter": ~m.between(5, 10),
        "summer_without_cup": F.when(m.between(6, 8), ~y.isin(*CUP_YEARS)),
        "not_september": m != 9,
        "january": m == 1,
        "turn_of_month": (F.col("dom") <= 3) | (F.col("dom") == F.col("days")),
        "expiry_week": c.expiry_week("date"),
        "quarter_end": m.isin(3, 6, 9, 12) & (F.col("dom") > F.col("days") - 3),
        **{f"month_{k:02}": m == k for k in range(1, 13)},
    }
    labels = F.array(*[F.struct(F.lit(n).alias("effect"), x.cast("int").alias("lab")).cast("struct<effect:string,lab:int>") for n, x in values.items()])
    return t.select("date", "r", F.inline(labels)).filter("lab is not null")


@query(sql("t", f"""{EFFECTS} SELECT effect, count(*) FILTER (lab = 1) AS n_on, count(*) FILTER (lab = 0) AS n_off, round(avg(r) FILTER (lab = 1), 6) AS mean_on, round(avg(r) FILTER (lab = 0), 6) AS mean_off,
round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (lab = 1), 6) AS up_on, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (lab = 0), 6) AS up_off FROM ek GROUP BY effect"""), dates="")
def q12a_calendar(spark, sf_dir):
    on, off, up = F.col("lab") == 1, F.col("lab") == 0, (F.col("r") > 0).cast("double")
    by = _effects(spark, sf_dir).groupBy("effect")
    means = _r(mean_on=F.avg(F.when(on, F.col("r"))), mean_off=F.avg(F.when(off, F.col("r"))), up_on=F.avg(F.when(on, up)), up_off=F.avg(F.when(off, up)))
    return by.agg(F.count(F.when(on, 1)).alias("n_on"), F.count(F.when(off, 1)).alias("n_off"), *means)


@query(sql("t", f"""{EFFECTS}, gm AS (SELECT effect, lab, count(*) AS n, avg(r) AS m FROM ek GROUP BY 1, 2), al AS (SELECT effect, avg(r) AS m FROM ek GROUP BY 1)
SELECT gm.effect, round(sum(n * (gm.m - al.m) * (gm.m - al.m)), 6) AS between_groups, round(sum(CASE WHEN lab = 1 THEN gm.m ELSE -gm.m END), 6) AS mean_difference, CAST(min(n) AS BIGINT) AS smallest FROM gm JOIN al ON al.effect = gm.effect GROUP BY 1"""), dates="")
def udf03_statistics(spark, sf_dir):
    x = _effects(spark, sf_dir)
    groups = x.groupBy("effect", "lab").agg(F.count("*").alias("n"), F.avg("r").alias("m"))
    every = x.groupBy("effect").agg(F.avg("r").alias("all"))
    by = groups.join(every, "effect").groupBy("effect")
    signed = F.when(F.col("lab") == 1, F.col("m")).otherwise(-F.col("m"))
    return by.agg(F.round(F.sum(F.col("n") * (F.col("m") - F.col("all")) ** 2), 6).alias("between_groups"), F.round(F.sum(signed), 6).alias("mean_difference"), F.min("n").alias("smallest"))


DIRECTED = ("pre_holiday", "santa", "winter", "summer_without_cup", "not_september", "january", "turn_of_month")


def _placebo(rows):
    """Permutation p-value of every effect, 1,000 draws; one-sided where a direction is claimed."""

    def test(frame, seed):
        statistic = b.mean_difference if frame["effect"].iloc[0] in DIRECTED else b.between_groups
        found = b.permutation_test(frame["r"].to_numpy(), frame["lab"].to_numpy(), 1000, seed, statistic)
        return found | {"smallest": int(np.bincount(frame["lab"], minlength=2).min())}

    return b.per_group(rows, ["effect"], "date", "effect string, observed double, p double, n long, smallest long", test)


@query(dates="")
def q11_placebo(spark, sf_dir):
    """Effects with p-values, q-values over all of them, and a state that tells weak tests from rejected ones."""
    q = s.q_values(_placebo(_effects(spark, sf_dir)), "p").drop("q_by")
    state = F.when(F.col("smallest") < 30, "inconclusive").when(F.col("p") < 0.05, "real").otherwise("rejected")
    return q.withColumn("state", state)


# ---- the other families ----------------------------------------------------------

REBOUND = [(p, h) for p in (1, 5, 10) for h in (1, 5)]
STREAKS = [(k, n, h) for k, ns in (("streak_down", (3, 4, 5)), ("streak_break", (3, 5))) for n in ns for h in (1, 3, 5)]
TRAILING = [(n, side, h) for n in (20, 60) for side in ("low", "high") for h in (5, 20)]
POSITION = [(side, h) for side in ("high", "low") for h in (20, 60)]
SENTIMENT = [(side, h) for side in ("high", "low") for h in (5, 20)]


def union_sql(parts) -> str:
    return " UNION ALL ".join(parts)


KIND = "struct<family:string,key:string,h:int,sel:boolean,y:double>"


def _rows(frame, triggers, known=True):
    """A row per day and trigger ``(family, key, on, h)``, in one pass; ``known`` leaves out those without an outcome yet."""
    frame = frame.withColumns({f"_y{h}": _rose(h) for h in {h for *_, h in triggers}})
    made = [F.struct(F.lit(f).alias("family"), F.lit(k).alias("key"), F.lit(h).alias("h"), on.alias("sel"), F.col(f"_y{h}").alias("y")).cast(KIND) for f, k, on, h in triggers]
    rows = frame.select("date", F.inline(F.array(*made))).filter("sel is not null")
    return rows.filter("y is not null") if known else rows


def _union(frames):
    return reduce(lambda x, y: x.unionByName(y), frames)


def _rebound(spark, sf_dir, known=True):
    t = _market(spark, sf_dir)
    t = t.join(t.agg(*[F.percentile("r", F.lit(p / 100)).alias(f"q{p}") for p in (1, 5, 10)]))  # one row
    return _rows(t, [("rebound", f"p{p}_h{h}", F.col("r") <= F.col(f"q{p}"), h) for p, h in REBOUND], known)


REBOUND_SQL = f"""rb AS ({union_sql(f"SELECT 'rebound' AS family, 'p{p}_h{h}' AS key, date, r <= (SELECT quantile_cont(r, {p / 100}) FROM r) AS sel, {fwd(h)} AS y FROM r" for p, h in REBOUND)})"""


def _streaks(spark, sf_dir, known=True):
    t = e.run_lengths(_market(spark, sf_dir), F.col("r") < 0, ())
    t = t.withColumn("was", F.lag("streak").over(ONE.ordered)).filter("r is not null")
    hit = {"streak_down": lambda n: F.col("streak") >= n, "streak_break": lambda n: (F.col("was") >= n) & (F.col("r") >= 0)}
    return _rows(t, [(k, f"n{n}_h{h}", hit[k](n), h) for k, n, h in STREAKS], known)


STREAK_SQL = f"""s1 AS (SELECT *, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) {OD} AS grp FROM r), s2 AS (SELECT *, sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY date) AS streak FROM s1),
s3 AS (SELECT *, lag(streak) {OD} AS was FROM s2), s4 AS (SELECT * FROM s3 WHERE r IS NOT NULL), st AS ({union_sql(f"SELECT '{k}' AS family, 'n{n}_h{h}' AS key, date, {'streak >= %d' % n if k == 'streak_down' else 'was >= %d AND r >= 0' % n} AS sel, {fwd(h)} AS y FROM s4" for k, n, h in STREAKS)})"""
WARM_UP = 252


def _trailing(spark, sf_dir):
    frames = []
    for n in (20, 60):
        t = _market(spark, sf_dir).withColumn("m", ONE.change("value", n))
        t = expanding_quantiles(t, (), "date", "m", {"q_low": 0.1, "q_high": 0.9}, WARM_UP)
        t = t.filter("q_low is not null and m is not null")
        on = {"low": F.col("m") <= F.col("q_low"), "high": F.col("m") >= F.col("q_high")}
        frames.append(_rows(t, [("trailing", f"n{n}_{side}_h{h}", on[side], h) for k, side, h in TRAILING if k == n]))
    return _union(frames)


def _trail_sql(n: int) -> str:
    frame = "OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""m{n} AS (SELECT *, value / lag(value, {n}) {OD} - 1 AS m FROM r), x{n} AS (SELECT *, quantile_cont(m, 0.1) {frame} AS lo, quantile_cont(m, 0.9) {frame} AS hi, count(m) {frame} AS c FROM m{n}), k{n} AS (SELECT * FROM x{n} WHERE c >= {WARM_UP} AND m IS NOT NULL)"""


TRAIL_SQL = f"""{_trail_sql(20)}, {_trail_sql(60)}, tr AS ({union_sql(f"SELECT 'trailing' AS family, 'n{n}_{side}_h{h}' AS key, date, {'m <= lo' if side == 'low' else 'm >= hi'} AS sel, {fwd(h)} AS y FROM k{n}" for n, side, h in TRAILING)})"""
REPORTS = 156


def _ranked_reports(spark, sf_dir):
    """Weekly reports with the share of the last 156 reports at or below each."""
    return rolling_share(a.weekly_reports(spark, sf_dir), (), "report_date", "value", REPORTS, "rank")


RANK_SQL = f"""w1 AS (SELECT *, row_number() OVER (ORDER BY report_date) AS i FROM wr), w2 AS (SELECT x.report_date, any_value(x.usable_from) AS usable_from, any_value(x.value) AS value,
CASE WHEN any_value(x.i) >= {REPORTS} THEN count(*) FILTER (y.value <= x.value) / {REPORTS}.0::DOUBLE END AS rank FROM w1 AS x JOIN w1 AS y ON y.i > x.i - {REPORTS} AND y.i <= x.i GROUP BY x.report_date)"""


@query(sql("wr", f"WITH {RANK_SQL} SELECT report_date AS date, value, round(rank, 6) AS rank FROM w2"))
def udf40_report_rank(spark, sf_dir):
    return _ranked_reports(spark, sf_dir).select(F.col("report_date").alias("date"), "value", F.round("rank", 6).alias("rank"))


def _positions(spark, sf_dir):
    reports = _ranked_reports(spark, sf_dir).select("usable_from", "rank")
    t = asof_join(_market(spark, sf_dir), reports, "date", "usable_from").withColumn("rank", F.col("matched.rank"))
    on = {"high": F.col("rank") >= 0.9, "low": F.col("rank") <= 0.1}
    return _rows(t.filter("rank is not null"), [("positioning", f"{side}_h{h}", on[side], h) for side, h in POSITION])


POSITION_SQL = f"""{RANK_SQL}, pd AS (SELECT r.*, w2.rank FROM r ASOF JOIN w2 ON r.date >= w2.usable_from), pk AS (SELECT * FROM pd WHERE rank IS NOT NULL),
po AS ({union_sql(f"SELECT 'positioning' AS family, '{side}_h{h}' AS key, date, {'rank >= 0.9' if side == 'high' else 'rank <= 0.1'} AS sel, {fwd(h)} AS y FROM pk" for side, h in POSITION)})"""


def _ratio(spark, sf_dir):
    """Daily share of orders still open, on days that the market series has too."""
    o = a.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"))
    return o.agg((F.count(F.when(F.col("o_orderstatus") == "O", 1)) / F.count("*")).alias("ratio"))


def _sentiment(spark, sf_dir):
    x = _market(spark, sf_dir).join(_ratio(spark, sf_dir), "date").filter("r is not null and ratio is not null").withColumn("z", ONE.z_score("ratio", 252))
    on = {"high": F.col("z") >= 2, "low": F.col("z") <= -2}
    return _rows(x.filter("z is not null"), [("sentiment", f"{side}_h{h}", on[side], h) for side, h in SENTIMENT])


Z = "OVER (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
SENTIMENT_SQL = f"""ra AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) FILTER (o_orderstatus = 'O') / count(*)::DOUBLE AS ratio FROM orders GROUP BY 1), rj AS (SELECT r.*, ratio FROM r JOIN ra ON ra.date = r.date WHERE r IS NOT NULL),
rz AS (SELECT *, CASE WHEN count(ratio) {Z} >= 252 THEN (ratio - avg(ratio) {Z}) / nullif(stddev_pop(ratio) {Z}, 0) END AS z FROM rj), zk AS (SELECT * FROM rz WHERE z IS NOT NULL),
se AS ({union_sql(f"SELECT 'sentiment' AS family, '{side}_h{h}' AS key, date, {'z >= 2' if side == 'high' else 'z <= -2'} AS sel, {fwd(h)} AS y FROM zk" for side, h in SENTIMENT)})"""


def _regime(spark, sf_dir, known=True):
    t = _market(spark, sf_dir).withColumn("fast", ONE.mean("value", 50)).withColumn("slow", ONE.mean("value", 200)).filter("slow is not null")
    fast, slow = F.col("fast"), F.col("slow")
    return _rows(t, [("regime", "golden_h20", fast > slow, 20), ("regime", "death_h20", fast < slow, 20)], known)


REGIME_SQL = f"""g1 AS (SELECT *, avg(value) OVER (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS fast, avg(value) OVER (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS slow, row_number() {OD} AS i FROM r),
g2 AS (SELECT * FROM g1 WHERE i >= 200), rg AS ({union_sql(f"SELECT 'regime' AS family, '{k}_h20' AS key, date, {x} AS sel, {fwd(20)} AS y FROM g2" for k, x in (('golden', 'fast > slow'), ('death', 'fast < slow')))})"""
STATS = "SELECT family, key, count(*) FILTER (sel) AS n_on, count(*) AS n, round(avg(y) FILTER (sel), 6) AS up_on, round(avg(y), 6) AS up_all, round(avg(y) FILTER (sel) - avg(y), 6) AS diff FROM {0} WHERE sel IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2"


def _stats(rows):
    on = F.when(F.col("sel"), F.col("y"))
    return rows.groupBy("family", "key").agg(F.count(F.when(F.col("sel"), 1)).alias("n_on"), F.count("*").alias("n"), *_r(up_on=F.avg(on), up_all=F.avg("y"), diff=F.avg(on) - F.avg("y")))


@query(sql("t", f"{RT}, {REBOUND_SQL} {STATS.format('rb')}"), dates="")
def q12b_rebound(spark, sf_dir):
    return _stats(_rebound(spark, sf_dir))


@query(sql("t", f"{RT}, {REGIME_SQL} {STATS.format('rg')}"), dates="")
def q12c_regime(spark, sf_dir):
    return _stats(_regime(spark, sf_dir))


@query(sql("t wr", f"{RT}, {POSITION_SQL} {STATS.format('po')}"), dates="")
def q12e_positioning(spark, sf_dir):
    return _stats(_positions(spark, sf_dir))


@query(sql("t", f"{RT}, {SENTIMENT_SQL} {STATS.format('se')}"), dates="")
def q12f_sentiment(spark, sf_dir):
    return _stats(_sentiment(spark, sf_dir))


@query(sql("t", f"{RT}, {STREAK_SQL} {STATS.format('st')}"), dates="")
def q12g_streaks(spark, sf_dir):
    return _stats(_streaks(spark, sf_dir))


@query(sql("t", f"{RT}, {TRAIL_SQL} {STATS.format('tr')}"), dates="")
def q12h_trailing_extremes(spark, sf_dir):
    return _stats(_trailing(spark, sf_dir))


FACTOR_SQL = f"""{RET}, {TECH}, fs AS (SELECT asset, date, CASE WHEN lead(value, 20) OVER (PARTITION BY asset ORDER BY date) > value THEN 1.0 WHEN lead(value, 20) OVER (PARTITION BY asset ORDER BY date) IS NOT NULL THEN 0.0 END::DOUBLE AS y, {', '.join(f'({x}) AS {n}' for n, x in FLAGS.items())} FROM tech),
fc AS ({union_sql(f"SELECT '{n}' AS key, asset, date, {n} AS sel, y FROM fs WHERE {n} IS NOT NULL AND y IS NOT NULL" for n in FLAGS)})"""


def _factors(spark, sf_dir):
    S = Series(("asset",), "date")
    ahead = F.lead("value", 20).over(S.ordered)
    t = _technical(spark, sf_dir).withColumn("y", F.when(ahead.isNotNull(), (ahead > F.col("value")).cast("double")))
    flags = F.array(*[F.struct(F.lit(n).alias("key"), F.expr(x).alias("sel")).cast("struct<key:string,sel:boolean>") for n, x in FLAGS.items()])
    return t.select("asset", "date", "y", F.inline(flags)).filter("sel is not null and y is not null")


RECENT = "1999-01-01"


@query(sql("p", f"""{FACTOR_SQL} SELECT asset, key, count(*) FILTER (sel) AS n_on, round(avg(y) FILTER (sel) - avg(y), 6) AS diff, round(avg(y) FILTER (sel AND date >= DATE '{RECENT}') - avg(y) FILTER (date >= DATE '{RECENT}'), 6) AS recent, count(*) FILTER (sel AND date >= DATE '{RECENT}') AS n_recent FROM fc GROUP BY 1, 2"""), dates="")
def udf21_segment_lens(spark, sf_dir):
    on, new = F.col("sel"), F.col("date") >= F.lit(RECENT).cast("date")
    y = F.col("y")
    by = _factors(spark, sf_dir).groupBy("asset", "key")
    lens = _r(diff=F.avg(F.when(on, y)) - F.avg(y), recent=F.avg(F.when(on & new, y)) - F.avg(F.when(new, y)))
    return by.agg(F.count(F.when(on, 1)).alias("n_on"), *lens, F.count(F.when(on & new, 1)).alias("n_recent"))


@query(sql("p", f"""{FACTOR_SQL}, a AS (SELECT key, avg(y) FILTER (sel) - avg(y) AS diff, count(*) FILTER (sel) AS n FROM fc GROUP BY 1) SELECT 'factor' AS family, key, n AS n_on, round(diff, 6) AS diff, CAST(sign(round(diff, 9)) AS INT) AS direction FROM a"""), dates="")
def q12d_factors(spark, sf_dir):
    on, y = F.col("sel"), F.col("y")
    by = _factors(spark, sf_dir).groupBy("key").agg(F.count(F.when(on, 1)).alias("n_on"), (F.avg(F.when(on, y)) - F.avg(y)).alias("diff"))
    return by.select(F.lit("factor").alias("family"), "key", "n_on", F.round("diff", 6).alias("diff"), F.signum(F.round("diff", 9)).cast("int").alias("direction"))


FOLDS = (("1996-01-01", "1997-01-01"), ("1997-01-01", "1998-01-01"), ("1998-01-01", "1999-01-01"), ("1999-01-01", "2000-01-01"))
HOLDOUT = "2000-01-01"


@query(sql("p", f"""{FACTOR_SQL}, fo(fold, cut, stop) AS (VALUES {', '.join(f"({i}, DATE '{x}', DATE '{y}')" for i, (x, y) in enumerate(FOLDS))}),
fd AS (SELECT key, fold, avg(y) FILTER (sel AND date < cut - 20) - avg(y) FILTER (date < cut - 20) AS train, avg(y) FILTER (sel AND date >= cut AND date < stop) - avg(y) FILTER (date >= cut AND date < stop) AS test FROM fc CROSS JOIN fo GROUP BY 1, 2),
sg AS (SELECT key, count(test) AS folds, count(*) FILTER (sign(round(train, 9)) = sign(round(test, 9))) AS same FROM fd GROUP BY 1), ho AS (SELECT key, avg(y) FILTER (sel AND date < DATE '{HOLDOUT}') - avg(y) FILTER (date < DATE '{HOLDOUT}') AS dev, avg(y) FILTER (sel AND date >= DATE '{HOLDOUT}') - avg(y) FILTER (date >= DATE '{HOLDOUT}') AS held, count(*) FILTER (sel AND date >= DATE '{HOLDOUT}') AS n_held FROM fc GROUP BY 1)
SELECT sg.key, folds, same, round(dev, 6) AS dev, round(held, 6) AS held, CASE WHEN n_held < 30 THEN 'thin' WHEN sign(round(dev, 9)) <> sign(round(held, 9)) THEN 'reversed' WHEN same >= 3 THEN 'stable' ELSE 'unstable' END AS verdict FROM sg JOIN ho ON ho.key = sg.key"""), dates="")
def udf22_factor_scorecard(spark, sf_dir):
    """Signs over folds with an embargo of 20 days, a holdout, and a verdict."""
    x = _factors(spark, sf_dir)
    on, y, day = F.col("sel"), F.col("y"), F.col("date")
    gap = lambda inside: F.avg(F.when(on & inside, y)) - F.avg(F.when(inside, y))
    sign = lambda v: F.signum(F.round(v, 9))
    folds = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(p).cast("date").alias("cut"), F.lit(q).cast("date").alias("stop")) for i, (p, q) in enumerate(FOLDS)])
    per = x.select("*", F.inline(folds)).groupBy("key", "fold").agg(gap(day < F.date_sub("cut", 20)).alias("train"), gap((day >= F.col("cut")) & (day < F.col("stop"))).alias("test"))
    signs = per.groupBy("key").agg(F.count("test").alias("folds"), F.count(F.when(sign(F.col("train")) == sign(F.col("test")), 1)).alias("same"))
    late = day >= F.lit(HOLDOUT).cast("date")
    held = x.groupBy("key").agg(gap(~late).alias("dev"), gap(late).alias("held"), F.count(F.when(on & late, 1)).alias("n_held"))
    verdict = F.when(F.col("n_held") < 30, "thin").when(sign(F.col("dev")) != sign(F.col("held")), "reversed").when(F.col("same") >= 3, "stable").otherwise("unstable")
    return signs.join(held, "key").select("key", "folds", "same", *_r(dev=F.col("dev"), held=F.col("held")), verdict.alias("verdict"))


@query(sql("p", f"""{RET}, n AS (SELECT asset, date, r, row_number() OVER (PARTITION BY asset ORDER BY date) AS i, count(*) OVER (PARTITION BY asset) AS m FROM r WHERE r IS NOT NULL),
k AS (SELECT *, CASE WHEN i <= m * 7 // 10 - 20 THEN 'train' WHEN i > m * 7 // 10 THEN 'test' ELSE 'purged' END AS part FROM n) SELECT asset, part, count(*) AS n, min(date) AS first, max(date) AS last, round(avg(r), 6) AS mean FROM k GROUP BY 1, 2"""), dates="first last")
def udf24_purged_split(spark, sf_dir):
    from .window_queries import _returns

    S = Series(("asset",), "date")
    r = _returns(spark, sf_dir).filter("r is not null").withColumn("i", S.position()).withColumn("m", F.count("*").over(Window.partitionBy("asset")))
    cut = F.floor(F.col("m") * 7 / 10)
    part = F.when(F.col("i") <= cut - 20, "train").when(F.col("i") > cut, "test").otherwise("purged")
    return r.groupBy("asset", part.alias("part")).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.round(F.avg("r"), 6).alias("mean"))


# ---- Q-12: all candidates with bootstrap p-values; gates and ledgers -------------


def _candidates(spark, sf_dir):
    families = (_rebound, _regime, _positions, _sentiment, _streaks, _trailing)
    return _union([f(spark, sf_dir) for f in families])


def _tested(rows, draws=2000):
    """Block bootstrap of every candidate, its block as long as its holding period."""

    def test(frame, seed):
        return b.block_bootstrap(frame["sel"].to_numpy(bool), frame["y"].to_numpy(), int(frame["h"].iloc[0]), draws, seed)

    schema = "family string, key string, diff double, low double, high double, p double, n_used long, n_dropped long"
    return b.per_group(rows, ["family", "key"], "date", schema, test)


DECLARED = len(REBOUND) + 2 + len(POSITION) + len(SENTIMENT) + len(STREAKS) + len(TRAILING)


@query(dates="")
def q12_discovery(spark, sf_dir):
    """Every declared candidate, with q-values in its family and in the pool, and a verdict."""
    q = s.q_values(_tested(_candidates(spark, sf_dir)), "p", ["family"]).withColumnRenamed("q_bh", "q_family").drop("q_by")
    q = s.q_values(q, "p").withColumnRenamed("q_bh", "q_pool").drop("q_by")
    return s.verdicts(q, "q_family", "q_pool", 0.10, expected=DECLARED)


NAMES = [("rebound", f"p{p}_h{h}") for p, h in REBOUND] + [("regime", k) for k in ("golden_h20", "death_h20")] + [("positioning", f"{x}_h{h}") for x, h in POSITION]
NAMES += [("sentiment", f"{x}_h{h}") for x, h in SENTIMENT] + [(k, f"n{n}_h{h}") for k, n, h in STREAKS] + [("trailing", f"n{n}_{x}_h{h}") for n, x, h in TRAILING]


@query(f"SELECT family, key, substr(family, 1, 3) || '_' || substr(sha1(family || '|' || key), 1, 10) AS candidate_id FROM (VALUES {', '.join(f'{x}' for x in NAMES)}) AS v(family, key)", dates="")
def udf38_declared(spark, sf_dir):
    """The declared candidates, enumerated from the parameter grids."""
    from ..functions.scores import stable_id
    from ..operators.ranking import grid

    def keys(family, text, **values):
        return grid(spark, **values).select(F.lit(family).alias("family"), text.alias("key"))

    hold = F.concat(F.lit("_h"), "h")
    parts = [
        keys("rebound", F.concat(F.lit("p"), "p", hold), p=(1, 5, 10), h=(1, 5)),
        keys("regime", F.concat("k", F.lit("_h20")), k=("golden", "death")),
        keys("positioning", F.concat("side", hold), side=("high", "low"), h=(20, 60)),
        keys("sentiment", F.concat("side", hold), side=("high", "low"), h=(5, 20)),
        keys("streak_down", F.concat(F.lit("n"), "n", hold), n=(3, 4, 5), h=(1, 3, 5)),
        keys("streak_break", F.concat(F.lit("n"), "n", hold), n=(3, 5), h=(1, 3, 5)),
        keys("trailing", F.concat(F.lit("n"), "n", F.lit("_"), "side", hold), n=(20, 60), side=("low", "high"), h=(5, 20)),
    ]
    return _union(parts).select("family", "key", stable_id("family", "key").alias("candidate_id"))


ANCHOR = "1999-06-01"
ALL_SQL = f"{REBOUND_SQL}, {REGIME_SQL}, {STREAK_SQL}, cd AS (SELECT * FROM rb UNION ALL SELECT * FROM rg UNION ALL SELECT * FROM st), ck AS (SELECT * FROM cd WHERE sel IS NOT NULL AND y IS NOT NULL)"


def _after_anchor(rows):
    late = F.col("date") > F.lit(ANCHOR).cast("date")
    on, y = F.col("sel"), F.col("y")
    diff = lambda inside: F.avg(F.when(on & inside, y)) - F.avg(F.when(inside, y))
    found = rows.groupBy("family", "key").agg(diff(F.lit(True)).alias("full"), diff(late).alias("late"), F.count(F.when(on & late, 1)).alias("oos_n"), F.count(F.when(~on & late, 1)).alias("others"))
    sign = lambda v: F.signum(F.round(v, 9)).cast("int")
    return found.select("family", "key", sign(F.col("full")).alias("full_sign"), sign(F.col("late")).alias("oos_sign"), "oos_n", "others")


@query(sql("t", f"""{RT}, {ALL_SQL}, d AS (SELECT family, key, avg(y) FILTER (sel) - avg(y) AS f, avg(y) FILTER (sel AND date > DATE '{ANCHOR}') - avg(y) FILTER (date > DATE '{ANCHOR}') AS l, count(*) FILTER (sel AND date > DATE '{ANCHOR}') AS oos_n, count(*) FILTER (NOT sel AND date > DATE '{ANCHOR}') AS others FROM ck GROUP BY 1, 2)
SELECT family, key, CAST(sign(round(f, 9)) AS INT) AS full_sign, CAST(sign(round(l, 9)) AS INT) AS oos_sign, oos_n, CASE WHEN oos_n < 30 OR others < 30 THEN 'pending' WHEN sign(round(f, 9)) <> sign(round(l, 9)) THEN 'overturned' ELSE 'open' END AS by_sign FROM d"""), dates="")
def q13_gate_signs(spark, sf_dir):
    """What the gate knows before any draw: enough triggers after the anchor, and their direction."""
    rows = _union([f(spark, sf_dir) for f in (_rebound, _regime, _streaks)])
    x = _after_anchor(rows)
    thin = (F.col("oos_n") < 30) | (F.col("others") < 30)
    state = F.when(thin, "pending").when(F.col("full_sign") != F.col("oos_sign"), "overturned").otherwise("open")
    return x.select("family", "key", "full_sign", "oos_sign", "oos_n", state.alias("by_sign"))


@query(dates="")
def q13_gate(spark, sf_dir):
    """State of every candidate from the rows after its anchor alone; thresholds stay as they were."""
    rows = _candidates(spark, sf_dir)
    p = _tested(rows.filter(F.col("date") > F.lit(ANCHOR).cast("date"))).select("family", "key", "p")
    x = _after_anchor(rows).join(p, ["family", "key"], "left")
    thin = (F.col("oos_n") < 30) | (F.col("others") < 30)
    x = x.withColumn("p", F.when(~thin, F.col("p")))
    return x.withColumn("state", g.out_of_sample(F.col("full_sign"), F.col("oos_sign"), F.col("p"))).drop("others")


YEARLY = f"""{RT}, {ALL_SQL}, fl AS (SELECT family, key, avg(y) FILTER (sel) - avg(y) AS f FROM ck GROUP BY 1, 2), yr AS (SELECT family, key, year(date) AS year, avg(y) FILTER (sel) - avg(y) AS d, count(*) FILTER (sel) AS n FROM ck GROUP BY 1, 2, 3),
ys AS (SELECT yr.family, yr.key, year, CASE WHEN n < 5 OR d IS NULL THEN 'pending' WHEN sign(round(d, 9)) <> sign(round(f, 9)) THEN 'overturned' WHEN abs(round(d, 9)) > 0.02 THEN 'confirmed' ELSE 'neutral' END AS state FROM yr JOIN fl ON fl.family = yr.family AND fl.key = yr.key)"""


def _yearly_states(spark, sf_dir):
    rows = _union([f(spark, sf_dir) for f in (_rebound, _regime, _streaks)])
    on, y = F.col("sel"), F.col("y")
    gap = F.round(F.avg(F.when(on, y)) - F.avg(y), 9)
    full = rows.groupBy("family", "key").agg(gap.alias("f"))
    per = rows.groupBy("family", "key", F.year("date").cast("long").alias("year")).agg(gap.alias("d"), F.count(F.when(on, 1)).alias("n"))
    d, n = F.col("d"), F.col("n")
    state = F.when((n < 5) | d.isNull(), "pending").when(F.signum(d) != F.signum("f"), "overturned").when(F.abs(d) > 0.02, "confirmed").otherwise("neutral")
    return per.join(full, ["family", "key"]).select("family", "key", "year", state.alias("state"))


@query(sql("t", f"""{YEARLY}, dv AS (SELECT *, lag(state, 1, 'overturned') OVER (PARTITION BY family, key ORDER BY year) AS was FROM ys WHERE state IN ('confirmed', 'overturned'))
SELECT family, key, year, CASE WHEN state = 'confirmed' THEN 'promote' ELSE 'demote' END AS action FROM dv WHERE state <> was"""), dates="")
def q14_promotions(spark, sf_dir):
    """Promotions and demotions as years pass: neutral and pending years change nothing."""
    states = _yearly_states(spark, sf_dir).filter("state in ('confirmed', 'overturned')")
    was = F.lag("state", 1, "overturned").over(Window.partitionBy("family", "key").orderBy("year"))
    action = F.when(F.col("state") == "confirmed", "promote").otherwise("demote")
    return states.withColumn("was", was).filter("state <> was").select("family", "key", "year", action.alias("action"))


@query(sql("t", f"""{YEARLY}, dv AS (SELECT *, lag(state, 1, 'overturned') OVER (PARTITION BY family, key ORDER BY year) AS was FROM ys WHERE state IN ('confirmed', 'overturned')), ac AS (SELECT * FROM dv WHERE state <> was),
m AS (SELECT family, key, arg_max(state, year) AS last FROM ac GROUP BY 1, 2), nw AS (SELECT family, key, arg_max(state, year) AS state FROM ys GROUP BY 1, 2)
SELECT nw.family, nw.key, coalesce(last = 'confirmed', false) AS member, nw.state, CASE WHEN NOT coalesce(last = 'confirmed', false) AND nw.state = 'confirmed' THEN 'promote' WHEN coalesce(last = 'confirmed', false) AND nw.state = 'overturned' THEN 'demote' END AS action FROM nw LEFT JOIN m ON m.family = nw.family AND m.key = nw.key"""), dates="")
def sta16_replay(spark, sf_dir):
    """Members by replaying the ledger, and what the newest states would change."""
    members = keep_members(q14_promotions(spark, sf_dir), ["family", "key"], "year", "action")
    newest = _yearly_states(spark, sf_dir).groupBy("family", "key").agg(F.max_by("state", "year").alias("state"))
    x = newest.join(members.withColumn("member", F.lit(True)), ["family", "key"], "left").withColumn("member", F.coalesce("member", F.lit(False)))
    return x.withColumn("action", g.promotion(F.col("member"), F.lit("survives"), F.col("state"))).select("family", "key", "member", "state", "action")


@query(sql("t", f"""{YEARLY}, fl2 AS (SELECT *, lag(state) OVER (PARTITION BY family, key ORDER BY year) AS was FROM ys) SELECT family, key, count(*) FILTER (was IS NOT NULL AND was <> state) AS flips, count(*) AS years, count(*) FILTER (was IS NOT NULL AND was <> state) >= 2 AS flickers FROM fl2 GROUP BY 1, 2"""), dates="")
def q15_flicker(spark, sf_dir):
    states = _yearly_states(spark, sf_dir)
    flips = transitions(states, ["family", "key"], ["year"], "state").groupBy("family", "key").agg(F.count("*").alias("flips"))
    years = states.groupBy("family", "key").agg(F.count("*").alias("years")).join(flips, ["family", "key"], "left").fillna(0, ["flips"])
    return years.select("family", "key", "flips", "years", (F.col("flips") >= 2).alias("flickers"))


POOL = """pr AS (SELECT family, key, avg(y) FILTER (sel) AS a, avg(y) AS m, count(*) FILTER (sel) AS n FROM ck GROUP BY 1, 2), pv AS (SELECT family, key, round(1 / (1 + (a - m) * (a - m) * n / (m * (1 - m))), 9) AS p FROM pr WHERE n > 0),
pk AS (SELECT *, row_number() OVER (ORDER BY p, family, key) AS i, count(*) OVER () AS m FROM pv), pq AS (SELECT *, least(min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS q, sum(1.0 / i) OVER () AS c FROM pk)"""


def _claims(spark, sf_dir):
    """Claims of several families with a number that ranks them as a p-value would, by exact arithmetic."""
    rows = _union([f(spark, sf_dir) for f in (_rebound, _regime, _streaks)])
    on, y = F.col("sel"), F.col("y")
    x = rows.groupBy("family", "key").agg(F.avg(F.when(on, y)).alias("a"), F.avg(y).alias("m"), F.count(F.when(on, 1)).alias("n")).filter("n > 0")
    z2 = (F.col("a") - F.col("m")) ** 2 * F.col("n") / (F.col("m") * (1 - F.col("m")))
    return x.select("family", "key", F.round(1 / (1 + z2), 9).alias("p"))


@query(sql("t", f"{RT}, {ALL_SQL}, {POOL} SELECT family, key, round(p, 6) AS p, round(q, 6) AS q_bh, round(least(q * c, 1.0), 6) AS q_by, least(q * c, 1.0) <= 0.10 AS survives_by, q <= 0.10 AS survives_bh, p < 0.05 / m AS survives_all FROM pq"), dates="")
def q16_cross_family(spark, sf_dir):
    """Claims of all families in one pool: BY, BH and Bonferroni."""
    total = Window.partitionBy()
    x = s.q_values(_claims(spark, sf_dir), "p").withColumn("all", F.col("p") < 0.05 / F.count("*").over(total))
    return x.select("family", "key", *_r(p=F.col("p"), q_bh=F.col("q_bh"), q_by=F.col("q_by")), (F.col("q_by") <= 0.10).alias("survives_by"), (F.col("q_bh") <= 0.10).alias("survives_bh"), F.col("all").alias("survives_all"))


@query(sql("t", f"{RT}, {ALL_SQL}, {POOL} SELECT family, count(*) AS n, count(*) FILTER (q <= 0.10) AS n_bh, count(*) FILTER (least(q * c, 1.0) <= 0.10) AS n_by, round(min(p), 6) AS least_p FROM pq GROUP BY 1"), dates="")
def agg40_family_counts(spark, sf_dir):
    x = s.q_values(_claims(spark, sf_dir), "p").groupBy("family")
    return x.agg(F.count("*").alias("n"), F.count(F.when(F.col("q_bh") <= 0.10, 1)).alias("n_bh"), F.count(F.when(F.col("q_by") <= 0.10, 1)).alias("n_by"), F.round(F.min("p"), 6).alias("least_p"))


@query(sql("p", f"""{FACTOR_SQL}, pr AS (SELECT key, avg(y) FILTER (sel) AS a, avg(y) AS m, count(*) FILTER (sel) AS n FROM fc GROUP BY 1), pv AS (SELECT key, n, a - m AS diff, round(1 / (1 + (a - m) * (a - m) * n / (m * (1 - m))), 9) AS p FROM pr WHERE n > 0),
pk AS (SELECT *, row_number() OVER (ORDER BY p, key) AS i, count(*) OVER () AS m FROM pv) SELECT key, n, round(diff, 6) AS diff, round(least(min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) AS q FROM pk"""), dates="")
def q06_factor_autopsy(spark, sf_dir):
    on, y = F.col("sel"), F.col("y")
    x = _factors(spark, sf_dir).groupBy("key").agg(F.avg(F.when(on, y)).alias("a"), F.avg(y).alias("m"), F.count(F.when(on, 1)).alias("n")).filter("n > 0")
    z2 = (F.col("a") - F.col("m")) ** 2 * F.col("n") / (F.col("m") * (1 - F.col("m")))
    x = s.q_values(x.withColumn("p", F.round(1 / (1 + z2), 9)), "p")
    return x.select("key", "n", F.round(F.col("a") - F.col("m"), 6).alias("diff"), F.round("q_bh", 6).alias("q"))


LATEST = f"""{RT}, s1 AS (SELECT *, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) {OD} AS grp FROM r), s2 AS (SELECT *, sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY date) AS streak FROM s1), m60 AS (SELECT *, value / lag(value, 60) {OD} - 1 AS m FROM s2)"""


@query(sql("t", f"""{LATEST}, z AS (SELECT max(date) AS date, arg_max(streak, date) AS streak, arg_max(m, date) AS momentum, quantile_cont(m, 0.1) AS low, quantile_cont(m, 0.9) AS high FROM m60)
SELECT date, CAST(streak AS BIGINT) AS streak, round(momentum, 6) AS momentum, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN momentum <= low THEN 'low' WHEN momentum >= high THEN 'high' ELSE 'middle' END AS place FROM z"""))
def q12i_context(spark, sf_dir):
    """Where the last row stands: its losing streak and its momentum against all so far."""
    t = e.run_lengths(_market(spark, sf_dir), F.col("r") < 0, ()).withColumn("m", ONE.change("value", 60))
    z = t.agg(F.max("date").alias("date"), F.max_by("streak", "date").alias("streak"), F.max_by("m", "date").alias("m"), F.percentile("m", F.lit(0.1)).alias("low"), F.percentile("m", F.lit(0.9)).alias("high"))
    place = F.when(F.col("m") <= F.col("low"), "low").when(F.col("m") >= F.col("high"), "high").otherwise("middle")
    return z.select("date", "streak", *_r(momentum=F.col("m"), low=F.col("low"), high=F.col("high")), place.alias("place"))


@query(sql("t", f"""{RT}, {ALL_SQL}, lt AS (SELECT max(date) AS last FROM cd WHERE sel IS NOT NULL), ls AS (SELECT family, key, max(date) FILTER (sel) AS last_on, arg_max(sel, date) AS active FROM cd WHERE sel IS NOT NULL GROUP BY 1, 2)
SELECT family, key, last_on, active FROM ls"""), dates="last_on")
def q47_active_now(spark, sf_dir):
    """Which triggers are on at their last row, and when they last were; rows without an outcome yet count."""
    rows = _union([f(spark, sf_dir, known=False) for f in (_rebound, _regime, _streaks)])
    last_on = F.max(F.when(F.col("sel"), F.col("date"))).alias("last_on")
    return rows.groupBy("family", "key").agg(last_on, F.max_by("sel", "date").alias("active"))


SCORES = f"""{FACTOR_SQL}, yv AS (SELECT key, year(date) AS year, avg(y) FILTER (sel) - avg(y) AS gain, count(*) FILTER (sel) AS n FROM fc GROUP BY 1, 2),
vd AS (SELECT key, year, CASE WHEN n < 20 THEN 'insufficient' WHEN round(gain, 9) IS NULL THEN 'missing' WHEN round(gain, 9) > 0 THEN 'beats' WHEN round(gain, 9) < 0 THEN 'loses' ELSE 'ties' END AS verdict, n, gain FROM yv)"""


def _cards(spark, sf_dir):
    on, y = F.col("sel"), F.col("y")
    x = _factors(spark, sf_dir).groupBy("key", F.year("date").cast("long").alias("year")).agg(F.round(F.avg(F.when(on, y)) - F.avg(y), 9).alias("gain"), F.count(F.when(on, 1)).alias("n"))
    return x.withColumn("verdict", g.forward_verdict(F.col("n") >= 20, F.col("gain")))


@query(sql("p", f"{SCORES} SELECT key, year, n, round(gain, 6) AS gain, verdict FROM vd"), dates="")
def q46_benchmark_card(spark, sf_dir):
    return _cards(spark, sf_dir).select("key", "year", "n", F.round("gain", 6).alias("gain"), "verdict")


@query(sql("p", f"""{SCORES}, rk AS (SELECT *, CASE verdict WHEN 'beats' THEN 3 WHEN 'ties' THEN 2 WHEN 'loses' THEN 1 END AS k FROM vd), lg AS (SELECT *, lag(k) OVER (PARTITION BY key ORDER BY year) AS was FROM rk)
SELECT key, year, CASE WHEN k > was THEN 'better' WHEN k < was THEN 'worse' ELSE 'same' END AS drift FROM lg WHERE k IS NOT NULL AND was IS NOT NULL"""), dates="")
def sta23_drift(spark, sf_dir):
    """Change of a verdict's rank against the card before; cards without a rank show no drift."""
    rank = F.when(F.col("verdict") == "beats", 3).when(F.col("verdict") == "ties", 2).when(F.col("verdict") == "loses", 1)
    x = _cards(spark, sf_dir).withColumn("k", rank)
    x = x.withColumn("was", F.lag("k").over(Window.partitionBy("key").orderBy("year"))).filter("k is not null and was is not null")
    return x.select("key", "year", F.when(F.col("k") > F.col("was"), "better").when(F.col("k") < F.col("was"), "worse").otherwise("same").alias("drift"))
