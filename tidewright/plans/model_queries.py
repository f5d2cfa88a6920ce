"""Registered queries of statistical models: boosting duels, attributions, states, breaks, lags and seasons."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import attribution as at
from ..operators import boosting as eb
from ..operators import bootstrap as bs
from ..operators import change_points as cp
from ..operators import garch as gm
from ..operators import hidden_states as hs
from ..operators import kernels as kr
from ..operators import lag_models as lm
from ..operators import seasonal as sd
from ..operators import significance as s
from ..operators.windows import Series
from ..sources import adapters as a
from .event_queries import CAR, _after, _states
from .registry import query
from .study_queries import _flags, _split, _with_forward
from .window_queries import RET, O, _returns, last

S = Series(("asset",), "date")
sql = a.with_views

# ---- boosting duel -----------------------------------------------------------

FEATURES = ["momentum", "volatility", "z", "market_z"]
#: Ends of training and of testing, by year: fixed folds of the duel.
FOLDS = [(1997, 1998), (1998, 1999), (1999, 2001)]
PURGE = 25  # rows before a test period that a 20-row label reaches, and 5 more


def duel_rows(spark, sf_dir):
    """``asset, date, features, y``: whether the value is higher 20 rows on."""
    total = a.daily_total(spark, sf_dir)
    market = total.select("date", Series((), "date").z_score("value", 60).alias("market_z"))
    r = _returns(spark, sf_dir).select("asset", "date", "value", "r")
    f = r.withColumns({"momentum": S.skip_momentum("value", 21, 147), "volatility": S.deviation("r", 63), "z": S.z_score("value", 60), "ahead": F.lead("value", 20).over(S.ordered)})
    f = f.join(market, "date").withColumn("y", (F.col("ahead") > F.col("value")).cast("int"))
    return f.select("asset", "date", *FEATURES, "y").dropna()


def folds(rows):
    """Training rows of each fold without those whose label reaches into the test period, and test rows."""
    year = F.year("date")
    ends = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(x).alias("cut"), F.lit(y).alias("stop")) for i, (x, y) in enumerate(FOLDS)])
    rows = rows.withColumn("f", F.explode(ends)).select(*rows.columns, "f.*")
    train = rows.filter(year < F.col("cut"))
    left = F.row_number().over(Window.partitionBy("asset", "fold").orderBy(F.desc("date")))
    train = train.withColumn("left", left).filter(F.col("left") > PURGE).drop("left")
    return train, rows.filter((year >= F.col("cut")) & (year < F.col("stop")))


def duel(rows):
    """``fold, asset, date, y, boosted, linear``: both models' probabilities of the test rows; folds without training rows have none."""
    train, test = folds(rows)
    boosted = eb.fit_additive(train, FEATURES, "y", "fold", rounds=12)
    linear = eb.fit_linear(train, FEATURES, "y", "fold")
    both = linear.transform(boosted.transform(test).withColumnRenamed("p", "boosted")).withColumnRenamed("p", "linear")
    return both.select("fold", "asset", "date", "y", "boosted", "linear").dropna()


@query(dates="")
def udf35_shapes(spark, sf_dir):
    """What each feature's bins add to the log odds, fitted on all rows."""
    model = eb.fit_additive(duel_rows(spark, sf_dir), FEATURES, "y", rounds=12)
    return model.table(spark).select("feature", "bin", F.round("upper", 9).alias("upper"), F.round("share", 6).alias("share"))


@query(dates="")
def q51_duel(spark, sf_dir):
    """Pooled out-of-sample scores of both models, intervals of their differences and the gate's verdict."""
    pooled = duel(duel_rows(spark, sf_dir))
    scores = None
    for m in ("boosted", "linear"):
        hits = F.avg(((F.col(m) >= 0.5).cast("int") == F.col("y")).cast("double"))
        one = s.auc(pooled, m, "y").select(F.col("auc").alias(f"{m}_auc"), F.col("brier").alias(f"{m}_brier"), "n")
        one = one.join(pooled.agg(hits.alias(f"{m}_accuracy")))  # one row each
        scores = one if scores is None else scores.join(one.drop("n"))
    for block in (20, 40):
        draws = [bs.area_draws(pooled, [], ["date", "asset"], "y", m, block, 2000, 42).select("draw", F.col("auc").alias(f"auc_{m}"), F.col("brier").alias(f"brier_{m}")) for m in ("boosted", "linear")]
        both = draws[0].join(draws[1], "draw").select("draw", *[(F.col(f"{x}_boosted") - F.col(f"{x}_linear")).alias(x) for x in ("auc", "brier")])
        found = bs.intervals(both.filter("auc is not null"), [], ["auc", "brier"])
        names = {"draws": f"draws_{block}"} | {f"{x}_{e}": f"{x}_{e}_{block}" for x in ("auc", "brier") for e in ("low", "high")}
        scores = scores.join(found.select(*[F.col(c).alias(n) for c, n in names.items()]))  # one row
    side = {b: eb.interval_side(F.col(f"auc_low_{b}"), F.col(f"auc_high_{b}")) for b in (20, 40)}
    diff = F.col("boosted_auc") - F.col("linear_auc")
    verdict = eb.promotion(side[20], side[40], diff, diff, F.col("boosted_brier") <= F.col("linear_brier"))
    return scores.withColumn("verdict", verdict)


def _bets(spark, sf_dir):
    """``asset, date, gap, sq``: whether two fixed rules called the next move right, as a difference, and its squared errors."""
    r = _returns(spark, sf_dir).withColumn("next", F.lead("r").over(S.ordered))
    r = r.withColumns({"mean": S.mean("value", 20), "lag": S.lagged("value", 1)}).filter("mean is not null and next is not null and lag is not null")
    up, one, two = (c.cast("long") for c in (F.col("next") > 0, F.col("value") < F.col("mean"), F.col("value") < F.col("lag")))
    return r.select("asset", "date", ((one == up).cast("long") - (two == up).cast("long")).alias("gap"), F.lit(1).cast("long").alias("one"))


BETS = f"""{RET}, b AS (SELECT asset, date, value, lead(r) {O} AS next, CASE WHEN count(value) {last(20)} >= 20 THEN avg(value) {last(20)} END AS mean, lag(value) {O} AS lag FROM r),
v AS (SELECT asset, date, CAST((value < mean) = (next > 0) AS BIGINT) - CAST((value < lag) = (next > 0) AS BIGINT) AS gap FROM b WHERE mean IS NOT NULL AND next IS NOT NULL AND lag IS NOT NULL),
i AS (SELECT asset, gap, row_number() {O} - 1 AS position, count(*) OVER (PARTITION BY asset) AS n FROM v)"""


def _draws_cte(name: str, block: int, draws: int) -> str:
    """Means of ``gap`` over circular block draws of each asset."""
    long = f"""e{block} AS (SELECT asset, gap, position, n FROM i UNION ALL SELECT asset, gap, position + n, n FROM i WHERE position < {block - 1}),
c{block} AS (SELECT * FROM (SELECT asset, position, n, sum(gap) OVER (PARTITION BY asset ORDER BY position ROWS BETWEEN CURRENT ROW AND {block - 1} FOLLOWING) AS gap, count(*) OVER (PARTITION BY asset ORDER BY position ROWS BETWEEN CURRENT ROW AND {block - 1} FOLLOWING) AS one FROM e{block}) WHERE position < n)"""
    picked = bs.drawn_sql("SELECT DISTINCT asset, n FROM i", ["asset"], f"ceil(n / {block}.0)", draws, f"gate{block}")
    return f"""{long}, d{block} AS ({picked}), {name} AS (SELECT d.asset, d.draw, CAST(sum(c.gap) AS DOUBLE) / CAST(sum(c.one) AS DOUBLE) AS diff FROM d{block} AS d JOIN c{block} AS c ON c.asset = d.asset AND c.position = d.place GROUP BY 1, 2)"""


GATE_DRAWS = 500


@query(sql("p", f"""{BETS}, {_draws_cte('w20', 20, GATE_DRAWS)}, {_draws_cte('w40', 40, GATE_DRAWS)},
k20 AS ({bs.intervals_sql('w20', ['asset'], ['diff'])}), k40 AS ({bs.intervals_sql('w40', ['asset'], ['diff'])}), o AS (SELECT asset, avg(gap) AS diff, count(*) AS n FROM i GROUP BY 1),
s AS (SELECT o.asset, o.n, o.diff, k20.diff_low AS low20, k20.diff_high AS high20, k20.diff_p AS p20, k40.diff_low AS low40, k40.diff_high AS high40, CASE WHEN k20.diff_low > 0 THEN 'positive' WHEN k20.diff_high < 0 THEN 'negative' ELSE 'zero' END AS s20, CASE WHEN k40.diff_low > 0 THEN 'positive' WHEN k40.diff_high < 0 THEN 'negative' ELSE 'zero' END AS s40 FROM o JOIN k20 ON k20.asset = o.asset JOIN k40 ON k40.asset = o.asset)
SELECT asset, n, round(diff, 6) AS diff, round(low20, 6) AS low20, round(high20, 6) AS high20, round(p20, 6) AS p20, round(low40, 6) AS low40, round(high40, 6) AS high40,
CASE WHEN s20 = 'positive' AND s40 = 'positive' AND diff >= 0 THEN 'promote' WHEN s20 = 'negative' AND s40 = 'negative' OR s20 = 'zero' AND s40 = 'zero' AND diff <= 0 THEN 'not_promote' ELSE 'borderline_stop' END AS verdict FROM s"""), dates="")
def udf35_gate(spark, sf_dir):
    """The promotion gate on a duel of two fixed rules, by asset, from block draws that SQL repeats."""
    bets = _bets(spark, sf_dir)
    found = bets.groupBy("asset").agg(F.avg("gap").alias("diff"), F.count("*").alias("n"))
    for block in (20, 40):
        draws = bs.block_draws(bets, ["asset"], ["date"], ["gap", "one"], block, GATE_DRAWS, f"gate{block}")
        k = bs.intervals(draws.withColumn("diff", F.col("gap") / F.col("one")), ["asset"], ["diff"])
        found = found.join(k.select("asset", *[F.col(f"diff_{e}").alias(f"{e}{block}") for e in ("low", "high", "p")]), "asset")
    side = {b: eb.interval_side(F.col(f"low{b}"), F.col(f"high{b}")) for b in (20, 40)}
    verdict = eb.promotion(side[20], side[40], F.col("diff"), F.col("diff"), F.col("diff") >= 0)
    return found.select("asset", "n", *[F.round(c, 6).alias(c) for c in ("diff", "low20", "high20", "p20", "low40", "high40")], verdict.alias("verdict"))


# ---- attributions, radial classifier -----------------------------------------

MODEL_INPUTS = ["r", "momentum", "z"]


def _boosted(rows):
    assembled = VectorAssembler(inputCols=MODEL_INPUTS, outputCol="features").transform(rows)
    return GBTClassifier(labelCol="y", maxIter=15, maxDepth=3, seed=7).fit(assembled)


@query(dates="")
def udf34_attributions(spark, sf_dir):
    """Mean size of what each feature adds to boosted trees' margins, and its rank."""
    rows = _flags(spark, sf_dir)
    found = at.attributions(rows, MODEL_INPUTS, at.fitted_leaves(_boosted(rows)))
    sizes = found.agg(*[F.avg(F.abs(f"{f}_adds")).alias(f) for f in MODEL_INPUTS])
    long = sizes.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_size")) for f in MODEL_INPUTS])).alias("x")).select("x.*")
    return long.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean_size"))))  # a row for each feature


@query(dates="")
def q50_explained_latest(spark, sf_dir):
    """The latest row of each asset: what its features add to the margin, the most supporting and the most opposing one."""
    rows = _flags(spark, sf_dir)
    latest = rows.groupBy("asset").agg(F.max_by(F.struct(*rows.columns), "date").alias("x")).select("x.*")
    found = at.attributions(latest, MODEL_INPUTS, at.fitted_leaves(_boosted(rows)))
    adds = F.array(*[F.struct(F.col(f"{f}_adds").alias("adds"), F.lit(f).alias("feature")) for f in MODEL_INPUTS])
    return found.select("asset", "output", "base", *[f"{f}_adds" for f in MODEL_INPUTS], F.array_max(adds)["feature"].alias("supports"), F.array_min(adds)["feature"].alias("opposes"))


@query(dates="")
def udf30_radial(spark, sf_dir):
    """Held-out area of the radial classifier, by asset."""
    train, test = _split(_flags(spark, sf_dir))
    out = kr.radial_classifier(train, test, MODEL_INPUTS, "y")
    return s.auc(out.withColumn("y", F.col("y").cast("int")), "decision", "y", ["asset"]).select("asset", "auc", "n")


# ---- hidden states -----------------------------------------------------------


def _regimes(spark, sf_dir):
    rows = hs.prepared(_returns(spark, sf_dir).select("asset", "date", (F.log1p("r")).alias("r")), ["asset"], ["date"], "r")
    return rows, hs.fit_states(rows, ["asset"], 3, rounds=6)[0]


@query(dates="")
def udf34_regimes(spark, sf_dir):
    """States of each asset's most likely path: rows, mean and deviation of returns."""
    rows, params = _regimes(spark, sf_dir)
    path = hs.most_likely(rows, ["asset"], params)
    share = F.count("*") / F.sum(F.count("*")).over(Window.partitionBy("asset"))
    return path.groupBy("asset", "state").agg(F.count("*").alias("n"), share.alias("share"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("deviation"))


# ---- lags --------------------------------------------------------------------

ASSETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NAMES = ["a1", "a2", "a3", "a4", "a5"]


def _wide(spark, sf_dir):
    """``date, a1 .. a5``: log values of all assets on days that have them all."""
    p = a.daily_prices(spark, sf_dir)
    wide = p.groupBy("date").agg(*[F.max(F.when(F.col("asset") == x, F.ln("value"))).alias(n) for x, n in zip(ASSETS, NAMES)])
    return wide.dropna()


WIDE = f"WITH w AS (SELECT date, {', '.join(f'''max(CASE WHEN asset = '{x}' THEN ln(value) END) AS {n}''' for x, n in zip(ASSETS, NAMES))} FROM p GROUP BY date), x AS (SELECT * FROM w WHERE {' AND '.join(f'{n} IS NOT NULL' for n in NAMES)})"
LONG = f"{WIDE}, g AS ({' UNION ALL '.join(f'''SELECT '{n}' AS name, date, {n} AS v, lag({n}) OVER (ORDER BY date) AS v1, lag({n}, 2) OVER (ORDER BY date) AS v2, row_number() OVER (ORDER BY date) - 1 AS i FROM x''' for n in NAMES)})"


@query(sql("p", f"""{LONG}, c AS (SELECT e.name AS effect, c.name AS cause, count(*) AS n, corr(e.v, e.v1) AS r1, corr(e.v, c.v1) AS r2, corr(e.v1, c.v1) AS r12 FROM g AS e JOIN g AS c ON c.i = e.i AND c.name <> e.name WHERE e.i > 0 GROUP BY 1, 2),
q AS (SELECT *, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) AS fit FROM c) SELECT cause, effect, n, round((fit - r1 * r1) / (1 - fit) * (n - 3), 5) AS f FROM q"""), dates="")
def udf34_causality_one_lag(spark, sf_dir):
    """F statistics of one lag, for all ordered pairs."""
    found = lm.causality(_wide(spark, sf_dir), ["date"], NAMES, 1)
    return found.select("cause", "effect", "n", F.round("f", 5).alias("f"))


@query(dates="")
def udf34_causality(spark, sf_dir):
    """The best of ten lags for each ordered pair, with its F statistic and p-value."""
    return lm.best_lags(lm.causality(_wide(spark, sf_dir), ["date"], NAMES, 10)).withColumn("significant", F.col("p") < 0.05)


@query(sql("p", """WITH g AS (SELECT asset, value - lag(value) OVER w AS d, lag(value) OVER w AS v FROM p WINDOW w AS (PARTITION BY asset ORDER BY date)), c AS (SELECT asset, count(*) AS n, corr(d, v) AS r FROM g WHERE v IS NOT NULL GROUP BY 1)
SELECT asset, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS statistic FROM c"""), dates="")
def udf34_unit_root_no_lags(spark, sf_dir):
    """Dickey-Fuller statistics without lagged differences."""
    found = lm.unit_roots(a.daily_prices(spark, sf_dir), ["asset"], ["date"], "value", 0)
    return found.select("asset", "n", F.round("statistic", 6).alias("statistic"))


@query(dates="")
def udf34_unit_roots(spark, sf_dir):
    """Augmented tests of every asset with lags by Akaike's criterion."""
    found = lm.unit_roots(a.daily_prices(spark, sf_dir), ["asset"], ["date"], "value")
    return found.withColumn("stationary", F.col("p") < 0.05)


@query(sql("p", f"""{LONG}, j AS (SELECT e.name AS name, c.name AS other, 0 AS k, e.v AS x, c.v AS y FROM g AS e JOIN g AS c ON c.i = e.i UNION ALL SELECT e.name, c.name, 1, e.v, c.v1 FROM g AS e JOIN g AS c ON c.i = e.i UNION ALL SELECT e.name, c.name, 2, e.v, c.v2 FROM g AS e JOIN g AS c ON c.i = e.i)
SELECT name, other, k, count(*) AS n, round(covar_pop(x, y), 7) AS covariance, round(corr(x, y), 6) AS correlation FROM j WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3"""), dates="")
def udf34_lag_moments(spark, sf_dir):
    """Covariances of each asset's log value with each other's, up to two rows before."""
    found, columns, scales = lm.lag_moments(_wide(spark, sf_dir), ["date"], NAMES, 2)

    def solve(m):
        out = []
        for x in NAMES:
            for y in NAMES:
                for k in range(3):
                    z, n = y if k == 0 else f"{y}_{k}", m.rows(k)
                    (sx, sy), ((xx, xy), (_, yy)) = m.of(k, ["1"], [x, z])[0], m.of(k, [x, z], [x, z])
                    xx, xy, yy = xx / n - (sx / n) ** 2, xy / n - sx * sy / n / n, yy / n - (sy / n) ** 2
                    out.append((x, y, k, n, float(xy) * scales[x] * scales[y], float(xy / (xx * yy) ** 0.5)))
        return out

    table = lm.solved(found, columns, 2, "name string, other string, k int, n long, covariance double, correlation double", solve)
    return table.select("name", "other", "k", "n", F.round("covariance", 7).alias("covariance"), F.round("correlation", 6).alias("correlation"))


@query(dates="")
def udf34_impulse_responses(spark, sf_dir):
    """Responses of log changes to shocks over 20 rows, order by Akaike's criterion."""
    w = Series((), "date")
    changes = _wide(spark, sf_dir).select("date", *[(F.col(n) - w.lagged(n)).alias(n) for n in NAMES]).dropna()
    return lm.impulse_responses(changes, ["date"], NAMES, 10, 20)


@query(dates="")
def udf34_cointegration(spark, sf_dir):
    """Cointegrating relations of three assets' log values, two lagged differences."""
    return lm.cointegration(_wide(spark, sf_dir), ["date"], NAMES[:3], 2)


# ---- variances, breaks, seasons ----------------------------------------------


@query(dates="")
def udf34_volatility(spark, sf_dir):
    """GARCH(1,1) of each asset's returns: parameters, the latest variance and its place among all."""
    rows = gm.prepared(_returns(spark, sf_dir).select("asset", "date", "r"), ["asset"], ["date"], "r")
    fitted = gm.fit(rows, ["asset"], rounds=4)
    table = [(k[0], *map(float, p), float(likelihood)) for k, (p, likelihood) in fitted.items()]
    params = spark.createDataFrame(table, "asset string, constant double, square double, carry double, likelihood double")
    path = gm.variance_path(rows, ["asset"], fitted).withColumn("level", F.sqrt("variance") * F.sqrt(F.lit(252.0)))
    last_one = path.groupBy("asset").agg(F.max_by("level", "date").alias("latest"))
    share = F.avg((F.col("level") <= F.col("latest")).cast("double"))
    found = path.join(last_one, "asset").groupBy("asset").agg(F.first("latest").alias("latest"), F.avg("level").alias("mean"), share.alias("share"), F.count("*").alias("n"))
    return params.join(found, "asset")


def _monthly(spark, sf_dir):
    """``asset, month, value``: the last value of each month."""
    p = a.daily_prices(spark, sf_dir)
    return p.groupBy("asset", F.trunc("date", "month").alias("month")).agg(F.max_by("value", "date").alias("value"))


@query(dates="")
def udf34_breaks(spark, sf_dir):
    """Segments of monthly changes in level and spread, by penalty."""
    w = Series(("asset",), "month")
    changes = _monthly(spark, sf_dir).withColumn("r", w.change("value"))
    found = cp.segments(changes, ["asset"], "month", "r", (1.0, 3.0), 6, "spread")
    return found.withColumn("begins", F.col("begins").cast("string"))


@query(dates="")
def udf34_season(spark, sf_dir):
    """Season, trend and rest of monthly values, with the season's strength."""
    parts = sd.decomposed(_monthly(spark, sf_dir), ["asset"], "month", "value", 12, robust=2)
    found = parts.join(sd.seasonal_strength(parts, ["asset"]), "asset")
    return found.withColumn("month", F.col("month").cast("string"))


# ---- bootstraps whose draws are rows -----------------------------------------

FORWARD = f"""{RET}, f AS (SELECT asset, date, r, lead(value, 5) {O} / value - 1 AS f FROM r), k AS (SELECT * FROM f WHERE f IS NOT NULL AND r IS NOT NULL)"""


def _bands(names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names.split())


@query(sql("p", f"""{FORWARD}, q AS (SELECT asset, quantile_cont(r, 0.1) AS q FROM k GROUP BY 1), v AS (SELECT k.asset, date, CASE WHEN r <= q THEN 1.0 ELSE 0.0 END AS sel, CASE WHEN r <= q THEN f ELSE 0.0 END AS sy, f AS y FROM k JOIN q ON q.asset = k.asset),
i AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS position, count(*) OVER (PARTITION BY asset) AS n FROM v), e AS (SELECT asset, sel, sy, y, position, n FROM i UNION ALL SELECT asset, sel, sy, y, position + n, n FROM i WHERE position < 19),
c AS (SELECT * FROM (SELECT asset, position, n, sum(sel) OVER w AS sel, sum(sy) OVER w AS sy, sum(y) OVER w AS y, count(*) OVER w AS one FROM e WINDOW w AS (PARTITION BY asset ORDER BY position ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) WHERE position < n),
d AS ({bs.drawn_sql("SELECT DISTINCT asset, n FROM i", ["asset"], "ceil(n / 20.0)", 2000, "blocks")}), s AS (SELECT d.asset, draw, sum(sel) AS sel, sum(sy) AS sy, sum(y) AS y, sum(one) AS one FROM d JOIN c ON c.asset = d.asset AND c.position = d.place GROUP BY 1, 2),
x AS (SELECT asset, sy / sel - y / one AS diff FROM s WHERE sel > 0), b AS ({bs.intervals_sql("x", ["asset"], ["diff"])}), o AS (SELECT asset, sum(sy) / sum(sel) - avg(y) AS diff FROM v GROUP BY 1)
SELECT b.asset, draws, round(o.diff, 6) AS diff, {_bands('diff_low diff_high diff_p')} FROM b JOIN o ON o.asset = b.asset"""), dates="")
def udf01_block_draws(spark, sf_dir):
    """Forward returns after the worst tenth of days less those after all, 2,000 circular block draws."""
    k = _with_forward(spark, sf_dir)
    q = k.groupBy("asset").agg(F.percentile("r", F.lit(0.1)).alias("q"))
    sel = (F.col("r") <= F.col("q")).cast("double")
    v = k.join(q, "asset").select("asset", "date", sel.alias("sel"), F.when(F.col("r") <= F.col("q"), F.col("f")).otherwise(0.0).alias("sy"), F.col("f").alias("y"), F.lit(1).alias("one"))
    draws = bs.block_draws(v, ["asset"], ["date"], ["sel", "sy", "y", "one"], 20, 2000, "blocks").filter("sel > 0")
    found = bs.intervals(draws.withColumn("diff", F.col("sy") / F.col("sel") - F.col("y") / F.col("one")), ["asset"], ["diff"])
    seen = v.groupBy("asset").agg((F.sum("sy") / F.sum("sel") - F.avg("y")).alias("diff"))
    return found.join(seen, "asset").select("asset", "draws", *[F.round(c, 6).alias(c) for c in ("diff", "diff_low", "diff_high", "diff_p")])


@query(sql("p", f"""{FORWARD}, c AS (SELECT asset, strftime(date, '%Y%m') AS cluster, sum(f) AS y, count(*) AS one FROM k GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY cluster) - 1 AS position, count(*) OVER (PARTITION BY asset) AS n FROM c),
d AS ({bs.drawn_sql("SELECT DISTINCT asset, n FROM i", ["asset"], "n", 2000, "clusters")}), x AS (SELECT d.asset, draw, sum(y) / sum(one) AS mean FROM d JOIN i ON i.asset = d.asset AND i.position = d.place GROUP BY 1, 2), b AS ({bs.intervals_sql("x", ["asset"], ["mean"])}),
o AS (SELECT asset, sum(y) / sum(one) AS mean, count(*) AS clusters FROM c GROUP BY 1) SELECT b.asset, clusters, round(o.mean, 6) AS mean, {_bands('mean_low mean_high')} FROM b JOIN o ON o.asset = b.asset"""), dates="")
def udf04_cluster_draws(spark, sf_dir):
    """Mean forward return when whole months are drawn, 2,000 draws."""
    v = _with_forward(spark, sf_dir).select("asset", F.date_format("date", "yyyyMM").alias("cluster"), F.col("f").alias("y"), F.lit(1).alias("one"))
    draws = bs.cluster_draws(v, ["asset"], "cluster", ["y", "one"], 2000, "clusters")
    found = bs.intervals(draws.withColumn("mean", F.col("y") / F.col("one")), ["asset"], ["mean"])
    seen = v.groupBy("asset").agg(F.avg("y").alias("mean"), F.countDistinct("cluster").alias("clusters"))
    return found.join(seen, "asset").select("asset", "clusters", *[F.round(c, 6).alias(c) for c in ("mean", "mean_low", "mean_high")])


@query(sql("t ev", f"""{CAR}, v AS (SELECT year(event) AS year, event, car AS y, CASE WHEN car > 0 THEN 1.0 ELSE 0.0 END AS up FROM hit WHERE car IS NOT NULL), i AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY event) - 1 AS position, count(*) OVER (PARTITION BY year) AS n FROM v),
d AS ({bs.drawn_sql("SELECT DISTINCT year, n FROM i", ["year"], "n", 500, "events")}), x AS (SELECT d.year, draw, avg(y) AS mean, avg(up) AS up FROM d JOIN i ON i.year = d.year AND i.position = d.place GROUP BY 1, 2), b AS ({bs.intervals_sql("x", ["year"], ["mean", "up"])}),
o AS (SELECT year, avg(y) AS mean, avg(up) AS up, count(*) AS n FROM v GROUP BY 1) SELECT b.year, n, round(o.mean, 6) AS mean, {_bands('mean_low mean_high')}, round(o.up, 6) AS up, {_bands('up_low up_high')} FROM b JOIN o ON o.year = b.year"""), dates="")
def udf05_event_draws(spark, sf_dir):
    """Mean return after events and share of rising ones when events are drawn again, by year, 500 draws."""
    v = _after(spark, sf_dir).select(F.year("event").cast("long").alias("year"), "event", F.col("car").alias("y"), (F.col("car") > 0).cast("double").alias("up"), F.lit(1).alias("one"))
    draws = bs.cluster_draws(v, ["year"], "event", ["y", "up", "one"], 500, "events")
    found = bs.intervals(draws.select("year", (F.col("y") / F.col("one")).alias("mean"), (F.col("up") / F.col("one")).alias("up")), ["year"], ["mean", "up"])
    seen = v.groupBy("year").agg(F.avg("y").alias("mean"), F.avg("up").alias("up"), F.count("*").alias("n"))
    return found.join(seen, "year").select("year", "n", *[F.round(c, 6).alias(c) for c in ("mean", "mean_low", "mean_high", "up", "up_low", "up_high")])


@query(dates="")
def udf07_area_draws(spark, sf_dir):
    """Difference of two scores' areas with an interval, from weights of blocks of rows, by asset."""
    rows = _states(spark, sf_dir)
    one, two = (bs.area_draws(rows, ["asset"], ["date"], "y", x, 20, 1000, 7).select("asset", "draw", F.col("auc").alias(n)) for x, n in (("v", "short"), ("v60", "long")))
    found = bs.intervals(one.join(two, ["asset", "draw"]).withColumn("diff", F.col("short") - F.col("long")).filter("diff is not null"), ["asset"], ["diff"])
    seen = s.auc(rows, "v", "y", ["asset"]).select("asset", "auc", "n").join(s.auc(rows, "v60", "y", ["asset"]).select("asset", F.col("auc").alias("other")), "asset")
    return found.join(seen.select("asset", "n", (F.col("auc") - F.col("other")).alias("diff")), "asset")
