"""Registered model queries without SQL, on the test tables, against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import garch
from tidewright.operators.change_points import breaks, segment_costs
from tidewright.plans import model_queries as mq
from tidewright.plans import registry, workers
from tidewright.sources import adapters as a

from .test_models import least_squares, plain_decomposition, plain_forward_backward

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def run(spark):
    workers.find_package(spark)
    return lambda name: registry.queries()[name](spark, DATA).toPandas()


@pytest.fixture(scope="module")
def prices(spark):
    return a.daily_prices(spark, DATA).toPandas().sort_values(["asset", "date"])


@pytest.fixture(scope="module")
def wide(spark):
    return mq._wide(spark, DATA).toPandas().sort_values("date")[mq.NAMES].to_numpy()


def test_unit_roots(run, prices):
    got = run("udf34_unit_roots").set_index("asset")
    for asset, own in prices.groupby("asset"):
        y = own["value"].to_numpy() / 1e5
        d, k = np.diff(y), int(got.loc[asset, "lags"])
        rows = np.arange(k, len(d))
        b, e, x = least_squares(d[rows], y[rows], *[d[rows - i] for i in range(1, k + 1)])
        t = b[1] / math.sqrt(e @ e / (len(rows) - k - 2) * np.linalg.inv(x.T @ x)[1, 1])
        assert abs(t - got.loc[asset, "statistic"]) < 1e-5 and got.loc[asset, "n"] == len(rows)


def test_causality(run, wide):
    n = len(wide)
    for r in run("udf34_causality").itertuples():
        i, j, k = mq.NAMES.index(r.effect), mq.NAMES.index(r.cause), r.lag
        own, other = ([wide[k - m : n - m, c] for m in range(1, k + 1)] for c in (i, j))
        one, both = (float(e @ e) for _, e, _ in (least_squares(wide[k:, i], *own), least_squares(wide[k:, i], *own, *other)))
        want = (one - both) / k / (both / (n - 3 * k - 1))
        assert abs(r.f - want) < 1e-6 * max(1, want) and r.n == n - k and 0 <= r.p <= 1


def test_impulse_responses(run, wide):
    x, got = np.diff(wide, axis=0), run("udf34_impulse_responses")
    p, n = int(got["lags"].iloc[0]), len(x)
    blocks = [x[p - m : n - m] for m in range(1, p + 1)]
    fits = [least_squares(x[p:, i], *[c for b in blocks for c in b.T])[0] for i in range(5)]
    first = np.array([f[1:6] for f in fits])
    for r in got[got["day"] == 1].itertuples():
        assert abs(r.response - first[mq.NAMES.index(r.target), mq.NAMES.index(r.shock)]) < 1e-7
    assert len(got) == 500


def test_cointegration(run, wide):
    got, x = run("udf34_cointegration"), wide[:, :3]
    d = np.diff(x, axis=0)
    rows = np.arange(2, len(d))
    z = [c for i in (1, 2) for c in d[rows - i].T]
    left, right = (np.array([least_squares(s[rows, i], *z)[1] for i in range(3)]) for s in (d, x))
    values = np.linalg.eigvals(np.linalg.inv(right @ right.T) @ right @ left.T @ np.linalg.inv(left @ left.T) @ left @ right.T).real
    assert np.allclose(got.groupby("relation")["eigenvalue"].first(), np.sort(values)[::-1], atol=1e-8)


def test_regimes(spark, run, prices):
    got = run("udf34_regimes")
    assert np.allclose(got.groupby("asset")["share"].sum(), 1) and got["state"].isin([0, 1, 2]).all()
    rows, params = mq._regimes(spark, DATA)
    asset = "2-HIGH"
    x = np.log1p(prices[prices["asset"] == asset]["value"].pct_change().dropna().to_numpy())
    path = plain_forward_backward(x, params[asset,])[3]
    rank = np.argsort(np.argsort(params[asset,][2]))
    counts = pd.Series(rank[path]).value_counts()
    own = got[got["asset"] == asset].set_index("state")["n"]
    assert own.to_dict() == counts.to_dict()


def test_volatility(run, prices):
    for r in run("udf34_volatility").itertuples():
        v = prices[prices["asset"] == r.asset]["value"].pct_change().dropna()
        e = ((v - v.mean()) ** 2).to_numpy()
        total = garch.likelihoods(e, np.array([e.mean()]), np.array([[r.constant, r.square, r.carry]]))[0]
        assert abs(total - r.likelihood) < 1e-4 * abs(total) and r.n == len(v) and 0 < r.share <= 1
        plain = garch.likelihoods(e, np.array([e.mean()]), np.array([[e.mean(), 0.0, 0.0]]))[0]
        assert r.likelihood > plain - 1


def test_breaks(spark, run):
    months = mq._monthly(spark, DATA).toPandas().sort_values(["asset", "month"])
    got = run("udf34_breaks")
    for asset, own in months.groupby("asset"):
        x = own["value"].pct_change().dropna().to_numpy()
        x = x - x.mean()
        sums, squares = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x))
        for penalty, part in got[got["asset"] == asset].groupby("penalty"):
            price = penalty * math.log(len(x))
            ends = part.sort_values("segment")["rows"].cumsum().tolist()[:-1]
            cost = lambda f: sum(segment_costs(sums, squares, np.array([s]), t, "spread")[0] + price for s, t in zip([0, *f], [*f, len(x)]))  # noqa: B023, E731
            assert abs(cost(ends) - cost(breaks(sums, squares, price, 6, "spread", pruned=False))) < 1e-6


def test_season(spark, run):
    got = run("udf34_season")
    months = mq._monthly(spark, DATA).toPandas().sort_values("month")
    y = months[months["asset"] == "3-MEDIUM"]["value"].to_numpy()
    season, trend, _ = plain_decomposition(y, 12, 7, 2, 2)
    own = got[got["asset"] == "3-MEDIUM"].sort_values("month")
    scale = np.abs(y).max()
    assert np.abs(own["season"] - season).max() < 1e-9 * scale and np.abs(own["trend"] - trend).max() < 1e-9 * scale


def test_attributions_and_radial_scores(spark, run):
    from pyspark.ml.functions import vector_to_array

    sizes = run("udf34_attributions")
    assert sorted(sizes["rank"]) == [1, 2, 3] and (sizes["mean_size"] > 0).all()
    got = run("q50_explained_latest")
    assert np.allclose(got[[f"{f}_adds" for f in mq.MODEL_INPUTS]].sum(axis=1) + got["base"], got["output"])
    rows = mq._flags(spark, DATA)
    latest = rows.groupBy("asset").agg(F.max_by(F.struct(*rows.columns), "date").alias("x")).select("x.*")
    from pyspark.ml.feature import VectorAssembler

    scored = mq._boosted(rows).transform(VectorAssembler(inputCols=mq.MODEL_INPUTS, outputCol="features").transform(latest))
    want = scored.select("asset", vector_to_array("rawPrediction")[1].alias("margin")).toPandas().set_index("asset")["margin"]
    assert np.allclose(got.set_index("asset")["output"].sort_index(), want.sort_index(), atol=1e-9)
    assert run("udf30_radial")["auc"].between(0.6, 1).all()  # a rule on the held-out rows that a line finds too


def test_area_draws_contain_the_difference(run):
    r = run("udf07_area_draws")
    assert ((r["diff_low"] <= r["diff"]) & (r["diff"] <= r["diff_high"])).all() and (r["draws"] == 1000).all()


def test_shapes_are_centred(spark, run):
    shapes = run("udf35_shapes")
    assert set(shapes["feature"]) == set(mq.FEATURES) and shapes["share"].abs().max() > 0.1
    rows = mq.duel_rows(spark, DATA).toPandas()
    for f, own in shapes.groupby("feature"):
        own = own.sort_values("bin")
        at = np.searchsorted(own["upper"].dropna().to_numpy() - 1e-9, rows[f].to_numpy())
        assert abs(own["share"].to_numpy()[at].mean()) < 1e-3
