"""Statistical models against plain numpy, brute force and planted truths."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import boosting as eb
from tidewright.operators import bootstrap as bs
from tidewright.operators import ranges as rg
from tidewright.plans import registry, workers

DATA = "/root/testdata/sf0.01"  # the smallest tables leave some folds without rows


@pytest.fixture(autouse=True)
def package(spark):
    workers.find_package(spark)


def test_positions_and_carries_whatever_the_cuts(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", int(t), float(t % 11)) for i, t in enumerate(rng.permutation(4000))]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    for ranges in (1, 3, 9):
        got = rg.positions(df, ["k"], ["t"], ranges=ranges).toPandas()
        got = got.sort_values(["k", "t"])
        assert (got["position"] == got.groupby("k").cumcount()).all() and len(got) == 4000
        c = rg.carried(rg.cut(df, ["k"], ["t"], ranges), ["k"], {"before": F.sum("v")}).toPandas().sort_values(["k", "t"])
        for k, own in c.groupby("k"):
            sums = own.groupby("_part")["v"].sum().cumsum().shift(fill_value=0.0)
            assert (own["before"] == own["_part"].map(sums)).all()
    assert rg.positions(df.limit(0), ["k"], ["t"]).count() == 0


def test_folds_over_ranges_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [("a" if i % 4 else "b", i, float(rng.normal())) for i in range(600)]
    df = rg.cut(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], ["t"], 5)

    def affine(frame):
        a, b = 1.0, 0.0
        for v in frame["v"]:
            a, b = 0.9 * a, 0.9 * b + v
        return {"a": a, "b": b}

    def starts(frame):
        out, x = [], 0.0
        for a, b in zip(frame["a"], frame["b"]):
            out.append(x)
            x = a * x + b
        return pd.DataFrame({"x": out})

    def finish(frame, start):
        x, out = start["x"], []
        for v in frame["v"]:
            x = 0.9 * x + v
            out.append(x)
        return frame[["k", "t"]].assign(x=out)

    got = rg.folded(df, ["k"], affine, "a double, b double", starts, "x double", finish, "k string, t int, x double").toPandas()
    for k in "ab":
        x, want = 0.0, []
        for _, t, v in sorted(r for r in rows if r[0] == k):
            x = 0.9 * x + v
            want.append(x)
        assert np.allclose(got[got["k"] == k].sort_values("t")["x"], want)


# ---- bootstrap ---------------------------------------------------------------


def test_block_draws_are_circular_blocks(spark):
    rows = [("a", i, float(i), 1) for i in range(53)] + [("b", i, float(i), 1) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, t int, v double, one int")
    got = bs.block_draws(df, ["k"], ["t"], ["v", "one"], 7, 40, "x").toPandas()
    sizes = {"a": 56, "b": 4}
    assert all((own["one"] == sizes[k]).all() and len(own) == 40 for k, own in got.groupby("k"))
    # A draw is a sum of blocks: its starts, by the same hash.
    import hashlib

    for d in range(1, 41):
        starts = [int(hashlib.md5(f"x:a:{d}:{i}".encode()).hexdigest()[:12], 16) % 53 for i in range(1, 9)]
        want = sum((s + k) % 53 for s in starts for k in range(7))
        assert got[(got["k"] == "a") & (got["draw"] == d)]["v"].iloc[0] == want


def test_weighted_areas_over_ranges(spark):
    rng = np.random.default_rng(8)
    n = 400
    y, score = rng.integers(0, 2, n), np.round(rng.random(n), 1)
    score[:150] = 0.5  # a tie larger than a range
    df = spark.createDataFrame(pd.DataFrame({"t": range(n), "y": y, "s": score}))
    w = bs.multiplicities(np.arange(n), n, 6, np.arange(30), 5)
    assert abs(w.mean() - 1) < 0.1
    assert (np.diff(w, axis=1) != 0).mean() < 0.5  # blocks hang together
    for ranges in (1, 6):
        got = bs.area_draws(df, [], ["t"], "y", "s", 6, 30, 5, ranges).toPandas().set_index("draw")
        for d in range(30):
            pairs = [(w[d, i] * w[d, j], (score[i] > score[j]) + 0.5 * (score[i] == score[j])) for i in np.flatnonzero(y) for j in np.flatnonzero(1 - y)]
            total = sum(a for a, _ in pairs)
            assert abs(got.loc[d, "auc"] - sum(a * b for a, b in pairs) / total) < 1e-12
            assert abs(got.loc[d, "brier"] - (w[d] * (score - y) ** 2).sum() / w[d].sum()) < 1e-12


# ---- boosting ----------------------------------------------------------------


def plain_boost(x, y, edges, rounds, rate, leaves, ridge):
    """Row by row, with every split tried by plain sums."""
    bins = [np.array([int((e < v).sum()) for v in x[:, j]]) for j, e in enumerate(edges)]
    shapes = [np.zeros(len(e) + 1) for e in edges]
    base = math.log(y.mean() / (1 - y.mean()))
    for _ in range(rounds):
        for j, b in enumerate(bins):
            p = 1 / (1 + np.exp(-(base + sum(s[k] for s, k in zip(shapes, bins)))))
            g = np.array([(y - p)[b == k].sum() for k in range(len(shapes[j]))])
            h = np.array([(p * (1 - p))[b == k].sum() for k in range(len(shapes[j]))])
            best_cuts = ()
            for _ in range(leaves - 1):
                options = []
                for c in set(range(1, len(g))) - set(best_cuts):
                    cuts = [0, *sorted([*best_cuts, c]), len(g)]
                    gain = sum(g[a:z].sum() ** 2 / (h[a:z].sum() + ridge) for a, z in zip(cuts, cuts[1:]))
                    options.append((-gain, c))
                if options:
                    best_cuts = (*best_cuts, min(options)[1])
            cuts = [0, *sorted(best_cuts), len(g)]
            for a, z in zip(cuts, cuts[1:]):
                shapes[j][a:z] += rate * g[a:z].sum() / (h[a:z].sum() + ridge)
    for j, b in enumerate(bins):
        mean = shapes[j][b].mean()
        shapes[j] -= mean
        base += mean
    return shapes, base


def labelled(seed, n=500):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    p = 1 / (1 + np.exp(-(2 * (x[:, 0] > 0.3) + np.abs(x[:, 1]) - 1)))
    return x, (rng.random(n) < p).astype(int)


def test_shapes_equal_plain_numpy(spark):
    frames = []
    for g, seed in (("one", 1), ("two", 2)):
        x, y = labelled(seed)
        frames.append(pd.DataFrame(x, columns=list("abc")).assign(y=y, g=g))
    df = spark.createDataFrame(pd.concat(frames)).repartition(6)
    model = eb.fit_additive(df, ["a", "b", "c"], "y", "g", bins=8, rounds=4)
    for i, frame in enumerate(frames):
        x, y = frame[["a", "b", "c"]].to_numpy(), frame["y"].to_numpy()
        shapes, base = plain_boost(x, y, model.edges[i], 4, 0.2, 3, 1.0)
        assert abs(base - model.intercepts[i]) < 1e-9
        for mine, want in zip(model.shapes[i], shapes):
            assert np.abs(mine - want).max() < 1e-9
        assert all(abs(e - np.quantile(x[:, j], k / 8)) < 0.1 for j in range(3) for k, e in enumerate(model.edges[i][j], 1))
    out = model.transform(df, shares=True).toPandas()
    score = out[["a_share", "b_share", "c_share"]].sum(axis=1) + out["g"].map(dict(zip(model.groups, model.intercepts)))
    assert np.allclose(out["p"], 1 / (1 + np.exp(-score)))
    # The step of the first feature is found where it was planted.
    e, shape = model.edges[0][0], model.shapes[0][0]
    assert shape[-1] - shape[0] > 0.5 and shape[e.searchsorted(1.0)] - shape[e.searchsorted(-0.5)] > 0.5


def test_boosting_of_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 1), (None, 0), (2.0, 1)], "a double, y int")
    out = eb.fit_additive(df, ["a"], "y", rounds=2).transform(df).toPandas()
    assert out["p"].isna().sum() == 1 and (out["p"].dropna() > 0.5).all()
    assert eb.fit_additive(df.limit(0), ["a"], "y").transform(df).count() == 4


def test_linear_model_is_at_the_optimum(spark):
    x, y = labelled(5)
    df = spark.createDataFrame(pd.DataFrame(x * [1, 10, 100] + 5, columns=list("abc")).assign(y=y))
    m = eb.fit_linear(df, ["a", "b", "c"], "y", penalty=1.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.array(m.weights[0])
    p = 1 / (1 + np.exp(-(w[0] + z @ w[1:])))
    assert abs((y - p).sum()) < 1e-6 and np.abs(z.T @ (y - p) - w[1:]).max() < 1e-6
    got = m.transform(df).orderBy("a").toPandas()["p"]
    assert np.allclose(got, p[np.argsort(x[:, 0])])


def test_gate_has_three_outcomes(spark):
    sides = ["positive", "negative", "zero"]
    rows = [(a, b, d, ok) for a, b in itertools.product(sides, sides) for d in (-0.1, 0.0, 0.1) for ok in (True, False)]
    df = spark.createDataFrame(rows, "a string, b string, d double, ok boolean")
    got = df.withColumn("v", eb.promotion(F.col("a"), F.col("b"), F.col("d"), F.col("d"), F.col("ok"))).collect()
    for r in got:
        if r["a"] == r["b"] == "positive":
            want = "promote" if r["ok"] else "borderline_stop"
        elif r["a"] == r["b"] == "negative" or r["a"] == r["b"] == "zero" and r["d"] <= 0:
            want = "not_promote"
        else:
            want = "borderline_stop"
        assert r["v"] == want


def test_duel(spark):
    found = registry.queries()["q51_duel"](spark, DATA).collect()
    assert len(found) == 1
    r = found[0]
    assert r["n"] > 4000 and r["boosted_brier"] < 0.25
    for block in (20, 40):
        assert r[f"brier_low_{block}"] <= r["boosted_brier"] - r["linear_brier"] <= r[f"brier_high_{block}"]
        assert r[f"draws_{block}"] > 1900 and r[f"auc_low_{block}"] <= r["boosted_auc"] - r["linear_auc"] <= r[f"auc_high_{block}"]
    assert 0.3 < r["linear_auc"] < 0.95 and r["verdict"] in ("promote", "not_promote", "borderline_stop")


# ---- attributions ------------------------------------------------------------


def random_tree(rng, depth, rows):
    if depth == 0 or rows < 2 or rng.random() < 0.15:
        return {"value": float(rng.normal()), "rows": rows}
    left = int(rng.integers(0, rows + 1))
    node = {"feature": int(rng.integers(0, 4)), "threshold": float(rng.normal()), "rows": rows}
    return node | {"left": random_tree(rng, depth - 1, left), "right": random_tree(rng, depth - 1, rows - left)}


def expected(tree, x, known):
    """The output where features outside ``known`` follow both branches."""
    if "value" in tree:
        return tree["value"]
    if tree["feature"] in known:
        return expected(tree["left" if x[tree["feature"]] <= tree["threshold"] else "right"], x, known)
    return sum(tree[s]["rows"] / tree["rows"] * expected(tree[s], x, known) for s in ("left", "right"))


def test_attributions_equal_all_coalitions():
    from tidewright.operators.attribution import base_value, leaves_of, shapley

    rng = np.random.default_rng(6)
    for _ in range(25):
        tree = random_tree(rng, 5, 200)
        leaves, x = leaves_of(tree), rng.normal(size=(6, 4))
        got = shapley(x, leaves)
        assert abs(base_value(leaves) - expected(tree, x[0], set())) < 1e-12
        for row, values in zip(x, got):
            for i in range(4):
                want = 0.0
                for k in range(4):
                    for known in itertools.combinations([j for j in range(4) if j != i], k):
                        w = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                        want += w * (expected(tree, row, {*known, i}) - expected(tree, row, set(known)))
                assert abs(values[i] - want) < 1e-12
            assert abs(base_value(leaves) + values.sum() - expected(tree, row, {0, 1, 2, 3})) < 1e-12


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_attributions_sum_to_the_fitted_output(spark, kind):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tidewright.operators.attribution import attributions, fitted_leaves

    x, y = labelled(9, 300)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(label=y, **{"e e": 1}))
    rows = VectorAssembler(inputCols=list("abc"), outputCol="features").transform(df)
    trees = GBTClassifier(maxIter=6, maxDepth=3, seed=1) if kind == "boosted" else RandomForestClassifier(numTrees=7, maxDepth=4, seed=1)
    model = trees.fit(rows)
    out = attributions(model.transform(rows).select("a", "b", "c", "e e", vector_to_array("rawPrediction" if kind == "boosted" else "probability")[1].alias("want")), list("abc"), fitted_leaves(model)).toPandas()
    assert np.allclose(out["output"], out["want"], atol=1e-9)
    assert np.allclose(out[["a_adds", "b_adds", "c_adds"]].sum(axis=1) + out["base"], out["want"])
    assert out["a_adds"].abs().mean() > 3 * out["c_adds"].abs().mean()
    missing = attributions(df.withColumn("b", F.lit(None).cast("double")), list("abc"), fitted_leaves(model))
    assert missing.filter("a_adds is null or isnan(a_adds)").count() == 300


# ---- kernels -----------------------------------------------------------------


def test_fourier_features_are_near_the_kernel():
    from tidewright.operators.kernels import fourier_lines, fourier_map

    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 5))
    want = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(-1))
    for count, seed in itertools.product((256, 4096), (1, 2)):
        z = fourier_map(x, fourier_lines(5, count, 0.2, seed))
        # Hoeffding: terms lie in [-2, 2]; of 7,140 pairs none is beyond this in all but one case of a thousand.
        bound = math.sqrt(8 * math.log(2 * 7140 * 1000) / count)
        assert np.abs(z @ z.T - want).max() < bound


def test_a_radial_classifier_learns_a_ring(spark):
    from tidewright.operators.kernels import radial_classifier

    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 2)) * [3.0, 0.2]
    y = ((x / [3.0, 0.2]) ** 2).sum(1) < 1.2
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(y=y.astype(int), at=range(700)))
    train, test = df.filter("at < 400"), df.filter("at >= 400").union(spark.createDataFrame([(None, 1.0, 1, 999)], df.schema))
    got = radial_classifier(train, test, ["a", "b"], "y").toPandas()
    assert got["decision"].isna().sum() == 1
    got = got.dropna()
    assert ((got["decision"] > 0) == (got["y"] == 1)).mean() > 0.93
    assert radial_classifier(train.limit(0), test, ["a", "b"], "y").filter("decision is not null").count() == 0


# ---- hidden states -----------------------------------------------------------


def planted_states(seed, n):
    rng = np.random.default_rng(seed)
    stay, state, states = 0.95, 0, []
    for _ in range(n):
        state = state if rng.random() < stay else int(rng.integers(0, 3))
        states.append(state)
    states = np.array(states)
    return states, np.array([-2.0, 0.0, 2.5])[states] + rng.normal(size=n) * np.array([0.6, 0.3, 0.8])[states]


def plain_forward_backward(x, params):
    """By plain probabilities in logarithms, row after row."""
    start, trans, mean, var = params
    d = -0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
    n, k = d.shape
    add = np.logaddexp.reduce
    a, b = np.empty((n, k)), np.zeros((n, k))
    a[0] = np.log(start) + d[0]
    for t in range(1, n):
        a[t] = add(a[t - 1][:, None] + np.log(trans), axis=0) + d[t]
    for t in range(n - 2, -1, -1):
        b[t] = add(np.log(trans) + d[t + 1] + b[t + 1], axis=1)
    total = add(a[-1])
    joint = sum(np.exp(a[t][:, None] + np.log(trans) + d[t + 1] + b[t + 1] - total) for t in range(n - 1))
    score, back = np.log(start) + d[0], []
    for t in range(1, n):
        ways = score[:, None] + np.log(trans)
        back.append(ways.argmax(0))
        score = ways.max(0) + d[t]
    path = [int(score.argmax())]
    for way in reversed(back):
        path.append(int(way[path[-1]]))
    return np.exp(a + b - total), joint, total, path[::-1]


@pytest.mark.parametrize("ranges", [1, 4, 11])
def test_states_equal_a_sequential_run_whatever_the_cuts(spark, ranges):
    from tidewright.operators import hidden_states as hs

    params, frames = {}, []
    for i, key in enumerate("ab"):
        _, x = planted_states(i, 260 - 100 * i)
        frames.append(pd.DataFrame({"k": key, "t": range(len(x)), "v": x}))
        params[key,] = (np.array([0.2, 0.5, 0.3]), np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.05, 0.15, 0.8]]), np.array([0.5, -1.5, 2.0]), np.array([0.5, 0.4, 0.9]))
    df = spark.createDataFrame(pd.concat(frames)).withColumn("v", F.when(F.col("t") != 250, F.col("v")))  # a missing value is left out
    rows = hs.prepared(df, ["k"], ["t"], "v", ranges)
    got = hs.expectations(rows, ["k"], params).groupBy("k").sum().toPandas().set_index("k")
    paths = hs.most_likely(rows, ["k"], params).toPandas().sort_values(["k", "t"])
    for key, frame in zip("ab", frames):
        x = frame[frame["t"] != 250]["v"].to_numpy()
        gamma, joint, total, path = plain_forward_backward(x, params[key,])
        r = got.loc[key]
        assert abs(r["sum(likelihood)"] - total) < 1e-7
        assert np.allclose([r[f"sum(g{i})"] for i in range(3)], gamma.sum(0)) and np.allclose([r[f"sum(x{i})"] for i in range(3)], gamma.T @ x)
        assert np.allclose([r[f"sum(j{i})"] for i in range(9)], joint.ravel()) and np.allclose([r[f"sum(p{i})"] for i in range(3)], gamma[0])
        rank = {1: 0, 0: 1, 2: 2}
        assert paths[paths["k"] == key]["state"].tolist() == [rank[s] for s in path]


def test_planted_states_are_found(spark):
    from tidewright.operators import hidden_states as hs

    states, x = planted_states(7, 1500)
    rows = hs.prepared(spark.createDataFrame(pd.DataFrame({"t": range(1500), "v": x})), [], ["t"], "v", 4)
    params, seen = hs.fit_states(rows, [], rounds=8)
    assert all(b > a - 1e-6 for a, b in zip(seen[()], seen[()][1:]))  # the likelihood never falls
    assert np.abs(np.sort(params[()][2]) - [-2.0, 0.0, 2.5]).max() < 0.25
    got = hs.most_likely(rows, [], params).toPandas().sort_values("t")["state"].to_numpy()
    assert (got == states).mean() > 0.95
    assert hs.fit_states(hs.prepared(spark.createDataFrame([], "t int, v double"), [], ["t"], "v"), [])[0] == {}


# ---- lags --------------------------------------------------------------------


def least_squares(y, *x):
    """Coefficients, residuals and rows of y on a constant and columns."""
    design = np.column_stack([np.ones(len(y)), *x])
    b = np.linalg.lstsq(design, y, rcond=None)[0]
    return b, y - design @ b, design


def walks(seed, n=320):
    """Two walks that hang together, one apart."""
    rng = np.random.default_rng(seed)
    one = np.cumsum(rng.normal(size=n)) * 50 + 1000
    gap = np.zeros(n)
    for t in range(1, n):
        gap[t] = 0.5 * gap[t - 1] + rng.normal() * 20
    return pd.DataFrame({"t": range(n), "a": one, "b": 2 * one + gap + 5, "c": np.cumsum(rng.normal(size=n))})


def test_unit_roots_against_plain_regressions(spark):
    from tidewright.operators.lag_models import unit_root_p, unit_roots

    f = walks(1)
    long = pd.concat([pd.DataFrame({"k": k, "t": f["t"], "v": v}) for k, v in (("walk", f["a"]), ("steps", f["c"].diff().fillna(0)), ("gap", f["b"] - 2 * f["a"]))])
    df = spark.createDataFrame(long).union(spark.createDataFrame([("short", 1, 2.0), ("short", 2, None)], "k string, t long, v double"))
    for choose, ranges in ((True, 5), (False, 1)):
        got = {r["k"]: r for r in unit_roots(df, ["k"], ["t"], "v", 4, choose, ranges).collect()}
        assert got["short"]["statistic"] is None
        for k, own in long.groupby("k"):
            y = own.sort_values("t")["v"].to_numpy()
            d = np.diff(y)

            def fit(lags, start):
                rows = np.arange(start, len(d))
                b, e, x = least_squares(d[rows], y[rows], *[d[rows - i] for i in range(1, lags + 1)])
                n = len(rows)
                se = math.sqrt(e @ e / (n - lags - 2) * np.linalg.inv(x.T @ x)[1, 1])
                return n * math.log(e @ e / n) + 2 * (lags + 2), b[1] / se, n

            lags = min(range(5), key=lambda k: (fit(k, 4)[0], k)) if choose else 4
            _, t, n = fit(lags, lags)
            assert got[k]["lags"] == lags and got[k]["n"] == n and abs(got[k]["statistic"] - t) < 1e-6
        assert got["walk"]["p"] > 0.05 > 0.01 > got["gap"]["p"]
    # Published 5 and 1 % points of the test.
    assert abs(unit_root_p(-2.86) - 0.05) < 0.002 and abs(unit_root_p(-3.43) - 0.01) < 0.001


@pytest.mark.parametrize("ranges", [1, 6])
def test_causality_and_responses_against_plain_regressions(spark, ranges):
    from tidewright.operators.lag_models import best_lags, causality, impulse_responses

    rng = np.random.default_rng(11)
    n, x = 300, np.zeros((300, 3))
    for t in range(2, n):
        x[t] = 0.3 * x[t - 1] + rng.normal(size=3)
        x[t, 1] += 0.6 * x[t - 2, 0]
    x = x * [1, 100, 0.01] + [0, 7, 1]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(t=range(n)))
    tests = causality(df, ["t"], list("abc"), 3, ranges)
    for r in tests.collect():
        i, j, k = "abc".index(r["effect"]), "abc".index(r["cause"]), r["lag"]
        own, other = ([x[k - m : n - m, c] for m in range(1, k + 1)] for c in (i, j))
        one, both = (float(e @ e) for _, e, _ in (least_squares(x[k:, i], *own), least_squares(x[k:, i], *own, *other)))
        want = (one - both) / k / (both / (n - k - 2 * k - 1))
        assert r["n"] == n - k and abs(r["f"] - want) < 1e-6 * max(1, want)
    best = {(r["cause"], r["effect"]): r for r in best_lags(tests).collect()}
    assert best["a", "b"]["p"] < 1e-6 and best["a", "b"]["lag"] == 2 and best["c", "b"]["p"] > 1e-3
    got = impulse_responses(df, ["t"], list("abc"), 3, 6, ranges).toPandas()
    p = int(got["lags"].iloc[0])
    assert p == 2
    lags = [x[p - m : n - m] for m in range(1, p + 1)]
    fits = [least_squares(x[p:, i], *[col for block in lags for col in block.T]) for i in range(3)]
    a = [np.array([f[0][1 + 3 * m : 4 + 3 * m] for f in fits]) for m in range(p)]
    e = np.array([f[1] for f in fits])
    root = np.linalg.cholesky(e @ e.T / (n - p - 3 * p - 1))
    powers = [np.eye(3)]
    for day in range(1, 6):
        powers.append(sum(a[m] @ powers[day - 1 - m] for m in range(min(p, day))))
    for r in got.itertuples():
        i, j = "abc".index(r.target), "abc".index(r.shock)
        size = abs(powers[r.day]).max()
        assert abs(r.response - powers[r.day][i, j]) < 1e-7 * size and abs(r.orthogonal - (powers[r.day] @ root)[i, j]) < 1e-7 * 100


def test_the_f_tail_against_draws():
    from tidewright.operators.lag_models import f_tail

    rng = np.random.default_rng(1)
    draws = (rng.chisquare(3, 200_000) / 3) / (rng.chisquare(40, 200_000) / 40)
    for f in (0.5, 1.0, 2.5, 4.0):
        assert abs(f_tail(f, 3, 40) - (draws > f).mean()) < 0.005
    assert f_tail(0.0, 2, 9) == 1.0


def test_a_planted_relation_is_found(spark):
    from tidewright.operators.lag_models import cointegration

    f = walks(2)
    got = cointegration(spark.createDataFrame(f), ["t"], list("abc"), 2, 4).toPandas()
    # The same eigenvalues from residuals, row by row.
    x = f[list("abc")].to_numpy()
    d = np.diff(x, axis=0)
    rows = np.arange(2, len(d))
    z = [d[rows - i] for i in (1, 2)]
    left = np.array([least_squares(d[rows, i], *[c for b in z for c in b.T])[1] for i in range(3)])
    right = np.array([least_squares(x[rows, i], *[c for b in z for c in b.T])[1] for i in range(3)])
    s00, s01, s11 = left @ left.T, left @ right.T, right @ right.T
    want = np.sort(np.linalg.eigvals(np.linalg.inv(s11) @ s01.T @ np.linalg.inv(s00) @ s01).real)[::-1]
    first = got[got["name"] == "a"].sort_values("relation")
    assert np.allclose(first["eigenvalue"], want, atol=1e-8) and first["found"].tolist() == [True, False, False]
    assert np.allclose(first["trace"], [-len(rows) * np.log(1 - want[r:]).sum() for r in range(3)])
    one = got[got["relation"] == 1].set_index("name")
    assert abs(one.loc["b", "weight"] + 0.5) < 0.01 and abs(one.loc["c", "weight"]) < 0.5
    assert one.loc["b", "adjustment"] > 0 > one.loc["b", "weight"]  # b moves against a gap
    # Adjustments are the regression of differences on the relation.
    beta = one.loc[list("abc"), "weight"].to_numpy()
    slope = [least_squares(d[rows, i], x[rows] @ beta, *[c for b in z for c in b.T])[0][1] for i in range(3)]
    assert np.allclose(one.loc[list("abc"), "adjustment"], slope, rtol=1e-5, atol=1e-9)


# ---- variances and breaks ----------------------------------------------------


def garch_series(seed, n, w=0.1, a=0.12, b=0.8):
    rng = np.random.default_rng(seed)
    h, x = w / (1 - a - b), []
    for _ in range(n):
        e = rng.normal() * math.sqrt(h)
        x.append(e)
        h = w + a * e * e + b * h
    return np.array(x)


@pytest.mark.parametrize("ranges", [1, 5])
def test_variances_equal_a_loop_and_find_planted_parameters(spark, ranges):
    from tidewright.operators import garch

    frames = [pd.DataFrame({"k": k, "t": range(n), "v": garch_series(i, n) * scale}) for i, (k, n, scale) in enumerate((("a", 3000, 1.0), ("b", 400, 50.0)))]
    rows = garch.prepared(spark.createDataFrame(pd.concat(frames)), ["k"], ["t"], "v", ranges)
    candidates, variances = {}, {}
    for f in frames:
        e = (f["v"] - f["v"].mean()) ** 2
        variances[f["k"].iloc[0],] = v = float(e.mean())
        candidates[f["k"].iloc[0],] = np.array([[0.1 * v, 0.1, 0.8], [0.3 * v, 0.2, 0.5]])
    got = {(r["k"], r["at"]): r["likelihood"] for r in garch.evaluated(rows, ["k"], candidates, variances).collect()}
    for f in frames:
        k, e = f["k"].iloc[0], ((f["v"] - f["v"].mean()) ** 2).tolist()
        for i, (w, a, b) in enumerate(candidates[k,]):
            h, total = variances[k,], 0.0
            for x in e:
                total -= 0.5 * (math.log(2 * math.pi) + math.log(h) + x / h)
                h = w + a * x + b * h
            assert abs(got[k, i] - total) < 1e-6
    if ranges > 1:
        fitted = garch.fit(rows, ["k"])
        (w, a, b), best = fitted["a",]
        assert abs(a - 0.12) < 0.04 and abs(b - 0.8) < 0.08 and abs(w / (1 - a - b) / variances["a",] - 1) < 0.25
        # No neighbour of the found point is better by more than the last grid's step can tell.
        around = {k: np.array([p * np.array(f) for f in itertools.product((0.98, 1.02), repeat=3)]) for k, (p, _) in fitted.items()}
        assert all(r["likelihood"] <= fitted[r["k"],][1] + 1.0 for r in garch.evaluated(rows, ["k"], around, variances).collect())
        path = garch.variance_path(rows, ["k"], fitted).filter("k = 'a'").orderBy("t").toPandas()["variance"]
        assert np.isclose(path[0], variances["a",]) and len(path) == 3000 and (path > 0).all()
    assert garch.fit(rows.limit(0), ["k"]) == {}


def test_pruned_search_equals_the_unpruned():
    from tidewright.operators.change_points import breaks, segment_costs

    rng = np.random.default_rng(5)
    for case in range(60):
        n, least = int(rng.integers(3, 140)), int(rng.integers(1, 9))
        x = rng.normal(size=n) + np.repeat(rng.normal(size=n) * 3, rng.integers(1, 40, n))[:n]
        sums, squares = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x))
        for cost, penalty in (("level", 4.0), ("level", 25.0), ("spread", 6.0)):
            least = max(least, 2) if cost == "spread" else least
            found = [breaks(sums, squares, penalty, least, cost, pruned) for pruned in (True, False)]
            price = [sum(segment_costs(sums, squares, np.array([a]), b, cost)[0] + penalty for a, b in zip([0, *f], [*f, n])) for f in found]
            assert abs(price[0] - price[1]) < 1e-7 * max(1, abs(price[1])), (case, cost)
            assert all(b - a >= least for a, b in zip([0, *found[0]], [*found[0], n])) or n < 2 * least
            if n <= 40:  # all partitions, by a plain recursion
                best = {0: -penalty}
                for t in range(1, n + 1):
                    best[t] = min((best[s] + segment_costs(sums, squares, np.array([s]), t, cost)[0] + penalty for s in range(t) if t - s >= least and s in best and best[s] < math.inf), default=math.inf)
                if n >= 2 * least:
                    assert abs(best[n] - (price[1] - penalty)) < 1e-7 * max(1, abs(price[1]))


@pytest.mark.parametrize("ranges", [1, 6])
def test_planted_breaks_are_found(spark, ranges):
    from tidewright.operators.change_points import segments

    rng = np.random.default_rng(6)
    level = np.repeat([0.0, 5.0, -1.0], [80, 50, 70])
    f = pd.DataFrame({"k": "a", "t": range(200), "v": level + rng.normal(size=200)})
    short = pd.DataFrame({"k": "b", "t": range(5), "v": 1.0})
    df = spark.createDataFrame(pd.concat([f, short])).union(spark.createDataFrame([("a", 999, None)], "k string, t long, v double"))
    got = segments(df, ["k"], "t", "v", (3.0, 1000.0), ranges=ranges).toPandas().sort_values(["k", "penalty", "segment"])
    assert got[(got["k"] == "a") & (got["penalty"] == 3.0)]["begins"].tolist() == [0, 80, 130]
    assert got[(got["k"] == "a") & (got["penalty"] == 1000.0)]["rows"].tolist() == [200]
    assert got[got["k"] == "b"]["rows"].tolist() == [5, 5]
    one = got[(got["k"] == "a") & (got["penalty"] == 3.0)].iloc[1]
    assert abs(one["mean"] - f["v"][80:130].mean()) < 1e-9 and abs(one["deviation"] - f["v"][80:130].std(ddof=0)) < 1e-9


# ---- seasons -----------------------------------------------------------------


def plain_line(y, w, span, x):
    """One local fit by weighted least squares."""
    n, q = len(y), min(span, len(y))
    near = sorted(range(n), key=lambda i: (abs(i - x), -i))[:q]
    reach = max(abs(i - x) for i in near) + max((span - n) // 2, 0)
    rows, weight = [], []
    for i in near:
        u = abs(i - x) / reach
        k = 1.0 if u <= 0.001 else (1 - u**3) ** 3 if u <= 0.999 else 0.0
        if k * w[i] > 0:
            rows.append((1.0, i - x, y[i])), weight.append(math.sqrt(k * w[i]))
    if not rows:
        return y[min(max(round(x), 0), n - 1)]
    rows, weight = np.array(rows), np.array(weight)
    if len(rows) == 1:
        return rows[0, 2]
    return float(np.linalg.lstsq(rows[:, :2] * weight[:, None], rows[:, 2] * weight, rcond=None)[0][0])


def plain_decomposition(y, period, seasonal, passes, robust):
    n, trend, weights = len(y), np.zeros(len(y)), np.ones(len(y))
    span = int(math.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    span += span % 2 == 0
    low_span = period + 1 if period % 2 == 0 else period + 2
    for turn in range(robust + 1):
        for _ in range(passes):
            cycle = np.zeros(n + 2 * period)
            for phase in range(period):
                own = list(range(phase, n, period))
                for i in range(-1, len(own) + 1):
                    cycle[phase + (i + 1) * period] = plain_line((y - trend)[own], weights[own], seasonal, i)
            low = cycle
            for k in (period, period, 3):
                low = np.convolve(low, np.ones(k) / k, "valid")
            season = cycle[period : period + n] - np.array([plain_line(low, np.ones(n), low_span, i) for i in range(n)])
            trend = np.array([plain_line(y - season, weights, span, i) for i in range(n)])
        if turn < robust:
            gap = np.abs(y - season - trend)
            u = gap / (6 * np.median(gap))
            weights = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u**2) ** 2, 0.0))
    return season, trend, weights


@pytest.mark.parametrize("n, stretch", [(75, 4096), (700, 1)])
def test_seasons_equal_plain_local_regressions_whatever_the_stretches(spark, n, stretch):
    from tidewright.operators.seasonal import decomposed, seasonal_strength

    rng = np.random.default_rng(n)
    t = np.arange(n)
    y = 0.02 * t + 3 * np.sin(2 * np.pi * t / 4) + rng.normal(size=n) * 0.3
    y[[20, n // 2]] += 15  # outliers
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"k": "a", "t": t, "v": y}), pd.DataFrame({"k": "b", "t": range(5), "v": 1.0})]))
    parts = decomposed(df, ["k"], "t", "v", period=4, seasonal=7, robust=2, stretch=stretch)
    got = parts.filter("k = 'a'").orderBy("t").toPandas()
    season, trend, weights = plain_decomposition(y, 4, 7, 2, 2)
    assert np.abs(got["season"] - season).max() < 1e-8 and np.abs(got["trend"] - trend).max() < 1e-8 and np.abs(got["weight"] - weights).max() < 1e-8
    assert np.allclose(got["season"] + got["trend"] + got["rest"], y) and got["weight"][20] == 0
    assert parts.filter("k = 'b' and season is null").count() == 5
    strength = {r["k"]: r["strength"] for r in seasonal_strength(parts.filter("weight > 0"), ["k"]).collect()}
    assert strength["a"] > 0.9


def test_quantiles_over_ranges(spark):
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"k": np.where(np.arange(900) % 3 == 0, "a", "b"), "v": np.round(rng.normal(size=900), 1)})
    df = spark.createDataFrame(f).union(spark.createDataFrame([("c", 2.0), ("a", None)], "k string, v double"))
    got = {r["k"]: r for r in rg.quantiles(df, ["k"], "v", {"m": 0.5, "t": 0.93}, 5).collect()}
    assert got["c"]["m"] == got["c"]["t"] == 2.0
    for k, own in f.groupby("k"):
        assert np.isclose(got[k]["m"], own["v"].quantile(0.5)) and np.isclose(got[k]["t"], own["v"].quantile(0.93))


# ---- order statistics --------------------------------------------------------


def test_growing_quantiles_whatever_the_cuts(spark):
    from tidewright.operators.order_statistics import expanding_quantiles

    rng = np.random.default_rng(2)
    frames = [pd.DataFrame({"k": k, "t": range(n), "v": np.round(rng.normal(size=n).cumsum() * s, 1)}) for k, n, s in (("a", 600, 1.0), ("b", 90, 0.0), ("c", 1, 1.0))]
    f = pd.concat(frames)
    df = spark.createDataFrame(f).withColumn("v", F.when(F.col("t") % 9 != 4, F.col("v"))).withColumn("more", F.lit("x"))
    f.loc[f["t"] % 9 == 4, "v"] = np.nan
    for ranges in (None, 3, 12):
        got = expanding_quantiles(df.repartition(5), ["k"], "t", "v", {"low": 0.05, "middle": 0.5, "top": 1.0}, 20, ranges=ranges).toPandas()
        assert len(got) == len(f)
        for k, own in f.groupby("k"):
            mine, seen = got[got["k"] == k].sort_values("t"), own.sort_values("t")["v"].expanding(20)
            for name, q in (("low", 0.05), ("middle", 0.5), ("top", 1.0)):
                assert np.allclose(mine[name].astype(float), seen.quantile(q), equal_nan=True), (ranges, k, name)
    one = expanding_quantiles(df.filter("k = 'a'").drop("k"), [], "t", "v", {"m": 0.3}, 1, ranges=7).toPandas().sort_values("t")
    assert np.allclose(one["m"].astype(float), f[f["k"] == "a"].sort_values("t")["v"].expanding(1).quantile(0.3))


@pytest.mark.parametrize("most", [100_000, 50])
def test_moving_shares_whatever_the_stretches(spark, most):
    from tidewright.operators.order_statistics import rolling_share

    rng = np.random.default_rng(3)
    f = pd.concat([pd.DataFrame({"k": k, "t": range(n), "v": np.round(rng.normal(size=n), 1)}) for k, n in (("a", 400), ("b", 6))])
    df = spark.createDataFrame(f).withColumn("v", F.when(F.col("t") != 77, F.col("v")))
    f.loc[f["t"] == 77, "v"] = np.nan
    got = rolling_share(df, ["k"], "t", "v", 21, "share", most).toPandas()
    for k, own in f.groupby("k"):
        v = own.sort_values("t")["v"].to_numpy()
        want = [np.nan if i < 20 or np.isnan(v[i - 20 : i + 1]).any() else (v[i - 20 : i + 1] <= v[i]).mean() for i in range(len(v))]
        assert np.allclose(got[got["k"] == k].sort_values("t")["share"].astype(float), want, equal_nan=True)


# ---- folds -------------------------------------------------------------------


def test_local_levels_whatever_the_cuts(spark):
    from tidewright.operators.folds import gains, local_levels

    rng = np.random.default_rng(4)
    f = pd.concat([pd.DataFrame({"k": k, "t": range(n), "v": rng.normal(size=n).cumsum()}) for k, n in (("a", 500), ("b", 3))])
    df = spark.createDataFrame(f)
    for ratio, ranges in ((0.1, None), (0.1, 7), (0.0003, 7)):
        got = local_levels(df, ["k"], "t", "v", ratio, ranges=ranges).toPandas()
        for k, own in f.groupby("k"):
            level, var, want = own["v"].iloc[0], 1.0, []
            for v in own["v"]:
                var += ratio
                gain = var / (var + 1)
                level, var = level + gain * (v - level), var * (1 - gain)
                want.append(level)
            assert np.allclose(got[got["k"] == k].sort_values("t")["level"], want, atol=1e-12)
    assert np.array_equal(gains(0, 900, 0.1)[700:], gains(700, 200, 0.1))


def test_a_walk_holds_one_state(spark):
    from tidewright.operators.folds import walked

    def step(state, row):
        state[0] += 1
        state[1] = state[1] * 0.5 + row[0]

    rows = [("a", i, float(i)) for i in range(50)] + [(None, 1, 2.0), ("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, t int, v double").fillna(0.0, ["v"]).repartition(5)
    got = {r["k"]: (r["n"], r["x"]) for r in walked(df, ["k"], ["t"], ["v"], lambda: [0, 0.0], step, "n long, x double").collect()}
    x = 0.0
    for i in range(50):
        x = x * 0.5 + i
    assert got == {"a": (50, x), None: (1, 2.0), "b": (1, 0.0)}
    assert walked(df.limit(0), ["k"], ["t"], ["v"], lambda: [0, 0.0], step, "n long, x double").count() == 0
