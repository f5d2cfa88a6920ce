"""Queries that SQL can't express, against numpy and pandas on the same rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import ledger, models
from tidewright.operators import resampling as b
from tidewright.operators.episodes import merged_segments
from tidewright.plans import discovery_queries as d
from tidewright.plans import event_queries as ev
from tidewright.plans import registry, study_queries, workers
from tidewright.sources import readers

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def run(spark):
    workers.find_package(spark)
    held = {}

    def rows(name):
        if name not in held:
            held[name] = registry.queries()[name](spark, DATA).toPandas()
            assert len(held[name])
        return held[name]

    return rows


def q_values(p):
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


def between(v, g):
    return sum((g == k).sum() * (v[g == k].mean() - v.mean()) ** 2 for k in np.unique(g))


def own_p(v, g, statistic, draws=400):
    rng = np.random.default_rng(99)
    seen = statistic(v, g)
    return (sum(statistic(v, rng.permutation(g)) >= seen for _ in range(draws)) + 1) / (draws + 1)


def bootstrap_p(sel, y, block, draws=1500):
    rng, n, out = np.random.default_rng(98), len(y), []
    for _ in range(draws):
        at = np.concatenate([(s + np.arange(block)) % n for s in rng.integers(0, n, -(-n // block))])[:n]
        if sel[at].any():
            out.append(y[at][sel[at]].mean() - y[at].mean())
    out = np.array(out)
    return min(1.0, 2 * min((out <= 0).mean(), (out >= 0).mean()))


def test_placebo(spark, run):
    got = run("q11_placebo").set_index("effect")
    rows = d._effects(spark, DATA).toPandas()
    for effect in ("santa", "quarter_end", "month_12"):
        x = rows[rows["effect"] == effect]
        v, g = x["r"].to_numpy(), x["lab"].to_numpy()
        statistic = (lambda v, g: v[g == 1].mean() - v[g == 0].mean()) if effect in d.DIRECTED else between
        assert got.loc[effect, "observed"] == pytest.approx(statistic(v, g))
        assert got.loc[effect, "p"] == pytest.approx(own_p(v, g, statistic), abs=0.08)
    assert got["q_bh"].to_numpy() == pytest.approx(q_values(got["p"].to_numpy()))


def test_discovery(spark, run):
    got = run("q12_discovery")
    assert len(got) == d.DECLARED
    rows = d._candidates(spark, DATA).toPandas()
    for (family, key), x in rows.groupby(["family", "key"]):
        one = got[(got["family"] == family) & (got["key"] == key)].iloc[0]
        x = x.sort_values("date")
        sel, y = x["sel"].to_numpy(bool), x["y"].to_numpy()
        if sel.any():
            assert one["diff"] == pytest.approx(y[sel].mean() - y.mean())
        if (family, key) in (("rebound", "p10_h5"), ("streak_down", "n3_h1")):
            assert one["p"] == pytest.approx(bootstrap_p(sel, y, int(x["h"].iloc[0])), abs=0.1)
    known = got[got["p"].notna()]
    assert known["q_pool"].to_numpy() == pytest.approx(q_values(known["p"].to_numpy()))
    for _, x in known.groupby("family"):
        assert x["q_family"].to_numpy() == pytest.approx(q_values(x["p"].to_numpy()))


def test_gate(run):
    for _, r in run("q13_gate").iterrows():
        if r["p"] != r["p"] or r["p"] is None:
            want = "pending"
        elif r["oos_sign"] != r["full_sign"] or r["p"] > 0.20:
            want = "overturned"
        else:
            want = "confirmed" if r["p"] < 0.10 else "neutral"
        assert r["state"] == want


def test_event_impact(spark, run):
    got = run("udf19_event_impact")
    r = study_queries._returns(spark, DATA).toPandas()
    r["r"] = np.log1p(r["r"].astype(float))
    days = sorted(r.loc[r["r"].notna(), "date"].unique())
    wide = r.pivot(index="date", columns="asset", values="r").reindex(days).fillna(0.0)
    for _, one in got.iloc[::17].iterrows():
        at = next(i for i, x in enumerate(days) if str(x) >= one["event"])
        near = wide.iloc[at - 120 : at + 20]
        y, x = near[one["treated"]].to_numpy(), near.drop(columns=one["treated"]).to_numpy()
        x = np.column_stack([np.ones(len(x)), x])
        coef = np.linalg.lstsq(x[:120], y[:120], rcond=None)[0]
        assert one["effect"] == pytest.approx((y - x @ coef)[120:].sum()) and 0 < one["p"] <= 1
    by = run("q25_counterfactual").set_index("treated")
    assert by["events"].to_dict() == got.groupby("treated").size().to_dict()
    assert by["usable"].to_dict() == (got["r2"] >= 0.3).groupby(got["treated"]).sum().to_dict()


def test_event_impact_finds_a_planted_shift():
    rng = np.random.default_rng(1)
    controls = rng.normal(0, 0.01, (140, 3))
    quiet = controls @ [0.5, 0.3, 0.2] + rng.normal(0, 0.001, 140)
    moved = quiet.copy()
    moved[120:] += 0.01
    assert models.event_impact(moved, controls, 120, 20, 2000, 5)["p"] < 0.01
    assert models.event_impact(quiet, controls, 120, 20, 2000, 5)["p"] > 0.05


def test_event_bootstrap(spark, run):
    x = ev._after(spark, DATA).toPandas()
    x["year"] = [e.year for e in x["event"]]
    for _, r in run("udf05_event_bootstrap").iterrows():
        v = x.loc[x["year"] == r["year"], "car"].to_numpy()
        error = 1.96 * v.std() / len(v) ** 0.5
        assert r["mean"] == pytest.approx(v.mean()) and r["up"] == pytest.approx((v > 0).mean())
        assert r["mean_high"] - r["mean_low"] == pytest.approx(2 * error, rel=0.25)


def test_cluster_and_block_bootstraps(spark, run):
    f = study_queries._with_forward(spark, DATA).toPandas().sort_values(["asset", "date"])
    for _, r in run("udf01_block_bootstrap").iterrows():
        x = f[f["asset"] == r["asset"]]
        sel, y = (x["r"] <= x["r"].quantile(0.1)).to_numpy(), x["f"].to_numpy()
        assert r["diff"] == pytest.approx(y[sel].mean() - y.mean())
        assert r["p"] == pytest.approx(bootstrap_p(sel, y, 20), abs=0.1)
    for _, r in run("udf02_permutation").iterrows():
        x = f[f["asset"] == r["asset"]]
        v, g = x["r"].to_numpy(), np.array([t.weekday() for t in x["date"]])
        assert r["observed"] == pytest.approx(between(v, g)) and r["p"] == pytest.approx(own_p(v, g, between), abs=0.08)
    for _, r in run("q28_dip_intervals").iterrows():
        assert r["low"] <= r["mean"] <= r["high"]


def test_auc_difference(spark, run):
    x = ev._states(spark, DATA).toPandas()

    def area(score, y):
        pos, neg = score[y == 1], score[y == 0]
        return ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)

    for _, r in run("udf07_auc_difference").iterrows():
        one = x[x["asset"] == r["asset"]]
        y = one["y"].to_numpy()
        if r["n"] >= 60:
            assert r["diff"] == pytest.approx(area(one["v"].to_numpy(), y) - area(one["v60"].to_numpy(), y))
            assert r["low"] <= r["diff"] <= r["high"]


def test_robustness(spark, run):
    r = study_queries._returns(spark, DATA).filter("r is not null").toPandas().sort_values(["asset", "date"])
    for _, one in run("udf23_robustness").iterrows():
        x = r[r["asset"] == one["asset"]]
        v, g = x["r"].to_numpy(), np.array([t.weekday() for t in x["date"]])
        assert one["p"] == pytest.approx(own_p(v, g, between), abs=0.08) and one["n"] == len(x)


def test_tail_risk():
    rng = np.random.default_rng(3)
    losses = 2 + ((1 - rng.random(40_000)) ** -0.25 - 1) / 0.25  # shape 0.25, scale 1
    got = models.tail_risk(losses)
    assert got["shape"] == pytest.approx(0.25, abs=0.08)
    assert got["var"] == pytest.approx(np.quantile(losses, 0.99), rel=0.03)
    assert got["es"] == pytest.approx(losses[losses > np.quantile(losses, 0.99)].mean(), rel=0.08)
    assert got["var"] < got["loss_5y"] < got["loss_10y"] < got["loss_20y"] and got["shape_low"] <= got["shape"] <= got["shape_high"]
    assert models.tail_risk(losses[:999])["shape"] is None


def test_spectral(run):
    rng = np.random.default_rng(4)
    cycle = np.sin(2 * np.pi * np.arange(240) / 12) + rng.normal(0, 0.5, 240)
    got = models.spectral_test(cycle, 500, 1)
    assert got["period"] == pytest.approx(12) and got["p"] < 0.01
    assert models.spectral_test(rng.normal(0, 1, 240), 500, 1)["p"] > 0.02
    for name in ("udf18_spectral", "q23_cycles"):
        assert run(name)["p"].between(1 / 1001, 1).all()


def test_models(spark, run):
    train, test = study_queries._split(study_queries._flags(spark, DATA))
    names = ["r", "momentum", "z"]
    x, new = train.toPandas(), test.toPandas().sort_values(["asset", "date"])
    design, y, w = np.column_stack([x[names].to_numpy(float), np.ones(len(x))]), x["y"].to_numpy(), np.zeros(4)
    penalty = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):  # Newton steps on the summed loss
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (p - y) + penalty @ w)
    want = 1 / (1 + np.exp(-np.column_stack([new[names].to_numpy(float), np.ones(len(new))]) @ w))
    got = models.logistic(train, test, names, "y").toPandas().sort_values(["asset", "date"])
    assert got["p"].to_numpy() == pytest.approx(want, abs=2e-3)
    for name in ("udf28_logistic", "udf29_boosted_trees", "udf30_forest"):
        assert run(name)["auc"].dropna().between(0, 1).all() and run(name)["n"].sum() == len(new)
    made = spark.range(400).select(((F.col("id") * 7) % 100 / 100).alias("x"), ((F.col("id") * 7) % 100 > 50).cast("double").alias("y"))
    for kind in ("forest", "boosted"):
        p = models.trees(made, made, ["x"], "y", kind).toPandas()
        assert ((p["p"] > 0.5) == (p["y"] == 1)).mean() > 0.97


def test_components(spark, run):
    wide = study_queries._returns(spark, DATA).toPandas().pivot(index="date", columns="asset", values="r").fillna(0.0)
    z = ((wide - wide.mean()) / wide.std()).to_numpy()
    values, vectors = np.linalg.eigh(np.cov(z.T))
    got = run("udf31_principal_components")
    for k in (1, 2, 3):
        one = got[got["component"] == k]
        v = vectors[:, -k] * np.sign(vectors[0, -k])
        assert one["explained"].iloc[0] == pytest.approx(values[-k] / values.sum(), abs=1e-6)
        assert one.set_index("name")["loading"].reindex(wide.columns).to_numpy() == pytest.approx(v, abs=1e-6)


def test_canonical_and_quantiles(run):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 3))
    y = x[:, :2] @ [[1.0, 0.2], [0.0, 1.0]] + rng.normal(size=(500, 2))
    a, c = x - x.mean(0), y - y.mean(0)
    sxx, syy, sxy = a.T @ a, c.T @ c, a.T @ c
    want = np.sqrt(np.sort(np.linalg.eigvals(np.linalg.solve(sxx, sxy) @ np.linalg.solve(syy, sxy.T)).real)[::-1][:2])
    got = models.canonical(x, y)
    assert (got["first"], got["second"]) == pytest.approx(tuple(want))
    u, v = x[:, 0], 2 * x[:, 0] + rng.normal(size=500)
    for q in (0.1, 0.5, 0.9):
        line = models.quantile_line(u, v, q)
        loss = lambda a, s: np.maximum(q * (v - a - s * u), (q - 1) * (v - a - s * u)).sum()
        assert (v <= line[0] + line[1] * u + 1e-6).mean() == pytest.approx(q, abs=0.02)
        assert all(loss(*line) <= loss(line[0] + i, line[1] + j) + 1e-3 for i in (-0.05, 0, 0.05) for j in (-0.05, 0, 0.05))
    assert len(run("udf32_canonical_correlation")) == len(run("udf33_quantile_regression")) == 5


def test_shuffled_mentions(run):
    got = run("udf37_placebo").iloc[0]
    seen = run("q53_sentiment_decision").iloc[0]
    assert got["ic"] == pytest.approx(seen["mean"], abs=1e-6) and got["draws"] == 500 and 0 < got["p"] <= 1


def test_table_rows(spark, run):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").toPandas().set_index("page_id")["html"]
    got = run("src23_table_rows").set_index("page_id")
    for i, html in pages.items():
        cells = html.lower().count("<td") + html.lower().count("<th>") + html.lower().count("<th ")
        if html.lower().count("</td>") + html.lower().count("</th>") == cells and "<script" not in html.lower() and "<!--" not in html:
            assert got.loc[i, "n_cells"] == cells


def test_hash_chain(spark):
    import hashlib
    import json

    rows = [("a", i, f"v{i}", None if i == 3 else i / 2) for i in range(1, 8)] + [("b", 1, "x", 0.5)]
    df = spark.createDataFrame(rows, "ledger string, nr int, text string, x double").repartition(3)
    sealed = ledger.seal(df, "ledger", "nr", ["text", "x"])
    prev = {}
    for r in sorted(sealed.collect(), key=lambda r: (r["ledger"], r["nr"])):
        text = json.dumps({"text": r["text"], "x": None if r["x"] is None else str(r["x"])}, separators=(",", ":"))
        assert r["prev_hash"] == prev.get(r["ledger"], "")
        prev[r["ledger"]] = hashlib.sha256((r["prev_hash"] + text).encode()).hexdigest()
        assert r["row_hash"] == prev[r["ledger"]]
    edited = sealed.withColumn("text", F.when((F.col("ledger") == "a") & (F.col("nr") == 4), "changed").otherwise(F.col("text")))
    assert sorted(r["nr"] for r in ledger.broken_links(edited, "ledger", "nr", ["text", "x"]).collect()) == [4, 5, 6, 7]


def test_conflicts_segments_and_sources(spark, tmp_path):
    old = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    with pytest.raises(Exception, match="sources disagree"):
        ledger.upsert_checked(old, spark.createDataFrame([(1, 2.2)], "k int, v double"), ["k"], "v", 0.05).collect()
    segments = spark.createDataFrame([("a", 1, 3), ("a", 5, 6), ("a", 20, 22)], "asset string, f int, l int")
    assert [r["cluster"] for r in merged_segments(segments, "f", "l", 5).orderBy("f").collect()] == [1, 1, 2]
    spark.dataSource.register(readers.SeriesSource)
    (tmp_path / "A.csv").write_text("date,value\n2020-01-01,1.5\n2020-01-02,.\n")
    source = spark.read.format("daily_series").option("folder", str(tmp_path)).option("symbols", "A,B").option("tries", "1")
    with pytest.raises(Exception, match="no series of B"):
        source.load().collect()
    assert [tuple(r) for r in source.option("missing", "skip").load().collect()] == [("A", "2020-01-01", 1.5)]


def test_seeds_differ_by_group():
    assert len({b.seed_of("a"), b.seed_of("b"), b.seed_of("a", seed=1)}) == 3
