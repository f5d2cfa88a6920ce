"""The resampling queries draw as often as the studies they rebuild."""

import os

import pytest
from pyspark.sql import functions as F

from tidewright.operators import resampling as b
from tidewright.plans import registry, study_queries, workers

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(spark, name):
    workers.find_package(spark)
    found = registry.queries()[name](spark, DATA).collect()
    assert found
    return found


def test_block_bootstrap(spark):
    assert {r["n_used"] + r["n_dropped"] for r in rows(spark, "udf01_block_bootstrap")} == {2000}


@pytest.mark.parametrize("name", ["udf02_permutation", "udf18_spectral"])
def test_p_is_a_share_of_1001(spark, name):
    assert all(abs(r["p"] * 1001 - round(r["p"] * 1001)) < 1e-6 for r in rows(spark, name))


def test_cluster_bootstrap(spark):
    got = {r["asset"]: (r["low"], r["high"]) for r in rows(spark, "udf04_cluster_bootstrap")}
    frame = study_queries._with_forward(spark, DATA).withColumn("cluster", F.date_format("date", "yyyyMM")).toPandas()
    for asset, part in frame.groupby("asset"):
        part = part.sort_values("date")
        want = b.cluster_bootstrap(part["f"].to_numpy(), part["cluster"].to_numpy(), 2000, b.seed_of(asset))
        assert got[asset] == pytest.approx((want["low"], want["high"]))


def test_overfit_probability(spark):
    assert [r["splits"] for r in rows(spark, "udf17_overfit_probability")] == [252]
