"""Explainable boosting: a sum of one step function per feature, fitted by cyclic gradient boosting.

Features are cut at quantiles, and rows that agree in all bins become one cell
with a count and a sum of labels, which is all the fit reads: its cost depends on
the cells, not on the rows.  A step of boosting takes one feature: gradients and
curvatures are summed per bin in one map-side aggregate, a small tree over those
bins is found on the driver (a row for each bin), and its leaves are added to the
feature's shape.  Several groups, such as the folds of a study, are fitted in the
same jobs, each with its own bins and shapes.

Logistic regression by Newton's method goes the same way: one aggregate of
gradients and curvatures for a step, for all groups at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored


def _literal(values) -> str:
    """SQL for nested lists of numbers."""
    if isinstance(values, (list, tuple, np.ndarray)):
        return "array(" + ", ".join(_literal(v) for v in values) + ")" if len(values) else "cast(array() as array<double>)"
    return f"cast({float(values)!r} as double)"


def _of_group(values: Sequence, group: Column) -> Column:
    """The element of a list with an entry for each group."""
    return F.try_element_at(F.expr(_literal(list(values))), group + 1)


def _numbered(df: DataFrame, group: str | None) -> tuple[DataFrame, list]:
    """Rows with the number of their group, and the groups in order."""
    if group is None:
        return df.withColumn("_g", F.lit(0)), [None]
    groups = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]
    return df.withColumn("_g", _rank(group, groups)), groups


def _rank(group: str | None, groups: list) -> Column:
    """A row's group's number; null for a group that isn't listed."""
    if group is None:
        return F.lit(0)
    known = [F.when(F.col(group).eqNullSafe(F.lit(g)), F.lit(i)) for i, g in enumerate(groups)]
    return F.coalesce(F.lit(None).cast("int"), *known)


@dataclass
class Additive:
    """Edges, shapes and intercepts, for each group a list over the features."""

    features: list[str]
    group: str | None
    groups: list
    edges: list[list[np.ndarray]]
    shapes: list[list[np.ndarray]]
    intercepts: list[float]

    def bin(self, j: int) -> Column:
        """The bin of a feature: the number of edges below its value."""
        edges = _of_group([e[j] for e in self.edges], F.col("_g"))
        return F.size(F.filter(edges, lambda e: e < F.col(self.features[j])))

    def share(self, j: int) -> Column:
        """What a feature adds to the log odds."""
        return F.try_element_at(_of_group([s[j] for s in self.shapes], F.col("_g")), self.bin(j) + 1)

    def transform(self, df: DataFrame, shares: bool = False) -> DataFrame:
        """Adds ``p``, and on request ``<feature>_share``; a missing value gives null."""
        df = df.withColumn("_g", _rank(self.group, self.groups))
        score = _of_group(self.intercepts, F.col("_g"))
        for j, f in enumerate(self.features):
            share = F.when(F.col(f).isNotNull(), self.share(j))
            df = df.withColumn(f"{f}_share", share) if shares else df
            score = score + share
        return df.withColumn("p", 1 / (1 + F.exp(-score))).drop("_g")

    def table(self, spark) -> DataFrame:
        """``group, feature, bin, upper, share``: the shapes; the last bin has no upper end."""
        rows = []
        for g, edges, shapes in zip(self.groups, self.edges, self.shapes):
            for f, e, s in zip(self.features, edges, shapes):
                rows += [(None if g is None else str(g), f, b, float(e[b]) if b < len(e) else None, float(v)) for b, v in enumerate(s)]
        return spark.createDataFrame(rows, "group string, feature string, bin int, upper double, share double")


def leaf_values(gradient: np.ndarray, curvature: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """What a tree of so many leaves over ordered bins adds to each: best splits first, lowest bin on ties."""

    def gain(a: int, b: int) -> float:
        g, h = gradient[a:b].sum(), curvature[a:b].sum()
        return g * g / (h + ridge)

    cuts = [0, len(gradient)]
    for _ in range(leaves - 1):
        best = (1e-12, None)
        for a, b in zip(cuts, cuts[1:]):
            for c in range(a + 1, b):
                more = gain(a, c) + gain(c, b) - gain(a, b)
                if more > best[0] * (1 + 1e-9):
                    best = (more, c)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = gradient[a:b].sum() / (curvature[a:b].sum() + ridge)
    return out


def fit_additive(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    group: str | None = None,
    bins: int = 32,
    rounds: int = 20,
    rate: float = 0.2,
    leaves: int = 3,
    ridge: float = 1.0,
) -> Additive:
    """Boosted shapes of 0/1 labels; rows with a missing feature or label are left out."""
    features = list(features)
    df = df.dropna(subset=[*features, label])
    df, groups = _numbered(df, group)
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = df.groupBy("_g").agg(*[F.percentile_approx(f, cuts, F.lit(10_000)).alias(f"_{j}") for j, f in enumerate(features)]).collect()
    if not found:
        return Additive(features, group, [None], [[np.zeros(0)] * len(features)], [[np.zeros(1)] * len(features)], [0.0])
    edges = [[np.zeros(0)] * len(features) for _ in groups]
    for r in found:
        edges[r["_g"]] = [np.unique(np.array(r[f"_{j}"], float)) for j in range(len(features))]
    shapes = [[np.zeros(len(e) + 1) for e in of] for of in edges]
    model = Additive(features, group, groups, edges, shapes, [0.0] * len(groups))
    names = [f"_b{j}" for j in range(len(features))]
    cells = df.select("_g", F.col(label).cast("double").alias("_y"), *[model.bin(j).alias(b) for j, b in enumerate(names)])
    cells = stored(cells.groupBy("_g", *names).agg(F.count("*").alias("_n"), F.sum("_y").alias("_s")), "cells")
    for r in cells.groupBy("_g").agg(F.sum("_n").alias("n"), F.sum("_s").alias("s")).collect():
        rate_up = min(max(r["s"], 0.5), r["n"] - 0.5) / r["n"] if r["n"] > 1 else 0.5
        model.intercepts[r["_g"]] = math.log(rate_up / (1 - rate_up))
    counts = [[np.zeros(len(e) + 1) for e in of] for of in edges]
    for step in range(rounds * len(features)):
        j = step % len(features)
        score = _of_group(model.intercepts, F.col("_g"))
        for k, b in enumerate(names):
            score = score + F.try_element_at(_of_group([s[k] for s in shapes], F.col("_g")), F.col(b) + 1)
        scored = cells.withColumn("_p", 1 / (1 + F.exp(-score)))
        sums = [F.sum(F.col("_s") - F.col("_n") * F.col("_p")).alias("g"), F.sum(F.col("_n") * F.col("_p") * (1 - F.col("_p"))).alias("h"), F.sum("_n").alias("n")]
        gradient, curvature = ([np.zeros(len(of[j]) + 1) for of in edges] for _ in range(2))
        for r in scored.groupBy("_g", F.col(names[j]).alias("b")).agg(*sums).collect():
            gradient[r["_g"]][r["b"]], curvature[r["_g"]][r["b"]], counts[r["_g"]][j][r["b"]] = r["g"], r["h"], r["n"]
        for i in range(len(groups)):
            shapes[i][j] = shapes[i][j] + rate * leaf_values(gradient[i], curvature[i], leaves, ridge)
    for i in range(len(groups)):  # each shape's mean over the rows moves to the intercept
        for j in range(len(features)):
            n = counts[i][j].sum()
            mean = float((shapes[i][j] * counts[i][j]).sum() / n) if n else 0.0
            shapes[i][j] = shapes[i][j] - mean
            model.intercepts[i] += mean
    return model


@dataclass
class Linear:
    """Weights on standardised features, for each group; the first is the intercept."""

    features: list[str]
    group: str | None
    groups: list
    centres: list[list[float]]
    scales: list[list[float]]
    weights: list[list[float]]

    def scaled(self, j: int) -> Column:
        g = F.col("_g")
        return (F.col(self.features[j]) - _of_group([c[j] for c in self.centres], g)) / _of_group([s[j] for s in self.scales], g)

    def score(self) -> Column:
        total = _of_group([w[0] for w in self.weights], F.col("_g"))
        for j in range(len(self.features)):
            total = total + _of_group([w[j + 1] for w in self.weights], F.col("_g")) * self.scaled(j)
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``p``."""
        return df.withColumn("_g", _rank(self.group, self.groups)).withColumn("p", 1 / (1 + F.exp(-self.score()))).drop("_g")


def fit_linear(df: DataFrame, features: Sequence[str], label: str, group: str | None = None, penalty: float = 1.0, steps: int = 30) -> Linear:
    """L2-penalised logistic regression (penalty on the summed loss) on features standardised over the given rows."""
    features, k = list(features), len(features) + 1
    df, groups = _numbered(df.dropna(subset=[*features, label]), group)
    df = stored(df.select("_g", F.col(label).cast("double").alias("_y"), *features), "labelled")
    model = Linear(features, group, groups, [[0.0] * (k - 1) for _ in groups], [[1.0] * (k - 1) for _ in groups], [[0.0] * k for _ in groups])
    moments = [c for j, f in enumerate(features) for c in (F.avg(f).alias(f"m{j}"), F.stddev_pop(f).alias(f"s{j}"))]
    for r in df.groupBy("_g").agg(*moments).collect():
        model.centres[r["_g"]] = [r[f"m{j}"] for j in range(k - 1)]
        model.scales[r["_g"]] = [r[f"s{j}"] or 1.0 for j in range(k - 1)]
    ridge = np.diag([0.0] + [1 / penalty] * (k - 1))
    for _ in range(steps):
        rows = df.withColumn("_p", 1 / (1 + F.exp(-model.score())))
        x = [F.lit(1.0), *[model.scaled(j) for j in range(k - 1)]]
        sums = [F.sum((F.col("_y") - F.col("_p")) * x[i]).alias(f"g{i}") for i in range(k)]
        sums += [F.sum(F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        moved = 0.0
        for r in rows.groupBy("_g").agg(*sums).collect():
            w = np.array(model.weights[r["_g"]])
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge
            step = np.linalg.solve(h + np.eye(k) * 1e-12, np.array([r[f"g{i}"] for i in range(k)]) - ridge @ w)
            model.weights[r["_g"]] = (w + step).tolist()
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-10:
            break
    return model


def interval_side(low: Column, high: Column) -> Column:
    """Where an interval lies against 0."""
    return F.when(low > 0, "positive").when(high < 0, "negative").otherwise("zero")


def promotion(short: Column, long: Column, short_diff: Column, long_diff: Column, brier_ok: Column) -> Column:
    """Three outcomes of a duel from the sides of both intervals, both differences and whether squared errors are no worse."""
    better = (short == "positive") & (long == "positive") & brier_ok
    worse = (short == "negative") & (long == "negative")
    nothing = (short == "zero") & (long == "zero") & (short_diff <= 0) & (long_diff <= 0)
    return F.when(better, "promote").when(worse | nothing, "not_promote").otherwise("borderline_stop")
