"""Statistical models: distribution tails, spectra, event impact, filters and MLlib fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def student_t_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t, by the incomplete beta function."""
    return incomplete_beta(dof / (dof + t * t), dof / 2, 0.5)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14 and i:
            break
    return front * (f - 1)


def fit_pareto(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution by profile likelihood on a refined grid."""
    top, best = float(excess.max()), None
    low, high = -0.9 / top, 20 / float(excess.mean())
    for _ in range(6):
        grid = np.linspace(low, high, 201)
        grid = grid[np.abs(grid) > 1e-9]
        grid = grid[1 + grid * top > 0]
        shape = np.log1p(grid[:, None] * excess).mean(1)
        good = shape / grid > 0
        like = np.where(good, -np.log(np.where(good, shape / grid, 1)) - shape - 1, -np.inf)
        i = int(np.argmax(like))
        best = (float(shape[i]), float(shape[i] / grid[i]))
        span = (high - low) / 40
        low, high = max(grid[i] - span, -0.999 / top), grid[i] + span
    return best


PERIODS = (5, 10, 20)  # years


def tail_risk(losses: np.ndarray, cut: float = 0.95, level: float = 0.99, per_year: int = 252, least: int = 1000, least_excess: int = 50) -> dict:
    """Peaks over a threshold: shape, scale, value at risk, expected shortfall, losses by return period.

    ``shape_low`` and ``shape_high`` show how the shape moves as the threshold
    does.  Too few losses, or too few beyond the threshold, give no fit.
    """
    losses = losses[np.isfinite(losses)]
    names = ["threshold", "shape", "scale", "var", "es", "shape_low", "shape_high", *(f"loss_{y}y" for y in PERIODS)]
    out = dict.fromkeys(names) | {"n": len(losses)}
    if len(losses) < least:
        return out

    def fitted(at: float) -> tuple[float, np.ndarray, float, float] | None:
        u = float(np.quantile(losses, at))
        excess = losses[losses > u] - u
        return (u, excess, *fit_pareto(excess)) if len(excess) >= least_excess else None

    if (main := fitted(cut)) is None:
        return out
    u, excess, shape, scale = main
    share = len(excess) / len(losses)

    def beyond(p: float) -> float:
        """The loss exceeded with probability p."""
        ratio = p / share
        return u + (scale / shape * (ratio**-shape - 1) if abs(shape) > 1e-6 else -scale * math.log(ratio))

    var = beyond(1 - level)
    others = [f[2] for f in map(fitted, (0.90, 0.925, 0.95, 0.97)) if f is not None]
    out |= {"threshold": u, "shape": shape, "scale": scale, "var": var, "es": (var + scale - shape * u) / (1 - shape) if shape < 1 else None}
    out |= {"shape_low": min(others), "shape_high": max(others)}
    return out | {f"loss_{y}y": beyond(1 / (y * per_year)) for y in PERIODS}


def spectral_test(x: np.ndarray, draws: int, seed: int) -> dict:
    """Largest normalised periodogram ordinate against surrogates of the fitted AR(1)."""
    x = x - x.mean()
    phi = float((x[1:] * x[:-1]).sum() / (x * x).sum())
    noise = float(np.sqrt(max(1e-12, x.var() * (1 - phi * phi))))
    freq = np.fft.rfftfreq(len(x))[1:]
    red = 1 / (1 - 2 * phi * np.cos(2 * np.pi * freq) + phi * phi)

    def peak(rows: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.rfft(rows, axis=-1)[..., 1:]) ** 2 / red
        return power.max(-1) / power.mean(-1)

    rng = np.random.default_rng(seed)
    e = rng.normal(0, noise, (draws, len(x)))
    rows = np.empty_like(e)
    rows[:, 0] = e[:, 0]
    for t in range(1, len(x)):
        rows[:, t] = phi * rows[:, t - 1] + e[:, t]
    seen = float(peak(x[None])[0])
    power = np.abs(np.fft.rfft(x)[1:]) ** 2 / red
    return {"phi": phi, "peak": seen, "period": float(1 / freq[int(np.argmax(power))]), "p": (int((peak(rows) >= seen).sum()) + 1) / (draws + 1), "n": len(x)}


def event_impact(treated: np.ndarray, controls: np.ndarray, at: int, post: int, draws: int, seed: int) -> dict:
    """Cumulated gap to a regression on controls fitted before the event.

    Under the null the gap is a block of the residuals before the event plus
    what the uncertain coefficients add over the rows after it.
    """
    design = np.column_stack([np.ones(len(controls)), controls])
    before, after = design[:at], design[at : at + post]
    coef, *_ = np.linalg.lstsq(before, treated[:at], rcond=None)
    gap = treated - design @ coef
    pre = gap[:at]
    spread = float(((treated[:at] - treated[:at].mean()) ** 2).sum())
    r2 = 1 - float((pre**2).sum()) / spread if spread > 0 else 0.0
    effect = float(gap[at : at + post].sum())
    rng = np.random.default_rng(seed)
    variance = float((pre**2).sum()) / max(at - design.shape[1], 1)
    cov = variance * np.linalg.pinv(before.T @ before)
    drift = after.sum(0) @ rng.multivariate_normal(np.zeros(len(coef)), cov, draws, method="eigh").T
    starts = rng.integers(0, max(at - post, 0) + 1, draws)
    sums = np.concatenate([[0.0], np.cumsum(pre)])
    null = sums[starts + min(post, at)] - sums[starts] + drift
    return {"effect": effect, "p": (int((np.abs(null) >= abs(effect)).sum()) + 1) / (draws + 1), "r2": r2, "n_pre": at}


def canonical(x: np.ndarray, y: np.ndarray) -> dict:
    """First two canonical correlations, and the share of y's variance that x explains."""
    if len(x) <= x.shape[1] + y.shape[1]:
        return {"first": None, "second": None, "explained": None, "n": len(x)}
    x, y = x - x.mean(0), y - y.mean(0)
    qx, qy = np.linalg.qr(x)[0], np.linalg.qr(y)[0]
    found = np.clip(np.linalg.svd(qx.T @ qy, compute_uv=False), 0, 1)
    fitted = qx @ (qx.T @ y)
    return {"first": float(found[0]), "second": float(found[1]), "explained": float((fitted**2).sum() / (y**2).sum()), "n": len(x)}


def quantile_line(x: np.ndarray, y: np.ndarray, q: float, rounds: int = 300) -> tuple[float, float]:
    """Intercept and slope of the line that a share q of the points lies below, by reweighted least squares."""
    design = np.column_stack([np.ones(len(x)), x])
    coef = np.array([np.quantile(y, q), 0.0])
    floor = 1e-6 * max(float(y.std()), 1e-12)
    for _ in range(rounds):
        gap = y - design @ coef
        weight = np.where(gap >= 0, q, 1 - q) / np.maximum(np.abs(gap), floor)
        scaled = design * weight[:, None]
        new = np.linalg.solve(scaled.T @ design, scaled.T @ y)
        if np.allclose(new, coef, rtol=1e-10, atol=1e-12):
            break
        coef = new
    return float(coef[0]), float(coef[1])


# ---- MLlib ------------------------------------------------------------------


def _assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")


def logistic(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, penalty: float = 1.0) -> DataFrame:
    """L2-penalised logistic regression with the penalty on the summed loss; adds ``p`` to the test rows."""
    n = max(train.count(), 1)
    model = LogisticRegression(labelCol=label, regParam=1 / (penalty * n), elasticNetParam=0.0, standardization=False)
    fitted = Pipeline(stages=[_assembled(features), model]).fit(train)
    return fitted.transform(test).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def trees(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, kind: str = "forest", seed: int = 7) -> DataFrame:
    """Random forest or boosted trees; adds ``p`` to the test rows."""
    if kind == "forest":
        model = RandomForestClassifier(labelCol=label, numTrees=30, maxDepth=4, seed=seed)
    else:
        model = GBTClassifier(labelCol=label, maxIter=15, maxDepth=3, seed=seed)
    fitted = Pipeline(stages=[_assembled(features), model]).fit(train)
    return fitted.transform(test).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def principal_components(df: DataFrame, columns: Sequence[str], k: int, anchor: str) -> DataFrame:
    """Explained share and loadings of standardised columns; signs make the anchor's loading positive."""
    steps = [_assembled(columns), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="pcs")]
    model = Pipeline(stages=steps).fit(df).stages[-1]
    loadings, at = model.pc.toArray(), list(columns).index(anchor)
    rows = []
    for j in range(k):
        sign = 1.0 if loadings[at, j] >= 0 else -1.0
        rows += [(j + 1, float(model.explainedVariance[j]), c, float(sign * loadings[i, j])) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["component", "explained", "name", "loading"]))


def isotonic(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds ``calibrated``: the non-decreasing least-squares fit of y on x."""
    fitted = IsotonicRegression(featuresCol=x, labelCol=y, predictionCol="calibrated").fit(df)
    return fitted.transform(df)
