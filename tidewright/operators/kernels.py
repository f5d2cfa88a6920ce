"""A support-vector classifier with a radial kernel by random Fourier features.

The kernel ``exp(-gamma |x - y|^2)`` is the mean of cosines along random lines, so
a fixed number of seeded cosines of each row stands for it: the error of a kernel
value falls with the square root of their number, whatever the number of rows.
A linear hinge fit over them is distributed as MLlib does it; no matrix of pairs
of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fourier_lines(dim: int, count: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases of the cosines."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2 * gamma), (dim, count)), rng.uniform(0, 2 * np.pi, count)


def fourier_map(x: np.ndarray, lines: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows whose inner products are near the kernel's values."""
    directions, phases = lines
    return np.sqrt(2 / len(phases)) * np.cos(x @ directions + phases)


def _mapped(frames: Iterator[pd.DataFrame], features: list[str], centre: np.ndarray, scale: np.ndarray, lines: tuple) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), 4096):
            part = frame.iloc[at : at + 4096].reset_index(drop=True)
            z = fourier_map((part[features].to_numpy(float) - centre) / scale, lines)
            yield part.assign(_z=list(z))


def radial_classifier(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str,
    cost: float = 1.0,
    gamma: float | None = None,
    count: int = 256,
    seed: int = 7,
    steps: int = 50,
) -> DataFrame:
    """Adds ``decision`` to the test rows: positive for class 1.

    Features are standardised over the training rows; ``gamma`` is one over their
    number unless given.  ``cost`` weighs the summed hinge loss against half the
    squared norm.  Rows with a missing feature or label are left out of the fit, test
    rows with a missing feature get no decision.
    """
    features = list(features)
    train = train.dropna(subset=[*features, label])
    moments = train.agg(F.count("*").alias("n"), *[c for i, f in enumerate(features) for c in (F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}"))]).first()
    if not moments["n"]:
        return test.withColumn("decision", F.lit(None).cast("double"))
    centre, scale = (np.array([moments[f"{k}{i}"] for i in range(len(features))]) for k in "ms")
    scale = np.where(scale > 0, scale, 1.0)
    lines = fourier_lines(len(features), count, gamma or 1 / len(features), seed)
    run = partial(_mapped, features=features, centre=centre, scale=scale, lines=lines)

    def mapped(df: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(run, f"{schema}, _z array<double>").withColumn("_z", array_to_vector("_z"))

    model = LinearSVC(featuresCol="_z", labelCol="_y", maxIter=steps, regParam=1 / (cost * moments["n"]), standardization=False)
    fitted = model.fit(mapped(train.select(*features, F.col(label).cast("double").alias("_y"))).select("_z", "_y"))
    weights, intercept = fitted.coefficients.toArray(), float(fitted.intercept)

    def decided(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 4096):
                part = frame.iloc[at : at + 4096].reset_index(drop=True)
                z = fourier_map((part[features].to_numpy(float) - centre) / scale, lines)
                yield part.assign(decision=z @ weights + intercept)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in test.schema)
    there = reduce(and_, [F.col(f).isNotNull() for f in features])
    return test.mapInPandas(decided, f"{schema}, decision double").withColumn("decision", F.when(there, F.col("decision")))
