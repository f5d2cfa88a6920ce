"""What each feature adds to a fitted tree ensemble's output, row by row.

Attributions are path-dependent Shapley values: features outside a coalition
follow both branches by the share of training rows on each.  A leaf's
contribution depends, for each feature on its path, only on whether the row meets
all of that feature's conditions there, and on the shares that the training rows
have on it.  So a leaf is a handful of intervals and shares, the whole ensemble
is a table of leaves, bounded by the model, that goes to every task, and rows are
done as arrays, leaf by leaf: no row ever walks a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Leaf:
    """Value, and for each feature on the path its open lower and closed upper bound and its share of training rows."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]


def leaves_of(tree: dict, scale: float = 1.0) -> list[Leaf]:
    """Leaves of nested dicts: ``value``, or ``feature, threshold, left, right``; each with ``rows``."""
    out = []
    stack = [(tree, {})]
    while stack:
        node, path = stack.pop()
        if "value" in node:
            at = sorted(path)
            out.append(Leaf(scale * node["value"], at, *[[path[f][i] for f in at] for i in range(3)]))
            continue
        f, t = node["feature"], node["threshold"]
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for side, bounds in (("left", (low, min(high, t))), ("right", (max(low, t), high))):
            part = node[side]["rows"] / node["rows"] if node["rows"] else 0.0
            stack.append((node[side], path | {f: (*bounds, share * part)}))
    return out


def fitted_leaves(model) -> list[Leaf]:
    """Leaves of a fitted MLlib classifier: boosted trees (what they add to the margin) or a forest (to the probability of 1)."""
    forest = type(model).__name__.startswith("RandomForest")

    def walked(node) -> dict:
        rows = float(node.impurityStats().count())
        if node.subtreeDepth() == 0:
            if not forest:
                return {"value": float(node.prediction()), "rows": rows}
            stats = list(node.impurityStats().stats())
            return {"value": stats[1] / sum(stats) if sum(stats) else 0.0, "rows": rows}
        split = node.split()
        inner = {"feature": int(split.featureIndex()), "threshold": float(split.threshold()), "rows": rows}
        return inner | {"left": walked(node.leftChild()), "right": walked(node.rightChild())}

    weights = [1 / len(model.trees)] * len(model.trees) if forest else model.treeWeights
    return [leaf for tree, w in zip(model.trees, weights) for leaf in leaves_of(walked(tree._java_obj.rootNode()), w)]


def base_value(leaves: Sequence[Leaf]) -> float:
    """The output's mean over the training rows, as the trees hold it."""
    return sum(leaf.value * math.prod(leaf.share) for leaf in leaves)


def shapley(x: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """Attributions of each row of ``x``, feature by feature."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        d = len(leaf.features)
        inside = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi in zip(leaf.features, leaf.low, leaf.high)]
        weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
        for i in range(d):
            # Coefficient k: the ways in which k of the other features are in the coalition.
            ways = np.zeros((d, len(x)))
            ways[0] = 1.0
            for done, j in enumerate(j for j in range(d) if j != i):
                ways[1 : done + 2] = ways[1 : done + 2] * leaf.share[j] + ways[: done + 1] * inside[j]
                ways[0] = ways[0] * leaf.share[j]
            out[:, leaf.features[i]] += leaf.value * (inside[i] - leaf.share[i]) * (weight @ ways)
    return out


def _attributed(frames: Iterator[pd.DataFrame], features: list[str], leaves: list[Leaf], base: float, chunk: int = 4096) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), chunk):
            part = frame.iloc[at : at + chunk].reset_index(drop=True)
            x = part[features].to_numpy(float)
            found = shapley(x, leaves)
            found[np.isnan(x).any(1)] = np.nan
            for j, f in enumerate(features):
                part[f"{f}_adds"] = found[:, j]
            part["base"], part["output"] = base, base + found.sum(1)
            yield part


def attributions(df: DataFrame, features: Sequence[str], leaves: Sequence[Leaf]) -> DataFrame:
    """Adds ``<feature>_adds`` of each feature, ``base`` and ``output``, their sum; a row with a missing feature gets nulls."""
    features = list(features)
    more = ", ".join(f"`{f}_adds` double" for f in features)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    run = partial(_attributed, features=features, leaves=list(leaves), base=base_value(leaves))
    return df.mapInPandas(run, f"{schema}, {more}, base double, output double")
