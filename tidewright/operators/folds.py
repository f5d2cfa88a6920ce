"""Folds over ordered rows: a filter that is affine in its state, cut into ranges, and states that only a walk can give."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order_statistics import MOST, longest
from .ranges import PART, ROW, carried, cut, folded


def gains(first: int, n: int, ratio: float) -> np.ndarray:
    """Weights of the new value at so many rows from a place on, for a local level with that signal-to-noise variance ratio.

    They don't depend on the values and soon settle; the first row's value is its level.
    """
    out, var = np.empty(n), 1.0
    for t in range(first + n):
        ahead = var + ratio
        gain = ahead / (ahead + 1)
        settled, var = var == ahead * (1 - gain), ahead * (1 - gain)
        if t >= first:
            out[t - first] = gain if t else 1.0
        if settled and t:
            out[max(t - first, 0) :] = gain
            break
    return out


def levels(y: np.ndarray, gain: np.ndarray, start: float) -> np.ndarray:
    out, level = np.empty(len(y)), start
    for i, (v, g) in enumerate(zip(y, gain)):
        level = level + g * (v - level)
        out[i] = level
    return out


def local_levels(df: DataFrame, keys: Sequence[str], time: str, value: str, ratio: float, name: str = "level", most: int = MOST, ranges: int | None = None) -> DataFrame:
    """Adds the filtered level of a local-level model; rows without a value are left out.

    A key of more than ``most`` rows is cut into ranges: each sums up what it does
    to a level, which is an affine map, and runs from what those before it make.
    """
    keys, columns = list(keys), df.columns
    df = df.filter(F.col(value).isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` double"

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(time, ignore_index=True)
        return frame.assign(**{name: levels(frame[value].to_numpy(float), gains(0, len(frame), ratio), 0.0)})

    if ranges is None and longest(df, keys) <= most:
        return df.groupBy(*keys).applyInPandas(whole, schema)
    rows = carried(cut(df, keys, [time], ranges), keys, {"_before": F.count("*")})

    def own_gains(frame: pd.DataFrame) -> np.ndarray:
        return gains(int(frame["_before"].iloc[0]), len(frame), ratio)

    def summary(frame: pd.DataFrame) -> dict:
        g = own_gains(frame)
        return {"slope": float(np.prod(1 - g)), "shift": float(levels(frame[value].to_numpy(float), g, 0.0)[-1])}

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        out, level = [], 0.0
        for slope, shift in zip(frame["slope"], frame["shift"]):
            out.append(level)
            level = slope * level + shift
        return pd.DataFrame({"start": out})

    def finish(frame: pd.DataFrame, start: dict) -> pd.DataFrame:
        return frame[columns].assign(**{name: levels(frame[value].to_numpy(float), own_gains(frame), start["start"])})

    return folded(rows, keys, summary, "slope double, shift double", combine, "start double", finish, schema)


def _walked(batches: Iterator[pa.RecordBatch], keys: int, start: Callable[[], list], step: Callable[[list, tuple], None], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    last, state, out = None, None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if state is None or row[:keys] != last:
                if state is not None:
                    out.append((*last, *state))
                last, state = row[:keys], start()
            step(state, row[keys:])
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out = []
    if state is not None:
        out.append((*last, *state))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


def walked(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], start: Callable[[], list], step: Callable[[list, tuple], None], fields: str) -> DataFrame:
    """Keys and the state that a walk over each key's rows ends in.

    For states whose steps don't compose.  Spark sorts the rows and a task streams
    over its keys holding one state, so a long key takes one task's time, not its memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *inputs)
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = StructType.fromDDL(f"{types}, {fields}")
    run = partial(_walked, keys=len(keys), start=start, step=step, schema=to_arrow_schema(schema))
    return rows.mapInArrow(run, schema)
