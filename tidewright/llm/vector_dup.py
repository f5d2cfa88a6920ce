"""Embedding near duplicates by collision counting over many projections.

Every vector is projected on many random lines.  Around each query's value on a
line lies a window; two vectors collide on a line if the other lies in it.  A
pair is verified in double precision if it collides on enough lines.  For unit
vectors at the threshold the difference on a Gaussian line is normal with a
known deviation, so window and count are set from the wanted recall, and
vectors closer than the threshold are found the more surely.

Vectors are sorted by length and by the first of these projections into blocks
of bounded size.  Two blocks are compared only if close pairs can lie in them, so
each task holds two blocks, in which collisions are counted as whole arrays, line
by line.  Copies of one vector count as one with a weight.  Each pair of blocks
reports link counts and a spanning forest, never pairs.  The driver holds the
first projection's range in each part of a block: four rows for every
``block_rows`` vectors.

Null, empty and zero vectors and those with a null or non-finite component link
with nothing; vectors of different lengths don't link with each other.  Vectors
are scaled before their norm is taken, so no finite one overflows.  Rows that
repeat an id count as vectors of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, stored

CLASS = "vec_id long, cls binary, dim int, place double, unit binary"


def lines(count: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, count))


def calibrated(cosine: float, count: int, recall: float) -> tuple[float, int]:
    """Window half-width and least number of collisions for pairs at the threshold.

    Of all windows, the one that lets the fewest unrelated pairs (at right
    angles) pass while the expected recall holds.
    """

    def inside(width: float, deviation: float) -> float:
        return math.erf(width / deviation / math.sqrt(2))

    def at_least(p: float, k: int) -> float:
        return sum(math.comb(count, i) * p**i * (1 - p) ** (count - i) for i in range(k, count + 1))

    near, far = math.sqrt(2 - 2 * cosine), math.sqrt(2)
    best = None
    for step in range(2, 60):
        width = step * near / 20
        k = max((k for k in range(1, count + 1) if at_least(inside(width, near), k) >= recall), default=0)
        if k:
            passed = at_least(inside(width, far), k)
            if best is None or passed < best[0]:
                best = (passed, width, k)
    return best[1], best[2]


def unit_vectors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which of them can be: those finite and not zero."""
    top = np.abs(values).max(1)
    ok = np.isfinite(top) & (top > 0)
    scaled = values[ok] / top[ok, None]
    return scaled / np.linalg.norm(scaled, axis=1)[:, None], ok


def _placed(batches: Iterator[pa.RecordBatch], count: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Class, length, first projection and unit vector of each vector; nulls if it links with nothing."""
    for batch in batches:
        vectors = batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
        cls, place, unit = ([None] * len(lengths) for _ in range(3))
        for dim in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == dim)
            values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            units, ok = unit_vectors(values)
            places = units @ lines(count, dim, seed)[:, 0]  # the same line as the first of _compared
            for i, v, p, u in zip(at[ok].tolist(), values[ok] + 0.0, places.tolist(), units):
                cls[i], place[i], unit[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest(), p, u.tobytes()
        cols = [batch.column(0), pa.array(cls, pa.binary()), pa.array(lengths, pa.int32()), pa.array(place, pa.float64()), pa.array(unit, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "cls", "dim", "place", "unit"])


def _compared(rows: pd.DataFrame, cosine: float, reach: float, width: float, least: int, count: int, seed: int) -> pd.DataFrame:
    """Links between two blocks (or within one): weight linked and a forest edge for each vector."""
    a, b, dim = (int(rows[c].iloc[0]) for c in ("left", "right", "dim"))
    axes = lines(count, dim, seed)
    sides = []
    for block in (a, b):
        part = rows[rows["block"] == block].sort_values("place")
        units = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(-1, dim)
        sides.append((part["cls"].to_numpy(), part["copies"].to_numpy(), part["place"].to_numpy(), units, units @ axes))
    (cls_a, copies_a, place_a, unit_a, proj_a), (cls_b, copies_b, place_b, unit_b, proj_b) = sides
    # Projections in steps of a sixteenth of the window, as integers that compare fast.
    step = width / 16
    qa, qb = (np.clip(np.rint(p / step), -16000, 16000).astype(np.int16) for p in (proj_a, proj_b))
    columns = [np.ascontiguousarray(qb[:, k]) for k in range(count)]
    far = reach + 2 * step
    # A forest: each vector points to the least index that reaches it inside these blocks.
    # Links are folded into it batch by batch, so memory doesn't grow with their number.
    shift = 0 if a == b else len(cls_a)
    names = cls_a if a == b else np.concatenate([cls_a, cls_b])
    every, root, n = np.arange(len(names)), np.arange(len(names)), np.zeros(len(names), np.int64)
    for at in range(0, len(qa), 64):
        q = qa[at : at + 64]
        near = place_a[at : at + 64]
        lo = int(np.searchsorted(place_b, near[0] - far))
        hi = int(np.searchsorted(place_b, near[-1] + far, "right"))
        if a == b:
            lo = max(lo, at)
        if lo >= hi:
            continue
        hits = np.zeros((len(q), hi - lo), np.uint8)
        for k in range(count):
            # Within the window: one comparison of the unsigned distance.
            away = (columns[k][None, lo:hi] - q[:, k, None] + np.int16(17)).view(np.uint16)
            hits += away <= 34
        i, j = np.nonzero(hits >= least)
        if len(i):
            i, j = i + at, j + lo
            if a == b:
                i, j = i[i < j], j[i < j]
            close = np.einsum("ij,ij->i", unit_a[i], unit_b[j]) >= cosine
            i, j = i[close], j[close]
            np.add.at(n, i, copies_b[j])
            np.add.at(n, j + shift, copies_a[i])
            x, y = np.concatenate([every, i]), np.concatenate([root, j + shift])
            while True:
                low = np.minimum(root[x], root[y])
                before = root.copy()
                np.minimum.at(root, x, low)
                np.minimum.at(root, y, low)
                root = root[root]
                if np.array_equal(before, root):
                    break
    at = np.flatnonzero(n)
    return pd.DataFrame({"cls": names[at], "n": n[at], "other": names[root[at]]})


def vector_duplicates(
    vectors: DataFrame,
    cosine: float = 0.9,
    count: int = 20,
    recall: float = 0.995,
    block_rows: int = 16384,
    seed: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    ``recall`` is the least chance that a pair exactly at ``cosine`` is found.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    placed = stored(rows.mapInArrow(partial(_placed, count=count, seed=seed), CLASS), "placed")
    one = [F.first(c).alias(c) for c in ("dim", "place", "unit")]
    classes = placed.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), *one)
    classes = stored(classes, "vectors")
    # Parts are ranges of length and first projection; blocks are neighbouring parts of about ``block_rows`` vectors.
    parts = 4 * -(-classes.count() // block_rows)
    ranged = classes.repartitionByRange(max(parts, 1), "dim", "place").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    size = [F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("n")]
    edges = ranged.groupBy("dim", "part").agg(*size).toArrow().to_pandas()
    edges = edges.sort_values(["dim", "low", "high"], ignore_index=True)
    edges["of"] = (edges.groupby("dim")["n"].cumsum() - edges["n"]) // block_rows
    edges["block"] = edges.groupby(["dim", "of"]).ngroup()
    # Two blocks meet if the first projections of a pair at the threshold may lie in
    # them: all but one in two thousand differ by less than 3.5 deviations.
    width, least = calibrated(cosine, count, recall)
    reach = 3.5 * math.sqrt(2 - 2 * cosine)
    ends = edges.groupby("block", as_index=False).agg(dim=("dim", "first"), low=("low", "min"), high=("high", "max"))
    last = ends["block"].to_numpy().copy()
    for at in ends.groupby("dim").indices.values():
        last[at] = at[0] + np.searchsorted(ends["low"].to_numpy()[at], ends["high"].to_numpy()[at] + reach, "right") - 1
    ends = spark.createDataFrame(ends[["block"]].assign(last=last), "block int, last int")
    edges = spark.createDataFrame(edges[["dim", "part", "block"]], "dim int, part int, block int")
    pairs = ends.select(F.col("block").alias("left"), F.explode(F.sequence("block", "last")).alias("right"))
    sides = pairs.select("left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    meets = sides.join(edges, "block")
    meeting = ranged.join(meets, ["dim", "part"])
    schema = T.StructType.fromDDL("cls binary, n long, other binary")
    run = partial(_compared, cosine=cosine, reach=reach, width=width, least=least, count=count, seed=seed)
    links = stored(meeting.groupBy("left", "right").applyInPandas(run, schema), "links")
    roots = connected_components(links.filter("cls <> other").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    linked = links.groupBy("cls").agg(F.sum("n").alias("n"))
    per = classes.select("cls", "copies", "first").join(linked, "cls", "left")
    per = per.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    per = per.withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    # Written first, so that the join has plain shuffles on both sides and a large component is split.
    least_id = stored(per.groupBy("root").agg(F.min("first").alias("component_id")), "least-ids")
    per = per.join(least_id, "root").select("cls", "n_links", "component_id")
    out = placed.select("vec_id", "cls").join(per, "cls", "left")
    out = out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
