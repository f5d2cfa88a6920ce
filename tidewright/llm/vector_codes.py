"""Product codes of vectors by Lloyd's rounds over partition-local cover trees.

Components become whole numbers, a vector's parts are coded apart, and every
distance is a whole number too, so results don't depend on how rows are dealt.

Each task cuts its rows into blocks and builds, for each part of a block, a cover
tree: a node has one of its points as centre and the radius that covers all of
its points; children's centres are further apart than half the parent's radius,
and the parent's centre is its first child's.  Points lie in tree order, so a
node is a range and its sum a difference of cumulative sums.  In a round a node
is assigned whole if its centre's nearest entry stays nearest within its radius
by the triangle inequality; only the others go down, to exact comparisons of
single points at the leaves.  Blocks and trees are built once and written.

A round sends a count and sums for each entry from each task, and brings the new
codebooks, ``parts * entries`` of them, to the driver.

Null vectors and those with null or non-finite components are dropped.  Rows that
repeat count each; a null id comes last among the first entries.  Vectors of each
length have codebooks of their own; with a length that the parts don't divide the
later parts are longer.  Components of ``2**52`` and more are taken as that.  A
sum of squares beyond a long is null.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LEAF = 8  # points that a node may hold without children
LARGE = 1 << 62
EXACT = 2**53  # whole numbers below it are exact in double precision


def whole_vectors(vectors: pa.Array, scale: float, offset: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """``floor(scale * component) + offset`` of the finite vectors of each length: rows and their numbers."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
        ok = np.isfinite(values).all(1)  # a null became not a number
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(values[ok] * scale), -LARGE, LARGE).astype(np.int64)
        out.append((at[ok], x + offset))
    return out


def bounds_of(dim: int, parts: int) -> list[int]:
    return [i * dim // parts for i in range(parts + 1)]


def exact(x: np.ndarray) -> np.ndarray:
    """Whole numbers in a form in which squared distances between them are exact."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.float64) if 4 * most * most * max(x.shape[-1], 1) < EXACT else x.astype(object)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two arrays of :func:`exact`."""
    if x.dtype == object or y.dtype == object:
        x, y = ([[int(v) for v in r] for r in m] for m in (x, y))
        return np.array([[sum((a - b) ** 2 for a, b in zip(r, s)) for s in y] for r in x], object).reshape(len(x), len(y))
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)


NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("centre", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tree order of the rows of ``x`` and the nodes; a node's children are neighbours.

    ``start`` and ``end`` are places in tree order, ``centre`` too.
    """
    n = len(x)
    if x.dtype == object:  # too large for exact doubles: one leaf of which every point is compared
        return np.arange(n, dtype=np.int32), np.array([(0, n, 0, 0, 0, np.inf)], NODE)
    away = np.sqrt(np.maximum(squared(x, x), 0))
    order = np.arange(n)
    nodes = [(0, n, 0, 0, 0, float(away[0].max()))]  # centre as a row of x until the end
    at = 0
    while at < len(nodes):
        start, end, centre, _, _, radius = nodes[at]
        if end - start > LEAF and radius > 0:
            own = order[start:end]
            reach, centres, open_ = radius / 2, [centre], own[away[centre, own] > radius / 2]
            while len(open_):
                centres.append(int(open_[0]))
                open_ = open_[away[open_[0], open_] > reach]
            if len(centres) > 1:
                of = away[np.ix_(centres, own)].argmin(0)
                order[start:end] = own[np.argsort(of, kind="stable")]
                ends = start + np.cumsum(np.bincount(of, minlength=len(centres)))
                nodes[at] = (start, end, centre, len(nodes), len(centres), radius)
                for c, a, b in zip(centres, [start, *ends[:-1]], ends):
                    nodes.append((int(a), int(b), c, 0, 0, float(away[c, order[a:b]].max())))
        at += 1
    nodes = np.array(nodes, NODE)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    nodes["centre"] = place[nodes["centre"]]
    return order.astype(np.int32), nodes


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = (ends - starts).astype(np.int64)
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def assigned(x: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of ``book``, lowest index first, of each row of ``x`` (in tree order)."""
    out = np.zeros(len(x), np.int32)
    if x.dtype == object or book.dtype == object:
        return squared(x, book).argmin(1).astype(np.int32) if len(x) else out
    now, single = np.zeros(1, np.int64), []
    while len(now):
        node = nodes[now]
        d = squared(x[node["centre"]], book)
        best, rows = d.argmin(1), np.arange(len(d))
        least = np.sqrt(np.maximum(d[rows, best], 0))
        d[rows, best] = np.inf
        # Roots are rounded, so a node is only taken whole with some room to spare.
        room = np.sqrt(d.min(1)) - least - 2 * node["radius"]
        clear = (node["radius"] == 0) | (room > 1e-6 * (1 + least))
        whole = node[clear]
        out[ranges(whole["start"], whole["end"])] = np.repeat(best[clear], whole["end"] - whole["start"])
        node = node[~clear]
        leaf = node["children"] == 0
        single.append(ranges(node["start"][leaf], node["end"][leaf]))
        now = ranges(node["child"][~leaf], (node["child"] + node["children"])[~leaf])
    if len(at := np.concatenate([now, *single])):
        out[at] = squared(x[at], book).argmin(1)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, scale: float, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole vectors of one length with a tree for each part."""
    held: dict[int, list] = {}

    def block(dim: int, ids: list, labels: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        trees = [cover_tree(exact(x[:, a:b])) for a, b in zip(bounds_of(dim, parts), bounds_of(dim, parts)[1:])]
        small = np.abs(x).max(initial=0) < 2**15
        row = [pa.array([v], t) for v, t in ((dim, pa.int32()), (2 if small else 8, pa.int32()), (ids, pa.list_(pa.int64())))]
        row.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), labels))
        row.append(pa.array([x.astype("<i2" if small else "<i8").tobytes()], pa.binary()))
        row += [pa.array([[t[i].tobytes() for t in trees]], pa.list_(pa.binary())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(row, names=["dim", "width", "ids", "labels", "x", "orders", "nodes"])

    def full(dim: int, least: int) -> Iterator[pa.RecordBatch]:
        ids, labels, x = (np.concatenate([h[0] for h in held[dim]]), pa.concat_arrays([h[1] for h in held[dim]]), np.concatenate([h[2] for h in held[dim]]))
        at = 0
        while len(x) - at >= least and at < len(x):
            to = at + block_rows
            yield block(dim, [None if m else i for i, m in zip(*ids[at:to].T.tolist())], labels[at:to], x[at:to])
            at = to
        held[dim] = [(ids[at:], labels[at:], x[at:])] if at < len(x) else []

    for batch in batches:
        ids = np.stack([pc.fill_null(batch.column(0), 0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)], 1).astype(np.int64)
        for at, x in whole_vectors(batch.column(2), scale):
            if len(at):
                held.setdefault(x.shape[1], []).append((ids[at], batch.column(1).take(pa.array(at)), x))
        for dim in held:
            if sum(len(h[0]) for h in held[dim]) >= block_rows:
                yield from full(dim, block_rows)
    for dim in held:
        if held[dim]:
            yield from full(dim, 1)


def _opened(row: dict, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each part of a block: tree order, its numbers in that order, nodes."""
    x = np.frombuffer(row["x"], f"<i{row['width']}").astype(np.int64).reshape(row["n"], row["dim"])
    bounds = bounds_of(row["dim"], parts)
    for a, b, order, nodes in zip(bounds, bounds[1:], row["orders"], row["nodes"]):
        order = np.frombuffer(order, np.int32)
        yield order, x[order, a:b], np.frombuffer(nodes, NODE)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _summed(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's count and sums of the vectors of each entry of each part."""
    parts, width = len(books), max(b.shape[1] for b in books)
    counts = [np.zeros(len(b), np.int64) for b in books]
    sums = [np.zeros(b.shape, np.int64) for b in books]
    for row in _rows(batches):
        for p, (_, x, nodes) in enumerate(_opened(row, parts)):
            entry = assigned(exact(x), nodes, exact(books[p]))
            # Runs of one entry in tree order: mostly whole subtrees.
            starts = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
            ends, of = np.append(starts[1:], len(entry)), entry[starts]
            large = x.size and int(np.abs(x).max()) * len(x) >= LARGE
            if large and sums[p].dtype != object:
                sums[p] = sums[p].astype(object)
            sofar = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x.astype(object) if large else x, 0)])
            np.add.at(counts[p], of, ends - starts)
            np.add.at(sums[p], of, sofar[ends] - sofar[starts])
            if sums[p].dtype != object and x.size and int(np.abs(sums[p]).max()) >= LARGE // 2:
                sums[p] = sums[p].astype(object)
    at = [(p, e) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist()]
    cols = [pa.array([a[i] for a in at], pa.int32()) for i in (0, 1)] + [pa.array([int(counts[p][e]) for p, e in at], pa.int64())]
    for k in range(width):
        cols.append(pa.array([Decimal(int(sums[p][e][k])) if k < sums[p].shape[1] else Decimal(0) for p, e in at], pa.decimal128(38, 0)))
    yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", *[f"s{k}" for k in range(width)]])


def _coded(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Codes and summed squared distances of every vector of the blocks."""
    parts = len(books)
    digits = [f"{i:02x}" for i in range(max(len(b) for b in books))]
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            row = one.select([c for c in one.schema.names if c != "labels"]).to_pylist()[0]
            codes, error = np.zeros((row["n"], parts), np.int64), 0
            for p, (order, x, nodes) in enumerate(_opened(row, parts)):
                entry = assigned(exact(x), nodes, exact(books[p]))
                codes[order, p] = entry
                away = (x.astype(object) - books[p][entry].astype(object) if exact(x).dtype == object or exact(books[p]).dtype == object else x - books[p][entry])
                part = np.zeros(row["n"], object if away.dtype == object else np.int64)
                part[order] = (away * away).sum(1)
                error = error + part
            names = ["".join([digits[c] for c in r]) for r in codes.tolist()]
            error = [e if e < 2**63 else None for e in map(int, error)]
            labels = one.column(one.schema.get_field_index("labels")).flatten()
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), labels, pa.array(names), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])


def first_entries(rows: DataFrame, dim: int, entries: int, scale: float) -> np.ndarray:
    """The whole vectors of the smallest ids; equal ids go by their components."""
    first = rows.filter(F.size("v") == dim).filter("forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    first = first.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    x = [x for _, x in whole_vectors(first.column(0).combine_chunks(), scale)]
    return x[0] if x else np.zeros((0, dim), np.int64)


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for book in books for entry in book for c in entry).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: float = 1024.0,
    block_rows: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that is kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    label = rows.schema["label"].dataType.simpleString()
    schema = f"dim int, width int, ids array<long>, labels array<{label}>, x binary, orders array<binary>, nodes array<binary>"
    blocks = stored(rows.mapInArrow(partial(_blocks, parts=parts, scale=scale, block_rows=block_rows), schema), "blocks")
    blocks = blocks.withColumn("n", F.size("ids"))
    coded = None
    for dim in sorted(r["dim"] for r in blocks.select("dim").distinct().collect()):
        own, bounds = blocks.filter(F.col("dim") == dim), bounds_of(dim, parts)
        first = first_entries(rows, dim, entries, scale)
        books = [first[:, a:b] for a, b in zip(bounds, bounds[1:])]
        sums = [f"s{k}" for k in range(max(b.shape[1] for b in books))]
        for _ in range(rounds):
            shape = "part int, entry int, n long" + "".join(f", {s} decimal(38,0)" for s in sums)
            found = own.drop("ids", "labels").mapInArrow(partial(_summed, books=books), shape)
            found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])
            books = [b.copy() for b in books]
            for r in found.collect():
                own_sums = [int(r[s]) for s in sums[: books[r["part"]].shape[1]]]
                books[r["part"]][r["entry"]] = [s // r["n"] for s in own_sums]
        now = own.mapInArrow(partial(_coded, books=books), f"vec_id long, label {label}, code string, error long")
        now = now.withColumn("codebooks_sha256", F.lit(codebook_digest(books)))
        coded = now if coded is None else coded.union(now)
    if coded is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stored(coded, "codes")
    # Written, so its size is known: small enough it is broadcast, else the join's shuffles split hot labels.
    per = stored(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    per = per.withColumnRenamed("label", "of")
    return coded.join(per, coded["label"].eqNullSafe(per["of"]), "left").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
