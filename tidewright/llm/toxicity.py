"""Toxicity by a linear classifier over naive-Bayes-scaled character n-grams.

Features are the distinct hashed character n-grams of the lower-cased text.
Counts of documents with each n-gram, by label, come from all labelled training
rows; each feature is scaled by its log-count ratio, smoothed in proportion to
the class sizes so that an n-gram never seen weighs nothing.  A logistic
regression with an L2 penalty is fitted on the features that tell the classes
apart best; how many is chosen within the training rows, by learning from one
part of them and taking the number with the least log loss on the other.
(With all n-grams the loss is far larger: the ratios of rare ones are mostly noise.)

Only the text enters a score.  Rows whose ``crc32`` of the id as text is 1
modulo 3 are held out and never learned from.  Null and empty texts score what
no evidence scores; with one class or no labels all score that class's share.
Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, stored

SIZES = (4, 5, 6)


@cache
def _marks(bits: int) -> np.ndarray:
    return np.zeros(1 << bits, np.int32)


def features(text: str, bits: int) -> np.ndarray:
    """Distinct n-gram buckets of a text."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for n in SIZES:
        if len(chars) >= n:
            h = np.full(len(chars) - n + 1, n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + chars[k : len(chars) - n + 1 + k]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            found.append(h >> np.uint32(32 - bits))
    if not found:
        return np.zeros(0, np.int64)
    h = np.concatenate(found).astype(np.int64)
    # One of each bucket: the position that was written last is read back.
    marks, at = _marks(bits), np.arange(len(h), dtype=np.int32)
    marks[h] = at
    return h[marks[h] == at]


def _counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Documents with each bucket, by label, of all rows and of those of the inner part."""
    n = np.zeros((4, 1 << bits), np.int32)
    for batch in batches:
        for part in slices(batch):
            for label, inner, text in zip(*[part.column(i).to_pylist() for i in range(3)]):
                x = features(text, bits)
                n[label][x] += 1
                if inner:
                    n[2 + label][x] += 1
    at = np.flatnonzero(n[:2].any(0))
    cols = [pa.array(at, pa.int64()), *(pa.array(n[k][at], pa.int64()) for k in (1, 0, 3, 2))]
    yield pa.RecordBatch.from_arrays(cols, names=["bucket", "toxic", "clean", "inner_toxic", "inner_clean"])


def _rows(batches: Iterator[pa.RecordBatch], bits: int, chosen) -> Iterator[pa.RecordBatch]:
    keep = np.zeros(1 << bits, bool)
    keep[chosen.value] = True
    for batch in batches:
        for part in slices(batch):
            xs = [features(t, bits) for t in part.column(2).to_pylist()]
            xs = pa.array([x[keep[x]].astype(np.int32) for x in xs], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), xs], names=["label", "inner", "x"])


def evidence(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G-squared of each n-gram's presence against the label."""
    seen = toxic + clean
    out = np.zeros(len(seen))
    for got, total in ((toxic, n1), (clean, n0), (n1 - toxic, n1), (n0 - clean, n0)):
        of = seen if got is toxic or got is clean else n1 + n0 - seen
        expected = of * (total / (n1 + n0))
        out += 2 * np.where(got > 0, got * np.log(np.maximum(got, 1e-12) / np.maximum(expected, 1e-12)), 0)
    return out


def fit_logistic(cols: np.ndarray, sizes: np.ndarray, y: np.ndarray, scale: np.ndarray, penalty: float, steps: int, counts: np.ndarray | None = None):
    """Weights and bias of an L2-penalised logistic regression, by accelerated gradient steps.

    ``cols`` lists the columns present in each row, ``sizes`` how many each row
    has; column j has value scale[j].  ``counts`` says how many rows each stands for.
    """
    of = np.repeat(np.arange(len(sizes)), sizes)
    values, rows, d = scale[cols], len(sizes), len(scale)
    counts = np.ones(rows) if counts is None else counts
    n = counts.sum()

    def ahead(w):
        return np.bincount(of, w[cols] * values, rows)

    def back(g):
        return np.bincount(cols, g[of] * values, d)

    v = np.ones(d) / max(d, 1) ** 0.5
    top = 1.0
    for _ in range(20):  # largest eigenvalue of X'X / n by power iteration
        v = back(counts * ahead(v)) / n
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    rate = 1 / (0.25 * (top * 1.1 + 1) + penalty)
    ones = float((counts * y).sum())
    w, b = np.zeros(d), float(np.log((ones + 0.5) / (n - ones + 0.5)))
    w_old, b_old = w, b
    for k in range(steps):
        m = k / (k + 3)
        wm, bm = w + m * (w - w_old), b + m * (b - b_old)
        g = counts * (1 / (1 + np.exp(-np.clip(ahead(wm) + bm, -40, 40))) - y)
        w_old, b_old = w, b
        w, b = wm - rate * (back(g) / n + penalty * wm), bm - rate * float(g.sum() / n)
    return w, b


class Rows:
    """Sampled rows as lists of ranked features (rank 0 tells the classes apart best), and how many rows each stands for."""

    def __init__(self, cols: np.ndarray, sizes: np.ndarray, y: np.ndarray, counts: np.ndarray):
        self.cols, self.of, self.y, self.counts = cols, np.repeat(np.arange(len(sizes)), sizes), y, counts

    def part(self, rows: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature lists, labels and counts of the rows marked, with the ``best`` first features only."""
        keep = rows[self.of] & (self.cols < best)
        sizes = np.bincount(self.of[keep], minlength=len(rows))[rows]
        return self.cols[keep], sizes, self.y[rows], self.counts[rows]


def log_ratio(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int, smoothing: float) -> np.ndarray:
    n = n1 + n0
    return np.log(((c1 + smoothing * n1 / n) / n1) / ((c0 + smoothing * n0 / n) / n0))


def chosen_number(rows: Rows, inner: np.ndarray, ratio: np.ndarray, numbers: list[int], penalty: float, steps: int) -> int:
    """The number of features that does best on the outer part after learning from the inner one.

    Features are ranked, and their ratios taken, by the inner part alone.
    """
    found = []
    for k in numbers:
        cols, sizes, y, counts = rows.part(inner, k)
        w, b = fit_logistic(cols, sizes, y, ratio[:k], penalty, steps, counts)
        cols, sizes, y, counts = rows.part(~inner, k)
        z = np.bincount(np.repeat(np.arange(len(sizes)), sizes), (w * ratio[:k])[cols], len(sizes)) + b
        found.append((float(np.average(np.logaddexp(0, z) - y * z, weights=counts)), k))
    return min(found)[1]


def _scores(batches: Iterator[pa.RecordBatch], bits: int, model, threshold: float) -> Iterator[pa.RecordBatch]:
    chosen, weights, bias = model.value
    full = np.zeros(1 << bits)
    full[chosen] = weights
    for batch in batches:
        for part in slices(batch):
            z = np.array([full[features(t, bits)].sum() for t in part.column(2).to_pylist()]) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    bits: int = 20,
    smoothing: float = 10.0,
    columns: Sequence[int] = (256, 512, 1024, 2048),
    fit_rows: int = 20_000,
    penalty: float = 1e-4,
    steps: int = 300,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
):
    """Learn from all labelled rows that aren't held out; returns (bits, broadcast model).

    The log-count ratios use every such row.  Only the weights are fitted, and
    one of the numbers of features in ``columns`` is chosen, on a sample: of each
    label about half of ``fit_rows`` rows, picked by a hash of the id, or all where
    there are fewer, so that a rare label keeps its rows; a row counts as often as
    it stands for others.  The driver holds 2**bits counts
    and the features of that sample.  If a part lacks a class, the third number
    (or the last, if there are fewer) is taken.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    # Labels grow with the documents: the same join at every size, never a broadcast.
    train = id_and_text(docs, id_col, text_col).join(marks.hint("shuffle_merge"), "doc_id")
    train = stored(train.select("doc_id", "label", "text"), "toxic-train")
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = min(max(n1 / max(n1 + n0, 1), 1e-9), 1 - 1e-9)
        bias = float(np.log(share / (1 - share)))
        return bits, spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0), bias))
    # Half of the training rows, by the same remainder that holds others out.
    inner = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).alias("inner")
    train = train.select("label", inner, "text", "doc_id")
    names = ["bucket", "toxic", "clean", "inner_toxic", "inner_clean"]
    schema = ", ".join(f"{c} long" for c in names)
    counts = train.select("label", "inner", "text").mapInArrow(partial(_counts, bits=bits), schema)
    counts = counts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()
    bucket, c1, c0, i1, i0 = (counts[c].to_numpy() for c in names)
    parts = {tuple(r)[:2]: r["n"] for r in train.groupBy("label", "inner").agg(F.count("*").alias("n")).collect()}
    m1, m0 = parts.get((1, True), 0), parts.get((0, True), 0)
    numbers = sorted({min(k, len(bucket)) for k in columns})
    selectable = len(parts) == 4 and len(numbers) > 1
    best = np.lexsort((bucket, -evidence(c1, c0, n1, n0)))[: numbers[-1]]
    wanted = best
    if selectable:
        by_inner = np.lexsort((bucket, -evidence(i1, i0, m1, m0)))[: numbers[-1]]
        wanted = np.union1d(best, by_inner)
    share = [min(1.0, fit_rows / 2 / n) for n in (n0, n1)]
    limit = F.when(F.col("label") == 1, F.lit(int(share[1] * 1_000_000))).otherwise(F.lit(int(share[0] * 1_000_000)))
    sample = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit)
    sent = spark.sparkContext.broadcast(np.sort(bucket[wanted]))
    rows = sample.select("label", "inner", "text").mapInArrow(partial(_rows, bits=bits, chosen=sent), "label int, inner boolean, x array<int>")
    rows = rows.toArrow()
    at = {int(x): i for i, x in enumerate(np.sort(bucket[wanted]))}
    lists = rows["x"].chunks
    flat = np.concatenate([c.flatten().to_numpy() for c in lists] or [np.zeros(0, np.int32)])
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in lists] or [np.zeros(0, np.int32)]).astype(np.int64)
    y = rows["label"].to_numpy().astype(np.float64)
    stands = np.where(y == 1, 1 / share[1], 1 / share[0])

    def ranked(by: np.ndarray) -> np.ndarray:
        """For each bucket sent, its rank in an order of places; those not in it last."""
        rank = np.full(len(at), len(at), np.int64)
        rank[[at[int(x)] for x in bucket[by]]] = np.arange(len(by))
        return rank[np.searchsorted(np.sort(bucket[wanted]), flat)]

    number = numbers[min(2, len(numbers) - 1)]
    if selectable:
        ratio = log_ratio(i1[by_inner], i0[by_inner], m1, m0, smoothing)
        number = chosen_number(Rows(ranked(by_inner), sizes, y, stands), rows["inner"].to_numpy().astype(bool), ratio, numbers, penalty, steps)
    best = best[:number]
    ratio = log_ratio(c1[best], c0[best], n1, n0, smoothing)
    cols, sizes, y, counts = Rows(ranked(best), sizes, y, stands).part(np.ones(len(y), bool), number)
    w, b = fit_logistic(cols, sizes, y, ratio, penalty, steps, counts)
    return bits, spark.sparkContext.broadcast((bucket[best], w * ratio, b))


def toxicity_scores(
    docs: DataFrame, model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; no shuffle."""
    bits, sent = model
    rows = id_and_text(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, score double, predicted int"
    return rows.mapInArrow(partial(_scores, bits=bits, model=sent, threshold=threshold), schema)


def _kept(batches: Iterator[pa.RecordBatch], column: int, bits: int, model, threshold: float) -> Iterator[pa.RecordBatch]:
    chosen, weights, bias = model.value
    full = np.zeros(1 << bits)
    full[chosen] = weights
    limit = np.log(threshold / (1 - threshold))
    for batch in batches:
        for part in slices(batch):
            ok = [full[features(t or "", bits)].sum() + bias < limit for t in part.column(column).to_pylist()]
            yield part.filter(pa.array(ok, pa.bool_()))


def without_toxic(docs: DataFrame, model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below ``threshold``."""
    bits, sent = model
    run = partial(_kept, column=docs.columns.index(text_col), bits=bits, model=sent, threshold=threshold)
    return docs.mapInArrow(run, docs.schema)
