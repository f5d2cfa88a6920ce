"""Exact repeats of long byte strings, by longest-previous-factor arrays.

A window is a string of ``length`` bytes inside one document; what repeats are
windows.  Suffix arrays are built only where a window can repeat at all:

* Every window names its anchor, the ``gram`` bytes in it of least hash.  Equal
  windows have equal anchors at equal offsets, so windows meet only under their
  anchor's hash.  Consecutive windows share an anchor; together they span one
  segment, of which Spark shuffles a few numbers.
* Under an anchor seen once nothing repeats.  Equal segments repeat as a whole
  and count once.  The bytes of the remaining segments, different ones under
  one anchor, are fetched and concatenated in document order.
* A suffix array over them, with the previous and next smaller positions in
  suffix order, gives each window's longest previous factor; the greater
  positions give its longest next factor.  A factor of ``length`` or more marks
  the window as a later or an earlier copy.

An anchor with very many different segments is refined before: segments are
halved and grouped anew by the bytes that all windows of a half share, down to
single windows if need be, so no group is gathered whole however common its
anchor is.

Null and empty texts, and those under ``length`` bytes, keep all.  Rows that
repeat are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_and_text, slices, stored
from .near_dup import BASE, mixed, powers

U = np.uint64
PIECE = 20  # bits of a position: long texts are read in pieces of 2**20 windows
VALUES = mixed(np.arange(1001, 1257, dtype=np.uint64))

SEGMENTS = "doc_id long, th long, ah long, ctx long, at int, n int"


def sums_of(b: np.ndarray) -> np.ndarray:
    up, _ = powers(max(12, len(b).bit_length()))
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(VALUES[b] * up[: len(b)], out=out[1:])
    return out


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges."""
    _, down = powers(max(12, (len(sums) - 1).bit_length()))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of each w consecutive values, by running minima from block edges."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, U(2**64 - 1))
    padded[:n] = x
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, segment hash, first window and number of windows of each segment."""
    out = [np.zeros((4, 0), np.int64)]
    for base in range(0, max(len(raw) - length + 1, 0), 1 << PIECE):
        b = raw[base : base + (1 << PIECE) + length - 1]
        sums = sums_of(b)
        at = np.arange(len(b) - gram + 1)
        h = hashes(sums, at, at + gram)
        low = U((1 << PIECE + 1) - 1)
        place = sliding_min((h & ~low) | at.astype(np.uint64), length - gram + 1) & low
        first = np.flatnonzero(np.diff(place.astype(np.int64), prepend=-1))
        count = np.diff(first, append=len(place))
        anchor = place[first].astype(np.int64)
        ctx = hashes(sums, first, first + count + length - 1)
        ctx = mixed(ctx + (anchor - first).astype(np.uint64) * BASE + count.astype(np.uint64))
        out.append(np.stack([h[anchor].view(np.int64), ctx.view(np.int64), first + base, count]))
    return tuple(np.concatenate(out, 1))


def _segments(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = [segments(np.frombuffer(t.as_buffer() or b"", np.uint8), length, gram) for t in part.column(2)]
            sizes = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            ah, ctx, at, n = (np.concatenate([f[i] for f in found]) for i in range(4))
            cols = [part.column(0).take(sizes), part.column(1).take(sizes), pa.array(ah), pa.array(ctx)]
            cols += [pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "ah", "ctx", "at", "n"])


# ---- suffix arrays ----------------------------------------------------------


def ranks_by_doubling(text: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Ranks of all positions by their first 8, 16, ... ``upto`` bytes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << U(8)) | padded[k : n + k]
    ranks, k = {}, 8
    while True:
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        ranks[k] = rank
        if k == upto:
            return ranks
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - k, 0)] = rank[k:]
        key = (rank.astype(np.uint64) << U(32)) | ahead.astype(np.uint64)
        k *= 2


def nearest(values: np.ndarray) -> np.ndarray:
    """For each entry, the index of the last one before it with a smaller value, or -1."""
    n = len(values)
    held = np.append(values, np.iinfo(np.int64).min)  # index -1
    out = np.arange(n) - 1
    open_ = np.flatnonzero(held[out] >= values)
    while len(open_):
        out[open_] = out[out[open_]]
        open_ = open_[held[out[open_]] >= values[open_]]
    return out


def factors(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and next factor at each start, among the starts, cut off at or above ``length``.

    The nearest neighbours in suffix order with a smaller (greater) position
    have the longest common prefix of all earlier (later) ones.
    """
    n, m = len(text), len(starts)
    top = 8
    while 2 * top <= length:
        top *= 2
    ranks = ranks_by_doubling(text, top)
    end = np.minimum(starts + top, n - 1)
    order = np.lexsort((np.where(starts + top < n, ranks[top][end], 0), ranks[top][starts]))
    sa = starts[order]

    def common(other: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix with the one at index ``other``; 0 for none."""
        a, b = sa, sa[other]
        got = np.zeros(m, np.int64)
        for k in [top] * (-(-length // top)) + [top >> i for i in range(1, top.bit_length() - 3)]:
            x, y = a + got, b + got
            inside = (x < n) & (y < n)
            same = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
            got += np.where(same, k, 0)
        for _ in range(7):  # what is left is under 8 bytes
            x, y = a + got, b + got
            inside = (x < n) & (y < n)
            got += inside & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
        return np.where(other < 0, 0, got)

    def longest(values: np.ndarray) -> np.ndarray:
        before = nearest(values)
        after = nearest(values[::-1])[::-1]
        after = np.where(after < 0, -1, m - 1 - after)
        out = np.empty(m, np.int64)
        out[order] = np.maximum(common(before), common(after))
        return out

    return longest(sa), longest(-sa)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


PARTS = "ah long, ctx long, off int, key long, dig long, doc_id long, th long, at int, anchor int, near int, far int, bytes binary"
MARKS = "ah long, ctx long, a int, b int, earlier boolean"


def _arrays(batches: Iterator[pa.RecordBatch], length: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Marks of repeated windows, from segments sorted by key and then document order."""

    def marked(rows: list[dict]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        sizes = np.array([len(r["bytes"]) for r in rows])
        base = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        starts = np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        out = []
        for lengths, earlier in zip(factors(text, starts, length), (True, False)):
            cut = np.split(lengths >= length, np.cumsum(counts)[:-1])
            for r, flags in zip(rows, cut):
                out += [{**r, "a": r["off"] + a, "b": r["off"] + b, "earlier": earlier} for a, b in runs(flags)]
        names = ["ah", "ctx", "a", "b", "earlier"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(names, kinds)], names=names)

    held, size = [], 0
    for batch in batches:
        for part in slices(batch):
            for r in part.to_pylist():
                if size >= at_once and r["key"] != held[-1]["key"]:
                    yield marked(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
    if held:
        yield marked(held)


def anchor_of(window: np.ndarray, gram: int) -> int:
    """Where a window's anchor begins."""
    at = np.arange(len(window) - gram + 1)
    return int(np.argmin(hashes(sums_of(window), at, at + gram) & ~U((1 << PIECE + 1) - 1)))


def _fetched(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments of each document.

    ``anchor`` counts from the first window's start; a window's anchor lies
    ``near`` to ``far`` bytes from its start.
    """
    for batch in batches:
        for part in slices(batch, 32):
            out = []
            for doc, th, text, wanted in zip(*[part.column(i) for i in range(4)]):
                raw = text.as_buffer().to_pybytes()
                for w in wanted.as_py():
                    cut = raw[w["at"] : w["at"] + w["n"] + length - 1]
                    anchor = anchor_of(np.frombuffer(cut, np.uint8)[:length], gram)
                    row = (w["ah"], w["ctx"], 0, w["ah"], w["ctx"], doc.as_py(), th.as_py(), w["at"])
                    out.append((*row, anchor, 0, length - gram, cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(PART_TYPES)], names=PART_NAMES
            )


PART_NAMES = [c.split()[0] for c in PARTS.split(", ")]
PART_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in PARTS.split(", ")]


def _halved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each segment as two, keyed by the bytes that all windows of a half share."""
    for batch in batches:
        for part in slices(batch):
            out = []
            for r in part.to_pylist():
                b, anchor, windows = r["bytes"], r["anchor"], len(r["bytes"]) - length + 1
                mid = (r["near"] + r["far"]) // 2
                for near, far in ((r["near"], mid), (mid + 1, r["far"])):
                    # Windows whose anchor lies near to far bytes on.
                    x, y = max(0, anchor - far), min(windows, anchor - near + 1)
                    if near <= far and x < y:
                        cut = b[x : y + length - 1]
                        sums = sums_of(np.frombuffer(b, np.uint8))
                        shared = (anchor - near, anchor - far + length)
                        key, dig = hashes(sums, np.array([shared[0], x]), np.array([shared[1], y + length - 1]))
                        key = mixed(np.array([r["ah"], near, far]).view(np.uint64) + key).sum(keepdims=True)
                        row = (r["ah"], r["ctx"], r["off"] + x, int(mixed(key).view(np.int64)[0]), int(dig.view(np.int64)))
                        out.append((*row, r["doc_id"], r["th"], r["at"] + x, anchor - x, near, far, cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(PART_TYPES)], names=PART_NAMES
            )


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 64):
            out = []
            for doc, text, spans in zip(*[part.column(i) for i in range(3)]):
                raw = text.as_buffer().to_pybytes() if text.as_buffer() else b""
                ranges = sorted((s["a"], s["b"] + length - 1) for s in spans.as_py() or [])
                merged: list[list[int]] = []
                for a, b in ranges:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                at, kept = 0, hashlib.sha256()
                for a, b in merged:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                gone = sum(b - a for a, b in merged)
                out.append((doc.as_py(), len(raw), gone, len(merged), kept.hexdigest(), [{"start": a, "end": b} for a, b in merged]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            kinds.append(pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)


def with_counted_keys(rows: DataFrame, counted: DataFrame, keys: list[str], count: str, most: int) -> DataFrame:
    """``rows`` whose keys ``counted`` lists, with its other columns.

    Keys that more than ``most`` rows have are few.  They go to every task, so
    that their rows stay where they are instead of meeting in one.
    """
    common = F.broadcast(counted.filter(F.col(count) > most))
    rare = rows.join(common.select(*keys), keys, "left_anti").join(counted.filter(F.col(count) <= most), keys)
    return rows.join(common, keys).unionByName(rare)


def repeated_bytes(
    docs: DataFrame,
    length: int = 400,
    gram: int = 200,
    keep_first: bool = True,
    most_kinds: int = 500,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row.

    Removes each byte of a window that has an earlier copy in document order
    (``keep_first``), or of one that has any other copy.
    """
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = texts.mapInArrow(partial(_segments, length=length, gram=gram), SEGMENTS)
    found = stored(found, "segments")
    # Written first, so that the join below has plain shuffles on both sides and splits hot anchors.
    twice = stored(found.groupBy("ah").agg(F.count("*").alias("c")).filter("c > 1").select("ah"), "repeated-anchors")
    found = stored(found.join(twice, "ah"), "anchored")
    own = F.min(F.struct("doc_id", "th", "at", "n")).alias("own")
    kinds = stored(found.groupBy("ah", "ctx").agg(F.count("*").alias("copies"), own), "kinds")
    several = stored(kinds.groupBy("ah").agg(F.count("*").alias("k")).filter("k > 1"), "several-kinds")
    wanted = with_counted_keys(kinds, several, ["ah"], "k", most_kinds).select("ah", "ctx", "own.*")

    # Bytes of one segment of each kind.
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("ah", "ctx", "at", "n")).alias("wanted"))
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["th"] == wanted["th"])
    parts = texts.join(wanted, same).select(texts["doc_id"], texts["th"], "text", "wanted")
    parts = parts.mapInArrow(partial(_fetched, length=length, gram=gram), PARTS).dropDuplicates(["ah", "ctx"])
    parts = stored(parts, "parts")

    # Refine anchors of too many kinds until their groups are small.
    sizes = several.withColumnRenamed("ah", "key")
    marks, ready = [], []
    while True:
        # Few keys, so they go to every task and the rows of a common one stay spread.
        large = F.broadcast(sizes.filter(f"k > {most_kinds}").select("key"))
        ready.append(parts.join(large, "key", "left_anti").select(*PART_NAMES))
        if large.isEmpty():
            break
        halves = parts.join(large, "key", "left_semi").select(*PART_NAMES).mapInArrow(partial(_halved, length=length), PARTS)
        halves = stored(halves, "halves")
        # Equal halves repeat as a whole, and one stands for them.
        first = F.min(F.struct("doc_id", "th", "at", "ah", "ctx", "off")).alias("first")
        equal = stored(halves.groupBy("key", "dig").agg(F.count("*").alias("c"), first), "equal-halves")
        last = F.col("off") + F.length("bytes") - (length - 1)
        whole = halves.select("key", "dig", "ah", "ctx", F.col("off").alias("a"), last.alias("b"))
        whole = with_counted_keys(whole, equal.filter("c > 1"), ["key", "dig"], "c", most_kinds)
        is_first = (F.col("ah") == F.col("first.ah")) & (F.col("ctx") == F.col("first.ctx")) & (F.col("a") == F.col("first.off"))
        marks.append(checkpointed(whole.select("ah", "ctx", "a", "b", (~is_first).alias("earlier"))))
        sizes = stored(equal.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1"), "sizes")
        parts = with_counted_keys(equal, sizes, ["key"], "k", most_kinds)
        parts = parts.select("key", "dig", "first.ah", "first.ctx", "first.off")
        parts = stored(halves.join(parts, ["key", "dig", "ah", "ctx", "off"]).select(*PART_NAMES), "refined")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = ready[0]
    for r in ready[1:]:
        small = small.unionByName(r)
    small = small.repartition(tasks, "key").sortWithinPartitions("key", "doc_id", "th", "at")
    marks.append(small.mapInArrow(partial(_arrays, length=length, at_once=1 << 20), MARKS))
    all_marks = marks[0]
    for m in marks[1:]:
        all_marks = all_marks.unionByName(m)
    if keep_first:
        all_marks = all_marks.filter("earlier")
    spans = all_marks.groupBy("ah", "ctx").agg(F.collect_set(F.struct("a", "b")).alias("marks"))

    # Back to every segment, and to documents.
    # Written first, so that the join has plain shuffles on both sides and a hot segment is split.
    kinds = stored(kinds.join(spans, ["ah", "ctx"], "left").filter("copies > 1 or marks is not null"), "marked-kinds")
    hit = found.join(kinds, ["ah", "ctx"])
    everything = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    some = F.coalesce("marks", F.array().cast("array<struct<a:int,b:int>>"))
    if keep_first:
        mine = F.struct("doc_id", "th", "at").eqNullSafe(F.struct("own.doc_id", "own.th", "own.at"))
        local = F.when(mine, some).otherwise(everything)
    else:
        local = F.when(F.col("copies") > 1, everything).otherwise(some)
    hit = hit.withColumn("marks", F.transform(local, lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b"))))
    hit = hit.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    same = texts["doc_id"].eqNullSafe(hit["doc_id"]) & (texts["th"] == hit["th"])
    rows = texts.join(hit, same, "left").select(texts["doc_id"], "text", "marks")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return rows.mapInArrow(partial(_cut, length=length), schema)
