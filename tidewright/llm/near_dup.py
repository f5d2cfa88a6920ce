"""Near duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A text's set holds its distinct word shingles (words between ASCII white space,
A-Z lower-cased; with fewer words than a shingle takes, the sequence as one).
Texts with equal sets form a class and count once.  A class's signature has
``chunks * 5`` components of 16 bits.  Two signatures that differ in fewer than
``2 * chunks`` components have, by pigeonhole, a chunk with at most one
difference; so each chunk is indexed under every way to leave one component out
and all such pairs meet in a bucket.  Pairs further apart that meet still count.
Whole sets confirm every link.

Only components are wanted, so most pairs of a bucket need no look.  Shingles
that no other class in question has bound what two sets can share: classes that
can't reach the threshold with any go, and pairs under the bound are left out.
In each bucket all are compared with the class that has fewest shingles of its
own, and what links merges.  Of a small bucket still in several components,
every class outside the largest is compared with all of the others: any pair
across components has such a class.  Large buckets that stay in several
components overlap a lot; what they connect forms groups, which are dealt into
blocks, and each two blocks of a group count their common shingles as a matrix
product.  This loses no link of a bucket, and no bucket is gathered in one task.

Sets hold keyed 128-bit digests made of the words' own, so distinct shingles are
told apart whatever the texts.

Null and empty texts, and those without words, have no shingles and no links:
their component is their own id.  Rows that repeat an id each get a row; a null
id takes part by its text but is never the name of a component, unless alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, few_files, id_and_text, slices, stored

GROUP = 5  # components per chunk, of which one may differ
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
@cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


KEY = b"tidewright words"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Words(dict):
    """Numbers of words seen of late, and a keyed 128-bit digest of each as two integers."""

    def __init__(self, key: bytes, limit: int = 100_000):
        self.key, self.limit, self.digests = key, limit, np.zeros((4096, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == len(self.digests):
            self.digests = np.concatenate([self.digests, np.zeros_like(self.digests)])
        self.digests[n] = np.frombuffer(hashlib.blake2b(word, digest_size=16, key=self.key).digest(), np.uint64)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.digests[at]


words_of = cache(Words)


def shingle_set(raw: bytes, width: int, key: bytes = KEY) -> np.ndarray:
    """The distinct shingles of a text as keyed 128-bit hashes: sorted rows of two integers."""
    words = raw.translate(LOWER).split()  # at space and bytes 9 to 13
    if not words:
        return np.zeros((0, 2), np.uint64)
    d, take = words_of(key).of(words), min(width, len(words))
    h = np.full((len(words) - take + 1, 2), U(take))
    for k in range(take):
        h = mixed(h * BASE + d[k : len(words) - take + 1 + k])
    h = h[np.argsort(h[:, 0], kind="stable")]
    same = h[1:, 0] == h[:-1, 0]
    if (same & (h[1:, 1] != h[:-1, 1])).any():  # first halves that collide
        return np.unique(h, axis=0)
    return h[np.concatenate([[True], ~same])]


def common_shingles(a: np.ndarray, b: np.ndarray) -> int:
    """How many rows two sorted sets share."""
    if any((x[1:, 0] == x[:-1, 0]).any() for x in (a, b)):
        return len(set(map(tuple, a.tolist())) & set(map(tuple, b.tolist())))
    _, i, j = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
    return int((a[i, 1] == b[j, 1]).sum())


@cache
def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * U(0xD1B54A32D192ED03))
    return seeds[:count] | U(1), seeds[count:]


def signature(shingles: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash components, each cut to 16 bits."""
    shingles = shingles[:, 0]
    a, b = permutations(count)
    low = np.full(count, U(2**64 - 1))
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[at : at + 2048, None] * a + b).min(0))
    return (mixed(low) >> U(48)).astype(np.uint64)


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of a signature: each chunk under each choice of a component left out."""
    groups = sig.reshape(-1, GROUP)
    keys = []
    for left_out in range(GROUP):
        kept = np.delete(groups, left_out, 1)
        packed = (kept << (U(16) * np.arange(GROUP - 1, dtype=np.uint64))).sum(1, dtype=np.uint64)
        tag = np.arange(len(groups), dtype=np.uint64) * U(GROUP) + U(left_out + 1)
        keys.append(mixed(packed ^ mixed(tag)))
    return np.concatenate(keys).view(np.int64)


ROWS = "doc_id long, th long, n_shingles long, cls binary, keys array<long>"


def _signed(batches: Iterator[pa.RecordBatch], width: int, chunks: int, secret: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            n, cls, keys = [], [], []
            for text in part.column(2):
                s = shingle_set(text.as_buffer().to_pybytes() if text.as_buffer() else b"", width, secret)
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(bucket_keys(signature(s, GROUP * chunks)) if len(s) else None)
            cols = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "n_shingles", "cls", "keys"]
            )


def _confirmed(batches: Iterator[pa.RecordBatch], width: int, percent: int, secret: bytes) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are alike enough."""
    last, own = None, None
    for batch in batches:
        ok = []
        for a, ta, tb in zip(batch.column(0), batch.column(2), batch.column(3)):
            if a != last:
                last, own = a, shingle_set(ta.as_buffer().to_pybytes(), width, secret)
            other = shingle_set(tb.as_buffer().to_pybytes(), width, secret)
            both = common_shingles(own, other)
            ok.append(100 * both >= percent * (len(own) + len(other) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch], width: int, secret: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = [np.unique(shingle_set(t.as_buffer().to_pybytes(), width, secret)[:, 0]).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "s"])


def _bounds(held: DataFrame, width: int, percent: int, secret: bytes) -> DataFrame:
    """``cls, n, most``: each class's shingles, and how many another class can share.

    Counted by half hashes: one that collides only makes a bound larger.

    Classes that can share too few for a link with any are left out.
    """
    sets = stored(held.select("cls", "text").mapInArrow(partial(_sets, width=width, secret=secret), "cls binary, s array<long>"), "sets")
    seen = sets.select(F.xxhash64("cls").alias("of"), F.explode("s").alias("s"))
    seen = seen.groupBy("s").agg(F.count("*").alias("c"), F.min("of").alias("of"))
    own = seen.filter("c = 1").groupBy("of").agg(F.count("*").alias("own"))
    bounds = sets.select("cls", F.xxhash64("cls").alias("of"), F.size("s").cast("long").alias("n")).join(own, "of", "left")
    bounds = bounds.withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).select("cls", "n", "most")
    return bounds.filter(F.col("most") * 100 >= F.col("n") * percent)


def _block_links(frame: pd.DataFrame, shingle: int, percent: int, secret: bytes) -> pd.DataFrame:
    """A forest of the links between two blocks of a group (or within one)."""
    sides = [frame[frame["block"] == b] for b in dict.fromkeys((frame["left"].iloc[0], frame["right"].iloc[0]))]
    names = pd.concat([s["cls"] for s in sides]).to_numpy()
    sets = [shingle_set(t.encode(), shingle, secret) for s in sides for t in s["text"]]
    sizes = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    _, first, at, seen = np.unique(every[:, 0], return_index=True, return_inverse=True, return_counts=True)
    if (every[first[at], 1] != every[:, 1]).any():  # half hashes that collide: by whole ones
        _, at, seen = np.unique(every, axis=0, return_inverse=True, return_counts=True)
    shared = seen[at] > 1
    of, at = of[shared], at[shared]
    column = np.cumsum(seen > 1)[at] - 1
    m = len(sides[0])
    rows, cols = np.arange(m), np.arange(len(sets)) if len(sides) == 1 else np.arange(m, len(sets))
    common = np.zeros((len(rows), len(cols)), np.int32)
    width = max(256, (1 << 23) // len(sets))  # a bounded matrix at a time; its float32 counts are exact
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        ones = np.zeros((len(sets), width), np.float32)
        ones[of[a:b], column[a:b] - low] = 1
        common += (ones[rows] @ ones[cols].T).astype(np.int32)
    # 100 c >= percent (union) with union = sum - c, in whole numbers.
    both = sizes[rows][:, None] + sizes[cols][None, :]
    x, y = np.nonzero((100 + percent) * common.astype(np.int64) >= percent * both)
    y = cols[y]
    root = np.arange(len(sets))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    child = np.flatnonzero(root != np.arange(len(sets)))
    return pd.DataFrame({"a": names[child], "b": names[root[child]]})


def _group_links(
    rows: DataFrame, held: DataFrame, width: int, percent: int, secret: bytes, block_rows: int = 2000, block_bytes: int = 1 << 23
) -> DataFrame:
    """Links between classes of groups that the buckets of ``rows`` connect.

    A group's blocks hold about ``block_rows`` texts or ``block_bytes`` bytes,
    whichever is less, and a text moves once for each block of its group.
    """
    low = rows.groupBy("key").agg(F.min("cls").alias("low"))
    edges = rows.join(low, "key").filter(F.col("cls") != F.col("low")).select(F.col("cls").alias("a"), F.col("low").alias("b"))
    groups = checkpointed(connected_components(edges))
    size = held.select(F.col("cls").alias("node"), F.octet_length("text").alias("size"))
    share = F.greatest(F.count("*") / block_rows, F.sum("size") / block_bytes)
    blocks = groups.join(size, "node").groupBy("root").agg(F.ceil(share).alias("blocks"))
    dealt = groups.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = [F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right")]
    dealt = dealt.select(F.col("node").alias("cls"), "root", F.col("block"), *pair).join(held, "cls")
    run = partial(_block_links, shingle=width, percent=percent, secret=secret)
    return dealt.groupBy("root", "left", "right").applyInPandas(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    chunks: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_hash: bool = False,
    small_bucket: int = 64,
    secret: bytes = KEY,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, and ``th``, the text's xxhash64, on request.

    Links texts whose sets share at least ``percent`` % of their union.
    ``secret`` keys the words' digests, so that nobody without it can write texts
    whose shingles collide.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
    signed = stored(texts.mapInArrow(partial(_signed, width=width, chunks=chunks, secret=secret), ROWS), "signed")
    found = signed.filter("cls is not null")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    classes = found.groupBy("cls").agg(F.min(order).alias("own"), F.min(F.struct("doc_id", "th", "keys")).alias("x"))
    classes = classes.select("cls", "own.doc_id", "own.th", "x.keys")
    classes = stored(few_files(classes, signed.count(), 20_000, even=True), "classes")

    # Buckets with at least two classes.
    index = classes.select(F.explode("keys").alias("key"), "cls")
    shared = index.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low < high")
    buckets = stored(index.join(shared.select("key"), "key"), "buckets")
    most = buckets.count()  # no table of buckets' rows below has more

    # Texts of their classes, bucketed so that each round moves pairs only.
    name = f"near_dup_texts_{uuid.uuid4().hex}"
    wanted = buckets.select("cls").distinct().join(classes.drop("keys"), "cls")
    same = wanted["doc_id"].eqNullSafe(texts["doc_id"]) & (wanted["th"] == texts["th"])
    held = texts.join(wanted, same).select("cls", "text").dropDuplicates(["cls"])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = held.repartition(tasks, "cls").sortWithinPartitions("cls")
    held.write.option("compression", "zstd").bucketBy(tasks, "cls").sortBy("cls").saveAsTable(name)
    held = spark.table(name)

    rows = stored(few_files(buckets.join(_bounds(held, width, percent, secret), "cls"), most), "bounded")
    able = F.least("most", "p_most")
    able = able * 100 >= (F.col("n") + F.col("p_n") - able) * percent
    as_pivot = [F.col(c).alias(f"p_{c}") for c in ("cls", "n", "most")]

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("cls", "p_cls").alias("a"), F.greatest("cls", "p_cls").alias("b")).distinct()
        pairs = pairs.join(held.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
        pairs = pairs.join(held.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
        check = partial(_confirmed, width=width, percent=percent, secret=secret)
        return pairs.select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary")

    # Every class of a bucket with the one that has the least share of own shingles.
    best = F.struct(F.try_divide("most", "n"), "cls", "n", "most")
    pivots = rows.groupBy("key").agg(F.max(best).alias("p")).select("key", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("cls", "n", "most")])
    star = rows.join(pivots, "key").filter((F.col("cls") != F.col("p_cls")) & able)
    links = checkpointed(few_files(confirmed(star), most))
    labels = connected_components(links)

    # Every class outside its bucket's largest component with those of other components.
    rows = rows.join(labels, rows["cls"] == labels["node"], "left")
    rows = rows.select("key", "cls", "n", "most", F.coalesce("root", "cls").alias("label"))
    rows = stored(few_files(rows, most), "labelled")
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("size"))
    top = F.max_by("label", F.struct("size", "label")).alias("top")
    largest = sizes.groupBy("key").agg(top, F.count("*").alias("labels"), F.sum("size").alias("size")).filter("labels > 1")
    largest = stored(few_files(largest, most, even=True), "open")
    small = largest.filter(F.col("size") <= small_bucket).select("key", "top")
    others = rows.join(small, "key").filter(F.col("label") != F.col("top"))
    others = others.select("key", F.col("label").alias("of"), *as_pivot)
    across = rows.join(others, "key").filter((F.col("label") != F.col("of")) & able)
    # A label stands for all it joins, so new links and old labels suffice.
    joins = labels.select(F.col("node").alias("a"), F.col("root").alias("b"))
    joins = joins.union(confirmed(across))
    large = largest.filter(F.col("size") > small_bucket).select("key", "size")
    if not large.isEmpty():
        joins = joins.union(_group_links(rows.join(large, "key"), held, width, percent, secret))
    labels = connected_components(joins)
    spark.sql(f"DROP TABLE IF EXISTS {name}")

    # Smallest id of each component.
    named = classes.select("cls", F.col("doc_id").alias("own")).join(labels, F.col("cls") == F.col("node"), "left")
    named = named.withColumn("root", F.coalesce("root", "cls"))
    # Written first, so that the join has plain shuffles on both sides and a large component is split.
    first = named.groupBy("root").agg(F.min("own").alias("component_id"))
    first = stored(few_files(first, classes.count(), even=True), "least-ids")
    named = named.join(first, "root").select("cls", "component_id")
    out = signed.drop("keys").join(named, "cls", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    hashed = ["th"] if keep_hash else []
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), *hashed)
