"""Token-id files: canonical length-limited Huffman codes in independent blocks.

A file set is two Parquet tables in one folder.  ``codes`` holds the code length
of each id that occurs, chosen from the counts over all documents by
package-merge; canonical order makes the codes themselves implicit.  ``blocks``
holds one row per block of at most ``block_ids`` ids: where its ids start in the
whole sequence, its documents with their shares, the packed code bits, and the
bit offset of each ``stride``-th id.  A block decodes without any other: each
checkpoint starts a lane, and all lanes step through a lookup table together.

Documents are in ascending ``doc_id`` order (null first; equal ids in any
order) and end with the id ``end_id``.  Null and empty texts hold just that id.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UnitCache, id_and_text, sized_slices, slices, stored
from .token_counts import byte_spelling
from .tree_bpe import PLAIN_WORD, uncut, unit_ids

RAW = "part int, block int, first long, docs array<long>, ordinals array<long>, shares array<int>, ids binary"
CODED = "part int, block int, start long, docs array<long>, ordinals array<long>, shares array<int>, n int, checkpoints array<int>, bits binary"


# ---- tokenizing -------------------------------------------------------------


class LibraryEncoder:
    """Ids by the tokenizers library, unit by unit.

    The library splits text by its pattern before any merge, so the units of a
    text encode apart.  Plain words go to the library without its splitting,
    which would leave them whole.  Texts with a special string go to the
    library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        names = self.lib.get_vocab()
        self.width = np.zeros(1 + max(names.values()), np.int64)  # bytes of each id
        for name, i in names.items():
            self.width[i] = len(name)  # byte-level: a character a byte
        spec = json.loads(self.lib.to_str())
        splits = spec["pre_tokenizer"] or {}
        known = splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        self.plain = known and spec["normalizer"] is None
        self.word_lib = Tokenizer.from_file(path)
        self.word_lib.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        spelling = byte_spelling()
        # Plain words hold no line feed, so it stays to part them.
        self.space, self.spelling = spelling[32], {i: c for i, c in enumerate(spelling) if c != chr(i) and i != 10}
        self.cache = UnitCache(self.units, 500_000)

    def cut(self, encodings: list, sizes: list[np.ndarray]) -> list[bytes]:
        """Ids of the pieces of joined texts, from the size in bytes of each piece."""
        out = []
        for enc, size in zip(encodings, sizes):
            ids = np.array(enc.ids, "<u4")
            ends, want = np.cumsum(self.width[ids]), np.cumsum(size)
            cuts = np.searchsorted(ends, want, "right")
            if not len(ends) or not np.array_equal(ends[cuts - 1], want):
                raise ValueError("the vocabulary isn't byte-level")
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def encoded_words(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space in front, 500 at a time."""
        runs = [words[i : i + 500] for i in range(0, len(words), 500)]
        joined = ["\n".join([self.space + w for w in run]) for run in runs]
        sizes = [np.array([len(w) + 1 for w in run]) for run in runs]
        for i, run in enumerate(runs):
            if not "".join(run).isascii():
                spelled = "\n".join([" " + w for w in run]).encode().decode("latin-1").translate(self.spelling)
                joined[i], sizes[i] = spelled, np.array([len(w) for w in spelled.split("\n")])
        return self.cut(self.word_lib.encode_batch_fast(joined, add_special_tokens=False), sizes)

    def joined(self, texts: list[str]) -> list[bytes]:
        """Ids of stretches that each begin with a space and don't end in white space."""
        runs = [texts[i : i + 500] for i in range(0, len(texts), 500)]
        found = self.lib.encode_batch_fast(["".join(run) for run in runs], add_special_tokens=False)
        return self.cut(found, [np.array([len(t.encode()) for t in run]) for run in runs])

    def apart(self, texts: list[str]) -> list[bytes]:
        found = self.lib.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def units(self, texts: list[str]) -> list[bytes]:
        """Ids of units: plain words, other stretches within texts, what stands apart."""
        words, others, inner, marked = [], [], [], []
        for t in texts:
            if t[0] == " ":
                marked.append(t)
            elif not (self.plain and PLAIN_WORD(t)):
                inner.append(t)
            else:
                (words if t.isascii() else others).append(t)
        words += others  # apart, so that few runs need another spelling
        found = dict(zip(words, self.encoded_words(words)))
        found.update(zip(inner, self.joined(list(map(uncut, inner)))))
        found.update(zip(marked, self.apart(list(map(uncut, marked)))))
        return list(map(found.__getitem__, texts))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        ids, n = unit_ids(texts, self.cache, tuple(self.special))
        return np.split(ids, np.cumsum(n)[:-1])


library = cache(LibraryEncoder)


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    """Rows of RAW from documents in order; ``first`` counts from the partition's start."""
    enc = library(path)
    end = np.array([end_id], "<u4")
    block = first = ordinal = held = part_no = 0
    docs, ordinals, shares, kept = [], [], [], []

    def flushed() -> pa.RecordBatch:
        row = {"part": [part_no], "block": [block], "first": [first], "docs": [docs], "ordinals": [ordinals]}
        row |= {"shares": [shares], "ids": [np.concatenate(kept).astype("<u4").tobytes()]}
        return pa.RecordBatch.from_pylist([{k: v[0] for k, v in row.items()}], schema=RAW_ARROW)

    for batch in batches:
        for part in sized_slices(batch, 2):
            for part_no, doc, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), enc.encode(part.column(2))):
                ids = np.concatenate([ids, end])
                while len(ids):
                    now, ids = ids[: block_ids - held], ids[block_ids - held :]
                    docs.append(doc), ordinals.append(ordinal), shares.append(len(now)), kept.append(now)
                    held += len(now)
                    if held == block_ids:
                        yield flushed()
                        block, first, held = block + 1, first + held, 0
                        docs, ordinals, shares, kept = [], [], [], []
                ordinal += 1
    if held:
        yield flushed()


RAW_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("first", pa.int64()),
        ("docs", pa.list_(pa.int64())),
        ("ordinals", pa.list_(pa.int64())),
        ("shares", pa.list_(pa.int32())),
        ("ids", pa.binary()),
    ]
)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids in batch.column(0):
            now = np.bincount(np.frombuffer(ids.as_buffer(), "<u4"))
            if len(now) > len(total):
                now, total = total, now
            total[: len(now)] += now
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])


# ---- codes ------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts, by package-merge.

    On each level the coins are the symbols and the pairs of the level before;
    a symbol's length is the number of levels on which it is among those that
    the cheapest 2n-2 coins of the last level stand for.
    """
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need more than {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    own = counts[order].astype(np.float64)
    levels, pairs = [], np.zeros(0)
    for _ in range(max_bits):
        coins = np.concatenate([own, pairs])
        by = np.argsort(coins, kind="stable")
        coins = coins[by]
        levels.append(by < n)
        even = len(coins) // 2 * 2
        pairs = coins[:even:2] + coins[1:even:2]
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for is_own in reversed(levels):
        symbols = int(is_own[:need].sum())
        lengths[:symbols] += 1
        need = 2 * (need - symbols)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codes:
    """Canonical codes: ids by length, then id, take consecutive values."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, max_bits: int):
        by = np.lexsort((ids, lengths))
        self.max_bits = max_bits
        ids, lengths = ids[by], lengths[by]
        spans = np.left_shift(1, max_bits - lengths)
        at = np.cumsum(spans) - spans
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids] = (at >> (max_bits - lengths)).astype(np.uint64)
        self.length[ids] = lengths
        fill = (1 << max_bits) - int(spans.sum())
        self.symbols = np.concatenate([np.repeat(ids, spans), np.zeros(fill, np.int64)]).astype(np.uint32)
        self.lengths = np.concatenate([np.repeat(lengths, spans), np.ones(fill, np.int64)]).astype(np.uint8)

    def pack(self, ids: np.ndarray, stride: int) -> tuple[bytes, np.ndarray]:
        """Code bits, most significant first, and the bit offset of each stride-th id."""
        size = self.length[ids]
        ends = np.cumsum(size)
        at, code = ends - size, self.code[ids]
        words = np.zeros(int(ends[-1]) // 64 + 2, ">u8")
        word = at >> 6
        room = 64 - (at & 63) - size
        inside = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(inside, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.tobytes()[: (int(ends[-1]) + 7) // 8], at[::stride]

    def unpack(self, bits: bytes, n: int, checkpoints: np.ndarray, stride: int) -> np.ndarray:
        """The n ids of a block; each checkpoint's lane takes a step per lookup."""
        padded = bits + bytes(-len(bits) % 8 + 8 * (2 + stride * self.max_bits // 64))
        words = np.frombuffer(padded, ">u8").astype(np.uint64)
        at = checkpoints.astype(np.int64)
        out = np.empty((len(at), stride), np.uint32)
        shift, one, low = np.uint64(64 - self.max_bits), np.uint64(1), np.uint64(63)
        for k in range(stride):
            word = at >> 6
            off = (at & 63).astype(np.uint64)
            peek = ((words[word] << off) | ((words[word + 1] >> one) >> (low - off))) >> shift
            peek = peek.astype(np.int64)
            out[:, k] = self.symbols[peek]
            at = at + self.lengths[peek]
        return out.ravel()[:n]


def _packed(frames, codes_of, stride: int):
    codes = codes_of()
    for batch in frames:
        for one in slices(batch, 1):
            bits, marks = codes.pack(np.frombuffer(one.column(6)[0].as_buffer(), "<u4"), stride)
            n = len(one.column(6)[0].as_buffer()) // 4
            cols = [one.column(i) for i in range(6)]
            cols += [pa.array([n], pa.int32()), pa.array([marks], pa.list_(pa.int32())), pa.array([bits], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CODED.split(", ")])


SEGMENTS = "part int, ordinal long, doc_id long, start long, n long, crc long, open boolean"


def _read(batches: Iterator[pa.RecordBatch], codes_of, stride: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Each document's share of each block: position, length, checksum, ids on request.

    ``open`` marks the first and last share of a block, which may go on in a
    neighbouring block.
    """
    codes = codes_of()
    for batch in batches:
        for row in batch.to_pylist():
            ids = codes.unpack(row["bits"], row["n"], np.array(row["checkpoints"]), stride)
            ends = np.cumsum(np.array(row["shares"], np.int64))
            starts = ends - row["shares"]
            raw, m = ids.astype("<u4").tobytes(), len(ends)
            out = {
                "part": pa.array([row["part"]] * m, pa.int32()),
                "ordinal": pa.array(row["ordinals"], pa.int64()),
                "doc_id": pa.array(row["docs"], pa.int64()),
                "start": pa.array(row["start"] + starts, pa.int64()),
                "n": pa.array(row["shares"], pa.int64()),
                "crc": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64()),
                "open": pa.array([i in (0, m - 1) for i in range(m)], pa.bool_()),
            }
            if with_ids:
                out["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts, ends)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)


class _Code:
    """Codes made once per Python worker from a broadcast of lengths (bounded by the vocabulary)."""

    made: dict = {}

    def __init__(self, spark: SparkSession, ids: list[int], lengths: list[int], max_bits: int, key: str):
        self.sent = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(lengths, np.int64)))
        self.max_bits, self.key = max_bits, key

    def __call__(self) -> Codes:
        if self.key not in self.made:
            self.made.clear()
            self.made[self.key] = Codes(*self.sent.value, self.max_bits)
        return self.made[self.key]


def write_ids(
    docs: DataFrame,
    vocabulary: str,
    folder: str,
    end_id: int = 0,
    block_ids: int = 1 << 17,
    stride: int = 128,
    max_bits: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text and write its ids, in document order, to ``folder``.

    Rows that share an id stand in any order.

    One range shuffle of the texts orders them.  The driver holds code lengths
    (as many as the vocabulary has ids) and one count per partition.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id may fill several ranges, by their text's hash; so may equal rows, by where they were read.
    place = [F.col("doc_id"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")]
    ordered = rows.select("text", *place).repartitionByRange(tasks, "doc_id", "hash", "row").sortWithinPartitions("doc_id")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    raw = ordered.mapInArrow(partial(_tokenized, path=vocabulary, end_id=end_id, block_ids=block_ids), RAW)
    raw = stored(raw, "ids")
    counts = raw.select("ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = counts.orderBy("id").toArrow().to_pandas()
    found = code_lengths(counts["n"].to_numpy(), max_bits) if len(counts) else np.zeros(0, np.int64)
    table = pd.DataFrame({"id": counts["id"].astype("int64"), "length": found.astype("int32")})
    lengths = spark.createDataFrame(table, "id long, length int")
    lengths = lengths.withColumn("max_bits", F.lit(max_bits)).withColumn("stride", F.lit(stride))
    lengths.coalesce(1).write.parquet(f"{folder}/codes")
    # Where each partition's ids start: one row per partition, summed in order.
    size = F.sum(F.aggregate("shares", F.lit(0).cast("long"), lambda a, x: a + x)).alias("size")
    parts = raw.groupBy("part").agg(size).orderBy("part").toArrow().to_pandas()
    begin = (parts["size"].cumsum() - parts["size"]).astype("int64")
    bases = spark.createDataFrame(pd.DataFrame({"part": parts["part"].astype("int32"), "base": begin}), "part int, base long")
    placed = raw.join(F.broadcast(bases), "part").withColumn("first", F.col("first") + F.col("base")).drop("base")
    codes_of = _Code(spark, table["id"].tolist(), table["length"].tolist(), max_bits, folder)
    packed = placed.select(*raw.columns).mapInArrow(partial(_packed, codes_of=codes_of, stride=stride), CODED)
    packed.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def crc_of_joined(crcs: list[int], sizes: list[int]) -> int:
    """crc32 of concatenated parts from the crc32 and size in bytes of each.

    Appending n zero bytes acts on a crc as a linear map over bits, whose
    powers of two come by squaring.
    """

    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if vector & 1:
                out ^= row
            vector >>= 1
        return out

    total = crcs[0]
    for crc, size in zip(crcs[1:], sizes[1:]):
        shift = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
        n = 8 * size
        while n:
            if n & 1:
                total = times(shift, total)
            shift = [times(shift, row) for row in shift]
            n >>= 1
        total ^= crc
    return total


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of a file set: ``doc_id, start, n_tokens, ids_crc32``; ``ids`` on request.

    Only shares at a block's edge can belong to a document of several blocks;
    the others need no shuffle.  Blocks are decoded once: the shares are written
    before the two kinds part.
    """
    table = spark.read.parquet(f"{folder}/codes").toArrow().to_pandas()  # at most the vocabulary
    blocks = spark.read.schema(CODED).parquet(f"{folder}/blocks")
    max_bits, stride = (int(table["max_bits"][0]), int(table["stride"][0])) if len(table) else (1, 1)
    codes_of = _Code(spark, table["id"].tolist(), table["length"].tolist(), max_bits, folder)
    schema = SEGMENTS + (", ids array<int>" if with_ids else "")
    shares = stored(blocks.mapInArrow(partial(_read, codes_of=codes_of, stride=stride, with_ids=with_ids), schema), "shares")
    extra = ["ids"] if with_ids else []
    whole = shares.filter("not open").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), *extra)
    joined = F.udf(lambda rows: crc_of_joined([r["crc"] for r in rows], [4 * r["n"] for r in rows]), T.LongType())
    parts = F.array_sort(F.collect_list(F.struct("start", "n", "crc", *extra)))
    edges = shares.filter("open").groupBy("part", "ordinal").agg(F.first("doc_id").alias("doc_id"), parts.alias("parts"))
    edges = edges.select(
        "doc_id",
        F.col("parts")[0]["start"].alias("start"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_tokens"),
        joined("parts").alias("ids_crc32"),
        *([F.flatten("parts.ids").alias("ids")] if with_ids else []),
    )
    return whole.unionByName(edges)
