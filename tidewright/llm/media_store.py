"""A chunk store for media columns, with content-defined cuts.

A payload becomes a medium: an 8-bit mono WAV file whose samples are the
payload's bytes.  A rolling gear hash over the file cuts it where the hash of
the last 32 bytes has zero top bits, so equal stretches of different media
are cut alike.  Chunks go by their digest.  Only digests are shuffled to find
the chunks of several media, and joins on the digest leave each chunk's bytes
with one owner; the others, most of all, never enter a join.  Every medium is an
ordered list of chunks, of which the store row holds the bytes it owns.

Media go by the first 16 bytes of their sha256.

Reading joins the bytes of foreign chunks back by digest, concatenates each
medium's chunks in order, and checks the file's sha256 before anything is
computed from it.  Equal media are stored and read once.

Null and empty texts give one padded block of spaces.  Repeated rows give
repeated results; a null id stays null.  A medium must fit in a worker's memory.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, slices, stored
from .near_dup import mixed

BLOCK = 192
GEAR = (mixed(np.arange(3001, 3257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload_of(raw: bytes) -> bytes:
    """Bytes padded with spaces to a positive multiple of the block."""
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """An uncompressed WAV file of 8-bit mono samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(medium: bytes) -> bytes:
    kind, _, form = struct.unpack_from("<4sI4s", medium)
    channels, bits, (name, size) = medium[22:24], medium[34:36], struct.unpack_from("<4sI", medium, 36)
    if (kind, form, name, channels, bits) != (b"RIFF", b"WAVE", b"data", b"\1\0", b"\x08\0"):
        raise ValueError("not an 8-bit mono WAV file")
    return medium[44 : 44 + size]


def cuts(data: bytes, least: int, usual: int, most: int) -> list[int]:
    """Ends of the chunks: at ``least`` to ``most`` bytes, ``usual`` (a power of two) beyond that on average."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 bytes by doubling
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    hits = (np.flatnonzero(h >> np.uint32(33 - usual.bit_length()) == 0) + 1).tolist()
    out, at, n = [], 0, len(data)
    while at < n:
        i = bisect_left(hits, at + least)
        at = min(hits[i] if i < len(hits) else n, at + most, n)
        out.append(at)
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def media_of(texts: pa.Array) -> list[bytes]:
    return [wav(payload_of(t.as_buffer().to_pybytes() if t.as_buffer() else b"")) for t in texts]


def media_id(medium: bytes) -> bytes:
    return hashlib.sha256(medium).digest()[:16]


def _listed(batches: Iterator[pa.RecordBatch], sizes: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Each row's medium, its size before padding, and the medium's different chunk digests."""
    for batch in batches:
        for part in slices(batch):
            media = media_of(part.column(1))
            digests = [list({digest_of(m[a:b]) for a, b in zip([0, *e], e)}) for m, e in ((m, cuts(m, *sizes)) for m in media)]
            out = {"doc_id": part.column(0), "media": pa.array(map(media_id, media), pa.binary())}
            out["n_bytes"] = pa.array([len(t.as_buffer() or b"") for t in part.column(1)], pa.int64())
            out["digests"] = pa.array(digests, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_pydict(out)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=9)
    for batch in batches:
        for part in slices(batch):
            media = media_of(part.column(0))
            cols = [pa.array(map(media_id, media), pa.binary()), pa.array(map(pack.compress, media), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["media", "packed"])


STORE = "media binary, ends array<int>, digests array<binary>, kinds array<tinyint>, bytes binary"
STORE_NAMES = [c.split()[0] for c in STORE.split(", ")]
OWN, LENT, FOREIGN, REPEAT = range(4)  # bytes here; here and asked for; with another medium; earlier in this one


def _owned(batches: Iterator[pa.RecordBatch], sizes: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Store rows: each medium's chunk list, and the bytes of the chunks it owns."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in slices(batch):
            out = [[] for _ in STORE_NAMES]
            for name, data, foreign, lent in zip(*[part.column(i).to_pylist() for i in range(4)]):
                medium = unpack.decompress(data)
                foreign, lent, seen = set(foreign or ()), set(lent or ()), set()
                ends, digests, kinds, kept = cuts(medium, *sizes), [], [], []
                for a, b in zip([0, *ends], ends):
                    d = digest_of(medium[a:b])
                    kind = FOREIGN if d in foreign else REPEAT if d in seen else LENT if d in lent else OWN
                    if kind in (OWN, LENT):
                        seen.add(d)
                        kept.append(medium[a:b])
                    digests.append(d)
                    kinds.append(kind)
                for col, x in zip(out, (name, ends, digests, kinds, b"".join(kept))):
                    col.append(x)
            types = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int8()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=STORE_NAMES)


def _lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owned chunks that other media refer to."""
    for batch in batches:
        digests, chunks = [], []
        for part in slices(batch):
            for row in part.to_pylist():
                at = 0
                for a, b, d, kind in zip([0, *row["ends"]], row["ends"], row["digests"], row["kinds"]):
                    if kind == LENT:
                        digests.append(d)
                        chunks.append(row["bytes"][at : at + b - a])
                    at += (b - a) * (kind in (OWN, LENT))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], names=["digest", "chunk"])


def features(samples: bytes, chunks: int) -> str:
    """Mean, deviation and crossings of the middle of the samples, and the number of chunks."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    above = x >= 128
    return f"mean={x.mean():.6f};deviation={x.std():.6f};crossings={int((above[1:] != above[:-1]).sum())};chunks={chunks}"


READ = "media binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for part in slices(batch):
            for row in part.to_pylist():
                chunks, pieces, at = {f["digest"]: f["chunk"] for f in row["foreign"] or []}, [], 0
                for a, b, d, kind in zip([0, *row["ends"]], row["ends"], row["digests"], row["kinds"]):
                    if kind in (OWN, LENT):
                        chunks[d] = row["bytes"][at : at + b - a]
                        at += b - a
                    pieces.append(chunks[d])
                medium = b"".join(pieces)
                digest = hashlib.sha256(medium).digest()
                if digest[:16] != row["media"]:
                    raise ValueError(f"medium {row['media'].hex()} doesn't match its digest")
                x = samples_of(medium)
                out.append((row["media"], len(x), hashlib.sha256(x).digest(), zlib.crc32(x[-16:]), len(medium), digest, features(x, len(pieces))))
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        names = [c.split()[0] for c in READ.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)


def write_media(
    docs: DataFrame,
    name: str,
    least: int = 4096,
    usual: int = 16384,
    most: int = 262144,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the chunk store as table ``name``; returns ``doc_id, media, n_bytes`` of every row.

    The store is bucketed by medium, so reading moves foreign chunks only.
    """
    spark = docs.sparkSession
    rows, sizes = id_and_text(docs, id_col, text_col), (least, usual, most)
    listed = "doc_id long, media binary, n_bytes long, digests array<binary>"
    seen = stored(rows.mapInArrow(partial(_listed, sizes=sizes), listed), "media")
    # Copies of a medium give equal places, which a minimum and a maximum count once.
    places = seen.select("media", F.explode("digests").alias("digest"))
    shared = places.groupBy("digest").agg(F.min("media").alias("owner"), F.max("media").alias("last"))
    shared = stored(shared.filter("owner < last").select("digest", "owner"), "shared")
    mine = F.col("owner") == F.col("media")
    flags = places.join(shared, "digest").groupBy("media").agg(
        F.collect_set(F.when(~mine, F.col("digest"))).alias("foreign"), F.collect_set(F.when(mine, F.col("digest"))).alias("lent")
    )
    # Copies meet before and after the shuffle; one is kept.
    data = rows.select("text").mapInArrow(_packed, "media binary, packed binary").groupBy("media").agg(F.first("packed").alias("packed"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = data.join(flags, "media", "left").mapInArrow(partial(_owned, sizes=sizes), STORE)
    whole = whole.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9")
    whole.bucketBy(tasks, "media").saveAsTable(name)
    return seen.select("doc_id", "media", "n_bytes")


def read_media(spark: SparkSession, name: str) -> DataFrame:
    """Rebuild and verify every medium of a store, and compute features of its samples."""
    store = spark.table(name)
    foreign = F.filter(F.arrays_zip("digests", "kinds"), lambda x: x["kinds"] == FOREIGN)
    foreign = store.select("media", F.explode(F.array_distinct(F.transform(foreign, lambda x: x["digests"]))).alias("digest"))
    lent = store.filter(F.array_contains("kinds", F.lit(LENT).cast("tinyint"))).mapInArrow(_lent, "digest binary, chunk binary")
    fetched = foreign.join(lent, "digest").groupBy("media").agg(F.collect_list(F.struct("digest", "chunk")).alias("foreign"))
    return store.join(fetched, "media", "left").mapInArrow(_rebuilt, READ)


def media_round_trip(docs: DataFrame, least: int, usual: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as a medium, read all back; a row per input row."""
    name = f"media_{uuid.uuid4().hex}"
    rows = write_media(docs, name, least, usual, most, id_col, text_col)
    back = stored(read_media(docs.sparkSession, name), "read-back")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    for c in ("payload_sha256", "media_sha256"):
        back = back.withColumn(c, F.lower(F.hex(c)))
    return rows.join(back, "media").drop("media")
