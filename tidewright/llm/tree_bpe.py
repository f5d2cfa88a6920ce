"""Byte-level BPE encoding and decoding by a monoid tree reduction.

Encodings form a monoid under "encoding of the joined bytes".  A piece is
halved down to short leaves; two neighbours are joined by encoding a window
around their boundary anew, which grows until the tokens left of it and right
of it are proven to stay: a sequence is the encoding of its bytes exactly when
each two adjacent tokens, encoded together, come back as the same two.
Decoding concatenates token bytes, which is associative as well.

Null and empty texts have no tokens; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import UnitCache, id_and_text, sized_slices

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class TreeEncoder:
    """Encodes with a rank file: base64 token, space, rank on each line."""

    def __init__(self, path: str, pattern: str, leaf: int = 16):
        with open(path, "rb") as f:
            lines = [x.split() for x in f.read().splitlines() if x]
        self.ranks = {base64.b64decode(t): int(r) for t, r in lines}
        self.leaf = leaf
        # White space by the Unicode property, as the library reads \s and \S.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        tokens = [b""] * (1 + max(self.ranks.values()))
        for t, r in self.ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.stays: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Tokens by repeated merging of the adjacent pair of lowest rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        while len(parts) > 1:
            found = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            low = min(found)
            if low == 1 << 60:
                break
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens a and b next to each other stay as they are."""
        if (known := self.stays.get((a, b))) is None:
            if len(self.stays) > 100_000:
                self.stays.clear()
            known = self.stays[a, b] = self.merged(a + b) == [a, b]
        return known

    def joined(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merged(b"".join(left[-a:] + right[:b]))
            fits_left = a == len(left) or self.stable(left[-a - 1], window[0])
            fits_right = b == len(right) or self.stable(window[-1], right[b])
            if fits_left and fits_right:
                return left[:-a] + window + right[b:]
            if not fits_left:
                a *= 2
            if not fits_right:
                b *= 2

    def tree(self, piece: bytes) -> list[bytes]:
        if piece in self.ranks:
            # As the library does: a piece that is a token is that token.
            return [piece]
        # Bottom-up over power-of-two spans, so no recursion limit on long pieces.
        row = [self.merged(piece[i : i + self.leaf]) for i in range(0, len(piece), self.leaf)]
        while len(row) > 1:
            odd = row[-1:] if len(row) % 2 else []
            row = [self.joined(x, y) for x, y in zip(row[::2], row[1::2])] + odd
        return row[0]

    def unit(self, text: str) -> bytes:
        """Ids of a stretch of text, as little-endian 32-bit integers."""
        ids = [self.ranks[t] for p in self.pattern.findall(text) for t in self.tree(p.encode())]
        return np.array(ids, "<u4").tobytes()

    def units(self, texts: list[str]) -> list[bytes]:
        return [self.unit(uncut(t)) for t in texts]

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, concatenated."""
        return gathered(ids, self.starts, self.lengths, self.flat)


#: A space before a character that no engine takes for white space begins a match.
CUT = re.compile(r" (?=[^\s\x1c-\x1f\x85])")
#: A space of which that isn't sure.
OTHER = re.compile(r" (?:[\s\x1c-\x1f\x85]|\Z)")


def cut_at_spaces(text: str) -> list[str]:
    """Units of a text that the pattern never matches across.

    A match holds a space only at its start or within white space, so a text is
    cut at each single space that a visible character follows.  The first unit
    is marked with a space in front; the others go without the space they begin
    with, and never begin with white space.
    """
    if not text:
        return []
    units = CUT.split(text) if OTHER.search(text) else text.split(" ")
    units[0] = " " + units[0]
    return units


#: A space of which that isn't sure, or an empty text, for Arrow's engine (its \\s is ASCII only).
ANY_OTHER = r" (?:[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)|\A\z"


LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
PLAIN_WORD = re.compile(LATIN).fullmatch
#: A plain word and the signs behind it, which are a match of their own.
WORD_AND_SIGNS = r"\A(?P<word>" + LATIN + r")(?P<signs>[!-&(-/:-@\[-`{-~]*)\z"


def unit_codes(texts: pa.Array, alone: tuple[str, ...] = ()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Units of many texts: units that occur, the place of each text's units in that list, and their number per text.

    As ``cut_at_spaces``, but texts without odd spaces are split and their units
    told apart in Arrow, and signs behind a plain word are a unit too, marked as
    the first one is.  A text with a string of ``alone`` is one unit.
    """
    odd = pc.match_substring_regex(texts, ANY_OTHER)
    for s in alone:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    odd = odd.to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    flat = plain.flatten().dictionary_encode()
    parts = pc.extract_regex(flat.dictionary, WORD_AND_SIGNS)
    is_word = parts.is_valid()
    words = pc.if_else(is_word, parts.field(0), flat.dictionary).dictionary_encode()
    signs = pc.if_else(is_word, parts.field(1), "").dictionary_encode()
    units = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    units = [u or " " for u in units]  # nothing: a text that begins with a space
    at = flat.indices.to_numpy()
    codes = np.empty((len(at), 2), np.int64)
    codes[:, 0] = words.indices.to_numpy()[at]
    codes[:, 1] = len(units) + signs.indices.to_numpy()[at]
    units += [" " + s for s in signs.dictionary.to_pylist()]
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(plain).to_numpy())]).astype(np.int64)
    marked = [" " + u for u in flat.dictionary.take(flat.indices.take(pa.array(first[:-1]))).to_pylist()]
    codes[first[:-1], 0] = len(units) + np.arange(len(marked))
    codes[first[:-1], 1] = len(units) + len(marked)
    units += [*marked, " "]
    codes, first = codes.ravel(), 2 * first
    n = np.zeros(len(texts), np.int64)
    n[~odd] = np.diff(first)
    if odd.any():
        others = [[" " + t] if any(s in t for s in alone) else cut_at_spaces(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        n[odd] = [len(us) for us in others]
        whole = np.empty(n.sum(), np.int64)
        from_plain = np.repeat(~odd, n)
        whole[from_plain] = codes
        whole[~from_plain] = len(units) + np.arange(len(whole) - len(codes))
        codes, units = whole, units + [u for us in others for u in us]
    return units, codes, n


def unit_ids(texts: pa.Array, known: UnitCache, alone: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many texts on end, and their number per text; ``known`` gives a unit's ids as bytes."""
    units, codes, n = unit_codes(texts, alone)
    held = known.ready(units)
    parts = pa.array(list(map(held.__getitem__, units)), pa.large_binary()).take(pa.array(codes))
    _, ends, flat = parts.buffers()
    ends = np.frombuffer(ends, np.int64)[parts.offset : parts.offset + len(parts) + 1] // 4 if len(parts) else np.zeros(1, np.int64)
    ids = np.frombuffer(flat, "<u4")[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, "<u4")
    return ids, np.diff(ends[np.concatenate([[0], np.cumsum(n)])])


def uncut(unit: str) -> str:
    """The stretch of text that a unit stands for."""
    return unit[1:] if unit[0] == " " else " " + unit


def gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenation of flat[starts[i] : starts[i] + lengths[i]] for i in ids."""
    n = lengths[ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[ids] - (ends - n), n) + np.arange(total)]


@cache
def encoder(path: str, pattern: str) -> tuple[TreeEncoder, UnitCache, tuple]:
    e = TreeEncoder(path, pattern)
    names = [b"%d," % i for i in range(len(e.lengths))]
    lengths = np.array([len(x) for x in names], np.int64)
    decimal = (np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(names), np.uint8))
    return e, UnitCache(e.units, 200_000), decimal


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, units, decimal = encoder(path, pattern)
    for batch in batches:
        for part in sized_slices(batch, 1, 1 << 23):
            rows = [[], [], [], []]
            every, sizes = unit_ids(part.column(1), units)
            for ids in np.split(every, np.cumsum(sizes)[:-1]):
                listed = gathered(ids, *decimal)[:-1].tobytes()
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(listed).hexdigest())
                rows[2].append(hashlib.sha256(enc.decoded(ids).tobytes()).hexdigest())
                if with_ids:
                    rows[3].append(ids.astype(np.int32))
            out = {"doc_id": part.column(0), "n_tokens": pa.array(rows[0], pa.int64())}
            out |= {"ids_sha256": pa.array(rows[1], pa.string()), "decoded_sha256": pa.array(rows[2], pa.string())}
            if with_ids:
                out["ids"] = pa.array(rows[3], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)


def bpe_round_trip(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encode every whole text and decode the ids again; no shuffle.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, where
    ``with_ids`` is set, the ids as ``array<int>``.
    """
    rows = id_and_text(docs, id_col, text_col)
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(partial(_encoded, path=ranks, pattern=pattern, with_ids=with_ids), schema)


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    enc, _, _ = encoder(path, pattern)
    for batch in batches:
        texts = [enc.decoded(np.array(x or [], np.int64)).tobytes() for x in batch.column(1).to_pylist()]
        out = {"doc_id": batch.column(0), "bytes": pa.array(texts, pa.binary())}
        yield pa.RecordBatch.from_pydict(out)


def bpe_decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` of a table with ``doc_id`` and ``ids``."""
    return encoded.select("doc_id", "ids").mapInArrow(
        partial(_decoded, path=ranks, pattern=pattern), "doc_id long, bytes binary"
    )
