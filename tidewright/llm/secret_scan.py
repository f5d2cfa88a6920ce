"""Secrets in whole texts, plain or under nested encodings.

A worklist holds layers still to scan.  The first is the text itself; scanning
a layer also unwraps what it encodes: percent escapes and Unicode escapes are
decoded in place over the whole layer, Base64 runs and compressed bytes become
layers of their own.  Compressed bytes may be written in a mix of escapes and
plain characters; they are looked for wherever their first bytes stand.  String
literals are also read as such, so that ``\\\\u0041`` becomes ``\\u0041`` and then a
letter.  An escape that holds itself many times (``%252525...``) is brought down
by as many levels at once as all such escapes of the layer have, so the time
doesn't grow with depth times length.  It ends when no layer is new.  A layer seen before (by
its content and origin) is not scanned again, which ends cycles such as an
archive that holds itself.  Each layer maps its characters to spans of the
original text, so a secret found three layers down is reported where its
outermost carrier stands.

Null and empty texts hold no secrets.  Repeated rows give repeated results.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u\{(?P<b>[0-9A-Fa-f]{1,6})\}|(?:\\u|%u)(?P<u>[0-9A-Fa-f]{4})|\\U(?P<w>[0-9A-Fa-f]{8})"
    r"|\\x(?P<x>[0-9A-Fa-f]{2})|&#(?P<d>[0-9]{1,7});|&#[xX](?P<h>[0-9A-Fa-f]{1,6});"
)
# Source code and JSON put a backslash before quotes and backslashes too.
STRING = re.compile(r"\\(?P<c>[abfnrtv\\'\"/])|" + ESCAPE.pattern)
PLAIN = re.compile(r"\\[abfnrtv\\'\"/]")
# An escape of the character that escapes begin with, again and again, and what it ends in.
_HEX = "[0-9A-Fa-f]"
NESTED = [
    (re.compile(f"({lead})((?:{unit})+)(?={last})"), re.compile(unit))
    for lead, unit, last in (
        ("%", "25", _HEX + "{2}"),
        ("%u", "0025u", _HEX + "{4}"),
        (r"\\u", "005[cC]u", _HEX + "{4}"),
        (r"\\U", "0000005[cC]U", _HEX + "{8}"),
        (r"\\x", "5[cC]x", _HEX + "{2}"),
        (r"\\u\{", r"0*5[cC]\}u\{", _HEX + r"{1,6}\}"),
        ("&#", "0*38;#", "[0-9]{1,7};"),
        ("&#[xX]", "0*26;#[xX]", _HEX + "{1,6};"),
    )
]
# 19 characters are the shortest encoding of a secret.
RUN = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{2,}={0,2}")
# Escapes of byte strings, as source code and JSON write them.
BYTES = re.compile(
    r"\\u00(?P<u>[0-9A-Fa-f]{2})|\\u\{0*(?P<b>[0-9A-Fa-f]{1,2})\}|%u00(?P<v>[0-9A-Fa-f]{2})|\\U000000(?P<w>[0-9A-Fa-f]{2})"
    r"|\\x(?P<x>[0-9A-Fa-f]{2})|&#0*(?P<d>[0-9]{1,3});|&#[xX]0*(?P<h>[0-9A-Fa-f]{1,2});|\\(?P<o>[0-3][0-7]{2}|0)|\\(?P<c>[abfnrtv\\'\"/])"
)
NAMED = dict(zip("abfnrtv\\'\"/", "\a\b\f\n\r\t\v\\'\"/"))
PRINTED = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f-\x9f]*\Z")
MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ\x00")
PACKED = re.compile("\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00")
NARROW = re.compile(r"[\x00-\xff]*")

Span = tuple[str, int, int]


def matches(text: str) -> Iterator[Span]:
    """Base matches: leftmost, non-overlapping for each kind; failing ones are consumed."""
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


class Layer:
    """Text, and where its characters come from: starts and ends in the original.

    ``starts`` is None if the layer is the original; a pair of ints if the
    whole layer comes from one span.
    """

    def __init__(self, text: str, starts=None, ends=None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return self.starts[a], self.ends[b - 1]

    def replaced(self, parts: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
        """In-place decoding: parts are (a, b, [(char, its a, its b)...]) in order."""
        text, at, starts, ends = [], 0, [], []
        uniform = isinstance(self.starts, int)

        def copied(a: int, b: int) -> None:
            text.append(self.text[a:b])
            if not uniform:
                starts.extend(range(a, b) if self.starts is None else self.starts[a:b])
                ends.extend(range(a + 1, b + 1) if self.ends is None else self.ends[a:b])

        for a, b, chars in parts:
            copied(at, a)
            for c, x, y in chars:
                text.append(c)
                if not uniform:
                    s, e = self.span(x, y)
                    starts.append(s)
                    ends.append(e)
            at = b
        copied(at, len(self.text))
        return Layer("".join(text), *((self.starts, self.ends) if uniform else (starts, ends)))


def percent_bytes(run: str) -> bytes:
    return bytes.fromhex(run.replace("%", ""))


def percent_decoded(layer: Layer, form: bool = False) -> Layer | None:
    """The layer with percent escapes decoded as UTF-8 (else Latin-1); of a form, with pluses as spaces."""
    parts = [(m.start(), m.end(), [(" ", *m.span())]) for m in re.finditer(r"\+", layer.text)] if form else []
    for m in PERCENT.finditer(layer.text):
        raw = percent_bytes(m[0])
        try:
            chars, wide = raw.decode(), [len(c.encode()) for c in raw.decode()]
        except UnicodeDecodeError:
            chars, wide = raw.decode("latin-1"), [1] * len(raw)
        at, out = m.start(), []
        for c, n in zip(chars, wide):
            out.append((c, at, at + 3 * n))
            at += 3 * n
        parts.append((m.start(), m.end(), out))
    return layer.replaced(sorted(parts)) if parts else None


def byte_views(layer: Layer) -> Iterator[Layer]:
    """Views with compressed bytes as Latin-1: the layer, and with percent or byte escapes decoded."""
    now = layer.text
    ways = [[]]
    if "%" in now:
        ways.append([])
        for m in PERCENT.finditer(now):
            chars = percent_bytes(m[0]).decode("latin-1")
            ways[1].append((m.start(), m.end(), [(c, m.start() + 3 * k, m.start() + 3 * k + 3) for k, c in enumerate(chars)]))
        if "+" in now:  # forms write a space as a plus
            ways.append(sorted(ways[1] + [(m.start(), m.end(), [(" ", *m.span())]) for m in re.finditer(r"\+", now)]))
    if "\\" in now or "&#" in now or "%u" in now:
        parts = []
        for m in BYTES.finditer(now):
            digits = m["u"] or m["b"] or m["v"] or m["w"] or m["x"] or m["h"]
            value = ord(NAMED[m["c"]]) if m["c"] else int(m["o"], 8) if m["o"] else int(m["d"]) if m["d"] else int(digits, 16)
            if value < 256:
                parts.append((*m.span(), [(chr(value), *m.span())]))
        ways.append(parts)
    for parts in ways:
        flat, at = [], 0
        for a, b, chars in parts:
            flat += [now[at:a], *(c for c, _, _ in chars)]
            at = b
        if PACKED.search("".join(flat) + now[at:]):
            yield layer.replaced(parts) if parts else layer


def packed_in(view: Layer) -> Iterator[tuple[bytes, int, int]]:
    """Compressed bytes that stand in the text, one after another, and where from."""
    at, start, raw = 0, 0, b""
    while m := PACKED.search(view.text, at):
        if m.start() >= start + len(raw):
            start, raw = m.start(), NARROW.match(view.text, m.start())[0].encode("latin-1")
        first = m.start() - start
        used = Unpacker(raw[k : k + 4096] for k in range(first, len(raw), 4096))
        some = sum(map(len, used))
        if some:
            stop = first + used.taken - len(used.rest)
            yield (raw[first:stop], *view.span(m.start(), start + stop))
        at = start + stop if some and used.whole else m.start() + 1


def escapes_decoded(layer: Layer, pattern: re.Pattern = ESCAPE) -> Layer | None:
    """The layer with backslash, %u and numeric entity escapes decoded; by STRING as a string literal."""
    parts: list = []
    for m in pattern.finditer(layer.text):
        if pattern is STRING and m["c"]:
            parts.append((*m.span(), [(NAMED[m["c"]], *m.span())]))
            continue
        value = int(m["d"]) if m["d"] else int(m["b"] or m["u"] or m["w"] or m["x"] or m["h"], 16)
        if value > 0x10FFFF:
            continue
        a, b = m.start(), m.end()
        if 0xDC00 <= value < 0xE000 and parts and parts[-1][1] == a and "\ud800" <= (h := parts[-1][2][0][0]) < "\udc00":
            a = parts[-1][0]
            value = 0x10000 + ((ord(h) - 0xD800) << 10) + value - 0xDC00
            parts[-1] = (a, b, [(chr(value), a, b)])
        else:
            parts.append((a, b, [(chr(value), a, b)]))
    return layer.replaced(parts) if parts else None


def less_nested(layer: Layer) -> Layer | None:
    """The layer as many single steps on as its escapes that hold themselves all allow, if that is several."""
    found = []
    for nested, unit in NESTED:
        for m in nested.finditer(layer.text):
            ends = [u.end() for u in unit.finditer(layer.text, *m.span(2))]
            found.append((m.start(), len(m[1]), ends))
    steps = min((len(ends) for _, _, ends in found), default=0)
    if steps < 2:
        return None
    parts = []
    for a, width, ends in sorted(found):
        b, keep = ends[steps - 1], width - 1  # the last characters of the unit are those after the first of the lead
        tail = [(layer.text[k], k, k + 1) for k in range(b - keep, b)]
        parts.append((a, b, [(layer.text[a], a, b - keep), *tail]))
    return layer.replaced(parts)


class Unpacker:
    """Iterates over the decompressed content of byte pieces, in pieces of bounded size.

    Members that follow one another, with or without zeros between, are read
    on as one content.  Ends without an error where bytes are cut or damaged.
    After the end, ``rest`` holds what followed the last whole member.
    """

    def __init__(self, pieces: Iterable[bytes], most: int = 1 << 20):
        self.pieces, self.most, self.rest = iter(pieces), most, b""
        self.taken, self.whole = 0, False

    def filled(self, raw: bytes, n: int) -> bytes:
        while len(raw) < n and (more := next(self.pieces, None)) is not None:
            raw += more
            self.taken += len(more)
        return raw

    def __iter__(self) -> Iterator[bytes]:
        raw = self.filled(b"", 6)
        while raw.startswith(MAGIC):
            if raw.startswith(b"BZh"):
                tool = bz2.BZ2Decompressor()
            elif raw.startswith(b"\xfd7zXZ\x00"):
                tool = lzma.LZMADecompressor()
            else:
                tool = zlib.decompressobj(47)
            try:
                while not tool.eof:
                    if not raw and getattr(tool, "needs_input", True) and not (raw := self.filled(b"", 1)):
                        if hasattr(tool, "flush") and (out := tool.flush()):
                            yield out
                        return  # cut short
                    out = tool.decompress(raw[: 1 << 16], self.most)
                    raw = (getattr(tool, "unconsumed_tail", b"")) + raw[1 << 16 :]
                    if out:
                        yield out
            except (zlib.error, OSError, ValueError, lzma.LZMAError, EOFError):
                self.rest = raw
                return
            self.whole = True
            self.rest = raw = tool.unused_data + raw
            self.rest = raw = self.filled(raw, 6)
            while raw[:1] == b"\0" and not (raw := raw.lstrip(b"\0")):
                raw = self.filled(raw, 6)
            raw = self.filled(raw, 6)
            if not raw.startswith(MAGIC):
                self.rest = raw


def deflated(raw: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """The content of a bare deflate stream, in pieces of bounded size; ends where it is damaged."""
    tool = zlib.decompressobj(-15)
    try:
        while raw and not tool.eof:
            if out := tool.decompress(raw, most):
                yield out
            raw = tool.unconsumed_tail
    except zlib.error:
        return


def is_deflate(raw: bytes) -> bool:
    """Whether the bytes are a whole bare deflate stream with content; it has no mark to go by."""
    tool, n = zlib.decompressobj(-15), 0
    try:
        while raw and not tool.eof:
            n += len(tool.decompress(raw, 1 << 20))
            raw = tool.unconsumed_tail
    except zlib.error:
        return False
    return tool.eof and n >= 8


def windows(pieces: Iterable[bytes], most: int) -> Iterator[bytes]:
    """The joined pieces in windows of ``most`` bytes, each with the last half of the one before."""
    pieces, held, size, fresh, later = iter(pieces), [], 0, True, False
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        fresh = True
        while size >= most:
            whole = b"".join(held)
            if not later and whole.startswith(MAGIC) and any(Unpacker([whole[: 1 << 16]])):
                # Compressed once more, and too large for a window: unpacked on the way.
                yield from windows(Unpacker(chain([whole], pieces)), most)
                return
            later = True
            yield whole[:most]
            held = [whole[most - most // 2 :]]
            size, fresh = len(held[0]), len(whole) > most
    if size and fresh:
        yield b"".join(held)


def unfolded(raw: bytes, a: int, b: int, most: int) -> Iterator[tuple[bytes, int, int]]:
    """Windows of the decompressed content, and what follows the compressed bytes."""
    pieces = Unpacker([raw])
    for window in windows(pieces, most):
        yield window, a, b
    if pieces.rest and len(pieces.rest) < len(raw):
        yield pieces.rest, a, b


def base64_bytes(run: str) -> bytes | None:
    run = re.sub(r"[\r\n=]", "", run).translate({45: 43, 95: 47})
    if len(run) % 4 == 1:
        return None
    return base64.b64decode(run + "=" * (-len(run) % 4))


def readable(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if PRINTED.match(text) else None


def texts_of(raw: bytes) -> Iterator[str]:
    """Readings of any bytes: UTF-8 or else Latin-1, and with zeros also UTF-16 and UTF-32."""
    try:
        yield raw.decode()
    except UnicodeDecodeError:
        yield raw.decode("latin-1")
    if b"\0" in raw:
        for width, code in ((2, "utf-16-le"), (4, "utf-32-le")):
            for skip in range(width):  # another byte order is the same, shifted
                yield (raw[skip:] + bytes(-len(raw[skip:]) % width)).decode(code, "replace")


def scan(text: str, most: int) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, each sorted by start, kind as listed, end."""
    base, found, seen = list(matches(text)), set(), set()
    work: list[Layer | tuple[bytes, int, int] | Iterator[tuple[bytes, int, int]]] = [Layer(text)]
    found.update(base)
    while work:
        item = work.pop()
        if isinstance(item, Iterator):  # windows, one at a time
            if (one := next(item, None)) is not None:
                work += [item, one]
            continue
        if isinstance(item, tuple):
            raw, a, b = item
            if (key := (hashlib.sha256(raw).digest(), a, b)) in seen:
                continue
            seen.add(key)
            if raw.startswith(MAGIC) and any(Unpacker([raw])):
                work.append(unfolded(raw, a, b, most))
            else:
                work.extend(Layer(t, a, b) for t in texts_of(raw))
                if readable(raw) is None and is_deflate(raw):
                    work.append(((w, a, b) for w in windows(deflated(raw), most)))
            continue
        if item.starts is not None:
            where = (item.starts, item.ends) if isinstance(item.starts, int) else None
            if (key := (hashlib.sha256(item.text.encode("utf-8", "surrogatepass")).digest(), where)) in seen:
                continue
            seen.add(key)
            for kind, a, b in matches(item.text):
                found.add((kind, *item.span(a, b)))
        now = item.text
        marked = "\\" in now or "&#" in now or "%u" in now
        if ("%25" in now or marked) and (inner := less_nested(item)) is not None:
            work.append(inner)
        else:
            if "%" in now and (inner := percent_decoded(item)) is not None:
                work.append(inner)
                if "+" in now:
                    work.append(percent_decoded(item, form=True))
            if marked and (inner := escapes_decoded(item)) is not None:
                work.append(inner)
            if "\\" in now and PLAIN.search(now) and (inner := escapes_decoded(item, STRING)) is not None:
                work.append(inner)
        for view in byte_views(item):
            work.extend(packed_in(view))
        runs = list(RUN.finditer(now))
        if any(m.end() - m.start() >= 60 for m in runs):
            runs += WRAPPED.finditer(now)
        for m in runs:
            tries = [(m.start(), m.end())]
            if re.search(r"[/+_-]", m[0]):  # a path or name may precede the encoded part
                tries += [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"[A-Za-z0-9]{19,}={0,2}", m[0])]
            rough = []
            for a, b in tries:
                raw = base64_bytes(now[a:b])
                if raw and (raw.startswith(MAGIC) and any(Unpacker([raw])) or readable(raw) is not None):
                    work.append((raw, *item.span(a, b)))
                    break
                if raw:
                    rough.append((raw, *item.span(a, b)))
            else:  # none is clean text: all are scanned as they are
                work.extend(rough)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(found, key=order)


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """The text with each maximal run of covered characters replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in spans:
        if a > at or not out:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanned(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            both = [scan(t, most) for t in part.column(1).to_pylist()]
            cols = [[[dict(zip(("kind", "start", "end"), s)) for s in x[i]] for x in both] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(cols[0], SPANS), pa.array(cols[1], SPANS)], names=["doc_id", "base", "spans"]
            )


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 1 << 28
) -> DataFrame:
    """``doc_id, base, spans`` of every whole text; no shuffle.

    Compressed content is scanned whole, in windows of ``most_bytes`` that
    overlap by half; that bounds memory, not what is scanned.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(partial(_scanned, most=most_bytes), SCHEMA)


def _redacted(batches: Iterator[pa.RecordBatch], column: int, most: int, mark: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = [t and redacted(t, scan(t, most)[1], mark) for t in part.column(column).to_pylist()]
            yield part.set_column(column, part.schema.field(column), pa.array(texts, part.schema.field(column).type))


def without_secrets(
    docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", most_bytes: int = 1 << 28
) -> DataFrame:
    """The same rows and columns, every found span of ``text_col`` replaced by ``mark``; nulls stay."""
    run = partial(_redacted, column=docs.columns.index(text_col), most=most_bytes, mark=mark)
    return docs.mapInArrow(run, docs.schema)
