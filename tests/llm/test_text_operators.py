import base64
import bz2
import gzip
import json
import lzma
import hashlib
import random
import re
import urllib.parse
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidewright.llm.id_files import LibraryEncoder, code_lengths, crc_of_joined, read_ids, write_ids
from tidewright.llm.media_store import cuts, media_round_trip
from tidewright.llm.secret_scan import redacted, scan, secret_spans
from tidewright.llm.token_counts import token_counts
from tidewright.llm.toxicity import fit_toxicity, held_out, toxicity_scores, without_toxic
from tidewright.llm.tree_bpe import bpe_decode, bpe_round_trip

PIECES = ["a", "the", "in", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "é", "Σ", "ΑΣ", "İ", "'s", "'LL", "12", "漢字", "😀"]
PIECES += ["<|endoftext|>", "<|startoftext|>", "-", "\x00", "ſ", "​", "ﬁ", "zzzzqx"]


def texts():
    rng = random.Random(4)
    out = [None, "", " ", "x" * 3000, "ab" * 900, "\n\n \n", "<|endoftext|>", "word " * 2500]
    out += ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts())]
    rows += [rows[3], rows[20], (None, "no id", "clash", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)


def expected(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def key(row):
    return tuple((v is None, v) for v in row)


def test_token_counts(docs):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [(d, len(t.encode()), n := len(lib.encode(t, add_special_tokens=False).ids), n > 50) for d, t in expected(docs)]
    got = token_counts(docs, P.path("word_bpe_49k.json"), limit=50).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_bpe_round_trip(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in expected(docs):
        ids = lib.encode_ordinary(t)
        want.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())))
    coded = bpe_round_trip(docs, path, P.PATTERN, with_ids=True)
    got = [tuple(r)[:4] for r in coded.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    back = bpe_decode(coded, path, P.PATTERN).collect()
    assert sorted((r["doc_id"] or -1, bytes(r["bytes"])) for r in back) == sorted((d or -1, t.encode()) for d, t in expected(docs))
    assert bpe_round_trip(docs.limit(0), path, P.PATTERN).count() == 0


def test_id_files(spark, docs, tmp_path):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, at = [], 0
    for d, t in sorted(expected(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    write_ids(docs, P.path("byte_bpe_50k.json"), str(tmp_path / "a"), block_ids=700, stride=64)
    got = sorted(map(tuple, read_ids(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert got == want
    rows = read_ids(spark, str(tmp_path / "a"), with_ids=True).collect()
    by_text = {(r["doc_id"]): r["ids"] for r in rows}
    assert by_text[3] == lib.encode(texts()[3], add_special_tokens=False).ids + [0]
    write_ids(docs.limit(0), P.path("byte_bpe_50k.json"), str(tmp_path / "b"))
    assert read_ids(spark, str(tmp_path / "b")).count() == 0


def test_code_lengths_against_plain_huffman():
    import heapq

    rng = np.random.default_rng(1)
    for n in (2, 3, 17, 200):
        counts = rng.integers(1, 1000, n)
        heap = [(int(c), i, [i]) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        depth, tie = [0] * n, n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
            tie += 1
        found = code_lengths(counts, 24)
        assert (found * counts).sum() == sum(d * c for d, c in zip(depth, counts))
        short = code_lengths(counts, 8)
        assert short.max() <= 8 and (2.0**-short).sum() <= 1
    assert crc_of_joined([zlib.crc32(b"abc"), zlib.crc32(b""), zlib.crc32(b"de" * 99)], [3, 0, 198]) == zlib.crc32(b"abc" + b"de" * 99)


def base_spans(text):
    out = []
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8)]
    kinds += [("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32)]
    for k, p, least in kinds:
        for m in re.finditer(p, text, re.I | re.A if k == "assign" else 0):
            if len(m[2] if k == "assign" else m[0]) >= least:
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


def test_secret_layers():
    plain = "token=abcdefgh12"
    for wrap in (
        lambda x: b64(x),
        lambda x: b64(gzip.compress(x.encode())),
        lambda x: b64(zlib.compress(b64(x).encode())),
        lambda x: urllib.parse.quote(urllib.parse.quote(x, safe=""), safe=""),
        lambda x: "".join(f"\\u{ord(c):04x}" for c in x),
        lambda x: "".join(f"&#{ord(c)};" for c in x),
        lambda x: b64(b64("".join(f"%{ord(c):02X}" for c in x))),
    ):
        text = "éé " + wrap(plain) + " end"
        base, found = scan(text, 1 << 20)
        assert base == base_spans(text)
        assert found == [("assign", 3, len(text) - 4)], text
        assert redacted(text, found, "#") == "éé # end"
    assert scan("password: token: abcdefgh12", 1 << 20)[0] == []
    assert scan("ſecret=abcdefgh1", 1 << 20)[0] == []


def test_bare_deflate_layer():
    tool = zlib.compressobj(9, zlib.DEFLATED, -15)
    text = "see " + b64(tool.compress(b"some words then token=abcdefgh12 and more") + tool.flush()) + " end"
    assert scan(text, 1 << 20)[1] == [("assign", 4, len(text) - 4)]


def quoted(raw, safe="/"):
    return urllib.parse.quote(raw, safe=safe)


def test_secret_layers_in_other_writings():
    plain = b"password = hunter2hunter2 and some more text " + bytes(range(32, 127))
    other = gzip.compress(b"nothing here ") + gzip.compress(plain)
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        raw = pack(plain)
        two = pack(b"nothing here ") + pack(plain)
        wraps = [quoted(raw), quoted(raw, ""), urllib.parse.quote_plus(raw), quoted(two), b64(two), quoted(b64(raw), "")]
        wraps += ["".join(f"\\x{c:02x}" for c in raw), json.dumps(raw.decode("latin-1"))[1:-1], repr(raw)[2:-1], repr(two)[2:-1]]
        wraps += ["".join(f"&#{c};" for c in raw), b64(other + b"\0" * 9), b64(pack(plain + b"\x01\xff")), b64(plain + b"\x01")]
        wraps += [b64(pack(plain.decode().encode(code))) for code in ("utf-16", "utf-16-be", "utf-32")]
        wraps += [b64(pack(pack(plain))), b64(pack(b"a b " * 1000 + plain + b" c d" * 1000)), b64(raw + b" token=abcdefgh12")]
        for k, w in enumerate(wraps):
            text = "éé " + w + " end"
            spans = scan(text, 512)[1]
            assert spans and all(3 <= a < b <= len(text) - 4 for _, a, b in spans), (pack, k, spans)


def test_secrets_under_random_nestings():
    rng = random.Random(31)
    packed = lambda f: lambda s: base64.b64encode(f(s.encode())).decode()
    each = lambda form: lambda s: "".join(form.format(ord(c)) for c in s)
    ways = [str, urllib.parse.quote, urllib.parse.quote_plus, packed(bytes), packed(gzip.compress), packed(zlib.compress), packed(bz2.compress), json.dumps]
    ways += [each(f) for f in ("%{:02X}", "\\u{:04x}", "\\u{{{:x}}}", "\\U{:08x}", "\\x{:02x}", "%u{:04X}", "&#{};", "&#x{:x};")]
    ways += [lambda s: json.dumps(each("\\u{:04x}")(s)), lambda s: each("%{:02x}")(gzip.compress(s.encode()).decode("latin-1"))]
    for _ in range(200):
        said = "password = hunter2hunter2x"
        for way in rng.choices(ways, k=rng.randint(1, 5)):
            said = way(said) if len(said) < 50_000 else said
        spans = scan(f"Words before {said} and after", 1 << 28)[1]
        assert any(k == "assign" and a >= 13 and b <= 14 + len(said) for k, a, b in spans), said[:300]


def test_deep_nesting_takes_no_square_of_time():
    import time

    began = time.time()
    for text in ("%" + "25" * 300_000 + "41", "\\u" + "005cu" * 60_000 + "0041", "&#" + "38;#" * 60_000 + "65;", "\\" * 60_000 + "u0041"):
        scan(text, 1 << 28)
    assert time.time() - began < 30
    deep = "password%" + "25" * 40 + "3Dabcdefgh%" + "25" * 7 + "31"
    assert ("assign", 0, len(deep)) in scan(deep, 1 << 28)[1]


def test_secret_spans(spark):
    rows = [(1, None), (2, ""), (3, "api_key = 'ABCDEFGH1' " + "f" * 40 + " AKIA" + "Q" * 12), (3, "x"), (None, "SECRET:12345678")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["base"])) for r in secret_spans(df).collect()}
    assert got == {(d, tuple(base_spans(t or ""))) for d, t in rows}


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, marks = [], []
    for i in range(900):
        text = rng.choices(words, k=rng.randint(5, 60))
        bad = i % 4 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["zorkvile", "quzzling", "vexomort"])
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in toxicity_scores(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    out = [(got[d]["predicted"], y) for d, y in marks if got[d]["held_out"]]
    assert sum(p == y for p, y in out) / len(out) > 0.95
    assert not any(p and not y for p, y in out)
    # Labels of held-out rows have no influence.
    flipped = [(d, 1 - y if got[d]["held_out"] else y) for d, y in marks]
    again = fit_toxicity(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert {r["doc_id"]: r["score"] for r in toxicity_scores(docs, again).collect()} == {d: r["score"] for d, r in got.items()}
    kept = {r["doc_id"] for r in without_toxic(docs, model).collect()}
    assert kept == {d for d, r in got.items() if not r["predicted"]}
    none = fit_toxicity(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity_scores(docs, none).collect()} == {0}


def test_media_round_trip(spark):
    rng = random.Random(3)
    shared = "".join(rng.choice("abcd efgh") for _ in range(9000))
    rows = [(1, None), (2, ""), (3, shared), (4, shared), (5, "x" + shared), (6, shared[4000:] + "é"), (7, "a" * 50_000), (None, "id"), (3, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "x")
    got = media_round_trip(df, least=64, usual=256, most=2048).collect()
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(want, key=key)


def test_cuts_follow_content():
    rng = random.Random(6)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    one = cuts(data, 64, 512, 4096)
    assert one[-1] == len(data) and all(64 <= b - a <= 4096 for a, b in zip([0, *one], one[:-1]))
    two = [x - 7 for x in cuts(b"1234567" + data, 64, 512, 4096)]
    assert len(set(one) & set(two)) > 0.9 * len(one)


def test_a_weighted_fit_equals_repeated_rows():
    from tidewright.llm.toxicity import fit_logistic

    rng = np.random.default_rng(1)
    lists = [np.flatnonzero(rng.random(30) < 0.2) for _ in range(80)]
    y, counts, scale = (rng.random(80) < 0.4).astype(float), rng.integers(1, 5, 80), rng.normal(size=30)
    one = fit_logistic(np.concatenate(lists), np.array([len(x) for x in lists]), y, scale, 1e-2, 4000, counts.astype(float))
    many = [x for x, k in zip(lists, counts) for _ in range(k)]
    two = fit_logistic(np.concatenate(many), np.array([len(x) for x in many]), np.repeat(y, counts), scale, 1e-2, 4000)
    assert np.abs(one[0] - two[0]).max() < 1e-6 and abs(one[1] - two[1]) < 1e-6


def test_a_rare_label_keeps_its_rows(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=12) + (["zorkvile"] if i % 20 == 0 else []))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(3000)], "doc_id long, toxic int")
    got = toxicity_scores(docs, fit_toxicity(docs, labels, fit_rows=300)).collect()
    out = [(r["score"], r["doc_id"] % 20 == 0) for r in got if r["held_out"]]
    assert all(p >= 0.7 for p, bad in out if bad) and all(p < 0.7 for p, bad in out if not bad)
    assert sum(p for p, bad in out if not bad) / len(out) < 0.1


def test_runs_of_plain_and_accented_words_encode_as_the_library_does():
    """More than one run of each kind, texts without units between, and a batch of empty texts alone."""
    path = P.path("byte_bpe_50k.json")
    enc = LibraryEncoder(path)
    words = [f"{'aeiou'[i % 5]}{'brst'[i % 4]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(1300)]
    words = [w + "éßøÿ"[i % 4] if i % 3 == 0 else w for i, w in enumerate(words)]
    texts = [" ".join(words), "", " ", "é", "x, y; Ærø! z\n\nq", " ".join(reversed(words))]
    for part in (texts, ["", ""], []):
        found = enc.encode(pa.array(part, pa.string())) if part else []
        assert [x.tolist() for x in found] == [enc.lib.encode(t, add_special_tokens=False).ids for t in part]
