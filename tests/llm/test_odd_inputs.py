"""Nulls, ties, repeats, empty tables, clashing columns and long texts, operator by operator."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm.id_files import read_ids, write_ids
from tidewright.llm.media_store import cuts, media_round_trip
from tidewright.llm.near_dup import near_duplicates
from tidewright.llm.repeats import repeated_bytes, segments
from tidewright.llm.secret_scan import secret_spans, without_secrets
from tidewright.llm.source_mix import mix_sources
from tidewright.llm.token_counts import token_counts
from tidewright.llm.toxicity import fit_toxicity, toxicity_scores, without_toxic
from tidewright.llm.tree_bpe import bpe_round_trip
from tidewright.llm.vector_dup import vector_duplicates

from .test_near_dup import brute

# Names that operators use inside.
CLASHES = ["th", "cls", "n", "part", "media", "key", "size", "label", "block", "sources", "base", "spans", "score", "held_out", "at", "root", "keys"]


def clashing(df):
    return df.withColumns({c: F.lit(f"x{i}") if i % 2 else F.lit(i) for i, c in enumerate(CLASHES) if c not in df.columns})


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = make(120)
    rows = [(1, None, "s"), (2, "", "s"), (3, shared, "s"), (3, shared, "s"), (4, shared + " " + make(9), "t"), (5, make(60), None), (None, make(30), "t"), (6, "token=abcdefgh12 " + make(4000), "s"), (7, " ", "u")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_clashing_columns_change_nothing(spark, texts, tmp_path):
    import public_tokenizers as P

    odd = clashing(texts)
    same = lambda f, *names: rows_of(f(texts), *names) == rows_of(f(odd), *names)
    assert same(lambda d: secret_spans(d), "doc_id", "base", "spans")
    assert same(lambda d: media_round_trip(d, 64, 256, 2048), "doc_id", "media_sha256", "feature")
    assert same(lambda d: near_duplicates(d, width=2), "doc_id", "n_shingles", "component_id", "kept")
    assert same(lambda d: repeated_bytes(d, keep_first=False), "doc_id", "n_removed", "kept_sha256")
    assert same(lambda d: mix_sources(d), "doc_id", "size", "target", "taken")
    assert same(lambda d: token_counts(d, P.path("word_bpe_49k.json")), "doc_id", "n_tokens")
    assert same(lambda d: bpe_round_trip(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), "doc_id", "ids_sha256")
    for i, d in enumerate((texts, odd)):
        write_ids(d, P.path("byte_bpe_50k.json"), str(tmp_path / str(i)))
    assert rows_of(read_ids(spark, str(tmp_path / "0")), "start", "ids_crc32") == rows_of(read_ids(spark, str(tmp_path / "1")), "start", "ids_crc32")
    assert without_secrets(odd).columns == odd.columns


def test_empty_tables(spark, texts):
    import public_tokenizers as P

    none = clashing(texts).limit(0)
    assert secret_spans(none).count() == without_secrets(none).count() == media_round_trip(none, 64, 256, 2048).count() == 0
    assert near_duplicates(none).count() == repeated_bytes(none).count() == mix_sources(none).count() == 0
    assert token_counts(none, P.path("word_bpe_49k.json")).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity_scores(none, fit_toxicity(none, labels)).count() == 0


def test_near_duplicates_against_brute_force_with_ties(texts):
    rows = [(r["doc_id"], r["text"]) for r in texts.collect() if r["doc_id"] is not None]
    got = rows_of(near_duplicates(texts.filter("doc_id is not null"), width=2), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute(rows, 2, 80), key=str)


def test_media_forms(spark, texts):
    def form(text):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload))
        x = np.frombuffer(payload, np.uint8).astype(float)
        up = x >= 128
        n = len(cuts(head + payload, 64, 256, 2048))
        feature = f"mean={x.mean():.6f};deviation={x.std():.6f};crossings={int((up[1:] != up[:-1]).sum())};chunks={n}"
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]), len(head) + len(payload), sha(head + payload), feature

    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()
    want = sorted(((r["doc_id"], *form(r["text"])) for r in texts.collect()), key=str)
    assert rows_of(media_round_trip(texts, 64, 256, 2048), *names) == want
    # A medium made of one repeated chunk, and one whose chunks are all another's.
    rows = [(1, "ab" * 20_000), (2, "ab" * 10_000), (3, "ab" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["payload_sha256"] for r in media_round_trip(df, 64, 256, 1024).collect()}
    assert got == {d: form(t)[2] for d, t in rows}


def test_long_text_with_a_late_secret(spark):
    text = "word " * 400_000 + "password: abcdefgh1"
    found = secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(s) for s in found["base"]] == [("assign", 2_000_000, len(text))]


def test_repeats_across_pieces_of_a_long_text(spark):
    rng = np.random.default_rng(4)
    body = rng.integers(97, 123, (1 << 20) + 3000, dtype=np.uint8)
    edge = (1 << 20) - 250  # the repeated stretch lies across the edge of two pieces
    copied = body[edge : edge + 700].tobytes().decode()
    long = body.tobytes().decode()
    assert len({int(a) // (1 << 20) for a in segments(body, 400, 200)[2]}) == 2
    df = spark.createDataFrame([(1, long), (2, "z" * 50 + copied + "y" * 50)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_bytes(df, keep_first=False).collect()}
    cut = long[:edge] + long[edge + 700 :]
    assert got[1] == (700, 1, hashlib.sha256(cut.encode()).hexdigest())
    assert got[2] == (700, 1, hashlib.sha256(("z" * 50 + "y" * 50).encode()).hexdigest())


def test_toxicity_rows(spark):
    rng = random.Random(2)
    mild = [" ".join(rng.choice(["tree", "house", "river", "stone"]) for _ in range(20)) for _ in range(150)]
    rude = [m + " vilegrunt nastyword" for m in mild[:60]]
    rows = [(i, t) for i, t in enumerate(mild + rude)] + [(5, mild[5]), (900, None), (901, ""), (None, rude[0])]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(i >= 150)) for i in range(210)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    got = toxicity_scores(docs, model).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    by = {r["doc_id"]: r for r in got}
    assert by[900]["score"] == by[901]["score"] and not by[None]["held_out"]
    held = [r for r in got if r["held_out"] and r["doc_id"] < 210]
    assert all(r["predicted"] == (r["doc_id"] >= 150) for r in held) and held
    # A score right at the threshold counts as toxic, in the scores and in the filter.
    tie = by[151]["score"]
    again = {r["doc_id"]: r["predicted"] for r in toxicity_scores(docs, model, threshold=tie).collect()}
    assert again[151] == 1
    assert 151 not in {r["doc_id"] for r in without_toxic(docs, model, threshold=tie - 1e-9).collect()}


def test_mix_with_repeats_and_vectors_with_clashes(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "a b", "s"), (3, "x", "t"), (4, None, None), (5, "", "u")]
    mixed = mix_sources(clashing(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    got = mixed.collect()
    assert len(got) == 6 and all(r["taken"] <= 2 * r["size"] for r in got)
    for source in ("s", "t"):
        taken = sum(r["taken"] for r in got if r["sources"] == [source])
        target = next(r["target"] for r in got if r["sources"] == [source])
        assert taken == int(target)
    with pytest.raises(ValueError, match="patterns"):
        mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), most_patterns=2)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert rows_of(vector_duplicates(clashing(v)), "vec_id", "n_links", "component_id") == [(1, 1, 1), (2, 0, 2), (2, 1, 1)]
