import base64
import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from tidewright.llm.common import stored
from tidewright.llm.secret_scan import redacted, scan
from tidewright.llm.toxicity import fit_toxicity, toxicity_scores

from .test_near_dup import brute

SF = "/root/testdata/sf0.001"


def plain_score(text, model):
    """The classifier's score from its weights, n-gram by n-gram."""
    bits, sent = model
    buckets, weights, bias = sent.value
    weight = dict(zip(buckets.tolist(), weights.tolist()))
    chars, seen = [ord(c) for c in text.lower()], set()
    for n in (4, 5, 6):
        for i in range(len(chars) - n + 1):
            h = n
            for c in chars[i : i + n]:
                h = (h * 0x01000193 + c) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x9E3779B1) & 0xFFFFFFFF
            seen.add(h >> (32 - bits))
    return 1 / (1 + math.exp(-max(-40, min(40, sum(weight.get(b, 0.0) for b in seen) + bias))))


def plain_mix(rows):
    """How often each row is taken: whole copies, then rows in hash order until the source's share is used up."""
    size = {k: len(t.translate({i: 32 for i in range(9, 14)}).split(" ")) - t.translate({i: 32 for i in range(9, 14)}).split(" ").count("") for k, t, _ in rows}
    by = defaultdict(list)
    for k, t, source in rows:
        by[source].append(k)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[k] for k in by[s]) for s in names}
    left, open_, goal = 1.5 * sum(total.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    while open_:
        unit = left / sum(open_.values())
        full = [s for s, w in open_.items() if unit * w > 2 * total[s]]
        for s in full or list(open_):
            goal[s] = 2 * total[s] if full else unit * open_[s]
            if full:
                left -= goal[s]
        for s in full or list(open_):
            del open_[s]
    taken = {}
    for s in names:
        whole, rest = divmod(math.floor(goal[s] + 1e-9), total[s]) if total[s] else (0, 0)
        for k in sorted(by[s], key=lambda k: (hashlib.md5(f"mix:{k}".encode()).hexdigest(), k)):
            more = min(size[k], rest)
            rest -= more
            taken[k] = math.floor((whole * size[k] + more) / size[k] + 0.5) if size[k] else 0
    return Counter({k: n for k, n in taken.items() if n})


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = stored(stages["toxicity"](spark, docs, SF), "t1")
    model = fit_toxicity(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity_scores(docs, model).collect()}
    for r in docs.collect():
        assert abs(plain_score(r["text"], model) - scores[r["doc_id"]]) < 1e-9
    assert {r["doc_id"] for r in clean.collect()} == {d for d, s in scores.items() if s < 0.7}
    single = stored(stages["near_duplicates"](spark, clean, SF), "t2")
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert {r["doc_id"] for r in single.collect()} == {d for d, _, _, kept in brute(rows, 5, 80) if kept}
    safe = stored(stages["secrets"](spark, single, SF), "t3")
    want = {r["doc_id"]: redacted(r["text"], scan(r["text"], 1 << 28)[1], "[SECRET]") for r in single.collect()}
    assert {r["doc_id"]: r["text"] for r in safe.collect()} == want
    mixed = stored(stages["source_mix"](spark, safe, SF), "t4")
    assert mixed.columns == docs.columns and mixed.exceptAll(safe.union(safe)).count() == 0
    assert Counter(r["doc_id"] for r in mixed.collect()) == plain_mix([(r["doc_id"], r["text"], r["source"]) for r in safe.collect()])
    coded = stages["encoding"](spark, mixed, SF)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def coded_by_library(r):
        ids = lib.encode_ordinary(r["text"])
        return r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()

    assert sorted(map(tuple, coded.collect())) == sorted(map(coded_by_library, mixed.collect()))
    assert corpus_pipeline.run(spark, SF).count() == mixed.count()


def test_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, None, None), (None, "other words here", "s")], "doc_id long, text string, source string"
    )
    kept = corpus_pipeline.near_dup(spark, docs, SF)
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.distinct().collect()))
    assert corpus_pipeline.secrets(spark, docs, SF).count() == 4
    assert corpus_pipeline.source_mix(spark, docs.limit(0), SF).count() == 0


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, None, None), (4, "token=abcdefgh12 and more words", "s")], "doc_id long, text string, source string"
    )
    names = ["_th", "_th_", "th", "copies", "_copy", "_Copy_", "size", "taken", "label", "score", "kept", "cls", "ids"]
    odd = docs.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
        found = stage(spark, odd, SF)
        assert name == "encoding" or found.columns == odd.columns
        if name != "encoding":
            assert all(r[c] == i for r in found.collect() for i, c in enumerate(names))
        plain = stage(spark, docs, SF)
        assert sorted(map(str, found.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
