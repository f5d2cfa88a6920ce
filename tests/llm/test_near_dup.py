import random
import re
from pathlib import Path

import numpy as np
import pandas as pd

from tidewright.llm import common
from tidewright.llm import near_dup as n
from tidewright.llm.near_dup import near_duplicates


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = d if r not in low else min(low[r], d)
    return sorted((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows))


def result(spark, rows, width, percent=80, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, near_duplicates(df, width=width, percent=percent, **more).collect()))


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(260):
        rate = rng.choice([0.0, 0.02, 0.05, 0.08, 0.12])
        rows.append((1000 - i, " ".join(rng.choice(words[:60]) if rng.random() < rate else w for w in base)))
    rows += [(2000 + i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40])))) for i in range(60)]
    want = brute(rows, 2, 80)
    assert result(spark, rows, 2) == want
    assert result(spark, rows, 2, small_bucket=3) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A  b"), (8, "x " * 5000), (9, "x x"), (4, "One")]
    assert result(spark, rows, 2) == brute(rows, 2, 80)
    assert result(spark, rows[:0], 5) == []


def test_words_that_polynomials_confuse(spark):
    """A word of 1,024 letters and its complement, whose polynomial hashes modulo powers of two are equal."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"x {word} y"), (4, f"x {other} y"), (5, word.upper())]
    assert result(spark, rows, 2) == brute(rows, 2, 80)
    assert result(spark, rows, 2, secret=b"another") == brute(rows, 2, 80)


def test_half_hashes_that_collide(monkeypatch):
    """With first halves cut to a few bits, whole hashes still decide."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefghijkl", k=60)).encode() for _ in range(12)]
    whole = [n.shingle_set(t, 3) for t in texts]
    plain = n.mixed
    cut_mask = np.array([7, 2**64 - 1], np.uint64)
    monkeypatch.setattr(n, "mixed", lambda x: plain(x) & cut_mask if x.ndim == 2 else plain(x))
    cut = [n.shingle_set(t, 3) for t in texts]
    for a, b in zip(whole, cut):
        assert len(a) == len(b)
        assert [n.common_shingles(b, c) for c in cut] == [n.common_shingles(a, c) for c in whole]
    frame = pd.DataFrame({"left": 0, "right": 0, "block": 0, "cls": [b"%d" % i for i in range(24)], "text": [t.decode() for t in texts + texts]})
    linked = n._block_links(frame, 3, 80, n.KEY)
    assert sorted(zip(linked["a"], linked["b"])) == sorted((b"%d" % (i + 12), b"%d" % i) for i in range(12))


def test_extra_columns_and_null_id(spark):
    df = spark.createDataFrame([(None, "a b c", "x"), (3, "a b c", "y")], "doc_id long, text string, cls string")
    found = {tuple(r) for r in near_duplicates(df, width=2).collect()}
    assert found == {(None, 2, 3, False), (3, 2, 3, True)}


def test_small_tables_are_not_cut_by_shuffle_partitions(spark):
    """A component's rounds write a few files, also where every shuffle has many partitions, and lose no row."""
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for c, v in zip(held, ("40", "false")):
        spark.conf.set(c, v)
    try:
        before = set(Path(common.own_folder(spark)).glob("least-*"))
        edges = spark.range(1000).selectExpr("id AS a", "id + if(id % 10 = 9, 0, 1) AS b")
        found = {r["node"]: r["root"] for r in common.connected_components(edges).collect()}
        assert found == {i: i // 10 * 10 for i in range(1000)}
        made = set(Path(common.own_folder(spark)).glob("least-*")) - before
        assert made and max(len(list(f.glob("part-*"))) for f in made) <= 4
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
