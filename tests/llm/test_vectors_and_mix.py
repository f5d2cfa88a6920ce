import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm.source_mix import min_cost_flow, mix_sources, routed, targets
from tidewright.llm.vector_dup import vector_duplicates


def brute_links(rows, cosine):
    unit = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v) / np.linalg.norm(v)
    links = {i: set() for i in range(len(rows))}
    for i in unit:
        for j in unit:
            if i < j and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine:
                links[i].add(j), links[j].add(i)
    root = {}
    for i in range(len(rows)):
        stack, seen = [i], {i}
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j), stack.append(j)
        root[i] = min(rows[j][0] for j in seen)
    return sorted((rows[i][0], len(links[i]), root[i], rows[i][0] == root[i]) for i in range(len(rows)))


def test_vector_duplicates(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(400):
        noise = rng.choice([0.02, 0.1, 0.25])
        rows.append((900 - i, (base[i % 60] + rng.normal(size=16) * noise).tolist()))
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [1.0] * 5), (1004, [None] + [1.0] * 15)]
    rows += [(1005, rows[0][1]), (1006, (np.array(rows[0][1]) * 3).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vector_duplicates(df, cosine=0.9, block_rows=64).collect()))
    want = brute_links(rows, 0.9)
    assert [g[0] for g in got] == [w[0] for w in want]
    linked = sum(w[1] for w in want)
    assert sum(g[1] for g in got) <= linked and sum(g[1] for g in got) >= 0.97 * linked
    close = brute_links(rows, 0.97)
    assert all(g[1] >= c[1] for g, c in zip(got, close))
    assert vector_duplicates(df.limit(0)).count() == 0


def test_vectors_of_any_length_and_size(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [1.0] * 5), (4, [1.0] * 5), (5, [5e-324, 0.0]), (6, [0.0, -1e300]), (7, [1.0, 1e-9]), (8, [])]
    rows += [(9, [2.0] * 5), (10, [1.0] * 5 + [0.0]), (3, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"left": F.lit(0), "block": F.lit("x"), "cls": F.lit(None)})
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_duplicates(df).collect())
    near = {1: (3, 1), 2: (3, 1), 5: (3, 1), 7: (3, 1), 3: (3, 3), 4: (3, 3), 9: (3, 3)}
    assert got == sorted((i, *near.get(i, (0, i))) for i, _ in rows)


def test_recall_of_planted_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    u = rng.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = 0.9001 * u + math.sqrt(1 - 0.9001**2) * w
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([u, v]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in vector_duplicates(df, block_rows=1500).collect()}
    assert sum(got[i + 2000] == i for i in range(2000)) >= 0.99 * 2000


def test_vector_duplicates_in_a_tight_group(spark):
    rng = np.random.default_rng(5)
    one = rng.normal(size=64)
    rows = [(i, (one + rng.normal(size=64) * 0.002 if i % 3 == 0 else rng.normal(size=64)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block_rows in (1000, 250):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_duplicates(df, block_rows=block_rows).collect()}
        assert got == {i: (299, 0) if i % 3 == 0 else (0, i) for i in range(900)}


def test_flow_prefers_first_copies_and_meets_quotas():
    take = routed([((0,), 10), ((1,), 10), ((0, 1), 10)], [12, 17], 2)
    assert sum(take) == 29 and max(take) <= 20
    assert routed([((0,), 10), ((0, 1), 10)], [10, 10], 2) == [10, 10]
    assert min_cost_flow(3, [(0, 1, 5, 1), (0, 1, 5, 3), (1, 2, 7, 0)], 0, 2) == [5, 2, 7]


def test_targets_stop_and_reshare():
    got = targets([100, 10, 10], [5, 2, 1], 180, 2)
    assert got[1] == 20 and got[2] == 20 and got[0] == 140
    assert targets([10, 10], [1, 1], 40, 2) == [20, 20]
    assert targets([0, 0], [5, 2], 0, 2) == [0, 0]


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "c", None, "é"])) for i in range(500)]
    rows += [(3, None, "a"), (4, "one two", None), rows[10]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = mix_sources(df)
    got = one.collect()
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(7)).collect()))
    assert len(got) == len(rows)
    per = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = per.setdefault(r["sources"][0], [0, 0, r["target"], r["source_size"]])
        s[0] += r["taken"]
        s[1] += r["size"]
    assert all(abs(t - goal) < 1 and n == size for t, n, goal, size in per.values())
    assert abs(sum(s[2] for s in per.values()) - 1.5 * sum(s[1] for s in per.values())) < 1e-6
    assert mix_sources(df.limit(0)).count() == 0


def test_mix_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b"]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    got = mix_sources(df, total=1.0, weights=(1, 1), sources="tags").collect()
    assert sum(r["taken"] for r in got) == 900 and all(r["taken"] == 10 for r in got)
