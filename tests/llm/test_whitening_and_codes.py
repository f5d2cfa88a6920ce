import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm.queries import ORACLE_SQL, QUERIES
from tidewright.llm.vector_codes import assigned, cover_tree, exact, squared, vector_codes
from tidewright.llm.whitening import principal_axes, whitening

DATA = "/root/testdata/sf0.001"


def finite(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def brute_codes(rows, parts, entries, rounds):
    """Plain Python integers all the way."""
    rows = sorted(finite(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[max(-(2**62), min(2**62, math.floor(1024 * c))) for c in v] for _, v, _ in rows]
    dim = len(x[0])
    cut = [(i * dim // parts, (i + 1) * dim // parts) for i in range(parts)]
    books = [[v[a:b] for v in x[:entries]] for a, b in cut]
    away = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    nearest = lambda v, book: min(range(len(book)), key=lambda j: (away(v, book[j]), j))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            of = [nearest(v[a:b], books[p]) for v in x]
            for j in set(of):
                own = [v[a:b] for v, o in zip(x, of) if o == j]
                books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = []
    for (i, _, label), v in zip(rows, x):
        of = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        error = sum(away(v[a:b], books[p][o]) for p, ((a, b), o) in enumerate(zip(cut, of)))
        out.append([i, "".join(f"{o:02x}" for o in of), error, label])
    per = {}
    for *_, error, label in out:
        per[label] = per.get(label, 0) + error
    return sorted(((i, code, e if e < 2**63 else None, per[label] if e < 2**63 else None, digest) for i, code, e, label in out), key=str)


def codes(df, **more):
    return sorted((tuple(r) for r in vector_codes(df, **more).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


VECTORS = "vec_id long, embedding array<double>, label int"
ODD = [(9000, None, 1), (9001, [float("nan")] * 8, 1), (9002, [None] + [0.5] * 7, 1), (9003, [float("inf")] * 8, None)]


@pytest.mark.parametrize("seed, dim, parts", [(1, 8, 4), (2, 6, 4), (3, 3, 4), (4, 8, 1)])
def test_codes_against_plain_integers(spark, seed, dim, parts):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dim))
    rows = [(int(i), (base[i % 40] + 0.1 * rng.normal(size=dim)).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(300)]
    rows += [(400 + i, rows[0][1], 1) for i in range(100)] + [rows[1], (None, rows[2][1], None)]
    df = spark.createDataFrame(rows + [(i, v[:dim] if v else v, g) for i, v, g in ODD], VECTORS).withColumns({"n": F.lit("x"), "x": F.lit(1), "code": F.lit(2)})
    assert codes(df.repartition(5), parts=parts, entries=20, rounds=3, block_rows=64) == brute_codes(rows, parts, 20, 3)


def test_large_numbers_few_rows_and_other_lengths(spark):
    rows = [(i, [1e300 * (i % 3 - 1), 3e12 + i, -1.5, 0.25 * i], 1) for i in range(12)]
    big = spark.createDataFrame(rows, VECTORS)
    got = codes(big, entries=4, rounds=2)
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in brute_codes(rows, 4, 4, 2)]
    middling = [(i, [3e6 + 17 * i, -2e6 * (i % 5), 1e5 * (i % 7), 1.0], i % 2) for i in range(40)]
    assert codes(spark.createDataFrame(middling, VECTORS), entries=6, rounds=2) == brute_codes(middling, 4, 6, 2)
    mixed = middling + [(100 + i, [0.5 * i, 1.0], 7) for i in range(5)] + [(200, [], 8)]
    got = codes(spark.createDataFrame(mixed, VECTORS), entries=6, rounds=2)
    want = brute_codes(middling, 4, 6, 2) + brute_codes(mixed[40:45], 4, 6, 2) + [(200, "00000000", 0, 0, hashlib.sha256(b"").hexdigest())]
    assert got == sorted(want, key=str)
    assert codes(big.limit(0)) == []


def test_trees_keep_their_promises_and_assign_exactly():
    rng = np.random.default_rng(5)
    for n, w in [(1, 4), (5, 2), (300, 2), (500, 16), (400, 1)]:
        x = np.floor(1024 * rng.normal(size=(n, w)))
        x[: n // 3] = x[0]
        order, nodes = cover_tree(x)
        y = x[order]
        away = np.sqrt(squared(y, y))
        assert sorted(order) == list(range(n))
        for node in nodes:
            assert away[node["centre"], node["start"] : node["end"]].max() <= node["radius"]
            kids = nodes[node["child"] : node["child"] + node["children"]]
            if len(kids):
                assert kids["start"][0] == node["start"] and kids["end"][-1] == node["end"] and (kids["start"][1:] == kids["end"][:-1]).all()
                gaps = away[np.ix_(kids["centre"], kids["centre"])] + np.diag([np.inf] * len(kids))
                assert gaps.min() > node["radius"] / 2 and kids["centre"][0] == node["centre"]
        for k in (1, 3, 60):
            book = np.floor(1024 * rng.normal(size=(k, w)))
            book[k // 2] = book[0]  # a tie
            assert (assigned(y, nodes, exact(book)) == squared(y, book).argmin(1)).all()
        if w == 2:  # subtrees are taken whole
            counted = []
            far = np.array([[-90000.0] * w, [0.0] * w, [90000.0] * w])
            import tidewright.llm.vector_codes as module

            plain = module.squared
            module.squared = lambda a, b: counted.append(len(a)) or plain(a, b)
            assert (assigned(y, nodes, far) == 1).all()
            module.squared = plain
            assert sum(counted) < n / 2 or n < 10


def test_codes_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    wanted = con.execute(ORACLE_SQL["op13_vector_codes"])
    names = [d[0] for d in wanted.description]
    got = QUERIES["op13_vector_codes"](spark, DATA).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())


# ---- whitening ---------------------------------------------------------------


def test_solver_against_lapack():
    rng = np.random.default_rng(1)
    for case in range(40):
        d, m = int(rng.integers(1, 60)), int(rng.integers(1, 150))
        a = rng.standard_normal((m, d)) * np.exp(rng.standard_normal(d) * rng.choice([0, 1, 6]))
        if case % 4 == 1:
            a[:, rng.integers(0, d, max(1, d // 3))] = 0
        if case % 4 == 2:
            a = rng.integers(-2, 3, (m, d)).astype(float)
        if case % 4 == 3:  # many equal values
            a = np.diag(rng.choice([1.0, 2.0, 2.0, 3.0], d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
        r = np.linalg.qr(a, mode="r")
        values, axes, total = principal_axes(np.vstack([r, np.zeros((d - len(r), d))]), 16)
        want = np.zeros(d)
        own = np.linalg.svd(a, compute_uv=False) ** 2
        want[: len(own)] = own
        scale = max(want[0], 1e-300)
        assert np.abs(values - want).max() < 1e-12 * scale and abs(total - want.sum()) < 1e-11 * scale * d
        k = axes.shape[1]
        assert np.abs(axes.T @ axes - np.eye(k)).max(initial=0) < 1e-9
        assert np.abs(a.T @ (a @ axes) - axes * values[:k]).max(initial=0) < 1e-11 * scale


def brute_whitening(rows, components):
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v, _ in finite(rows)}
    fit = np.array(sorted(set(map(tuple, x.values()))), np.int64)
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    out = {}
    for i, v in x.items():
        off = n * np.array(v) - s
        for k in range(min(components, len(e))):
            if e[k] > 1e-9 * e[0]:
                out[i, k + 1] = (n, int((off.astype(object) ** 2).sum()), float(off / n @ axes[:, k] / math.sqrt(e[k])), float(e[k] / e.sum()))
    return out


@pytest.mark.parametrize("seed, dim, fan_in", [(1, 20, 2), (2, 5, 16)])
def test_whitening_against_numpy(spark, seed, dim, fan_in):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=dim) * np.linspace(2, 0.3, dim)).tolist(), 1) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 2) for i in range(300)]  # copies count once in the fit
    df = spark.createDataFrame(rows + [(i, v[:dim] if v else v, g) for i, v, g in ODD], VECTORS).withColumns({"n": F.lit("x"), "x": F.lit(1), "r": F.lit(2)})
    got = {(r["vec_id"], r["component"]): r for r in whitening(df.repartition(7), fan_in=fan_in).collect()}
    want = brute_whitening(rows, 16)
    assert got.keys() == want.keys()
    sign = {k: np.sign(got[0, k]["whitened"] * want[0, k][2]) for _, k in want}
    for key, (n, deviation, value, explained) in want.items():
        r = got[key]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"] - sign[key[1]] * value) < 1e-8 and abs(r["explained"] / explained - 1) < 1e-10 and r["identity_error"] < 1e-10


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitening(make([])).count() == 0
    assert whitening(make([(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)])).count() == 0  # one distinct vector
    assert whitening(make([(1, [], 1), (2, None, 1)])).count() == 0
    flat = whitening(make([(i, [i * 0.1, 7.0, i * 0.2], 1) for i in range(50)] + [(None, [0.0, 7.0, 0.0], 1)])).collect()
    assert {r["component"] for r in flat} == {1, 2} and sum(r["vec_id"] is None for r in flat) == 2  # a constant column has no component
    two = whitening(make([(i, [float(i), float(i * i % 7)], 1) for i in range(20)] + [(50 + i, [float(i), -i * 0.3, i % 3 * 1.0], 1) for i in range(20)])).collect()
    assert {(r["vec_id"] >= 50, r["component"]) for r in two} == {(False, 1), (False, 2), (True, 1), (True, 2), (True, 3)}
    large = whitening(make([(i, [1e300 * (-1) ** i, float(i)], 1) for i in range(6)])).collect()
    assert len(large) >= 6 and all(r["deviation"] is None for r in large)
