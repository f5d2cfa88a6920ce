import hashlib
import random

import pytest

from tidewright.llm.queries import QUERIES
from tidewright.llm.repeats import repeated_bytes, with_counted_keys


def brute(rows, length, keep_first):
    rows = sorted(((d is not None, d or 0), d, (t or "").encode()) for d, t in rows)
    seen, count = set(), {}
    for _, _, t in rows:
        for k in range(len(t) - length + 1):
            count[t[k : k + length]] = count.get(t[k : k + length], 0) + 1
    out = []
    for _, d, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            if (w in seen) if keep_first else count[w] > 1:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        runs = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("keep_first, most_kinds", [(False, 500), (True, 500), (False, 3)])
def test_against_brute_force(spark, keep_first, most_kinds):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, line = text(130), text(48)
    rows = [(i, text(rng.randint(0, 90)) + shared[rng.randint(0, 60) :] + text(30)) for i in range(40)]
    rows += [(50 + i, text(40) + line + text(40)) for i in range(30)]
    rows += [(90, None), (91, ""), (92, "x" * 500), (93, "ab" * 200), (94, rows[0][1]), (95, shared + text(9) + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeated_bytes(df, length=60, gram=30, keep_first=keep_first, most_kinds=most_kinds).drop("spans").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 60, keep_first), key=key)


def test_empty_table_and_null_id(spark):
    df = spark.createDataFrame([(None, "q" * 70, "clash"), (1, "q" * 70, "clash")], "doc_id long, text string, ah string")
    assert repeated_bytes(df.limit(0), length=60, gram=30).count() == 0
    got = repeated_bytes(df, length=60, gram=30, keep_first=False).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in got} == {(None, 70), (1, 70)}


def test_rows_of_a_common_key_stay_spread(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 8000, 1, 8).selectExpr("id", "if(id % 4 = 0, id div 40, -1) AS key")
        counted = rows.groupBy("key").count().filter("count > 1 and key != 3")
        got = with_counted_keys(rows, counted, ["key"], "count", 500)
        places = got.filter("key = -1").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
        assert sorted(r["count"] for r in places) == [750] * 8
        assert {tuple(r) for r in got.select("id", "key", "count").collect()} == {
            (i, -1 if i % 4 else i // 40, 6000 if i % 4 else 10) for i in range(8000) if i % 4 or i // 40 != 3
        }
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_passages_of_over_50_words_go_from_400_bytes_on(spark, tmp_path):
    rng = random.Random(400)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(58)]
    passage = " ".join(words)  # 58 words, 405 bytes
    rows = [(1, "A" + passage[:399] + "B"), (2, "C" + passage[:399] + "D"), (3, "E" + passage[5:] + "F"), (4, "G" + passage[5:] + "H")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op9_repeats"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in got} == {(1, 0), (2, 0), (3, 400), (4, 400)}
