import hashlib
import itertools
import random
import uuid

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewright.llm.chat_format import CONTROLS, Template, chat_digests, format_chats, read_turns, spans_of_turns

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CONTRACT = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]


def wanted(rows):
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(own), digest(turns), len(loss), digest(loss)))
    return sorted(out, key=str)


def test_escapes_are_undone_whatever_the_text():
    form, rng = Template(), random.Random(3)
    bits = [*CONTROLS, *[c[:-1] for c in CONTROLS], *[c[1:] for c in CONTROLS], "\\", "\\\\", "<", "[", "\n", "é", "<\\s>", "]", "|", "n"]
    for _ in range(3000):
        text, role = ("".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(2))
        escaped = form.escape(text)
        assert not any(c in escaped for c in CONTROLS) and form.unescape(escaped) == text
        assert form.read(form.turn(role, text) + form.turn("user", role)) == [(role, text), ("user", role)]
    with pytest.raises(ValueError):
        Template("<a<", "<b>")
    with pytest.raises(ValueError):
        form.read("plain")


def test_windows_cover_each_turn_once_within_the_budget():
    rng = random.Random(4)
    for _ in range(400):
        n, first = rng.randint(1, 30), rng.randint(0, 5)
        sizes = [rng.randint(1, 40) for _ in range(n + first)]
        sums = [0, *itertools.accumulate(sizes)]
        room, history, opens = rng.randint(1, 90), rng.randint(0, 40), first == 0
        import numpy as np

        found = spans_of_turns(np.array(sums), first, room, history, opens)
        assert [i for _, a, b in found for i in range(a, b)] == list(range(first, n + first))
        for old, at, end in found:
            assert sums[end] - sums[old] <= room or end == at + 1
            assert sums[at] - sums[old] <= history
            assert old == 0 or old == at or sums[at] - sums[old - 1] > min(history, room - (sums[end] - sums[at]))


@pytest.mark.parametrize("budget, history, cell", [(60, 20, 61), (200, 50, None), (100000, 100, None), (1, 0, 7)])
def test_every_turn_comes_back_once(spark, tmp_path, budget, history, cell):
    rng = random.Random(budget)
    words = ["one", "two", "</s>", "[INST]", "drei", "\\", "<|im_end|>\n", "四"]
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for conv in (1, 2, 5, -3, None):
        if conv in (1, None):
            rows.append((conv, 0, "system", say(6)))
        rows += [(conv, t, "assistant" if t % 2 else "user", say(rng.randint(0, 25))) for t in range(1, rng.choice([2, 9, 60]))]
    rows += [(7, 0, "system", "alone"), (8, 0, None, None), (8, 1, "assistant", None), (9, 3, "tool\n\\n", "x" * 30000), (9, None, "user", "first")]
    rows += [(10, 1, "assistant", "again"), (10, 1, "assistant", "again"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in ("at", "part", "cell", "own", "fresh", "tokens", "before")})
    path = str(tmp_path / uuid.uuid4().hex)
    format_chats(df.repartition(6), path, VOCABULARY, budget=budget, history=history, cell=cell)
    got = sorted((tuple(r) for r in chat_digests(spark, path).select(CONTRACT).collect()), key=str)
    assert got == wanted(rows)
    turns = read_turns(spark, path)
    assert turns.count() == len(rows) and turns.filter("target").count() == sum(r[2] == "assistant" for r in rows)
    for r in spark.read.parquet(path).collect():
        form, system = Template(), (r["conv_id"] in (1, None, 7))
        found = form.read(r["text"])
        assert len(found) == r["turns"] + r["repeated"] and r["over_budget"] == (r["tokens"] > budget)
        assert not r["over_budget"] or r["turns"] - (r["first"] == 0 and system) <= 1
        assert not system or found[0][0] == "system"
        targets = [r["text"][s["start"] : s["end"]] for s in r["loss"]]
        assert list(map(form.unescape, targets)) == [t for role, t in found[r["repeated"] :] if role == "assistant"]


def test_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    format_chats(none, str(tmp_path / "none"), VOCABULARY)
    assert chat_digests(spark, str(tmp_path / "none")).count() == read_turns(spark, str(tmp_path / "none")).count() == 0
