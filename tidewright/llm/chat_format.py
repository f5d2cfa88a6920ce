"""Chat formatting in token-budgeted windows.

A conversation is its rows in order of turn (nulls first; ties by a hash of role
and text).  Prefix sums of the turns' tokens, carried across range partitions,
give every turn its place; a cell is the stretch of a conversation that begins
in one multiple of ``cell`` tokens.  Cells are worked on apart, so a long
conversation is spread over many tasks, and a cell holds a bounded number of
tokens and one turn more at most.

Within a cell windows are filled with whole turns up to the budget.  Each window
of a conversation holds its system turn (if its first turn is one), as many of
the turns before as a limit of history tokens allows, and then its fresh turns.
What a window repeats is masked: the loss mask covers the texts of the fresh
assistant turns alone, so each is a target once.  No turn is ever cut; one that
is larger than the budget has a window of its own, which is marked.

Control strings inside texts and roles are escaped: a backslash goes in after
the first character, past which any backslashes already there move on, so that
escaping is undone exactly.  Nothing but the template writes a control string.

Null texts and roles are empty.  Rows that repeat are turns of their own.  A null
conversation id names one conversation.  An empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized_slices, stored
from .id_files import library

#: Strings that chat templates and public vocabularies give a meaning.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


class Template:
    """Turns as ``start role newline text end newline``, and back."""

    def __init__(self, start: str = "<|im_start|>", end: str = "<|im_end|>", controls: tuple[str, ...] = CONTROLS):
        self.start, self.end = start, end
        marks = sorted({start, end, *controls}, key=len, reverse=True)
        for a in marks:
            if len(a) < 2 or "\\" in a or any(a[i:].startswith(b) or b.startswith(a[i:]) for i in range(1, len(a)) for b in marks):
                raise ValueError(f"control strings must not overlap: {a!r}")
        rest: dict[str, list[str]] = {}
        for m in marks:
            rest.setdefault(m[0], []).append(re.escape(m[1:]))
        after = [f"(?<={re.escape(c)}){{}}(?=\\\\*(?:{'|'.join(r)}))" for c, r in rest.items()]
        self.bare = re.compile("|".join(x.format("") for x in after))
        self.marked = re.compile("|".join(x.format("\\\\") for x in after))
        self.turns = re.compile(f"{re.escape(start)}([^\n]*)\n(.*?){re.escape(end)}\n", re.DOTALL)

    def escape(self, text: str) -> str:
        return self.bare.sub(r"\\", text)

    def unescape(self, text: str) -> str:
        return self.marked.sub("", text)

    def role(self, role: str) -> str:
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def role_back(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))

    def turn(self, role: str, text: str) -> str:
        return f"{self.start}{self.role(role)}\n{self.escape(text)}{self.end}\n"

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """Role and text of each turn; anything that isn't a turn is an error."""
        out, at = [], 0
        while at < len(formatted):
            if (m := self.turns.match(formatted, at)) is None:
                raise ValueError(f"no turn at {at}")
            out.append((self.role_back(m[1]), self.unescape(m[2])))
            at = m.end()
        return out


template = cache(Template)

COUNTED = "conv_id long, role string, text string, part int, at long, before long, tokens long, ended boolean"


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: str, marks: tuple) -> Iterator[pa.RecordBatch]:
    """Each turn's tokens, place and tokens before it, within its conversation and partition; then how that ended."""
    lib, form, part = library(vocabulary), template(*marks), TaskContext.get().partitionId()
    names = [c.split()[0] for c in COUNTED.split(", ")]
    last, at, before, any_row = None, 0, 0, False

    def rows(conv, role, text, place, sums, tokens, ended):
        n = len(place)
        cols = [conv, role, text, pa.array([part] * n, pa.int32()), *(pa.array(x, pa.int64()) for x in (place, sums, tokens))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([ended] * n, pa.bool_())], names=names)

    for batch in batches:
        for some in sized_slices(batch, 2):
            conv, role, text = (some.column(i) for i in range(3))
            turns = [form.turn(r, t) for r, t in zip(role.to_pylist(), text.to_pylist())]
            n = [len(ids) for ids in lib.encode(pa.array(turns, pa.string()))]
            place, sums = [], []
            for c, k in zip(conv.to_pylist(), n):
                if not any_row or c != last:
                    last, at, before, any_row = c, 0, 0, True
                place.append(at), sums.append(before)
                at, before = at + 1, before + k
            yield rows(conv, role, text, place, sums, n, False)
    if any_row:
        yield rows(pa.array([last], pa.int64()), pa.array([""]), pa.array([""]), [at], [before], [0], True)


def placed_turns(convs: DataFrame, vocabulary: str, marks: tuple) -> DataFrame:
    """``conv_id, role, text, at, before, tokens``: each turn's place in its conversation and the tokens before it."""
    spark = convs.sparkSession
    keys = ["conv_id", "turn", "tie"]
    ranged = convs.withColumn("tie", F.xxhash64("role", "text")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    counted = ranged.select("conv_id", "role", "text").mapInArrow(partial(_counted, vocabulary=vocabulary, marks=marks), COUNTED)
    counted = stored(counted, "turns")
    # A row for each partition: what its last conversation carries into the next.
    carries, held = [], None
    for r in counted.filter("ended").orderBy("part").select("part", "conv_id", "at", "before").collect():
        if held is not None:
            carries.append((r["part"], *held))
        own = (r["conv_id"], r["at"], r["before"])
        more = held is not None and held[0] == own[0]
        held = (own[0], own[1] + held[1], own[2] + held[2]) if more else own
    carried = spark.createDataFrame(carries, "c_part int, c_conv long, c_at long, c_before long")
    same = (F.col("part") == F.col("c_part")) & F.col("conv_id").eqNullSafe(F.col("c_conv"))
    rows = counted.filter("not ended").join(F.broadcast(carried), same, "left")
    sums = [(F.col(c) + F.coalesce(f"c_{c}", F.lit(0))).alias(c) for c in ("at", "before")]
    return rows.select("conv_id", "role", "text", *sums, "tokens")


WINDOWS = "conv_id long, first long, turns long, repeated long, tokens long, over_budget boolean, text string, loss array<struct<start:int,end:int>>"
LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
WINDOW_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.string(), LOSS]


def spans_of_turns(sums: np.ndarray, first: int, room: int, history: int, opens: bool) -> list[tuple[int, int, int]]:
    """Windows ``(oldest, fresh, end)`` over turns with prefix sums of tokens ``sums``.

    Turns before ``first`` are history only.  ``opens``: the first window has no
    history to leave room for.
    """
    out, at, n = [], first, len(sums) - 1
    while at < n:
        fresh = room if opens and at == first else room - min(history, int(sums[at] - sums[0]))
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + fresh, "right")) - 1)
        spare = min(history, room - int(sums[end] - sums[at]))
        old = int(np.searchsorted(sums, sums[at] - spare)) if spare > 0 else at
        out.append((old, at, end))
        at = end
    return out


def _windows(batches: Iterator[pa.RecordBatch], budget: int, history: int, targets: tuple[str, ...], marks: tuple) -> Iterator[pa.RecordBatch]:
    form = template(*marks)

    def windows(turns: list[tuple]) -> Iterator[tuple]:
        """Windows of one cell from its turns ``(conv, cell, at, role, text, tokens, fresh)`` in order."""
        system = turns[0] if turns[0][2] == 0 and turns[0][3] == "system" else None
        rest = turns[1:] if system else turns
        opens = turns[0][1] == 0
        if not rest:  # nothing but a system turn
            yield window(turns[:1], 0)
            return
        sums = np.concatenate([[0], np.cumsum([t[5] for t in rest])])
        first = next((i for i, t in enumerate(rest) if t[6]), len(rest))
        room = budget - (system[5] if system else 0)
        for old, at, end in spans_of_turns(sums, first, room, history, opens):
            again = ([system] if system else []) + rest[old:at]
            if opens and at == first:
                again, fresh = [], again + rest[at:end]  # the system turn is fresh here
            else:
                fresh = rest[at:end]
            yield window(again + fresh, len(again))

    def window(turns: list[tuple], repeated: int) -> tuple:
        pieces, loss, at = [], [], 0
        for i, (_, _, _, role, text, _, _) in enumerate(turns):
            piece = form.turn(role, text)
            if i >= repeated and role in targets:
                end = at + len(piece) - len(form.end) - 1
                loss.append({"start": at + piece.index("\n") + 1, "end": end})
            pieces.append(piece)
            at += len(piece)
        tokens = sum(t[5] for t in turns)
        return (turns[0][0], turns[repeated][2], len(turns) - repeated, repeated, tokens, tokens > budget, "".join(pieces), loss)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in WINDOWS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(WINDOW_TYPES)], names=names)

    held, out, size = [], [], 0
    for batch in batches:
        for some in sized_slices(batch, 4):
            for row in zip(*[c.to_pylist() for c in some.columns]):
                if held and row[:2] != held[0][:2]:
                    now, held = list(windows(held)), []
                    out, size = out + now, size + sum(len(w[6]) for w in now)
                    if size > 1 << 22:
                        yield packed(out)
                        out, size = [], 0
                held.append(row)
    if held:
        out += windows(held)
    if out:
        yield packed(out)


def format_chats(
    convs: DataFrame,
    path: str,
    vocabulary: str,
    budget: int = 2048,
    history: int = 512,
    cell: int | None = None,
    targets: tuple[str, ...] = ("assistant",),
    marks: tuple = (),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> None:
    """Write every conversation's windows as Parquet files in ``path``.

    ``vocabulary`` is a tokenizers file that counts tokens; ``marks`` are the
    arguments of :class:`Template`.  A file row is a window: conversation, place
    of its first fresh turn, number of fresh and of repeated turns, tokens,
    whether these exceed the budget, the formatted text, and the loss mask as
    spans of code points.
    """
    cell = max(cell or 8 * budget, history + 1)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = convs.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    turns = placed_turns(rows, vocabulary, marks).withColumn("own", F.expr(f"before div {cell}"))
    # A turn goes to the cell it begins in and, as history, to the next if that is near.
    columns = ["conv_id", "cell", "at", "role", "text", "tokens", "fresh"]
    reach = F.expr(f"(before + {history}) div {cell}")
    shared = turns.withColumn("cell", F.explode(F.sequence("own", reach))).withColumn("fresh", F.col("cell") == F.col("own"))
    # Later cells get their conversation's system turn, if it has one.
    later = turns.filter("own > 0").select(F.col("conv_id").alias("of"), F.col("own").alias("cell")).distinct()
    first = turns.filter("at = 0 and role = 'system'")
    system = first.join(later, first["conv_id"].eqNullSafe(later["of"])).withColumn("fresh", F.lit(False))
    dealt = shared.select(columns).union(system.select(columns)).repartition("conv_id", "cell").sortWithinPartitions("conv_id", "cell", "at")
    run = partial(_windows, budget=budget, history=history, targets=targets, marks=marks)
    dealt.mapInArrow(run, WINDOWS).write.option("compression", "zstd").parquet(path)


def _turns(batches: Iterator[pa.RecordBatch], marks: tuple) -> Iterator[pa.RecordBatch]:
    form = template(*marks)
    for batch in batches:
        for some in sized_slices(batch, 3):
            out = []
            for conv, first, repeated, text, loss in zip(*[c.to_pylist() for c in some.columns]):
                starts, at = {s["start"] for s in loss}, 0
                for i, m in enumerate(form.turns.finditer(text)):
                    if i >= repeated:
                        out.append((conv, first + i - repeated, form.role_back(m[1]), form.unescape(m[2]), m.start(2) in starts))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["conv_id", "at", "role", "text", "target"])


def read_turns(spark: SparkSession, path: str, marks: tuple = ()) -> DataFrame:
    """``conv_id, at, role, text, target``: every turn once, read back from the formatted windows."""
    rows = spark.read.parquet(path).select("conv_id", "first", "repeated", "text", "loss")
    return rows.mapInArrow(partial(_turns, marks=marks), "conv_id long, at long, role string, text string, target boolean")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _digests(batches: Iterator[pa.RecordBatch], marks: tuple) -> Iterator[pa.RecordBatch]:
    """Folds over each conversation's windows in order; one conversation's sums are held."""
    form = template(*marks)
    out, conv, state = [], None, None

    def ended() -> tuple:
        turns, said, chars, loss, size, windows = state
        return (conv, turns, said.hexdigest(), chars, loss.hexdigest(), size, windows)

    for batch in batches:
        for some in sized_slices(batch, 3):
            for c, first, repeated, text, loss in zip(*[x.to_pylist() for x in some.columns]):
                if state is None or c != conv:
                    if state is not None:
                        out.append(ended())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                turns = form.read(text)[repeated:]
                if first != state[0]:
                    raise ValueError(f"conversation {c}: turn {first} follows {state[0]} turns")
                for role, said in turns:
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in loss:
                    target = form.unescape(text[s["start"] : s["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[0], state[4], state[5] = state[0] + len(turns), state[4] + len(text), state[5] + 1
    if state is not None:
        out.append(ended())
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)


def chat_digests(spark: SparkSession, path: str, marks: tuple = ()) -> DataFrame:
    """Counts and digests of every conversation, read back from the formatted windows in ``path``.

    A digest of a whole conversation is a fold, so its windows are read in order
    by one task, which holds one window at a time.
    """
    rows = spark.read.parquet(path).select("conv_id", "first", "repeated", "text", "loss")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(partial(_digests, marks=marks), DIGESTS)
