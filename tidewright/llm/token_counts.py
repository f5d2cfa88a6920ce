"""Token counts of whole texts by heap-and-linked-list byte-pair merging.

A word starts as its symbols in a doubly linked list; a heap yields the
adjacent pair of lowest rank (leftmost on ties), which merges until no pair has
a rank.  The count is the number of initial symbols less the merges: no
identifier is looked up or emitted.

Null and empty texts have 0 tokens; repeated rows give repeated results; a row
with a null id keeps its counts under the null id.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache, partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import UnitCache, id_and_text, slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# Fixed values of the vocabulary's format: how it spells bytes as characters.
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def byte_spelling() -> list[str]:
    """The character for each byte: itself if printable, else the next from U+0100 on."""
    others = iter(range(256, 512))
    return [chr(b) if b in set(PRINTABLE) else chr(next(others)) for b in range(256)]


class MergeCounter:
    """Counts tokens of text under a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""
        self.spelling = byte_spelling()
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # White space by the Unicode property, as the library reads \s.
        self.words = regex.compile(splits[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.mark = "<" if all(s.startswith("<") for s in special) else ""

    def merged(self, word: str) -> int:
        """Tokens of one word of the pre-tokenizer."""
        syms = [self.spelling[b] for b in word.encode()]
        syms[-1] += self.end
        n = len(syms)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((syms[i], syms[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if syms[i] is None or j >= n or rank((syms[i], syms[j])) != r:
                continue  # one of the pair has merged with another since
            syms[i] += syms[j]
            syms[j] = None
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((syms[i], syms[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((syms[h], syms[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def unit(self, text: str) -> int:
        """Tokens of a stretch of text without special strings."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return sum(map(self.merged, self.words.findall(text)))

    def units(self, texts: list[str]) -> list[int]:
        return [self.unit(t) for t in texts]

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Units of a text that can be counted apart, and its special strings.

        A space always ends a word and nothing composes across it, so text is
        cut there; special strings are found first, as the library does.
        """
        if self.special is None or self.mark not in text:
            return text.split(" "), 0
        parts = self.special.split(text)
        return [u for p in parts for u in p.split(" ")], len(parts) - 1


@cache
def counter(path: str) -> tuple[MergeCounter, UnitCache]:
    c = MergeCounter(path)
    return c, UnitCache(c.units)


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    merge, units = counter(path)
    for batch in batches:
        for part in slices(batch):
            texts = part.column(1).to_pylist()
            cut = [merge.pieces(t) for t in texts]
            known = units.ready({u for us, _ in cut for u in us})
            n = [sum(map(known.__getitem__, us)) + special for us, special in cut]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text; no shuffle."""
    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(partial(_count, path=vocabulary, limit=limit), SCHEMA)
