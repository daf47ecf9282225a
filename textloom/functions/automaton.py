"""All terms of a search in one pass over a text: an Aho-Corasick automaton over the folded text, in Arrow batches.

The cost of a text grows with its length and its occurrences, not with the number of terms. Kind and start are told for plain text (whose
folding is character by character); of other texts only which terms they hold, for the exact matcher to judge.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import forms

try:
    import ahocorasick
except ImportError:  # searches of many terms are then a test for each term, in the JVM
    ahocorasick = None

#: Searches of more terms than this take the automaton.
MANY = 8
KINDS = ("substring", "caseFolded", "exact")
FOUND = "array<struct<term_ord:int,kind:string,start:int>>"


@lru_cache(maxsize=4)
def built(terms: tuple[str, ...]):
    """An automaton whose values are a term's length and the ordinals of the terms that are equal to it."""
    at: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        at.setdefault(t, []).append(i)
    made = ahocorasick.Automaton()
    for t, ords in at.items():
        if t:
            made.add_word(t, (len(t), tuple(ords)))
    if len(made):
        made.make_automaton()
    return made


def occurrences(made, text: str) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """Start, end and ordinals of every occurrence, in the order of their ends."""
    if len(made):
        for end, (n, ords) in made.iter(text):
            yield end - n + 1, end + 1, ords


def bounded(text: str, start: int, end: int, more: str = "") -> bool:
    """Whether no letter, no number and none of ``more`` adjoins a part of a text."""
    for at in (start - 1, end):
        if 0 <= at < len(text) and (forms.alphanumeric(text[at]) or text[at] in more):
            return False
    return True


def in_plain(text: str, base: str, folded, raw: tuple[str, ...]) -> dict[int, tuple[int, int]]:
    """For each term of a plain text its best kind (as a number) and the first start of that kind."""
    best: dict[int, tuple[int, int]] = {}
    for start, end, ords in occurrences(folded, base):
        whole = None
        for i in ords:
            had = best.get(i, (-1, 0))[0]
            if had == 2:
                continue
            if whole is None:
                whole = bounded(base, start, end)
            now = 0 if not whole else 2 if text[start:end] == raw[i] else 1
            if now > had:
                best[i] = (now, start)
    return best


def found_column(text: Column, base: Column, usual: Column, folded: list[str], raw: list[str], identifiers: bool = False) -> Column:
    """The terms that each text holds, as ``FOUND``: ``kind`` and ``start`` are null where ``usual`` is false."""
    folded, raw = tuple(folded), tuple(raw)

    def told(t: str | None, b: str | None, plain: bool) -> list[tuple[int, str | None, int | None]]:
        if t is None or b is None:
            return []
        by_fold = built(folded)
        if identifiers:
            first: dict[int, int] = {}
            for start, end, ords in occurrences(by_fold, b):
                if any(i not in first for i in ords) and bounded(b, start, end, "_"):
                    for i in ords:
                        first.setdefault(i, start)
            return [(i, "identifier" if plain else None, s if plain else None) for i, s in sorted(first.items())]
        if plain:
            return [(i, KINDS[kind], start) for i, (kind, start) in sorted(in_plain(t, b, by_fold, raw).items())]
        held = {i for _, _, ords in occurrences(by_fold, b) for i in ords}
        held |= {i for start, end, ords in occurrences(built(raw), t) if bounded(t, start, end) for i in ords}
        return [(i, None, None) for i in sorted(held)]

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, bases, plains in batches:
            each = [told(*x) for x in zip(texts.to_pylist(), bases.to_pylist(), plains.to_pylist(), strict=True)]
            rows = [x for some in each for x in some]
            off = np.concatenate(([0], np.cumsum([len(some) for some in each]))).astype(np.int32)
            fields = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32()))]
            yield pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays(fields, ["term_ord", "kind", "start"]))

    return run(text, base, usual)
