"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised alike: lower case, each run of non-alphanumerics one space. An item of ``n``
characters may differ by ``e = floor(n * error_rate)`` edits; cut into ``e + 1`` pieces, at least one piece of every such
occurrence is unchanged. All pieces of a block of items are found in one pass over each whole text by an Aho-Corasick
automaton; each hit names a window, and Myers' bit-parallel algorithm verifies the joined windows within the error budget. Items of
fewer than ``MIN_CHARS`` characters must occur whole and unchanged, between word borders.

Scale: items travel to the executors in blocks of at most ``ITEM_BYTES`` of text (one pass over the documents a block);
documents are neither shuffled nor joined. A piece that is in a third of all documents costs each of them its own check.

Cases: null and empty texts have no matches; null items and items that normalise to nothing match nothing; of occurrences at
the same distance the one that ends first is told; repeated rows match alike, and equal items of different ids each;
further columns are ignored by the search and kept by the filter; empty tables give empty results.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._store import bounded_batches, carried

ERROR_RATE, MIN_CHARS = 0.05, 24
#: Most characters of item texts in one block's automaton.
ITEM_BYTES = 4 << 20

_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    """``errors + 1`` adjacent spans that cover ``n`` characters, as even as can be."""
    cuts = [n * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any substring of ``text`` and the first end at which it is met; None above ``most``."""
    m = len(pattern)
    if not m:
        return (0, 0)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = every, 0, m
    best, end = (m, 0)
    for j, c in enumerate(text):
        x = eq.get(c, 0)
        xv = x | mv
        xh = (((x & pv) + pv) ^ pv) | x
        ph, mh = mv | (~(xh | pv) & every), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & every
        mh = mh << 1 & every
        pv, mv = mh | (~(xv | ph) & every), ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


def start_of(pattern: str, text: str, distance: int) -> int:
    """Where the occurrence of ``pattern`` that ends with ``text`` at this distance begins: the latest such place."""
    row = list(range(len(text) + 1))  # distances of the reversed pattern's beginning to those of the reversed text
    for i, c in enumerate(reversed(pattern), 1):
        now = [i]
        for j, d in enumerate(reversed(text), 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return len(text) - row.index(distance)


class Matcher:
    """Finds each item of a block in a normalised text."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items, held = [], {}
        for item, text in items:
            t = normalise(text)
            if not t:
                continue
            whole = len(t) < MIN_CHARS
            e = 0 if whole else int(len(t) * error_rate)
            t = f" {t} " if whole else t
            for a, b in pieces(len(t), e):
                held.setdefault(t[a:b], []).append((len(self.items), a))
            self.items.append((item, t, e))
        self.automaton = ahocorasick.Automaton()
        for piece, at in held.items():
            self.automaton.add_word(piece, (len(piece), at))
        if held:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item, distance, start, errors)``: of each item its nearest occurrence, of equals the one that ends first."""
        if not self.items or not text:
            return []
        t = f" {text} "  # borders of words at the ends, too; places count without the first
        starts: dict[int, set[int]] = {}
        for last, (length, at) in self.automaton.iter(t):
            for k, a in at:
                starts.setdefault(k, set()).add(last + 1 - length - a)
        out = []
        for k, places in sorted(starts.items()):
            item, pattern, e = self.items[k]
            found = self.nearest(t, pattern, e, sorted(places))
            if found:
                out.append((item, found[0], max(0, found[1] - 1 + (pattern[0] == " ")), e))
        return out

    @staticmethod
    def nearest(t: str, pattern: str, e: int, places: list[int]) -> tuple[int, int] | None:
        """Distance and start of the nearest occurrence that begins within ``e`` of one of ``places``."""
        exact = t.find(pattern)
        if exact >= 0:
            return 0, exact
        if not e:
            return None
        windows: list[list[int]] = []
        for s in places:
            low, high = max(1, s - e), min(len(t) - 1, s + len(pattern) + e)
            if windows and low <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], high)
            else:
                windows.append([low, high])
        best: tuple[int, int] | None = None
        for low, high in windows:
            met = myers(pattern, t[low:high], e)
            if met and (best is None or met[0] < best[0]):
                best = met[0], low + met[1]
        if best is None:
            return None
        low = max(0, best[1] - len(pattern) - e)
        return best[0], low + start_of(pattern, t[low : best[1]], best[0])


_BUILT: dict[str, Matcher] = {}


def _matcher(shared, error_rate: float) -> Matcher:
    """The block's automaton, built once in each worker; blocks are told apart by a name of their own, as workers are reused."""
    name, items = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Matcher(items, error_rate)
    return _BUILT[name]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; the table is read once, and one block is on the driver at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    block: list[tuple[int, str]] = []
    size, some = 0, False
    for r in items.toLocalIterator():
        if block and size + len(r.text) > ITEM_BYTES:
            yield sorted(block)
            block, size, some = [], 0, True
        block.append((r.item, r.text))
        size += len(r.text)
    if block or not some:
        yield sorted(block)


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, distance, start, error_budget``: every pair of a document and an item it holds within the budget.

    ``start`` counts characters of the document's normalised text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in item_blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = _matcher(shared, error_rate)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in find(normalise(text.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["doc_id", "item_id", "distance", "start", "error_budget"])

        found = texts.mapInArrow(run, "doc_id long, item_id long, distance long, start long, error_budget long")
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item; judged row by row, so ids may be null or repeat."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs, names = carried(docs, text_col)
    for block in item_blocks(benchmark, "item_id", "text"):
        shared, at = spark.sparkContext.broadcast((uuid.uuid4().hex, block)), docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            find = _matcher(shared, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not find(normalise(x.as_py())) for x in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names.values())
