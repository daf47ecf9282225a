"""Fill-in-the-middle transformation by a parallel automaton scan.

A text is a sequence of units (lines, or words); two seeded draws cut it after whole units into prefix, middle and suffix, which
are put out in the order prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``) behind control strings. Where the
units begin, and whether a control string occurs in the text, is told by finite automata over its UTF-8 bytes:

1. Bytes are dealt in blocks of ``BLOCK``. Each block, for itself, steps through its bytes from every state at once and emits
   its transition function (entry state → exit state) and, for each entry state, how many units begin in it.
2. Such pairs compose associatively, so a doubling scan over the blocks resolves the state in which each block is entered
   and the units before it, in a logarithmic number of array operations.
3. A cut after k units is the place where unit k + 1 begins: a binary search over the blocks' counts finds the block, and a step
   through that block alone the place.

Texts of up to ``CHUNK`` bytes are scanned where they are read, many to an array. A longer text is dealt over the cluster as rows of
a chunk each: chunks emit their function and counts, of which only these few numbers meet (a row for each megabyte of a text) and
are composed by the same code; the chunks that hold a cut are searched by the tasks that have them. The cuts go back to the texts
by a join; output and restoring are string functions of the JVM.

Cases: a null or empty text has no units and stays ``plain``, its output empty; so does, unchanged, a text that holds a control string;
a null id draws as the empty string; repeated rows give equal rows; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import _kernels as K
from textloom.llm._store import Scratch, bounded_batches, small

#: Bytes of a block of the scan, and of a chunk of a giant text (a multiple of it).
BLOCK, CHUNK = 64, 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Automaton(NamedTuple):
    """``kinds``: class of each byte; ``step`` and ``begins``: next state, and 1 where a unit begins, by class and state, flat.

    State 0 is the first. The last class is padding: it changes no state and begins nothing.
    """

    kinds: np.ndarray
    step: np.ndarray
    begins: np.ndarray
    states: int


def automaton(kinds: np.ndarray, step: list[list[int]], begins: list[list[int]]) -> Automaton:
    states = len(step[0])
    flat = lambda rows, last: np.array([*rows, last], dtype=np.int64).ravel()
    return Automaton(kinds.astype(np.int64), flat(step, list(range(states))), flat(begins, [0] * states), states)


def _kinds(groups: list[bytes]) -> np.ndarray:
    """Class 0 for bytes of no group, else the group's number from 1."""
    out = np.zeros(256, dtype=np.int64)
    for i, g in enumerate(groups, 1):
        out[list(g)] = i
    return out


#: Units by name. lines: ``[^\\n]*\\n|[^\\n]+``. words: a word with the white space behind it (white space at the start is one for itself).
UNITS = {
    # states: a line is over, or has begun; classes: other bytes, line feed
    "lines": automaton(_kinds([b"\n"]), [[1, 1], [0, 0]], [[1, 0], [1, 0]]),
    # states: nothing yet, in a word, in white space; classes: other bytes, white space
    "words": automaton(_kinds([b" \t\n\x0b\x0c\r"]), [[1, 1, 1], [2, 2, 2]], [[1, 0, 1], [1, 0, 0]]),
}


def holding(patterns: list[bytes]) -> Automaton:
    """Counts the places, one at most, where a text first holds one of ``patterns``: states are what of a pattern has been read."""
    heads = sorted({p[:i] for p in patterns for i in range(len(p))}, key=lambda h: (len(h), h))
    letters, found = sorted({b for p in patterns for b in p}), len(heads)

    def after(read: bytes) -> int:
        if any(read.endswith(p) for p in patterns):
            return found
        return next(heads.index(read[i:]) for i in range(len(read) + 1) if read[i:] in heads)

    step = [[0] * found + [found], *([after(h + bytes([b])) for h in heads] + [found] for b in letters)]
    begins = [[int(to == found and i != found) for i, to in enumerate(row)] for row in step]
    return automaton(_kinds([bytes([b]) for b in letters]), step, begins)


MARKED = holding([s.encode() for s in (PREFIX, SUFFIX, MIDDLE)])


class Scan:
    """Blocks of several byte strings under one automaton: exit states and counts of each, composed from each string's start."""

    def __init__(self, a: Automaton, data: np.ndarray, off: np.ndarray):
        self.a, self.off = a, off
        sizes = np.diff(off)
        n = -(-sizes // BLOCK)
        self.first = np.concatenate(([0], np.cumsum(n)))  # of each string, and the end
        pad = len(a.step) // a.states - 1
        self.kinds = np.full(int(self.first[-1]) * BLOCK, pad, dtype=np.uint8)
        at = np.repeat(self.first[:-1] * BLOCK - off[:-1], sizes) + np.arange(len(data))
        self.kinds[at] = a.kinds[data]
        self.kinds = self.kinds.reshape(-1, BLOCK)
        self.to, self.count = self.emitted(self.kinds, np.tile(np.arange(a.states), (len(self.kinds), 1)))
        self.to, self.count = composed(self.to, self.count, np.repeat(self.first[:-1], n))
        self.owner = np.repeat(np.arange(len(sizes)), n)

    def emitted(self, kinds: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of each block for each of its entry states."""
        count = np.zeros(state.shape, dtype=np.int64)
        for column in (np.ascontiguousarray(kinds.T).astype(np.int64) * self.a.states)[:, :, None]:
            at = state + column
            count += self.a.begins[at]
            state = self.a.step[at]
        return state, count

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each string: exit state and count for each entry state; an empty string passes its state on."""
        to, count = np.tile(np.arange(self.a.states), (len(self.off) - 1, 1)), np.zeros((len(self.off) - 1, self.a.states), dtype=np.int64)
        held = np.flatnonzero(np.diff(self.first))
        to[held], count[held] = self.to[self.first[held + 1] - 1], self.count[self.first[held + 1] - 1]
        return to, count

    def places(self, string: np.ndarray, entry: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Byte within each given string where its unit ``k`` (from 1) begins, if it is entered in state ``entry``; ``k`` must exist."""
        low, high = self.first[string], self.first[string + 1] - 1
        while len(low) and (low < high).any():  # the first block by whose end k units have begun
            mid = (low + high) // 2
            there = self.count[mid, entry] >= k
            high, low = np.where(there, mid, high), np.where(there, low, mid + 1)
        inner = low > self.first[string]
        state = np.where(inner, self.to[np.maximum(low - 1, 0), entry], entry)
        left = k - np.where(inner, self.count[np.maximum(low - 1, 0), entry], 0)
        at = np.full(len(k), -1, dtype=np.int64)
        for j in range(BLOCK if len(k) else 0):
            cell = state + self.kinds[low, j].astype(np.int64) * self.a.states
            left = left - self.a.begins[cell]
            at = np.where((at < 0) & (left == 0), j, at)
            state = self.a.step[cell]
        return (low - self.first[string]) * BLOCK + at


def composed(to: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's function and counts after all rows from its ``first`` on: an inclusive scan by doubling."""
    rows, d = np.arange(len(to)), 1
    while True:
        later = np.flatnonzero(rows - d >= first)
        if not len(later):
            return to, count
        before = to[later - d]
        joined = np.take_along_axis(to[later], before, 1), count[later - d] + np.take_along_axis(count[later], before, 1)
        to, count = to.copy(), count.copy()
        to[later], count[later] = joined
        d *= 2


def cut_units(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many units end before the first and the second cut."""
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def _chars(data: np.ndarray) -> np.ndarray:
    """Characters before each byte, and in all: bytes that don't continue one."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def _cuts_column(units: str, text: Column, h1: Column, h2: Column) -> Column:
    """Units, whether a control string occurs, and the characters before both cuts, of texts that fit in a chunk."""

    @F.arrow_udf("struct<n:bigint,marked:boolean,first:bigint,second:bigint>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, one, two in batches:
            data, off = K.utf8(texts)
            h = [np.asarray(x, dtype=np.int64) for x in (one, two)]
            out: list[list[np.ndarray]] = []
            for a, b in K.blocks(off, 4 << 20):
                part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                scan = Scan(UNITS[units], part, at)
                n, marked = scan.total()[1][:, 0], Scan(MARKED, part, at).total()[1][:, 0] > 0
                chars, places = _chars(part), []
                for k in cut_units(n, h[0][a:b], h[1][a:b]):
                    place, inner = np.diff(at), np.flatnonzero(k < n)
                    place[inner] = scan.places(inner, np.zeros(len(inner), dtype=np.int64), k[inner] + 1)
                    places.append(chars[at[:-1] + place] - chars[at[:-1]])
                out.append([n, marked, *places])
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=t) for t in (np.int64, bool, np.int64, np.int64)]
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n", "marked", "first", "second"])

    return run(text, h1, h2)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, h1, h2, text`` → ``key, seq, h1, h2, chunk`` of at most ``CHUNK`` bytes, cut between characters."""
    names = ["key", "seq", "h1", "h2", "chunk"]
    for batch in batches:
        for key, h1, h2, text in zip(*(batch.column(c) for c in ("key", "h1", "h2", "text")), strict=True):
            data, at, seq = np.frombuffer(text.as_buffer(), dtype=np.uint8), 0, 0
            draws = [pa.array([h.as_py()], pa.int64()) for h in (h1, h2)]
            while at < len(data):
                end = min(at + CHUNK, len(data))
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end -= 1
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([seq], pa.int32()), *draws, pa.array([data[at:end].tobytes()], pa.binary())], names)
                at, seq = end, seq + 1


def _emitted(units: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4]
        names = ["key", "seq", "h1", "h2", "chars", "to", "count", "m_to", "m_count"]
        for batch in batches:
            of = (batch.column(c).to_pylist() for c in ("key", "seq", "h1", "h2"))
            for key, seq, h1, h2, chunk in zip(*of, batch.column("chunk"), strict=True):
                data = np.frombuffer(chunk.as_buffer(), dtype=np.uint8)
                off = np.array([0, len(data)])
                told = [x[0].tolist() for a in (UNITS[units], MARKED) for x in Scan(a, data, off).total()]
                columns = [pa.array([v], t) for v, t in zip([int(_chars(data)[-1]), *told], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([seq], pa.int32()), pa.array([h1], pa.int64()), pa.array([h2], pa.int64()), *columns], names)

    return run


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Composes a text's chunks: a row for each cut, with the chunk that holds it, its entry state and the unit's number there."""
    names = ["key", "n", "marked", "cut", "seq", "entry", "k", "before"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parts = r["parts"]
            first = np.zeros(len(parts), dtype=np.int64)
            to, count = composed(np.array([p["to"] for p in parts]), np.array([p["count"] for p in parts]), first)
            marked = composed(np.array([p["m_to"] for p in parts]), np.array([p["m_count"] for p in parts]), first)[1][-1, 0] > 0
            chars, upto = np.concatenate(([0], np.cumsum([p["chars"] for p in parts]))), count[:, 0]
            n = int(upto[-1])
            for cut, k in enumerate(cut_units(np.array([n]), np.array([r["h1"]]), np.array([r["h2"]]))):
                want = int(k[0]) + 1
                if want > n:
                    rows.append((r["key"], n, bool(marked), cut, None, 0, 0, int(chars[-1])))
                    continue
                i = int(np.searchsorted(upto, want))
                rows.append((r["key"], n, bool(marked), cut, parts[i]["seq"], int(to[i - 1, 0]) if i else 0, want - (int(upto[i - 1]) if i else 0), int(chars[i])))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names)


def _located(units: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, chunk in enumerate(batch.column("chunk")):
                data = np.frombuffer(chunk.as_buffer(), dtype=np.uint8)
                place = Scan(UNITS[units], data, np.array([0, len(data)])).places(np.array([0]), *(np.array([batch.column(c)[i].as_py()]) for c in ("entry", "k")))
                out.append(batch.column("before")[i].as_py() + int(_chars(data)[int(place[0])]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n", "marked", "cut")), pa.array(out, pa.int64())], ["key", "n", "marked", "cut", "place"])

    return run


def giant_cuts(giants: DataFrame, units: str, scratch: Scratch) -> DataFrame | None:
    """``key, text, h1, h2`` → ``key, n, marked, first, second`` of each key, with the chunks of all texts dealt over the tasks.

    None if there are no such texts.
    """
    dealt = giants.select("key", "h1", "h2", "text").mapInArrow(_chunks, "key string, seq int, h1 long, h2 long, chunk binary")
    chunks = scratch.save(dealt.hint("rebalance"), "chunks")
    if chunks.isEmpty():
        return None
    told = chunks.mapInArrow(_emitted(units), "key string, seq int, h1 long, h2 long, chars long, to array<long>, count array<long>, m_to array<long>, m_count array<long>")
    told = scratch.save(told.dropDuplicates(["key", "seq"]), "emitted")
    parts = F.array_sort(F.collect_list(F.struct("seq", "chars", "to", "count", "m_to", "m_count")))
    texts = told.groupBy("key").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), parts.alias("parts"))
    plan = scratch.save(texts.mapInArrow(_planned, "key string, n long, marked boolean, cut int, seq int, entry long, k long, before long"), "plan")
    held = chunks.join(small(plan.where("seq is not null")), ["key", "seq"]).select("key", "n", "marked", "cut", "entry", "k", "before", "chunk")
    places = held.mapInArrow(_located(units), "key string, n long, marked boolean, cut int, place long")
    places = places.union(plan.where("seq is null").select("key", "n", "marked", "cut", F.col("before").alias("place")))
    pick = lambda i: F.max(F.when(F.col("cut") == i, F.col("place")))
    return scratch.save(places.groupBy("key").agg(F.max("n").alias("n"), F.max("marked").alias("marked"), pick(0).alias("first"), pick(1).alias("second")), "cuts")


def transformed(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, units: str = "lines", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n`` (units), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` (null if plain) and the ``output`` of each row.

    ``rate`` per cent of the texts are transformed, ``spm`` per cent of these with the suffix in front, drawn by id and ``seed``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "middle")
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256)
    draw = lambda i: F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *(draw(i).alias(f"h{i}") for i in (1, 2, 3, 4)))
    giant = F.octet_length("text") > CHUNK
    near = rows.where(~giant).withColumn("c", _cuts_column(units, F.col("text"), F.col("h1"), F.col("h2")))
    far = rows.where(giant).withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(F.col("text").cast("binary"), 256)))
    fields = ["n", "marked", "first", "second"]
    cuts = giant_cuts(far, units, scratch)
    if cuts is not None:
        near = near.union(far.join(small(cuts), "key").withColumn("c", F.struct(*fields)).select(*near.columns))
    plain = (F.col("text") == "") | F.col("c.marked") | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    told = near.select("doc_id", "text", "c", form.alias("form"))
    part = lambda a, n: F.substring(F.col("text"), (a + 1).cast("int"), n.cast("int"))
    first, second = F.col("c.first"), F.col("c.second")
    head, body, tail = part(F.lit(0), first), part(first, second - first), part(second, F.lit((1 << 31) - 1))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), body))
    output = output.otherwise(F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), body))
    cut = lambda c: F.when(F.col("form") != "plain", c)
    return told.select("doc_id", F.col("c.n").alias("n"), "form", cut(first).alias("prefix_chars"), cut(second - first).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of, from these two alone."""
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    end = F.char_length(output) + 1
    middle = between(m, end)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
