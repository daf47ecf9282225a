"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits that hold at once: tokens, segments (examples or pieces of documents), and tokens that bear loss. Items are
vectors of the same three. The open sequence takes, of the items that fit in what is left of every limit, the one whose
demand has the largest dot product with what is left, each limit in its own units and weighted by how much the waiting items ask
of it: scarce limits decide. When nothing fits, the sequence is closed.

Instruction examples stay whole (``pack_examples``). Documents may be cut (``pack_documents``): a document's whole windows are
sequences by themselves, its rest is an item, and the item that comes first when nothing fits is cut to fill the sequence. A sequence
that can't be filled, as its segments are used up or the items at an end, is cut back to the largest power of two, and what stood
beyond waits again; as a sequence whose length is a power of two isn't padded, documents are packed without padding.

Each task packs the rows of its own input partition, a pool of at most ``POOL`` items or ``POOL_TOKENS`` tokens at a time, so nothing
is shuffled and no group meets in one task, whatever is alike. The price is a few short sequences for each partition. A sequence's id
is the number of its partition and its place there; equal partitions give equal results. A partition is packed in one task and
tells only of itself, so a lost executor's partitions are packed again without regard to others.

Ids are those of the tokenizer file (byte-level BPE of the ``tokenizers`` library), with its special tokens parsed and none added. Its
vocabulary is encoded by ``tiktoken``, which gives equal ids (tests hold both against each other on every code point) in a fifth
of the time; long texts are encoded in stretches cut before white space that follows other characters, where no token spans.

Cases: a null or empty text has its end token alone; a null id is kept; repeated rows are documents of their own; an empty table
gives an empty result; further columns are ignored. An example that alone exceeds a limit can't be packed whole: it is returned with a null
sequence. Examples without tokens aren't packed either; null counts are 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._store import bounded_batches
from textloom.llm.chat_format import TOKENIZER

#: Items, and their tokens, that wait at most before a sequence is filled.
POOL, POOL_TOKENS = 2048, 1 << 21
#: Characters that are encoded at a time, if the text has a place to cut.
STRETCH = 1 << 20
END = 1


class Limits(NamedTuple):
    """Of a sequence: tokens, segments, tokens that bear loss."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Piece(NamedTuple):
    """Tokens ``start`` to ``start + length`` of item ``owner``, of which ``loss`` bear loss."""

    owner: int
    start: int
    length: int
    loss: int


class Packer:
    """Places items of one partition; ``put`` and ``end`` give the sequences that are complete, as lists of pieces in order."""

    def __init__(self, limits: Limits, cut: bool):
        if min(limits) < 1:
            raise ValueError("every limit is 1 at least")
        self.limits, self.cut = limits, cut
        self.most = np.array(limits, dtype=np.float64)
        self.pool = np.zeros((4, 4 * POOL), dtype=np.int64)  # owner, start, length, loss of each item that waits
        self.n = self.tokens = 0

    def wait(self, p: Piece) -> None:
        if self.n == self.pool.shape[1]:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)], axis=1)
        self.pool[:, self.n] = p
        self.n += 1
        self.tokens += p.length

    def take(self, i: int) -> Piece:
        p = Piece(*self.pool[:, i].tolist())
        self.n -= 1
        self.tokens -= p.length
        self.pool[:, i] = self.pool[:, self.n]
        return p

    def put(self, owner: int, length: int, loss: int) -> Iterator[list[Piece]]:
        """``loss`` of an item that may be cut is its length."""
        at, window = 0, min(self.limits.tokens, self.limits.loss)
        if self.cut:
            while length - at >= window:
                yield [Piece(owner, at, window, window)]
                at += window
        if length > at:
            self.wait(Piece(owner, at, length - at, length - at if self.cut else loss))
        while self.n >= POOL or self.tokens >= POOL_TOKENS:
            yield self.filled()

    def end(self) -> Iterator[list[Piece]]:
        while self.n:
            yield self.filled()

    def best(self, left: np.ndarray) -> int:
        """Of the items that fit in ``left``, that of the largest weighted dot product (first of equal ones); -1 if none fits."""
        _, _, length, loss = self.pool[:, : self.n]
        fits = np.flatnonzero((length <= left[0]) & (loss <= left[2])) if left[1] >= 1 else ()
        if not len(fits):
            return -1
        share = left / self.most
        weight = np.array([length.mean(), 1.0, loss.mean()]) / self.most
        by = weight * share / self.most
        return int(fits[np.argmax(length[fits] * by[0] + loss[fits] * by[2])])  # one segment each: equal for all

    def filled(self) -> list[Piece]:
        out: list[Piece] = []
        left = np.array(self.limits, dtype=np.int64)
        while self.n:
            i = self.best(left)
            if i < 0:
                room = int(min(left[0], left[2]))
                if not self.cut or room < 1 or left[1] < 1:
                    break
                p = self.take(int(np.argmax(self.pool[2, : self.n])))
                self.wait(Piece(p.owner, p.start + room, p.length - room, p.length - room))
                out.append(Piece(p.owner, p.start, room, room))
                break
            p = self.take(i)
            out.append(p)
            left -= (p.length, 1, p.loss)
            if not left[0]:
                break
        return self.trimmed(out) if self.cut else out

    def trimmed(self, pieces: list[Piece]) -> list[Piece]:
        """The pieces cut back to the largest power of two, if they don't fill the sequence; the rest waits."""
        total = sum(p.length for p in pieces)
        over = 0 if total == self.limits.tokens else total - (1 << total.bit_length() - 1)
        while over:
            p = pieces.pop()
            back = min(over, p.length)
            over -= back
            if back < p.length:
                pieces.append(Piece(p.owner, p.start, p.length - back, p.length - back))
            self.wait(Piece(p.owner, p.start + p.length - back, back, back))
        return pieces


@cache
def encoder(path: str):
    """``text → ids`` of a byte-level BPE file of the ``tokenizers`` library."""
    import tiktoken

    told = json.loads(Path(path).read_text(encoding="utf-8"))
    pre, model = told["pre_tokenizer"], told["model"]
    if told["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        raise ValueError("not a plain byte-level BPE file")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"]):
        raise ValueError("added tokens that take more than their own characters")
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from U+0100
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    ranks = {bytes(letters[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    made = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    marks = set(special)
    return lambda text: made.encode_to_numpy(text, allowed_special=marks, disallowed_special=())


def stretches(text: str) -> Iterator[str]:
    """``text`` in parts of about ``STRETCH`` characters, each cut before white space that follows another character."""
    at = 0
    while len(text) - at > STRETCH:
        end = at + STRETCH
        while end < len(text) and not (text[end].isspace() and not text[end - 1].isspace()):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def tokens(text: str | None, path: str) -> np.ndarray:
    """The ids of a text and its end token."""
    parts = [np.asarray(encoder(path)(s), dtype="<u4") for s in stretches(text)] if text else []
    return np.concatenate([*parts, np.array([END], dtype="<u4")])


@dataclass
class _Held:
    """A document of which ``left`` tokens wait; ``ids`` are those from ``start`` on."""

    name: int | None
    ids: np.ndarray
    start: int
    tokens: int
    left: int


def _packed_documents(limits: Limits, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, waiting, sequence = Packer(limits, True), {}, [], TaskContext.get().partitionId() << 33

        def told(sequences: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    doc = held[p.owner]
                    at = p.start - doc.start
                    waiting.append((doc.name, p.start, p.length, doc.ids[at : at + p.length].tobytes(), doc.tokens, sequence, offset))
                    offset += p.length
                    doc.left -= p.length
                    if not doc.left:
                        del held[p.owner]
                sequence += 1

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            if len(waiting) > least:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
                waiting.clear()

        owner = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens(text.as_py(), path)
                held[owner] = doc = _Held(doc_id, ids, 0, len(ids), len(ids))
                told(packer.put(owner, len(ids), len(ids)))
                doc.ids, doc.start = doc.ids[-doc.left :].copy(), len(ids) - doc.left  # the rest alone waits
                owner += 1
                yield from rows(1000)
        told(packer.end())
        yield from rows(0)

    return run


def pack_documents(docs: DataFrame, limits: Limits = Limits(), tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids`` (little-endian 32-bit numbers), ``doc_tokens, sequence_id, offset``."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(_packed_documents(limits, tokenizer), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _packed_examples(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, sequence = Packer(limits, False), {}, TaskContext.get().partitionId() << 33
        names = ["example_id", "tokens", "loss_tokens", "sequence_id", "offset"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        def placed(sequences: Iterator[list[Piece]]) -> Iterator[tuple]:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    yield (held.pop(p.owner), p.length, p.loss, sequence, offset)
                    offset += p.length
                sequence += 1

        owner = 0
        for batch in batches:
            out: list[tuple] = []
            for name, length, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if length < 1 or length > limits.tokens or loss > limits.loss:
                    out.append((name, length, loss, None, None))
                    continue
                held[owner] = name
                out += placed(packer.put(owner, length, loss))
                owner += 1
            yield batch_of(out)
        yield batch_of(list(placed(packer.end())))

    return run


def pack_examples(examples: DataFrame, limits: Limits = Limits(), id_col: str = "example_id", tokens_col: str = "tokens", loss_col: str = "loss_tokens") -> DataFrame:
    """Whole examples of ``tokens``, of which ``loss_tokens`` bear loss: ``example_id`` (a string), both counts, ``sequence_id, offset``."""
    bounded_batches(examples.sparkSession)
    count = lambda c: F.greatest(F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)), F.lit(0))
    rows = examples.select(F.col(f"`{id_col}`").cast("string"), count(tokens_col), count(loss_col))
    return rows.mapInArrow(_packed_examples(limits), "example_id string, tokens long, loss_tokens long, sequence_id long, offset long")
