"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: ``### role: `` text ``</turn>`` and a line break for each turn, in order of turn. Inside roles
and texts a backslash stands before each ``\\``, ``<``, ``#`` and ``:`` that could begin or end a control string, which is undone
exactly. The rendered string is encoded once, with character offsets; the sorted spans of the turns to learn from are
intersected with the token spans by binary search, which gives the loss mask of the tokens and, cut to the turn, the
characters under it.

Cases: null text and null role are empty; equal turn numbers are ordered by role and text, null turns first; a null
conversation id is a conversation of its own; an empty table gives an empty result; further columns are ignored. A
conversation is one string by its nature and so is formatted by one task.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._store import bounded_batches

#: Conversations whose encodings are in memory at once.
SLICE = 32
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_ESCAPED, _UNESCAPED = re.compile(r"[\\<#:]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string, and the sorted character spans of the texts to learn from."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"### {escape(role)}: ", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered string; ValueError if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """A bit for each token, set if it meets a span, and the characters of the spans that tokens cover, joined.

    ``offsets`` ascend by start and end (several tokens may share a character); ``spans`` are sorted and disjoint.
    """
    bits, covered = [0] * len(offsets), []
    ends = [e for _, e in offsets]
    for a, b in spans:
        i, upto = bisect_left(ends, a + 1), a
        while i < len(offsets) and offsets[i][0] < b:
            s, e = max(offsets[i][0], a, upto), min(offsets[i][1], b)
            bits[i] = 1
            if e > s:
                if covered and covered[-1][1] == s and s > a:
                    covered[-1] = (covered[-1][0], e)
                else:
                    covered.append((s, e))
                upto = e
            i += 1
    return bits, covered


_TOKENIZERS: dict = {}


def _encoder(shared):
    from tokenizers import Tokenizer, processors

    if "it" not in _TOKENIZERS or _TOKENIZERS["key"] is not shared:
        it = Tokenizer.from_str(shared.value)
        it.encode_special_tokens = True
        it.post_processor = processors.ByteLevel(trim_offsets=False)  # a token's leading space is its own
        _TOKENIZERS.update(key=shared, it=it)
    return _TOKENIZERS["it"]


OUT = "conv_id long, formatted string, token_ids array<int>, loss_mask array<int>, loss_spans array<struct<start:int,end:int>>"


def formatted(conversations: DataFrame, tokenizer: str = TOKENIZER, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, token_ids, loss_mask, loss_spans``, one row per conversation; ``tokenizer``: a JSON vocabulary file
    with offsets that lose no character, read on the driver and sent to the executors (a few MB)."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared)
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
            made = [render([(t["role"], t["text"]) for t in x], learn) for x in batch.column("turns").to_pylist()]
            tokens = encode.encode_batch([s for s, _ in made], add_special_tokens=False)
            masks = [mask(e.offsets, spans) for e, (_, spans) in zip(tokens, made, strict=True)]
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([s for s, _ in made]), pa.array([e.ids for e in tokens], pa.list_(pa.int32())), pa.array([m for m, _ in masks], pa.list_(pa.int32())), pa.array([[{"start": a, "end": b} for a, b in c] for _, c in masks], span)], ["conv_id", "formatted", "token_ids", "loss_mask", "loss_spans"])

    return whole.mapInArrow(run, OUT)


def digests(formatted_rows: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations: their turns, and the text under the mask, both as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, bits, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_mask", "loss_spans")), strict=True):
                turns = parse(text)
                lost = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(told.encode("utf-8", "surrogatepass")).hexdigest(), len(lost), hashlib.sha256(lost.encode("utf-8", "surrogatepass")).hexdigest(), len(text), len(bits), sum(bits)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"])

    return formatted_rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")
