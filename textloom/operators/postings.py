"""Posting blocks of an index: which pages of units hold a gram or a token.

Units have numeric ids; ``PAGE`` neighbours are a page and ``ZONE`` pages a zone. For each key (a 2-gram or 3-gram of the loose form, or a
token) and zone there is one block (a zone that two tasks read, or that is large, has several): its first and last page, how many pages, and the
pages themselves as deltas of one or two bytes, or as a bitmap where that is shorter. A look-up intersects the blocks zone by
zone, the rarest key first: blocks of other keys are read only for zones in which the rarest occurs, and decoded only if their
range of pages meets what is left. What is found is exact for pages, and judged unit by unit afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import forms
from textloom.functions import text as X
from textloom.session import reachable

#: Bits of the numbers of units in a page, and of pages in a zone.
PAGE_BITS, ZONE_BITS = 4, 12
PAGE, ZONE = 1 << PAGE_BITS, 1 << ZONE_BITS
BUCKETS = 64
#: Units for which a bucket's blocks have one file more, up to eight.
SPLIT = 1 << 19
#: Bits of a character's number in a zone, and characters with which a zone is told early; pairs with which it is.
POINT_BITS, MOST_POINTS, PAIRS = 17, 1 << 16, 2_000_000
#: The letter that folds to two.
ESZETT = 0xDF
POSTING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("zone", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("first", "last", "n")), T.StructField("pages", T.BinaryType())])


def packed(pages: np.ndarray) -> bytes:
    """Rising page numbers of a zone as bytes: a first byte of 0 and deltas, or of 1 and a bitmap."""
    deltas = np.diff(pages, prepend=0)
    wide = deltas >= 128
    if len(pages) + int(wide.sum()) > ZONE // 8:
        bits = np.zeros(ZONE, dtype=bool)
        bits[pages] = True
        return b"\x01" + np.packbits(bits).tobytes()
    at = np.cumsum(1 + wide) - (1 + wide)
    out = np.zeros(len(pages) + int(wide.sum()), dtype=np.uint8)
    out[at] = np.where(wide, 128 | deltas >> 7, deltas)
    out[at[wide] + 1] = deltas[wide] & 127
    return b"\x00" + out.tobytes()


def unpacked(block: bytes) -> np.ndarray:
    raw = np.frombuffer(block, dtype=np.uint8, offset=1)
    if block[:1] == b"\x01":
        return np.flatnonzero(np.unpackbits(raw))
    wide = raw >= 128
    second = np.concatenate(([False], wide[:-1]))
    at = np.flatnonzero(~second)
    value = raw[at].astype(np.int64)
    long = wide[at]
    value[long] = (value[long] & 127) << 7 | raw[at[long] + 1]
    return np.cumsum(value)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted and each once; many times quicker than by hashing."""
    values = np.sort(values)
    return values[_firsts(values)] if len(values) else values


def _firsts(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], values[1:] != values[:-1]))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters that fold by themselves: lower case, the same in katakana, whether a letter or number, whether a separator."""
    lower, kana = (np.zeros(1 << 16, dtype=np.uint32) for _ in range(2))
    word, between = (np.zeros(1 << 16, dtype=bool) for _ in range(2))
    for low, high in X._BLOCKS:
        for i in range(low, high + 1):
            c = chr(i)
            lower[i] = ord(c.lower()[0])
            kana[i] = ord(forms.kana(c)[0]) if len(forms.kana(c)) == 1 else lower[i]
            word[i], between[i] = forms.alphanumeric(c), forms.separator(c)
    for table in (lower, kana):
        table[ESZETT] = ord("s")  # twice
    return lower, kana, word, between


def _loose(points: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loose forms of all units, and the unit of each character."""
    _, kana, _, between = _tables()
    kept = ~between[points]
    points, unit = points[kept], unit[kept]
    twice = 1 + (points == ESZETT)
    return np.repeat(kana[points], twice), np.repeat(unit, twice)


def _tokens(points: np.ndarray, unit: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all units (as ``forms.tokens``), and the unit of each."""
    lower, _, word, _ = _tables()
    if not len(points):
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    inside = word[points]
    small, capital, digit = ((points >= a) & (points <= b) for a, b in ((97, 122), (65, 90), (48, 57)))
    before = lambda x: np.concatenate(([False], x[:-1]))
    new = np.concatenate(([True], unit[1:] != unit[:-1]))
    small_next = np.append(small[1:] & ~new[1:], False)
    camel = before(small) & capital | before(capital) & capital & small_next
    starts = inside & (new | ~before(inside) | camel | (before(digit) != digit))
    own = points[inside]
    twice = 1 + (own == ESZETT)
    at = np.repeat(np.arange(len(own)), twice)
    text = lower[own][at]
    size = 1 + (text >= 0x80) + (text >= 0x800)
    first = starts[inside][at] & np.concatenate(([True], at[1:] != at[:-1]))
    off = np.append((np.cumsum(size) - size)[first], size.sum()).astype(np.int32)
    raw = text.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(raw)), unit[starts]


class _Zone:
    """Distinct pairs of key and page of one zone, gathered batch by batch; a pair is one number, its low bits the page."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.held: dict[str, list[np.ndarray]] = {"2": [], "3": []}
        self.words: list[tuple[pa.Array, np.ndarray]] = []
        self.point_ids, self.points = np.full(0x110000, -1, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def add(self, kind: str, keys: np.ndarray, pages: np.ndarray) -> None:
        pairs = distinct(keys << ZONE_BITS | pages)
        self.held[kind].append(pairs)
        self.size += len(pairs)

    def grams(self, points: np.ndarray, pages: np.ndarray, left: np.ndarray) -> None:
        """``left``: characters from each to the end of its unit. Characters are numbered as they come."""
        ids = self.point_ids[points]
        if (ids < 0).any():
            new = np.unique(points[ids < 0])
            self.point_ids[new] = np.arange(len(self.points), len(self.points) + len(new))
            self.points = np.concatenate([self.points, new])
            ids = self.point_ids[points]
        for n in (2, 3):
            at = np.flatnonzero(left >= n)
            key = ids[at] << POINT_BITS | ids[at + 1]
            self.add(str(n), key << POINT_BITS | ids[at + 2] if n == 3 else key, pages[at])

    def tokens(self, words: pa.Array, pages: np.ndarray) -> None:
        self.words.append((words, pages))
        self.size += len(pages)

    def units(self, texts: list[str], odd: np.ndarray, pages: np.ndarray) -> None:
        """Adds units of this zone. Texts of characters that fold by themselves are folded and cut as one array of all; ``odd`` ones
        by the functions for all of Unicode."""
        many = [("" if o else t) for t, o in zip(texts, odd.tolist(), strict=True)]
        points = np.frombuffer("".join(many).encode("utf-32-le"), dtype=np.uint32)
        unit = np.repeat(np.arange(len(many)), [len(t) for t in many])
        loose, of = _loose(points, unit)
        others = [(i, forms.loose(texts[i])) for i in np.flatnonzero(odd).tolist()]
        if others:
            more = np.frombuffer("".join(t for _, t in others).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            loose, of = np.concatenate([loose, more]), np.concatenate([of, np.repeat([i for i, _ in others], [len(t) for _, t in others])])
        if len(of):
            ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
            self.grams(loose, pages[of], np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(of)))
        words, own = _tokens(points, unit)
        self.tokens(words, pages[own])
        rest = [(w, int(pages[i])) for i, _ in others for w in forms.tokens(texts[i])]
        if rest:
            self.tokens(pa.array([w for w, _ in rest]), np.array([p for _, p in rest], dtype=np.int64))

    def names(self, n: int, keys: np.ndarray) -> list[str]:
        ids = np.stack([keys >> POINT_BITS * i & (1 << POINT_BITS) - 1 for i in range(n - 1, -1, -1)], axis=1)
        text = self.points[ids].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [text[i : i + n] for i in range(0, len(text), n)]

    def blocks(self) -> Iterator[pa.RecordBatch]:
        for kind, parts in self.held.items():
            pairs = distinct(np.concatenate(parts)) if parts else ()
            if len(pairs):
                keys = pairs >> ZONE_BITS
                yield from self._blocks(kind, keys, pairs & ZONE - 1, pa.array(self.names(int(kind), keys[_firsts(keys)])))
        each = pa.concat_arrays([w for w, _ in self.words]).dictionary_encode() if self.words else ()
        if len(each):
            pairs = distinct(np.asarray(each.indices, dtype=np.int64) << ZONE_BITS | np.concatenate([p for _, p in self.words]))
            yield from self._blocks("t", pairs >> ZONE_BITS, pairs & ZONE - 1, each.dictionary)  # numbered without gaps

    def _blocks(self, kind: str, keys: np.ndarray, pages: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        """The same bytes as ``packed`` of each key's pages, made for all keys at once."""
        first = _firsts(keys)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(keys))
        deltas = np.where(first, pages, pages - np.concatenate(([0], pages[:-1])))
        wide = deltas >= 128
        upto = np.cumsum(1 + wide + first)
        at = upto - 1 - wide
        blob = np.zeros(int(upto[-1]), dtype=np.uint8)
        blob[at] = np.where(wide, 128 | deltas >> 7, deltas)
        blob[at[wide] + 1] = deltas[wide] & 127
        off = np.append(at[starts] - 1, len(blob)).astype(np.int32)
        made = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(blob)])
        dense = np.flatnonzero(np.diff(off) - 1 > ZONE // 8)
        if len(dense):
            other = [packed(pages[starts[i] : ends[i]]) for i in dense.tolist()]
            made = pc.replace_with_mask(made, pa.array(np.isin(np.arange(len(starts)), dense)), pa.array(other, pa.binary()))
        columns = [pa.array([kind] * len(starts)), names, pa.array(np.full(len(starts), self.number))]
        columns += [pa.array(x.astype(np.int32)) for x in (pages[starts], pages[ends - 1], ends - starts)]
        whole = pa.RecordBatch.from_arrays([*columns, made], POSTING.names)
        for i in range(0, len(starts), 10_000):
            yield whole.slice(i, 10_000)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``unit_no, text, odd`` in the order of ``unit_no`` → blocks; at most ``PAIRS`` and a batch's pairs are in memory."""
    zone: _Zone | None = None
    for batch in batches:
        numbers = np.asarray(batch.column("unit_no"), dtype=np.int64)
        pages, zones = numbers >> PAGE_BITS, numbers >> PAGE_BITS + ZONE_BITS
        cuts = [0, *(np.flatnonzero(np.diff(zones)) + 1).tolist(), len(zones)] if len(zones) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if zone is None or zone.number != zones[a] or zone.size > PAIRS or len(zone.points) > MOST_POINTS:
                if zone:
                    yield from zone.blocks()
                zone = _Zone(int(zones[a]))
            texts = [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]
            zone.units(texts, np.asarray(batch.column("odd").slice(a, b - a).fill_null(False)), pages[a:b] & ZONE - 1)
    if zone:
        yield from zone.blocks()


def bucket(kind: Column, key: Column) -> Column:
    """Grams lie by their hash, tokens by that of their first character."""
    return F.pmod(F.crc32(F.when(kind == "t", F.substring(key, 1, 1)).otherwise(key)), F.lit(BUCKETS)).cast("int")


def buckets(values: list[str]) -> list[int]:
    return sorted({zlib.crc32(v.encode()) % BUCKETS for v in values})


def write(units: DataFrame, folder: str, size: int) -> None:
    """The blocks of ``size`` ``units``, which lie in the order of ``unit_no``. Blocks move, single postings never do."""
    conf = reachable(units.sparkSession).conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # the arrays of a batch take many times its text
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    made = units.select("unit_no", "text", F.col("text").rlike(X.UNTOKENED).alias("odd")).mapInArrow(blocks_of, POSTING)
    _store(made.withColumn("bucket", bucket(F.col("kind"), F.col("key"))), folder, size)


def copy(blocks: DataFrame, folder: str, size: int) -> None:
    """Blocks that were made before, of zones with new numbers; no text is read. ``size``: units that they are of."""
    _store(blocks.select(*POSTING.names, "bucket"), folder, size)


def _store(made: DataFrame, folder: str, size: int) -> None:
    # The second key splits a bucket's blocks over tasks; a small segment's aren't, as a file costs more than its few rows.
    dealt = made.repartition("bucket", F.pmod(F.xxhash64("zone"), F.lit(min(8, 1 + size // SPLIT)))).sortWithinPartitions("bucket", "kind", "key", "zone")
    dealt.write.mode("overwrite").partitionBy("bucket").option("parquet.block.size", str(1 << 20)).option("compression", "zstd").parquet(folder)


def _intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``segment, zone, want, blocks`` → ``segment, page`` of the pages that hold ``want`` different keys."""
    for batch in batches:
        segments, pages = [], []
        for r in batch.to_pylist():
            by_key: dict[str, list[dict]] = {}
            for b in r["blocks"]:
                by_key.setdefault(b["key"], []).append(b)
            left = None
            for _, blocks in sorted(by_key.items(), key=lambda x: sum(b["n"] for b in x[1])) if len(by_key) == r["want"] else ():
                if left is not None:  # maxima first: what can't meet isn't decoded
                    blocks = [b for b in blocks if len(left) and b["first"] <= left[-1] and b["last"] >= left[0]]
                own = np.unique(np.concatenate([unpacked(b["pages"]) for b in blocks])) if blocks else np.zeros(0, dtype=np.int64)
                left = own if left is None else np.intersect1d(left, own, assume_unique=True)
            if left is not None and len(left):
                segments.append(np.full(len(left), r["segment"], dtype=np.int32))
                pages.append(left + (r["zone"] << ZONE_BITS))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in ((segments, pa.int32()), (pages, pa.int64()))], ["segment", "page"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(batch.column("segment").to_pylist(), batch.column("zone").to_pylist(), (unpacked(p) for p in batch.column("pages").to_pylist()), strict=True))
        segments = [np.full(len(p), s, dtype=np.int32) for s, _, p in rows]
        pages = [p + (z << ZONE_BITS) for _, z, p in rows]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in ((segments, pa.int32()), (pages, pa.int64()))], ["segment", "page"])


def holding_all(postings: DataFrame, grams: list[str]) -> DataFrame:
    """``segment, page`` of the pages that hold each of a few grams of one length."""
    own = postings.where(F.col("bucket").isin(*buckets(grams)) & (F.col("kind") == str(len(grams[0]))) & F.col("key").isin(*grams))
    sizes = {r.key: r.n for r in own.groupBy("key").agg(F.sum("n").alias("n")).collect()}  # a row for each gram, of three at most
    if len(sizes) < len(set(grams)):
        return postings.sparkSession.createDataFrame([], "segment int, page long")
    rare = min(sorted(sizes), key=sizes.get)
    blocks = own.where(F.col("key") == rare)
    if len(sizes) > 1:
        blocks = blocks.union(own.where(F.col("key") != rare).join(blocks.select("segment", "zone").distinct(), ["segment", "zone"], "left_semi").select(*own.columns))
    zones = blocks.groupBy("segment", "zone").agg(F.collect_list(F.struct("key", "first", "last", "n", "pages")).alias("blocks"))
    return zones.select("segment", "zone", F.lit(len(sizes)).alias("want"), "blocks").mapInArrow(_intersected, "segment int, page long")


def holding_any(postings: DataFrame, firsts: list[str], test: Column) -> DataFrame:
    """``segment, page`` of the pages with a token that begins with one of ``firsts`` and passes ``test`` (of the column ``key``)."""
    own = postings.where(F.col("bucket").isin(*buckets(firsts)) & (F.col("kind") == "t") & test)
    return own.select("segment", "zone", "pages").mapInArrow(_decoded, "segment int, page long").distinct()
