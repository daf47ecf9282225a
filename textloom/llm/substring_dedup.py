"""Substring deduplication by paragraph MinHash banding, and exact removal of repeated passages inside paragraphs.

Paragraphs are the lines of ``min_words`` words or more. Equal ones form a class by digest, before anything else.
Each class's five-word shingles give a one-permutation signature, cut into bands tuned for the recall wanted at the similarity;
colliding paragraphs are joined, compared and clustered by connected components (``near_dedup.linked``: stars in large
buckets, then every pair of a bucket that isn't joined yet), verified by exact Jaccard similarity on the paragraphs' texts. A
cluster keeps its first occurrence (by doc_id, then place); the others are removals.

A passage that repeats inside differing paragraphs, or across their ends, is found on the document's whole word stream by
winnowing: of every ``WINDOW`` runs of ``RUN`` words the one of least hash is an anchor, which depends on nothing but these words. So
each passage of ``RUN + WINDOW - 1`` words (50) that occurs again has an equal anchor in both places, whatever surrounds it.
Anchors are joined by hash with their first occurrence outside removed paragraphs, those that touch or overlap make a run, and
each run is extended word by word at both ends as far as it and the kept text of its first, or last, anchor agree. (Beyond an
anchor no more than ``WINDOW - 1`` words can agree without another; that many words of both texts, as hashes of 32 bits, go to the run.) Runs of
``PASSAGE_WORDS`` words or more are removals, whole.

A row is known by its id and a hash of its text. Cases: null and empty texts, and shorter paragraphs, have no removals; rows with
a null id are ignored by the search and kept by the filter; rows of a repeated id are judged each by its own text, and equal
rows as one; where a text repeats itself without a gap, an anchor that overlaps its own kept place stays; of equal places the first is
kept; an empty table gives an empty result; further columns, whatever their names, are kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from textloom.llm import _kernels as K
from textloom.llm._store import Scratch, bounded_batches, carried, fresh, small
from textloom.llm.near_dedup import _confirm, linked, short

SHINGLE, PERCENT, MIN_WORDS = 5, 80, 22
#: Words of an anchor, anchors to choose one from, and words of a passage that goes.
RUN, WINDOW, PASSAGE_WORDS = 26, 25, 50
BINS, RECALL = 36, 0.999

UNITS = "doc_id long, th long, p_word array<int>, p_n array<int>, p_start array<int>, p_end array<int>, p_hash array<long>, p_bands array<array<long>>, a_hash array<long>, a_word array<int>"


def minima(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of so many values the place of its last minimum."""
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, place, width = values, np.arange(len(values)), 1

    def least(shift: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = best[:count], best[shift : shift + count]
        later = b <= a
        return np.where(later, b, a), np.where(later, place[shift : shift + count], place[:count])

    while 2 * width <= window:
        best, place = least(width, len(best) - width)
        width *= 2
    return least(window - width, n)[1]


def span_hashes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each span of words, from running sums: what stands before the span has no part in it."""
    power, inverse = K._powers(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return K.mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values).cast(kind))


def unit_batch(ids: pa.Array, texts: pa.Array, data: np.ndarray, own: np.ndarray, min_words: int, rows: int, one: K.OnePermutation) -> pa.RecordBatch:
    """Paragraphs (word and byte places, hashes, band keys) and anchors of a block of texts, whose bytes ``own`` cuts into rows."""
    starts, ends, first = K.word_spans(data, own)
    words = K.word_hashes(data, starts, ends)
    m = len(own) - 1
    doc = np.repeat(np.arange(m), np.diff(first))
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    edge = np.flatnonzero((doc[1:] != doc[:-1]) | (line[1:] != line[:-1])) + 1 if len(words) else np.zeros(0, dtype=np.int64)
    a, b = np.concatenate(([0], edge)), np.concatenate((edge, [len(words)]))
    long = b - a >= min_words
    a, b = a[long], b[long]
    sizes = b - a - SHINGLE + 1
    runs = K.shingles(words, SHINGLE)
    place = np.repeat(a - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    keys = K.band_keys(one.many(runs[place], sizes), rows).view(np.int64)
    d = doc[a] if len(a) else np.zeros(0, dtype=np.int64)
    par = np.searchsorted(d, np.arange(m + 1))
    base = own[:-1][d]
    at = np.arange(max(0, len(words) - RUN + 1))
    grams = span_hashes(words, at, at + RUN)
    picks = minima(grams)
    inside = doc[: len(picks)] == doc[WINDOW + RUN - 2 :][: len(picks)]
    picks = np.unique(picks[inside])
    of = doc[picks]
    anchors = np.searchsorted(of, np.arange(m + 1))
    bands = keys.shape[1]
    cols = [ids, texts, _lists(a - first[d], par, pa.int32()), _lists(b - a, par, pa.int32()), _lists(starts[a] - base, par, pa.int32()), _lists(ends[b - 1] - base if len(b) else b, par, pa.int32()), _lists(span_hashes(words, a, b).view(np.int64), par, pa.int64())]
    cols.append(pa.ListArray.from_arrays(pa.array(par, pa.int32()), _lists(keys.ravel(), np.arange(len(a) + 1) * bands, pa.int64())))
    cols += [_lists(grams[picks].view(np.int64), anchors, pa.int64()), _lists(picks - first[of], anchors, pa.int32())]
    out = pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "p_word", "p_n", "p_start", "p_end", "p_hash", "p_bands", "a_hash", "a_word"])
    return out.filter(pa.array((np.diff(par) > 0) | (np.diff(anchors) > 0)))


def _units(min_words: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = K.OnePermutation(BINS)
        for batch in batches:
            data, off = K.utf8(batch.column(2))
            for i, j in K.blocks(off):
                yield unit_batch(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i], min_words, rows, one)

    return run


def _text_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets, short and full, of the paragraphs at the given places of each text."""
    for batch in batches:
        node, held, full = [], [], []
        for text, spots in zip(batch.column("text"), batch.column("spots").to_pylist(), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            parts = pa.array([raw[s["start"] : s["end"]] for s in spots], pa.large_binary()).cast(pa.large_string())
            for s, values in zip(spots, K.shingle_sets(parts, SHINGLE), strict=True):
                node.append(s["node"])
                held.append(short(values).tobytes())
                full.append(values.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(held, pa.binary()), pa.array(full, pa.binary())], ["id", "held", "full"])


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a text's words, and the bytes at which they start and end."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends, _ = K.word_spans(data, np.array([0, len(data)]))
    return K.word_hashes(data, starts, ends), starts, ends


def contexts(text: str | None, lefts: list[int], rights: list[int]) -> Iterator[tuple]:
    """``left, at, words, bytes`` of places (numbers of words): the ``WINDOW`` words before a left one, those from a right one on,
    nearest first, and the bytes at which the place and each of them begins (or, at the right, ends)."""
    words, starts, ends = words_of(text)
    h = (words >> np.uint64(32)).astype(np.uint32)
    for at in lefts:
        low = max(0, at - WINDOW)
        yield True, at, h[low:at][::-1].tobytes(), starts[low : at + 1][::-1].astype(np.int32).tobytes()
    for at in rights:
        yield False, at, h[at : at + WINDOW].tobytes(), ends[at - 1 : at + WINDOW].astype(np.int32).tobytes()


AROUND = "doc_id long, th long, left boolean, at int, words binary, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, th, text, lefts, rights in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), batch.column("lefts").to_pylist(), batch.column("rights").to_pylist(), strict=True):
            out += [(doc, th, *c) for c in contexts(text.as_py(), lefts, rights)]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in AROUND.split(", ")])


def joined_runs(anchors: list[dict]) -> list[list[int]]:
    """``[a, b, ldoc, lth, la, rdoc, rth, rb]``: anchors of one document that touch or overlap as one run of words, with the kept texts, and the
    places in them, of its first anchor's start and its last one's end."""
    out: list[list[int]] = []
    for p in sorted(anchors, key=lambda p: (p["word"], p["kdoc"], p["kth"], p["kword"])):
        end = [p["kdoc"], p["kth"], p["kword"] + RUN]
        if out and p["word"] <= out[-1][1]:
            out[-1][1], out[-1][5:] = p["word"] + RUN, end
        else:
            out.append([p["word"], p["word"] + RUN, p["kdoc"], p["kth"], p["kword"], *end])
    return out


RUNS = "doc_id long, th long, a int, b int, ldoc long, lth long, la int, rdoc long, rth long, rb int"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = []
        for doc, th, anchors in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "anchors")), strict=True):
            own = [p for p in anchors if (p["kdoc"], p["kth"]) != (doc, th) or p["kword"] + RUN <= p["word"]]  # not what overlaps its own kept place
            out += [[doc, th, *r] for r in joined_runs(own)]
        names = [x.split() for x in RUNS.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[k]) for i, (_, k) in enumerate(names)], [n for n, _ in names])


def agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many values agree from the start."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans ``[a, b, start, end, ...]`` (words and bytes) of one text that touch or overlap as one, with what else the first of them has."""
    out: list[list[int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1][1], out[-1][3] = s[1], s[3]
        else:
            out.append(list(s))
    return out


SPANS = "doc_id long, th long, a int, b int, start int, end int, kept_doc_id long, kept_start int"


def _extended(least: int):
    """Each run as far as its text and the kept ones agree; those of enough words."""
    names = [x.split() for x in SPANS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                left = agreeing(np.frombuffer(r["own_l"], dtype=np.uint32), np.frombuffer(r["kept_l"], dtype=np.uint32))
                right = agreeing(np.frombuffer(r["own_r"], dtype=np.uint32), np.frombuffer(r["kept_r"], dtype=np.uint32))
                if (r["ldoc"], r["lth"]) == (r["doc_id"], r["th"]):
                    left = min(left, r["a"] - r["la"] - RUN)
                if r["b"] + right - r["a"] + left >= least:
                    at = [int(np.frombuffer(r[c], dtype=np.int32)[n]) for c, n in (("own_lb", left), ("own_rb", right), ("kept_lb", left))]
                    out.append((r["doc_id"], r["th"], r["a"] - left, r["b"] + right, at[0], at[1], r["ldoc"], at[2]))
            kinds = {"long": pa.int64(), "int": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[k]) for i, (_, k) in enumerate(names)], [n for n, _ in names])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, th, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "spans")), strict=True):
            out += [(doc, th, start, end, b - a, kept, at) for a, b, start, end, kept, at in merged([[s["a"], s["b"], s["start"], s["end"], s["kept_doc_id"], s["kept_start"]] for s in spans])]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "th", "start", "end", "n_words", "kept_doc_id", "kept_start"])


def removals(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, text_hash, kind, start, end, n_words, kept_doc_id, kept_start``: every span that repeats an earlier, kept one.

    ``start`` and ``end`` are bytes of the UTF-8 text, ``text_hash`` its ``xxhash64``; ``kind`` is ``paragraph`` or ``passage``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = scratch or Scratch(spark, "substring")
    _, rows = K.tuned_bands(percent / 100, RECALL, BINS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts = texts.select("doc_id", F.xxhash64("text").alias("th"), "text")
    units = scratch.save(texts.mapInArrow(_units(min_words, rows), UNITS), "units")

    key = ["doc_id", "th"]
    twice = scratch.save(units.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*key), "twice")
    again = scratch.save(texts.join(small(twice), key, "left_semi").dropDuplicates(key), "again-once")  # equal rows once
    single = texts.join(small(twice), key, "left_anti").select("doc_id", "th", "text").union(again.select("doc_id", "th", "text"))

    def with_texts(spots: DataFrame, tag: str) -> DataFrame:
        """Texts with what is wanted from them."""
        return single.join(small(scratch.save(spots, tag)), key)

    gone = scratch.save(_paragraphs(units, with_texts, percent, scratch).distinct(), "paragraphs")
    passages = _passages(units, gone, with_texts, scratch).distinct()
    columns = ["doc_id", F.col("th").alias("text_hash"), "kind", "start", "end", "n_words", "kept_doc_id", "kept_start"]
    return gone.withColumn("kind", F.lit("paragraph")).select(*columns).union(passages.withColumn("kind", F.lit("passage")).select(*columns))


def _paragraphs(units: DataFrame, with_texts, percent: int, scratch: Scratch) -> DataFrame:
    """``doc_id, th, word, n_words, start, end, kept_doc_id, kept_start`` of the paragraphs that go. Every join is between written tables, so that
    the rows of a paragraph that is everywhere are split over tasks."""
    zipped = F.arrays_zip("p_hash", "p_word", "p_n", "p_start", "p_end")
    paragraphs = units.select("doc_id", "th", F.explode(zipped).alias("p")).select("doc_id", "th", F.col("p.p_hash").alias("hash"), F.col("p.p_word").alias("word"), F.col("p.p_n").alias("n_words"), F.col("p.p_start").alias("start"), F.col("p.p_end").alias("end"))
    banded = units.select("doc_id", "th", F.explode(F.arrays_zip("p_hash", "p_start", "p_end", "p_n", "p_bands")).alias("p"))
    classes = banded.groupBy(F.col("p.p_hash").alias("hash")).agg(F.min(F.struct("doc_id", F.col("p.p_start").alias("start"), "th", F.col("p.p_end").alias("end"), F.col("p.p_n").alias("n"), F.col("p.p_bands").alias("bands"))).alias("at"), F.count(F.lit(1)).alias("m"))
    classes = scratch.save(classes, "classes")
    buckets = classes.select(F.explode("at.bands").alias("key"), F.col("hash").alias("id"), F.col("at.n").alias("size"))

    held: dict[str, DataFrame] = {}

    def sets_of(ids: DataFrame) -> DataFrame:
        spots = classes.join(small(ids), classes["hash"] == ids["id"], "left_semi").groupBy("at.doc_id", "at.th")
        spots = spots.agg(F.collect_list(F.struct("at.start", "at.end", F.col("hash").alias("node"))).alias("spots"))  # a document's own paragraphs
        held["sets"] = scratch.save(with_texts(spots, "spots").select("text", "spots").mapInArrow(_text_spans, "id long, held binary, full binary"), "sets")
        return held["sets"].select("id", "held")

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        full = held["sets"].select("id", "full")
        both = pairs.join(full.toDF("b", "held_b"), "b").join(full.toDF("a", "held_a"), "a").select("a", "b", "held_a", "held_b")
        return scratch.save(both.mapInArrow(_confirm(percent), "a long, b long").distinct(), f"links-{tag}").toDF("u", "v")

    found = linked(buckets, None, sets_of, confirmed, percent, scratch)
    scratch.drop("sets", "spots")
    cluster = F.coalesce("component", "hash").alias("cluster")
    named = classes.join(found.toDF("hash", "component"), "hash", "left").where("m > 1 or component is not null").select("hash", "at", cluster)
    named = scratch.save(named, "named")
    first = scratch.save(named.groupBy("cluster").agg(F.min(F.struct("at.doc_id", "at.start", "at.th")).alias("kept")), "first")
    kept = scratch.save(named.join(small(first), "cluster").select("hash", "kept"), "kept")
    out = paragraphs.join(small(kept), "hash").where("struct(doc_id, start, th) <> kept")
    scratch.drop("first")
    return out.select("doc_id", "th", "word", "n_words", "start", "end", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))


def _passages(units: DataFrame, gone: DataFrame, with_texts, scratch: Scratch) -> DataFrame:
    """``doc_id, th, start, end, n_words, kept_doc_id, kept_start`` of the passages that go."""
    again = scratch.save(units.select(F.explode("a_hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("hash"), "again")
    anchors = units.select("doc_id", "th", F.explode(F.arrays_zip("a_hash", "a_word")).alias("p")).select("doc_id", "th", F.col("p.a_hash").alias("hash"), F.col("p.a_word").alias("word"))
    some = scratch.save(anchors.join(small(again), "hash", "left_semi").select("hash", "doc_id", "th", "word"), "some")
    lost = scratch.save(gone.groupBy("doc_id", "th").agg(F.collect_set(F.struct(F.col("word").alias("a"), (F.col("word") + F.col("n_words")).alias("b"))).alias("lost")), "lost")
    free = some.join(small(lost), ["doc_id", "th"], "left").where(f"lost is null or not exists(lost, s -> word >= s.a and word + {RUN} <= s.b)")
    free = scratch.save(free.select("hash", "doc_id", "th", "word"), "free")
    first = free.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "word", "th")).alias("kept")).where("m > 1").select("hash", "kept")
    first = scratch.save(first, "firsts")
    later = free.join(first, "hash").where("struct(doc_id, word, th) <> kept")
    anchor = F.struct("word", F.col("kept.doc_id").alias("kdoc"), F.col("kept.th").alias("kth"), F.col("kept.word").alias("kword"))
    later = later.groupBy("doc_id", "th").agg(F.collect_set(anchor).alias("anchors"))  # a document's own anchors
    runs = scratch.save(later.mapInArrow(_joined, RUNS), "runs")
    scratch.drop("again", "some", "lost", "free", "firsts")
    sides = (("own_l", "doc_id", "th", "a", True), ("own_r", "doc_id", "th", "b", False), ("kept_l", "ldoc", "lth", "la", True), ("kept_r", "rdoc", "rth", "rb", False))
    places = F.array(*(F.struct(F.col(doc).alias("doc_id"), F.col(th).alias("th"), F.lit(left).alias("left"), F.col(at).alias("at")) for _, doc, th, at, left in sides))
    of = lambda left: F.collect_set(F.when(F.col("left") == left, F.col("at")))
    spots = runs.select(F.explode(places).alias("p")).select("p.*").groupBy("doc_id", "th").agg(of(True).alias("lefts"), of(False).alias("rights"))  # at most a text's words
    around = scratch.save(with_texts(spots, "places").select("doc_id", "th", "text", "lefts", "rights").mapInArrow(_contexts, AROUND), "around")
    met = runs
    for name, doc, th, at, left in sides:
        side = around.where(F.col("left") == left).select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("at").alias(at), F.col("words").alias(name), *([F.col("bytes").alias(f"{name}b")] if name != "kept_r" else []))
        met = met.join(side, [doc, th, at])  # as large as the runs: never broadcast
    spans = met.mapInArrow(_extended(PASSAGE_WORDS), SPANS)
    spans = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b", "start", "end", "kept_doc_id", "kept_start")).alias("spans"))  # a document's own
    return spans.mapInArrow(_merged, "doc_id long, th long, start int, end int, n_words int, kept_doc_id long, kept_start int")


def _cut(at: int, text_at: int, chars_at: int, mark: str):
    """Cuts the spans of column ``at`` out of the texts, and marks the rows that it changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, marks = [], [], []
            for text, n, spans in zip(batch.column(text_at), batch.column(max(chars_at, 0)), batch.column(at).to_pylist(), strict=True):
                t, size = text.as_py(), n.as_py()
                if spans and t is not None:
                    raw, left, parts = t.encode("utf-8", "surrogatepass"), 0, []
                    for s in spans:
                        if s["end"] > left:
                            parts.append(raw[left : max(left, s["start"])])
                            left = s["end"]
                    t = b"".join([*parts, raw[left:]]).decode("utf-8", "replace")
                    t = "\n".join(line for line in t.split("\n") if line.strip())
                    size = len(t)
                texts.append(t)
                sizes.append(size)
                marks.append(int(bool(spans)))
            cols, names = list(batch.columns), list(batch.schema.names)
            cols[text_at] = pa.array(texts, pa.string())
            if chars_at >= 0:
                cols[chars_at] = pa.array(sizes, cols[chars_at].type)
            cols[at], names[at] = pa.array(marks, pa.int32()), mark
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with each repeated span cut from ``text`` and ``n_chars`` counted anew; documents of which nothing is left go."""
    docs, names = carried(docs, "doc_id", "text", "n_chars")
    columns = docs.columns
    id_, hash_, spans_, mark = fresh(columns, "_id", "_hash", "_spans", "_cut")
    gone = removals(docs, min_words, percent)
    spans = gone.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans_))
    spans = Scratch(docs.sparkSession, "spans").save(spans, "spans")
    named = docs.join(small(spans), (docs["doc_id"].cast("long") == spans[id_]) & (F.xxhash64(docs["text"].cast("string")) == spans[hash_]), "left").select(*(docs[f"`{c}`"] for c in columns), spans_)
    schema = StructType([*docs.schema.fields, StructField(mark, IntegerType())])
    out = named.mapInArrow(_cut(len(columns), columns.index("text"), columns.index("n_chars") if "n_chars" in columns else -1, mark), schema)
    return out.where(f"`{mark}` = 0 or text <> ''").select(*columns).toDF(*names.values())
