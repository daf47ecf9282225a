"""Media columns by content-defined chunking.

A payload (a text's UTF-8 bytes, padded with bytes 255 to a positive multiple of ``UNIT``) is cut where a rolling gear hash of
the last 32 bytes has ``CUT_BITS`` zero bits, so equal passages are cut alike wherever they stand. Chunks are named by
digest and deduplicated by joins on the digests alone; a chunk's bytes are stored once, as a compressed frame, in the pack of the
first payload that holds it. A pack is a payload's stored form: its recipe (a header, and the ordered list of its chunks' digests
and frame sizes) and its own frames; what it shares with others is fetched from their packs by joins. Reading back
checks each frame's size and each chunk against the recipe and the whole against the payload's SHA-256, and fails loudly if one
differs. ``media_bytes`` and ``media_sha256`` are of the stored recipe and the stored frames that it lists, in order.

Scale: the first pass moves digests, never bytes; documents meet the plan (copies and shared chunks) by a broadcast of
measured size or else a shuffle; only shared chunks are shuffled when read. Thousands of copies are one payload, stored and read
once; their rows get its result by a join on the digest, between written tables, so that a payload that is everywhere is
split over tasks.

Cases: a null or empty text is one unit of padding; a null id is kept; repeated rows are copies; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._store import Scratch, bounded_batches, small

UNIT, LEAST, CUT_BITS, MOST, LEVEL = 576, 1024, 12, 16384, 6
_GEAR = np.random.Generator(np.random.PCG64(32)).integers(0, 1 << 32, 256, dtype=np.uint32)


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def cut(payload: bytes) -> list[tuple[int, int]]:
    """Spans of ``LEAST`` to ``MOST`` bytes that end at gear-hash cuts (the last may be shorter)."""
    n = len(payload)
    if n <= LEAST:
        return [(0, n)]
    h = _GEAR[np.frombuffer(payload, dtype=np.uint8)]
    for s in (1, 2, 4, 8, 16):  # sums of shifted byte values over the last 2, 4, 8, 16, 32 bytes
        wider = h.copy()
        wider[s:] += h[:-s] << np.uint32(s)
        h = wider
    ends = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, at = [], 0
    while at < n:
        i = int(np.searchsorted(ends, at + LEAST))
        end = min(int(ends[i]) if i < len(ends) else n, at + MOST, n)
        out.append((at, end))
        at = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(payload: bytes, n: int, chunks: int) -> str:
    """Chunk count, mean byte and byte entropy of the unpadded part."""
    count = np.bincount(np.frombuffer(payload, dtype=np.uint8, count=n), minlength=256) if n else np.zeros(256, dtype=np.int64)
    p = count[count > 0] / max(n, 1)
    return f"chunks={chunks};mean={float(count @ np.arange(256)) / max(n, 1):.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f}"


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas, lists = [], []
        for text in batch.column(1):
            payload, n = padded(text.as_py())
            shas.append(hashlib.sha256(payload[:n]).digest())
            lists.append([digest(payload[a:b]) for a, b in cut(payload)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["id", "sha", "chunks"])


def recipe(names: list[bytes], frames: list[bytes]) -> bytes:
    """A payload's ordered chunks: digest and frame size of each."""
    return b"".join([b"CDC2", struct.pack("<I", len(names)), *(d + struct.pack("<I", len(f)) for d, f in zip(names, frames, strict=True))])


def listed(stored: bytes) -> tuple[list[bytes], list[int]]:
    """Digests and frame sizes of a recipe."""
    if stored[:4] != b"CDC2" or len(stored) != 8 + 20 * struct.unpack("<I", stored[4:8])[0]:
        raise ValueError("a stored recipe is damaged")
    rows = [stored[i : i + 20] for i in range(8, len(stored), 20)]
    return [r[:16] for r in rows], [struct.unpack("<I", r[16:])[0] for r in rows]


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        shas, sizes, recipes, names, frames = [], [], [], [], []
        for text, skip in zip(batch.column("text"), batch.column("skip").to_pylist(), strict=True):
            payload, n = padded(text.as_py())
            spans, gone = cut(payload), set(skip or ())
            shas.append(hashlib.sha256(payload[:n]).digest())
            sizes.append(n)
            names.append([digest(payload[a:b]) for a, b in spans])
            every = [press.compress(payload[a:b]) for a, b in spans]
            recipes.append(recipe(names[-1], every))
            frames.append([None if i in gone else f for i, f in enumerate(every)])
        binaries = pa.list_(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.array(sizes, pa.int64()), pa.array(recipes, pa.binary()), pa.array(names, binaries), pa.array(frames, binaries)], ["sha", "n_bytes", "recipe", "chunks", "frames"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuilds each payload from its recipe and frames, verifies it, and tells of it."""
    for batch in batches:
        out: list[tuple] = []
        open_ = zstandard.ZstdDecompressor()
        for sha, n, stored, frames in zip(*(batch.column(c).to_pylist() for c in ("sha", "n_bytes", "recipe", "frames")), strict=True):
            names, sizes = listed(stored)
            if [len(f) for f in frames] != sizes:
                raise ValueError("a stored frame differs from its recipe")
            parts = [open_.decompress(f) for f in frames]
            if [digest(p) for p in parts] != names:
                raise ValueError("a stored chunk differs from its digest")
            payload = b"".join(parts)
            if hashlib.sha256(payload[:n]).digest() != sha or payload[n:].strip(b"\xff"):
                raise ValueError("a rebuilt payload differs from its digest")
            of = hashlib.sha256(stored)
            for f in frames:
                of.update(f)
            out.append((sha, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored) + sum(sizes), of.hexdigest(), features(payload, n, len(parts))))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["sha", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the chunk store; returns ``(id, sha)`` of every row, and the packs ``(pack, sha, n_bytes, recipe, chunks, frames)``, in
    which the frame of a chunk that another pack holds is null."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    recipes = scratch.save(texts.mapInArrow(_recipes, "id long, sha binary, chunks array<binary>"), "recipes")
    own = recipes.select(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "sha", "chunks")
    firsts = scratch.save(own.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")), "firsts")
    own = own.join(small(firsts), "sha")
    once = own.where("id = first").select("sha", "id", "chunks", "rows")
    twice = once.where("rows > 1").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("m"), F.first("chunks").alias("chunks")).select("sha", "id", "chunks", "m")
    once = scratch.save(once.where("rows = 1").select("sha", "id", "chunks", F.lit(1).cast("long").alias("m")).union(twice), "once")
    parts = once.select("sha", "id", F.posexplode("chunks").alias("seq", "chunk"))
    shared = parts.groupBy("chunk").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "sha", "seq")).alias("holder")).where("m > 1")
    shared = scratch.save(shared.select("chunk", "holder"), "holders")
    skips = parts.join(small(shared), "chunk").where("struct(id, sha, seq) <> holder").groupBy("id", "sha").agg(F.collect_list("seq").alias("skip"))
    plan = skips.select("id", "sha", "skip", F.lit(False).alias("copy"), F.lit(False).alias("again"))
    copies = own.where("id <> first").select("id", "sha", F.lit(None).cast("array<int>"), F.lit(True), F.lit(False)).distinct()
    again = once.where("m > 1").select("id", "sha", F.lit(None).cast("array<int>"), F.lit(False), F.lit(True))
    plan = plan.union(copies).union(again).groupBy("id", "sha").agg(F.first("skip", True).alias("skip"), F.max("copy").alias("copy"), F.max("again").alias("again"))
    plan = scratch.save(plan, "plan")
    keyed = texts.select(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("sha"), "text")
    todo = keyed.join(small(plan), ["id", "sha"], "left").where("copy is null or not copy")
    repeated = todo.where("again").dropDuplicates(["sha"])  # rows of equal id and text
    todo = todo.where("again is null or not again").union(repeated).select("text", "skip")
    packs = todo.mapInArrow(_packs, "sha binary, n_bytes long, recipe binary, chunks array<binary>, frames array<binary>").select(F.monotonically_increasing_id().alias("pack"), "*")
    return recipes.select("id", "sha"), scratch.save(packs, "packs")


def read(packs: DataFrame, scratch: Scratch) -> DataFrame:
    """What each pack's payload is, rebuilt from the store; chunks of other packs are fetched by digest."""
    lacks = F.exists("frames", lambda f: f.isNull())
    columns = ["sha", "n_bytes", "recipe", "frames"]
    each = packs.where(lacks).select("pack", F.posexplode(F.arrays_zip("chunks", "frames")).alias("seq", "c"))
    lacking = scratch.save(each.where("c.frames is null").select("pack", "seq", F.col("c.chunks").alias("chunk")), "lacking")
    wanted = scratch.save(lacking.select("chunk").distinct(), "wanted")
    there = packs.select(F.explode(F.arrays_zip("chunks", "frames")).alias("c")).where("c.frames is not null").select(F.col("c.chunks").alias("chunk"), F.col("c.frames").alias("frame"))
    frames = scratch.save(there.join(small(wanted), "chunk", "left_semi").dropDuplicates(["chunk"]), "shared")
    found = lacking.join(frames, "chunk").groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("seq", "frame"))).alias("found"))
    filled = packs.where(lacks).join(found, "pack").withColumn("frames", F.transform("frames", lambda f, i: F.coalesce(f, F.element_at("found", i))))
    told = "sha binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return packs.where(~lacks).select(*columns).union(filled.select(*columns)).mapInArrow(_read, told)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads every payload back, and returns what was read for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "media")
    rows, packs = store(docs, scratch, id_col, text_col)
    told = scratch.save(read(packs, scratch).dropDuplicates(["sha"]), "told")
    return rows.join(told, "sha").select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
