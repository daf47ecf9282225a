"""MinHash near-duplicate detection: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

1. One pass makes each document's shingle set, its digest, its one-permutation signature and band keys.
2. Documents of equal sets form a class by digest; only the class's smallest id goes on, so thousands of copies cost one row.
3. In each bucket a star is drawn around its smallest id, the hub. Stars of one hub are one: a row for each different pair of hub and
   id, however many buckets they share, so candidate rows grow with the buckets' sizes, never with their squares, and a set
   travels once for each of its hubs. The hub is compared with all ids of its star, on the sets' hashes cut to 32 bits (which never
   hides a link), and what passes is joined.
4. In every star each pair of ids that aren't joined yet is compared likewise: a star of more than a block beforehand along its edges
   and then in blocks, a block pair to a group of rows; of the pairs that pass only as many come out as join the group's
   components. So each pair that shares a bucket is in one component, or known to be no link.
5. All links are confirmed on full sets, rebuilt from the texts of just these documents. Where one fails there, 3 and 4 are gone
   over again without it, until none does. Links → connected components in the shared folder; each keeps its smallest id.

Cases: a null text or one without words has an empty set and is linked with nothing; fewer words than a shingle has make
one shingle of the whole sequence; rows of a repeated id are one node; a null id stays, with a null component; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _kernels as K
from textloom.llm._graph import components
from textloom.llm._store import Scratch, bounded_batches, carried, small

BINS, RECALL = 96, 0.999999
#: Ids of a block, and bytes of their sets: a larger bucket is compared block by block.
BLOCK, BLOCK_BYTES = 768, 16 << 20


def _profile(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = K.OnePermutation(BINS)
        for batch in batches:
            sizes, digests, bands = [], [], []
            for s in K.shingle_sets(batch.column(1), k):
                sizes.append(len(s))
                if len(s):
                    sig = one(s)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bands.append(K.band_keys(sig, rows).view(np.int64))
                else:
                    digests.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "digest", "bands"])

    return run


def _sets(k: int, cut: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(short(s) if cut else s).tobytes() for s in K.shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.large_binary()).cast(pa.binary())], ["id", "held"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, dtype=np.uint64))
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("held_a"), batch.column("held_b"), strict=True):
                x = x.as_py()
                if x != last[0]:
                    last = (x, np.frombuffer(x, dtype=np.uint64))
                ok.append(K.jaccard_at_least(last[1], np.frombuffer(y.as_py(), dtype=np.uint64), percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _alike(percent: int):
    """Pairs whose ``short`` sets may be alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, dtype=np.uint32))
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("held_a"), batch.column("held_b"), strict=True):
                x, y = x.as_py(), np.frombuffer(y.as_py(), dtype=np.uint32)
                if x != last[0]:
                    last = (x, np.frombuffer(x, dtype=np.uint32))
                ok.append(may_link(last[1], y, percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def may_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether ``short`` sets can belong to linked sets; no link is ever hidden."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def short(held: np.ndarray) -> np.ndarray:
    """A set's hashes cut to 32 bits, sorted; equal ones stay, so that no common element is lost."""
    return (held >> np.uint64(32)).astype(np.uint32)


def cross_links(ids: list[int], parts: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int, refuted: frozenset = frozenset()) -> list[tuple[int, int]]:
    """Pairs ``a < b`` that join all ids of one group whose ``short`` sets may be alike enough, as far as ``parts``, their components, don't.

    Every pair of different parts (and of different ``sides``, where there are two) is compared, but for those joined meanwhile.
    """
    out: list[tuple[int, int]] = []
    m, parts = len(ids), parts.copy()
    if m == 2:  # most groups are
        pair = (min(ids), max(ids))
        return [pair] if parts[0] != parts[1] and pair not in refuted and may_link(*sets, percent) else []
    n = np.array([len(s) for s in sets])
    high = [(s >> np.uint32(16)).astype(np.uint16) for s in sets]
    every, offsets = np.concatenate(high), np.cumsum(n) - n
    two, table, places = sides.min() != sides.max(), np.zeros(1 << 16, dtype=bool), np.arange(m)

    def star(x: int, others: np.ndarray) -> None:
        """Compares ``x`` with those of ``others`` that may link with it."""
        near = (parts != parts[x]) & others & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if two:
            near &= sides != sides[x]
        near = np.flatnonzero(near)
        if not len(near):
            return
        table[high[x]] = True
        if 8 * len(near) > m:
            common = np.add.reduceat(table[every], offsets, dtype=np.int64)[near]
        else:
            common = np.array([np.count_nonzero(table[high[y]]) for y in near.tolist()])
        table[high[x]] = False
        for y in near[100 * common >= percent * (n[near] + n[x] - common)].tolist():
            pair = (min(ids[x], ids[y]), max(ids[x], ids[y]))
            if parts[x] != parts[y] and pair not in refuted:
                if may_link(sets[x], sets[y], percent):
                    out.append(pair)
                    parts[parts == parts[y]] = parts[x]

    hub = int(np.argmin(ids))
    star(hub, np.ones(m, dtype=bool))
    names, counts = np.unique(parts, return_counts=True)
    main = parts == names[counts.argmax()]  # of two parts at most one is this: its ids need not look for others
    for x in np.flatnonzero(~main & (places != hub)).tolist():
        star(x, (main | (places > x)) & (places != hub))
    return out


def _cross(percent: int, refuted: frozenset):
    """Runs ``cross_links`` over rows that come sorted by ``key, low, high``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def told() -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            ids, parts, sides, sets = zip(*rows, strict=True)
            return cross_links(list(ids), np.array(parts), np.array(sides), list(sets), percent, refuted)

        for batch in batches:
            out: list[tuple[int, int]] = []
            names = zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "id", "c", "side")), strict=True)
            for (key, low, high, i, c, side), held in zip(names, batch.column("held"), strict=True):
                if (key, low, high) != now:
                    out += told()
                    now, rows = (key, low, high), []
                rows.append((i, c, side, np.frombuffer(held.as_py(), dtype=np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(2)], ["a", "b"])
        out = told()
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(2)], ["a", "b"])

    return run


def joined(found: DataFrame, links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """``found(node, component)`` with the components that ``links(u, v)`` join."""
    ends = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).distinct()
    merged = scratch.save(found.join(ends, "node", "right").select("node", F.coalesce("component", "node").alias("c")), f"{tag}-ends")
    between = links.join(merged.toDF("u", "cu"), "u").join(merged.toDF("v", "cv"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    roots = components(between, scratch, tag)
    found = found.select("node", "component").union(merged.where("node = c").select("node", "c")).distinct()
    return found.join(small(roots.toDF("component", "root")), "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def linked(buckets: DataFrame, known: DataFrame | None, sets_of, confirmed, percent: int, scratch: Scratch) -> DataFrame:
    """``node, component`` of all ids that have a link to another id of one of their buckets, or one of the links ``known(u, v)``.

    ``buckets`` has rows ``key, id, size``; ``sets_of(ids)`` gives a written table ``id, held`` (``short`` sets as bytes) and
    ``confirmed(pairs, tag)`` the links ``u, v`` among pairs ``a, b``, judged on full sets. Only pairs that agree in 32 bits and not
    in 64 are ever refuted, so that few are, and a second round is rare.
    """
    spark = buckets.sparkSession
    of = buckets.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    rows = buckets.join(scratch.save(of, "hubs"), "key").groupBy("hub", "id").agg(F.max("size").alias("size"))  # as many rows as buckets: never broadcast
    rows = scratch.save(rows, "rows")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, 4 * F.sum("size") / BLOCK_BYTES)).cast("int")
    large = scratch.save(rows.groupBy("hub").agg(blocks.alias("n")).where("n > 1"), "blocks")
    met = scratch.save(rows.join(small(large), "hub", "left").select(F.col("hub").alias("key"), "id", F.coalesce("n", F.lit(1)).alias("n")), "met")
    sets = sets_of(scratch.save(met.select("id").distinct(), "ids"))
    scratch.drop("hubs", "rows", "blocks", "ids")
    stars = met.where("n > 1 and key < id").select(F.col("key").alias("a"), F.col("id").alias("b"))
    both = stars.join(sets.toDF("b", "held_b"), "b").join(sets.toDF("a", "held_a"), "a")
    least, most = F.least(F.length("held_a"), F.length("held_b")), F.greatest(F.length("held_a"), F.length("held_b"))
    stars = scratch.save(both.where(100 * least.cast("long") >= percent * most.cast("long")).select("a", "b", "held_a", "held_b").mapInArrow(_alike(percent), "a long, b long"), "stars")
    none = spark.createDataFrame([], "a long, b long")
    refuted: frozenset = frozenset()
    turn = 0
    while True:
        gone = spark.createDataFrame(sorted(refuted), "a long, b long") if refuted else none
        kept = stars.join(F.broadcast(gone), ["a", "b"], "left_anti") if refuted else stars
        edges = kept.toDF("u", "v")
        found = scratch.save(components(edges if known is None else edges.union(known), scratch, f"cc-{turn}"), f"parts-{turn}")
        named = met.join(small(found.toDF("id", "c")), "id", "left").select("key", "n", "id", F.coalesce("c", "id").alias("c"))
        large = scratch.save(named.where("n > 1"), f"large-{turn}")  # of these, only buckets of several components
        mixed = large.groupBy("key").agg(F.min("c").alias("first"), F.max("c").alias("last")).where("first < last").select("key")
        mixed = scratch.save(mixed, f"mixed-{turn}")
        todo = named.where("n = 1").union(large.join(small(mixed), "key", "left_semi").select("key", "n", "id", "c"))
        todo = todo.withColumn("side", F.pmod(F.xxhash64("id"), "n").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        todo = todo.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "id", "c", "side").join(sets, "id")
        dealt = todo.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        cross = scratch.save(dealt.select("key", "low", "high", "id", "c", "side", "held").mapInArrow(_cross(percent, refuted), "a long, b long").distinct(), f"cross-{turn}")
        pairs = scratch.save(kept.union(cross).distinct(), f"pairs-{turn}")
        links = confirmed(pairs, f"{turn}")
        lost = frozenset((r.a, r.b) for r in pairs.join(links.toDF("a", "b"), ["a", "b"], "left_anti").collect())  # chance agreements of 32 bits
        if not lost:
            out = scratch.save(joined(found, cross.toDF("u", "v"), scratch, f"all-{turn}"), "linked")
            scratch.drop("met", "stars", f"parts-{turn}", f"large-{turn}", f"mixed-{turn}", f"cross-{turn}", f"pairs-{turn}")
            return out
        refuted, turn = refuted | lost, turn + 1


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``; see the module for method and cases.

    ``k`` words to a shingle; two documents are linked if ``100 * common >= percent * all`` of their shingles.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "near")
    _, rows = K.tuned_bands(percent / 100, RECALL, BINS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = scratch.save(texts.mapInArrow(_profile(k, rows), "id long, n long, digest binary, bands array<long>"), "profile")

    classes = profile.where("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    classes = scratch.save(classes, "classes")
    member = scratch.save(profile.select("id", "n", "digest").join(classes, "digest", "left"), "member")
    again = member.where("rep is not null").groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u <> v")
    again = again.select("id", "u").union(again.select("id", "v")).toDF("u", "v")

    reps = profile.join(classes, "digest").where("id = rep").groupBy("id", "digest").agg(F.first("bands").alias("bands"), F.first("n").alias("n"))
    reps = scratch.save(reps.drop("digest"), "reps")
    buckets = reps.select(F.explode("bands").alias("key"), "id", F.col("n").alias("size"))

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        wanted = scratch.save(pairs.select("a").union(pairs.select("b")).distinct().toDF("id"), f"wanted-{tag}")
        sets = scratch.save(texts.join(small(wanted), "id", "left_semi").mapInArrow(_sets(k), "id long, held binary"), f"sets-{tag}")
        both = pairs.join(sets.toDF("b", "held_b"), "b").join(sets.toDF("a", "held_a"), "a").select("a", "b", "held_a", "held_b")
        links = scratch.save(both.mapInArrow(_confirm(percent), "a long, b long").distinct(), f"links-{tag}")
        scratch.drop(f"sets-{tag}", f"wanted-{tag}")
        return links.toDF("u", "v")

    def sets_of(ids: DataFrame) -> DataFrame:
        return scratch.save(texts.join(small(ids), "id", "left_semi").mapInArrow(_sets(k, True), "id long, held binary"), "short")

    found = linked(buckets, again, sets_of, confirmed, percent, scratch)
    scratch.drop("short", "reps", "profile", "classes")

    named = member.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose component keeps another one; of rows with the same id and text one stays."""
    docs, names = carried(docs, "doc_id", "text")
    told, scratch = near_duplicates(docs, k, percent), Scratch(docs.sparkSession, "kept")
    gone = scratch.save(told.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    kept = docs.withColumn("_id", F.col("doc_id").cast("long")).join(small(gone.toDF("_id")), "_id", "left_anti")
    # Ids that occur once can't repeat a row: only the others' texts are shuffled.
    again = scratch.save(told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_again"), F.lit(True).alias("_more")), "again")
    kept = kept.join(small(again), F.col("_id").eqNullSafe(F.col("_again")), "left")
    once, more = kept.where("_more is null").select(*names), kept.where("_more").select(*names)
    return once.union(more.dropDuplicates(["doc_id", "text"])).toDF(*names.values())
