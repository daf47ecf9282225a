"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._store import BROADCAST_BYTES, Scratch

#: Bytes of a node and its least neighbour in a broadcast.
ROW = 64


def _star(edges: DataFrame, large: bool, most: int, scratch: Scratch, tag: str) -> DataFrame:
    """Each node's neighbours (of a small star: the smaller ones and itself) move to the smallest of them. ``most``: nodes at most."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    # Written before the join, so that the edges of a node with very many of them can be split over tasks.
    least = F.broadcast(least) if ROW * most <= BROADCAST_BYTES else scratch.save(least, tag)
    moved = both.join(least, "u").where(F.col("v") > F.col("u") if large else F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.where("u <> m").select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """``edges(u, v)`` → ``(node, component)`` for every node of an edge; ``component`` is the smallest node reachable.

    Null ends and loops are ignored; an empty table gives an empty one. Rounds grow with the logarithm of the longest
    path; each is written to the shared folder, so that neither lineage nor driver memory grows.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.save(now, f"{tag}-0")
    before, i = None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before, i = mark, i + 1
        large = _star(now, True, 2 * mark[0], scratch, f"{tag}-large")
        now = scratch.save(_star(large, False, 2 * mark[0], scratch, f"{tag}-small"), f"{tag}-{i}")
        scratch.drop(f"{tag}-{i - 1}", f"{tag}-large", f"{tag}-small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
