"""Mixing overlapping sources to target weights, by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to): the flow's size follows the patterns,
not the documents. Pattern → source arcs carry words at a convex cost of repetition (first pass free, each further pass
dearer, at most ``repeats``); source → sink arcs carry the sources' targets. The flow says how many words each pattern
gives to each source; documents are then selected in seeded order: whole passes over a pattern go to all its documents,
the rest to a prefix of the seeded order that ends nearest to the quota (ids, not rows: equal ids share their order).

The order is the MD5 of seed and id. Its prefix sums are taken in two steps, over ``BUCKETS`` hash ranges of each pattern
and then inside the one range where the quota ends, so that no task sorts a whole source.

Sources and patterns that share no document are solved apart, so that many sources of their own cost no more than their number.

Cases: null text has size 0; a null source is a source of its own, last; documents of equal id and size are interchangeable, and
rows of equal ids share their place in the order; an empty table gives an empty result; size-0 sources have target 0; source
names may hold any character; further columns are kept, but for those with the name of a result's column, which give way to it.
"""

from __future__ import annotations

import heapq
import itertools
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._store import Scratch, carried, small

SEED, SHARE, REPEATS, WEIGHTS = 17, 1.5, 2, (3, 1, 2)
#: Hash ranges of a pattern: the first hex digits of the order key.
DIGITS = 4
RESULT = ("size", "pattern", "source_size", "target", "taken", "repeats_taken")
#: Name of the column that holds the sources while a mix is made.
_SOURCES = "_mix_sources"
#: Most membership patterns of the flow; they are sets of sources, so they don't grow with the documents.
MAX_PATTERNS = 200_000


def n_words(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts 0."""
    plain = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Each source's share of ``total`` by weight; at most ``most`` times its size, the excess reshared by weight."""
    fixed: dict = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / weight > most * sizes[s]]
        if not over:
            return fixed | {s: left * weights[s] / weight for s in free}
        fixed |= {s: float(most * sizes[s]) for s in over}


def min_cost_flow(patterns: dict[tuple, float], wanted: dict, repeats: int) -> dict[tuple[tuple, object], float]:
    """Words that each pattern gives to each of its sources: targets are met as far as can be, at least total cost.

    Successive shortest paths with potentials; a pattern's ``i``-th pass costs ``i`` a word, and a word that a narrower
    pattern could give costs a little less than one of a wider pattern, which keeps shared documents for those in need.
    """
    nodes: dict = {}
    graph: list[list[list]] = []

    def node(x) -> int:
        if x not in nodes:
            nodes[x] = len(graph)
            graph.append([])
        return nodes[x]

    def arc(a: int, b: int, room: float, cost: float) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0.0, -cost, len(graph[a]) - 1])

    source, sink = node("from"), node("to")
    for p, size in patterns.items():
        for i in range(repeats):
            arc(source, node(("p", p)), float(size), float(i))
        for s in p:
            arc(node(("p", p)), node(("s", s)), float("inf"), 1e-3 * len(p))
    for s, t in wanted.items():
        arc(node(("s", s)), sink, float(t), 0.0)
    held = [0.0] * len(graph)
    while True:
        far, via = [float("inf")] * len(graph), [None] * len(graph)
        far[source] = 0.0
        queue = [(0.0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room > 1e-9 and (to := d + cost + held[a] - held[b]) < far[b] - 1e-12:
                    far[b], via[b] = to, (a, k)
                    heapq.heappush(queue, (to, b))
        if via[sink] is None:
            break
        held = [h + (f if f < float("inf") else 0.0) for h, f in zip(held, far, strict=True)]
        way, at = [], sink
        while at != source:
            way.append(via[at])
            at = via[at][0]
        push = min(graph[a][k][1] for a, k in way)
        for a, k in way:
            graph[a][k][1] -= push
            graph[graph[a][k][0]][graph[a][k][3]][1] += push
    return {(p, s): sum(graph[b][r][1] for b, _, _, r in (x for x in graph[nodes["p", p]] if x[0] == nodes["s", s])) for p in patterns for s in p}


def separate(patterns: list[tuple]) -> list[list[tuple]]:
    """The patterns in groups that share no source."""
    top: dict = {}

    def find(s):
        while top.setdefault(s, s) != s:
            top[s] = top[top[s]]
            s = top[s]
        return s

    for p in patterns:
        for s in p[1:]:
            top[find(s)] = find(p[0])
    groups: dict = {}
    for p in patterns:
        groups.setdefault(find(p[0]) if p else (), []).append(p)
    return list(groups.values())


def mixed(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size, pattern, source_size, target, taken, repeats_taken``.

    ``sources`` is an array of the names a document belongs to; names in code point order, null last, weigh ``weights``,
    repeating. ``source_size`` and ``target`` are sums over the document's sources.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    docs, called = carried(docs.withColumn(_SOURCES, sources), id_col, text_col, _SOURCES)
    called.pop(_SOURCES)
    pattern = F.to_json(F.array_sort(F.array_distinct(_SOURCES)))  # nulls last
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.struct(*called).alias("_row"), n_words(text_col).alias("_size"), F.coalesce(pattern, F.lit("[]")).alias("_pattern"), key.alias("_key")).withColumn("_range", F.substring("_key", 1, DIGITS))
    ranged = scratch.save(rows.groupBy("_pattern", "_range").agg(F.sum("_size").alias("_sum")), "ranged")
    told = [(r[0], int(r[1])) for r in ranged.groupBy("_pattern").agg(F.sum("_sum")).limit(MAX_PATTERNS + 1).collect()]
    if len(told) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = sorted((p, tuple(json.loads(p)), n) for p, n in told)
    sizes: dict[str | None, int] = {}
    for _, names, n in patterns:
        for s in names:
            sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(n for _, _, n in patterns)
    target = targets(sizes, weigh, share * total, repeats) if sizes else {}
    held, flow = {names: n for _, names, n in patterns}, {}
    for group in separate(sorted(held, key=repr)):
        flow |= min_cost_flow({p: held[p] for p in group}, {s: target[s] for s in {s for p in group for s in p}}, repeats)
    plan = []
    for p, names, n in patterns:
        quota = min(sum(flow.get((names, s), 0.0) for s in names), float(repeats * n))
        base = min(repeats, int(quota // n)) if n else 0
        plan.append((p, base, quota - base * n, sum(sizes[s] for s in names), float(sum(target[s] for s in names))))
    quotas = spark.createDataFrame(plan, "_pattern string, _base int, _rest double, source_size long, target double")
    quotas = small(quotas)
    before = Window.partitionBy("_pattern").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(quotas.select("_pattern", "_rest"), "_pattern")
    ends = ends.where("_before < _rest").groupBy("_pattern", "_rest").agg(F.max("_range").alias("_end"), F.max_by("_before", "_range").alias("_before"))
    # Inside the range where the quota ends the ids are summed one by one: a 16**DIGITS-th of a pattern.
    ends = small(scratch.save(ends, "ends"))
    inside = rows.join(ends, "_pattern").where("_range = _end").groupBy("_pattern", "_key", "_before", "_rest").agg(F.sum("_size").alias("_sum"))
    upto = Window.partitionBy("_pattern").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_upto", F.col("_before") + F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
    last = inside.where(F.col("_upto") + F.col("_sum") / 2 <= F.col("_rest")).groupBy("_pattern").agg(F.max("_key").alias("_last"))
    out = rows.join(quotas, "_pattern").join(ends.select("_pattern", "_end"), "_pattern", "left").join(small(scratch.save(last, "last")), "_pattern", "left")
    once = F.coalesce((F.col("_range") < F.col("_end")) | (F.col("_key") <= F.col("_last")), F.lit(False))
    times = F.least(F.col("_base") + once.cast("int"), F.lit(repeats))
    own = [F.col("_row")[c].alias(c) for c, n in called.items() if n.lower() not in RESULT]
    told = out.select(*own, F.col("_size").alias("size"), F.from_json("_pattern", "array<string>").alias("pattern"), "source_size", "target", (F.col("_size") * times).alias("taken"), times.alias("repeats_taken"))
    return told.toDF(*(n for n in called.values() if n.lower() not in RESULT), *told.columns[len(own) :])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """``mixed`` for documents of one source each."""
    return mixed(docs, F.array(F.col(source_col).cast("string")), id_col, text_col, **settings)
