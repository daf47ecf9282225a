"""Range joins, deletion neighbourhoods and the contexts of many results, against loops over all pairs."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom import catalogue
from textloom.operators import context, ranges, spelling
from textloom.sources import files


def spans(rnd, n, most):
    out = []
    for i in range(n):
        a = rnd.randint(-50, most)
        out.append((i, rnd.choice("xy"), a, a + rnd.choice([0, 1, 3, 7, 8, 9, 100, most])))
    return out


def test_range_join_against_all_pairs(spark):
    rnd = random.Random(1)
    left, right = spans(rnd, 120, 700), spans(rnd, 150, 700)
    left += [(500, None, 1, 5), (501, "x", None, 5), (502, "x", 9, 2), (503, "x", 0, 1 << 40), left[0]]
    right += [(600, "y", 5, 4), (601, "x", 1 << 39, 1 << 41), right[3]]
    a, b = spark.createDataFrame(left, "l long, k string, a long, b long"), spark.createDataFrame(right, "r long, k string, c long, d long")
    got = ranges.overlapping(a, b, ["k"], ("a", "b"), ("c", "d"))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    want = sorted((l, r) for l, k, x, y in left for r, j, c, d in right if k == j and None not in (k, x) and x <= y and c <= d and x <= d and c <= y)
    assert sorted((r.l, r.r) for r in got.collect()) == want and len(want) > 1000
    assert ranges.overlapping(a, b.limit(0), ["k"], ("a", "b"), ("c", "d")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=9), st.text("ab", max_size=9))
def test_words_that_are_near_share_a_neighbour(a, b):
    def cut(w, k):
        held = {w}
        for _ in range(k):
            held |= {v[:i] + v[i + 1 :] for v in held for i in range(len(v))}
        return held

    for k in (1, 2):
        assert distance(a, b) > k or cut(a, k) & cut(b, k)


def test_near_words_against_all_pairs(spark):
    rnd = random.Random(5)
    some = ["".join(rnd.choice("abc") for _ in range(rnd.randint(4, 14))) for _ in range(400)]
    words = some[:150] + ["Ab cdef", None, "é" * 7, "abcab"]
    tokens = some[100:] + [w[:3] + w[4:] for w in some[:150]] + [w[:2] + "z" + w[2:] + "z" for w in some[:150]] + ["", None]
    got = spelling.near(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in tokens], "token string"))
    want = set()
    for w in {w for w in words if w and w.isascii() and w.isalpha() and len(w) >= 6}:
        for t in {t for t in tokens if t and t[0] == w[0]}:
            d = distance(w, t)
            if 0 < d <= (2 if len(w) >= 11 else 1) and d * 5 <= len(w):
                want.add((w, t, d))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 100


def test_contexts_of_many_results(spark):
    rnd = random.Random(7)
    grid = spark.createDataFrame([(i, *(None if rnd.random() < 0.2 else f"v{i}" for _ in range(6))) for i in range(1, 60)], "r int, " + ", ".join(f"c{j} string" for j in range(6)))
    units = files.cell_units(grid, "s", "r", [f"c{j}" for j in range(6)])
    at = [(1, 1), (2, 3), (30, 6), (59, 1), (1048576, 16384)]
    targets = spark.createDataFrame([(i, "s.xlsx", "s", r, c) for i, (r, c) in enumerate(at)], "target int, path string, part_key string, row int, column int")
    merges = [(rnd.randint(1, 60), rnd.randint(1, 9)) for _ in range(80)]
    merges = [("s.xlsx", "s", r, c, r + rnd.randint(0, 30), c + rnd.randint(0, 3)) for r, c in merges] + [("s.xlsx", "t", 1, 1, 9, 9)]
    table = spark.createDataFrame(merges, "path string, part_key string, first_row int, first_column int, last_row int, last_column int")
    got, met = context.cells_of(targets, units).collect(), context.merges_of(targets, table).collect()
    for i, (r, c) in enumerate(at):
        one = context.Range.around(r, c)
        want = {(x.row, x.column, x.text) for x in context.cells(units, "s", one).collect()}
        assert {(x.row, x.column, x.text) for x in got if x.target == i} == want
        here = [m for m in merges if m[1] == "s" and m[2] <= one.last_row and m[4] >= one.first_row and m[3] <= one.last_column and m[5] >= one.first_column]
        assert sorted(tuple(x)[1:] for x in met if x.target == i) == sorted(here)
    assert context.cells_of(targets.where(F.lit(False)), units).count() == 0


def test_threads_of_any_length_and_with_gaps(spark):
    long = [(1, t, "A1" if t == 0 else None) for t in range(40)]
    rest = [(2, 1, None), (2, 2, None), (3, 0, "B1"), (3, 1, None), (3, 3, None), (3, 4, "B4"), (3, 5, None), (4, 0, "C1"), (4, 1, None), (4, 1, None), (None, 1, None), (5, None, None)]
    made = spark.createDataFrame(long + rest, "thread long, turn long, ref string")
    want = [(1, t, "A1") for t in range(40)] + [(3, 0, "B1"), (3, 1, "B1"), (3, 4, "B4"), (3, 5, "B4"), (4, 0, "C1"), (4, 1, "C1"), (4, 1, "C1")]
    assert sorted(map(tuple, context.threads(made, "thread", "turn", "ref").collect())) == want


def test_comment_query_over_a_million_steps(spark, tmp_path):
    made = spark.range(70_000).select(F.col("id").alias("conv_id"), F.explode(F.expr("sequence(0L, 19L)")).alias("turn"))
    made.withColumns({"role": F.lit("user"), "text": F.lit("")}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalogue.q36_comment_threads(spark, str(tmp_path))
    assert got.agg(F.count("address"), F.sum((F.col("address") == F.concat(F.lit("A"), F.col("conv_id") + 1)).cast("long"))).first() == (1_400_000, 1_400_000)
