"""Fill-in-the-middle, vector packing and exact whitening against plain versions."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import fill_middle, token_packing, whitening
from textloom.llm.oracle import ORACLE
from textloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"

UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"^[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*"}


def scanned(name, texts):
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))).astype(np.int64)
    return fill_middle.Scan(fill_middle.UNITS[name] if name in fill_middle.UNITS else fill_middle.MARKED, data, off)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="a<PSM>\n é", max_size=300), min_size=1, max_size=6), st.sampled_from(["lines", "words"]))
def test_scan_counts_and_places_units(texts, units):
    scan = scanned(units, texts)
    n = scan.total()[1][:, 0]
    for i, t in enumerate(texts):
        found = [len(t[: m.start()].encode()) for m in re.finditer(UNITS[units], t)]
        assert n[i] == len(found)
        k = np.arange(1, len(found) + 1)
        assert scan.places(np.full(len(k), i), np.zeros(len(k), dtype=np.int64), k).tolist() == found
    marked = scanned("marked", texts).total()[1][:, 0] > 0
    assert marked.tolist() == [bool(re.search("<[PSM]>", t)) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab<P>\n", max_size=400), st.integers(0, 400))
def test_chunks_compose_to_the_whole(text, at):
    for name in ("lines", "words", "marked"):
        to, count = scanned(name, [text[:at], text[at:]]).total()
        whole_to, whole = scanned(name, [text]).total()
        both = fill_middle.composed(to, count, np.zeros(2, dtype=np.int64))
        assert both[0][1].tolist() == whole_to[0].tolist() and both[1][1].tolist() == whole[0].tolist()


def plain_middle(doc_id, text, rate=100, spm=50, seed=7, pattern=UNITS["lines"]):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(pattern, text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    spm_form = h[3] % 100 < spm
    return (doc_id, n, "spm" if spm_form else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm_form else f"<P>{p}<S>{s}<M>{m}")


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_middle_of_giants_and_of_odd_rows(spark):
    rnd = random.Random(3)
    line = lambda: "".join(rnd.choice("abc é漢") for _ in range(rnd.randrange(90)))
    giant = "\n".join(line() for _ in range(60_000))  # over three chunks
    assert len(giant.encode()) > 3 * fill_middle.CHUNK
    one = "x" * (2 * fill_middle.CHUNK + 5)  # one unit over three chunks
    marked = giant[: fill_middle.CHUNK - 2] + "<P>" + giant[:200]  # a control string that chunks cut
    rows = [(1, giant), (2, giant), (2, giant), (3, one), (4, marked), (None, giant), (5, None), (6, ""), (7, "\n\n"), (None, "a\nb"), (8, "a <M> b\nc"), (9, "a<S\n>b\nc"), (10, "ends<S\nmore\n<M")]
    for units in ("lines", "words"):
        got = fill_middle.transformed(spark.createDataFrame(rows, DOCS), rate=90, spm=40, seed=11, units=units)
        assert in_order(got.collect()) == in_order(plain_middle(i, t, 90, 40, 11, UNITS[units]) for i, t in rows)
    told = got.withColumn("back", fill_middle.restored(got.output, got.form)).select("doc_id", "back").collect()
    assert in_order(told) == in_order((i, t or "") for i, t in rows)


def test_middle_of_an_empty_table_and_clashing_columns(spark):
    assert fill_middle.transformed(spark.createDataFrame([], DOCS)).collect() == []
    wide = spark.createDataFrame([(1, "a\nb", "x", 5, "y")], "doc_id long, text string, key string, n int, `c.d` string")
    assert in_order(fill_middle.transformed(wide).collect()) == [plain_middle(1, "a\nb")]


def test_middle_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = QUERIES["op11_fill_middle"](spark, SF)
    assert in_order(got.collect()) == in_order(con.execute(ORACLE["op11_fill_middle"]).fetchall())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_packing.TOKENIZER)


def test_ids_are_those_of_the_library_on_every_code_point(library):
    encode = token_packing.encoder(token_packing.TOKENIZER)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 40_000):
        texts = [f"a{c}b 1{c} {c}{c} !{c}2\n{c}" for c in map(chr, points[a : a + 40_000])]
        for text, told in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert encode(text).tolist() == told.ids, hex(ord(text[1]))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab's 1é漢\n\t\r.<|endoftext|>", max_size=80))
def test_stretches_change_no_id(text):
    before = token_packing.STRETCH
    token_packing.STRETCH = 5
    try:
        parts = list(token_packing.stretches(text))
        assert "".join(parts) == text
        assert token_packing.tokens(text, token_packing.TOKENIZER).tolist() == [*token_packing.encoder(token_packing.TOKENIZER)(text).tolist(), 1]
    finally:
        token_packing.STRETCH = before


def checked(rows, docs, limits, library):
    """Each id in one piece, sequences without gaps and within the limits; the ids of all sequences, padding included."""
    want = {}
    for i, text in docs:
        want.setdefault(i, []).append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    have, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length > 0
        have.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, lists in want.items():
        if len(lists) == 1:
            parts = sorted(have[i, len(lists[0])])
            assert [x for _, p in parts for x in p] == lists[0] and [s for s, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts)]).tolist()[:-1]
    assert sum(len(p) for parts in have.values() for _, p in parts) == sum(len(x) for lists in want.values() for x in lists)
    padded = 0
    for parts in sequences.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= limits.tokens and len(parts) <= limits.segments and end <= limits.loss
        padded += end if end & (end - 1) == 0 else limits.tokens
    return sum(len(x) for lists in want.values() for x in lists), padded


def test_documents_are_packed_without_padding(spark, library):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice(["alpha", "bé", "gamma\n", "漢字"]) for _ in range(rnd.choice([0, 1, 3, 50, 400, 3000])))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "x" * 5000), (1003, "a<|endoftext|>b")] + [(2000 + i, "same text") for i in range(500)]
    df = spark.createDataFrame(docs, DOCS).repartition(3, "doc_id")
    for limits in (token_packing.Limits(), token_packing.Limits(512, 3, 512), token_packing.Limits(512, 64, 300), token_packing.Limits(8, 1, 8)):
        ids, padded = checked(token_packing.pack_documents(df, limits).collect(), docs, limits, library)
        assert limits.loss < limits.tokens or padded == ids
    assert token_packing.pack_documents(spark.createDataFrame([], DOCS)).collect() == []
    odd = [(None, "a b"), (None, "a b"), (None, None), (3, "c")]
    rows = token_packing.pack_documents(spark.createDataFrame([(*d, "z") for d in odd], "doc_id long, text string, `ids.x` string")).collect()
    assert sum(r.length for r in rows) == sum(len(library.encode(t or "").ids) + 1 for _, t in odd)
    with pytest.raises(ValueError):
        token_packing.Packer(token_packing.Limits(segments=0), True)


def test_packing_query_on_a_whole_table(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pieces = token_packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    ids, padded = checked(pieces, docs, token_packing.Limits(), library)
    assert ids == padded
    want = sorted((r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in pieces)
    assert sorted(map(tuple, QUERIES["op12_vector_packing"](spark, SF).collect())) == want


def test_examples_stay_whole_under_all_three_limits(spark):
    rnd = random.Random(8)
    limits = token_packing.Limits(1000, 6, 400)
    rows = [(f"e{i}", n := rnd.randint(1, 700), rnd.randint(0, min(n, 400))) for i in range(800)] + [("long", 1001, 1), ("loss", 900, 401), ("none", 0, 0), (None, 5, 5), ("null", None, None)]
    got = token_packing.pack_examples(spark.createDataFrame(rows, "example_id string, tokens long, loss_tokens long").coalesce(1), limits).collect()
    assert sorted(((r.example_id, r.tokens, r.loss_tokens) for r in got), key=repr) == sorted(((i, n or 0, x or 0) for i, n, x in rows), key=repr)
    assert {r.example_id for r in got if r.sequence_id is None} == {"long", "loss", "none", "null"}
    held = {}
    for r in got:
        if r.sequence_id is not None:
            held.setdefault(r.sequence_id, []).append(r)
    for parts in held.values():
        assert sum(r.tokens for r in parts) <= 1000 and sum(r.loss_tokens for r in parts) <= 400 and len(parts) <= 6
        assert [r.offset for r in sorted(parts, key=lambda r: r.offset)] == np.cumsum([0, *(r.tokens for r in sorted(parts, key=lambda r: r.offset))]).tolist()[:-1]
    least = max(math.ceil(sum(r.tokens for p in held.values() for r in p) / 1000), math.ceil(sum(r.loss_tokens for p in held.values() for r in p) / 400), math.ceil(797 / 6))
    assert len(held) <= 1.12 * least  # of the bound of the scarcest limit

    def first_fit():
        bins = []
        for _, n, x in rows[:800]:
            for b in bins:
                if b[0] + n <= 1000 and b[1] + x <= 400 and b[2] < 6:
                    b[0] += n
                    b[1] += x
                    b[2] += 1
                    break
            else:
                bins.append([n, x, 1])
        return len(bins)

    assert len(held) <= first_fit()


def exact_whitening(vectors):
    """n, deviations, covariance in fractions, by the definition."""
    xs = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    centred = [[n * x[i] - s[i] for i in range(d)] for x in xs]
    v = [[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(d)] for i in range(d)]
    return n, [sum(c * c for c in row) for row in centred], centred, np.array(v)


def against_definition(got, ids, vectors, components=8):
    n, squares, centred, v = exact_whitening(vectors)
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(by) == list(range(1, min(components, len(values)) + 1))
    for k, rows in by.items():
        z = np.array(centred, dtype=float) @ basis[:, k - 1] / n / math.sqrt(values[k - 1])
        held = np.array([rows[i][0].whitened for i in ids])
        assert min(np.abs(held - z).max(), np.abs(held + z).max()) < 1e-6
        for i, sq in zip(ids, squares, strict=True):
            r = rows[i][0]
            assert r.n == n and int(r.deviation_exact) == sq and r.deviation == (sq if sq < 1 << 63 else None)
            assert abs(r.explained - values[k - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-6


def test_whitening_by_the_definition(spark):
    rnd = np.random.default_rng(4)
    vectors = (rnd.normal(size=(300, 5)) * [1, 2, 3, 4, 5] + 7).tolist()
    rows = list(enumerate(vectors)) + [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [1.0, math.nan, 2.0, 3.0, 4.0]), (903, [math.inf, 1.0, 2.0, 3.0, 4.0]), (904, []), (905, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    against_definition(whitening.whitened(df).collect(), range(300), vectors)
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, component int, `z.z` string")
    against_definition(whitening.whitened(df, components=3).collect(), range(300), vectors, 3)


def test_whitening_far_beyond_floats(spark):
    """Entries whose squares no float and no long holds."""
    rnd = np.random.default_rng(5)
    vectors = (rnd.integers(-(1 << 47), 1 << 47, (120, 3)) + (1 << 47)).astype(float).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    against_definition(whitening.whitened(df).collect(), range(120), vectors)
    narrow = [[1e12 + x, 1e12 - 2 * x + y] for x, y in rnd.normal(size=(50, 2)).tolist()]  # a float covariance would lose all digits
    df = spark.createDataFrame(list(enumerate(narrow)), "vec_id long, embedding array<double>")
    against_definition(whitening.whitened(df).collect(), range(50), narrow)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-(1 << 61), 1 << 61)] * 3), min_size=1, max_size=20))
def test_scatter_is_exact(rows):
    total = whitening.Scatter(3)
    total.add(np.array(rows, dtype=np.int64))
    n, sums, products = total.told()
    assert n == len(rows) and sums.tolist() == [sum(r[i] for r in rows) for i in range(3)]
    assert products.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
    for v in (*sums.tolist(), *products.ravel().tolist()):
        assert sum(x << whitening.WIDE * k for k, x in enumerate(whitening._wide(v))) == v


def test_whitening_without_variance(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert make([]) == [] and make([(1, [1.0, 2.0])]) == [] and make([(1, [1.0, 2.0])] * 9) == [] and make([(1, None)]) == []
    flat = make([(i, [float(i), 3.0]) for i in range(10)] + [(None, [4.0, 3.0])])  # one direction only, and a null id
    assert {r.component for r in flat} == {1} and len(flat) == 11 and abs(flat[0].explained - 1) < 1e-12


def test_whitening_query_on_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    against_definition(QUERIES["op13_exact_whitening"](spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])
