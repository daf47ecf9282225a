"""Posting blocks, tiers of segments, compaction and exactly-once indexing."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import forms
from textloom.functions import text as X
from textloom.functions.matcher import Term
from textloom.operators import index, postings, search, segments
from textloom.operators.segments import Manifest, Segment, Store
from textloom.plans.request import parse_batch, parse_conditions
from textloom.sources import files
from textloom.streaming import incremental

SF = "/root/testdata/sf0.01"
FILES = "path string, file_type string, size long, modified_ns long, text string"
WORDS = ("user", "name", "userName", "user_name", "uzername", "thtion", "größe", "漢字テスト", "かな", "x1y2", "HTTPServer", "plain", "Straße", "é")


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, postings.ZONE - 1), min_size=1, max_size=1200))
def test_packing_and_back(pages):
    want = np.array(sorted(pages))
    block = postings.packed(want)
    assert postings.unpacked(block).tolist() == want.tolist() and len(block) <= 1 + min(2 * len(pages), postings.ZONE // 8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=120))
def test_tiers_stay_few(added):
    sizes: list[int] = []
    for n in added:
        sizes.append(n)
        if (at := segments.due(sizes)) is not None:
            sizes[at:] = [sum(sizes[at:])]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and segments.due(sizes) is None
    assert sum(sizes) == sum(added) and len(sizes) <= np.log2(sum(added)) + 1
    assert segments.due([10, 10], largest=5) is None


def texts(rnd, n):
    return [(f"f{i:03}.txt", "txt", i, i, "\n".join(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 40)))) for i in range(n)]


def brute(rows, term):
    """Units that can match, by the index's definition, from the texts."""
    t = Term(term)
    wanted = index.wanted_grams(t)
    out = set()
    for path, *_, text in rows:
        for i, line in enumerate(files.split_lines(text) if text else [], 1):
            loose, words = forms.loose(line), forms.tokens(line)
            token = len(t.tokens) == 1 and any(w == t.tokens[0] or len(t.tokens[0]) >= 3 and w.startswith(t.tokens[0]) for w in words)
            typo = t.typo and any(w[:1] == t.typo[0] and abs(len(w) - len(t.typo)) <= t.edits for w in words)
            if not wanted or all(g in loose for g in wanted) or token or typo:
                out.add((path, i))
    return out


def test_candidates_against_the_texts(spark, tmp_path):
    rows = texts(random.Random(2), 120)
    incremental.index_batch(spark.createDataFrame(rows, FILES).repartition(5), 0, str(tmp_path))
    of = index.Index(spark, str(tmp_path))
    for term in ("username", "thtion", "größ", "漢字", "テスト", "かな", "1y", "ame us", "absent", "HTTPServer", "a-b"):
        assert {(r.path, r.unit_seq) for r in of.candidates(Term(term)).collect()} == brute(rows, term), term


def odd(text):
    """Whether a text has characters that don't fold by themselves, told without the pattern."""
    known = lambda c: c.isascii() or c in "ß\r" or X._tokens_usual(c) and any(a <= ord(c) <= b for a, b in X._BLOCKS)
    return not all(map(known, text))


def test_blocks_are_those_of_the_forms():
    rnd = random.Random(1)
    letters = "abABcdZ019 _-./éÉßüÄ漢字かカñжЖ\tｱ☃Σﬁ"
    texts_ = ["".join(rnd.choice(letters[: rnd.choice([30, 36])]) for _ in range(rnd.randint(0, 40))) for _ in range(2500)] + ["ß", "ßß", "aßB", ""]
    first = postings.PAGE * postings.ZONE - 500
    rows = pa.RecordBatch.from_arrays([pa.array(range(first, first + len(texts_))), pa.array(texts_), pa.array(list(map(odd, texts_)))], ["unit_no", "text", "odd"])
    got, want = {}, {}
    for out in postings.blocks_of(iter([rows.slice(0, 1111), rows.slice(1111)])):
        for r in out.to_pylist():
            pages = postings.unpacked(r["pages"])
            assert r["pages"] == postings.packed(pages) and (r["first"], r["last"], r["n"]) == (pages[0], pages[-1], len(pages))
            got.setdefault((r["kind"], r["key"]), set()).update((pages + (r["zone"] << postings.ZONE_BITS)).tolist())
    for i, t in enumerate(texts_):
        page, loose = first + i >> postings.PAGE_BITS, forms.loose(t)
        keys = [(str(n), g) for n in (2, 3) for g in forms.grams(loose, n)] + [("t", w) for w in forms.tokens(t)]
        for k in keys:
            want.setdefault(k, set()).add(page)
    assert got == want and len(want) > 5000


def test_native_tokens_and_the_pattern_of_odd_texts(spark):
    rnd = random.Random(2)
    letters = "abAB19 _-.éßÉüÄ漢字かカñΣσжЖ½١ｱ"
    rows = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(1500)] + ["a" * 20000, "A" * 20000 + "b", "aB" * 10000, "ﬁ x", "İstanbul"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", X.tokens_of_scripts("t").alias("w"), F.col("t").rlike(X.UNTOKENED).alias("odd")).collect()
    assert all(r.odd == odd(r.t) and (r.odd or r.w == forms.tokens(r.t)) for r in got) and 100 < sum(r.odd for r in got) < 1400


def bytes_of(folder: Path) -> int:
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_size_and_what_a_look_up_reads(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.lit("txt").alias("file_type"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("modified_ns"), "text")
    incremental.index_batch(d, 0, str(tmp_path))
    text = d.agg(F.sum(F.octet_length("text"))).first()[0]
    (at,) = (Path(tmp_path) / "v3/segments").iterdir()
    assert bytes_of(at) <= 1.5 * text
    opened = index.Index(spark, str(tmp_path)).postings().where(F.col("bucket").isin(*postings.buckets(index.wanted_grams(Term("ingthea")))))
    some = {r[0].removeprefix("file://") for r in opened.select("_metadata.file_path").distinct().collect()} if "_metadata" in opened.columns else {str(f) for b in postings.buckets(index.wanted_grams(Term("ingthea"))) for f in (at / f"postings/bucket={b}").iterdir()}
    assert sum(Path(f).stat().st_size for f in some) <= 0.06 * bytes_of(at)


def answers(spark, units):
    """Every form of query over some units."""
    key = lambda df, *c: sorted(map(repr, df.select(*c).collect()))
    spec = parse_conditions({"mode": "conditions", "scope": "file", "all": ["user"], "any": ["größe", "plain"], "not": ["HTTPServer"]})
    return [
        key(search.plain(units, "username"), "path", "unit_seq", "hit"),
        key(search.plain(units, "username", fuzzy=True), "path", "unit_seq", "hit"),
        key(search.where(units, spec), "path", "category"),
        key(search.batch_hits(units, parse_batch({"mode": "batch", "terms": ["Name", "é", "x1"]})), "path", "unit_seq", "term_id", "hit"),
    ]


def test_compaction_keeps_answers_and_few_segments(spark, tmp_path):
    rnd = random.Random(4)
    now, folder = {}, str(tmp_path)
    for step in range(12):
        changed = texts(rnd, 6) if step % 3 else [(f"g{step}.txt", "txt", 1, step, "user größe\nuserName")]
        gone = sorted(now)[:1] if step % 4 == 3 else []
        now |= {r[0]: r for r in changed}
        now = {p: r for p, r in now.items() if p not in gone}
        listing = lambda: spark.createDataFrame([(p,) for p in now], "path string")  # noqa: E731, B023
        incremental.index_batch(spark.createDataFrame(changed, FILES), step, folder, "s", listing)
        of = index.Index(spark, folder)
        assert len(of.manifest.segments) <= np.log2(sum(s.size for s in of.manifest.segments) + 1) + 1
    assert len(of.manifest.segments) <= np.log2(12) + 2 and of.manifest.gone
    fresh = files.line_units(spark.createDataFrame(list(now.values()), FILES), F.col("path"))
    assert answers(spark, of.units()) == answers(spark, fresh)
    assert {r.path for r in of.files().collect()} == set(now)
    cut = {(r.path, r.unit_seq) for r in of.candidates(Term("username")).collect()}
    assert cut == brute(now.values(), "username")
    before = index.Index(spark, folder)  # a reader that began before the segments go
    assert len(list((tmp_path / "v3/segments").iterdir())) > len(of.manifest.segments)
    after = index.compact(spark, folder, grace=0.0)
    assert {p.name for p in (tmp_path / "v3/segments").iterdir()} == {str(s.id) for s in after.segments}
    assert before.units().count() == fresh.count()


def test_a_killed_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    folder, rows = str(tmp_path), texts(random.Random(8), 20)
    monkeypatch.setattr(index, "compact", lambda *a, **k: None)
    for i in range(3):
        incremental.index_batch(spark.createDataFrame(rows[i::3], FILES), i, folder)
    monkeypatch.undo()
    assert len(index.Index(spark, folder).manifest.segments) == 3

    def killed(self, new):
        raise KeyboardInterrupt

    want = answers(spark, files.line_units(spark.createDataFrame(rows, FILES), F.col("path")))
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Store, "commit", killed)
        index.compact(spark, folder)
    assert len(index.Index(spark, folder).manifest.segments) == 3 and answers(spark, index.Index(spark, folder).units()) == want
    index.compact(spark, folder)
    assert len(index.Index(spark, folder).manifest.segments) < 3 and answers(spark, index.Index(spark, folder).units()) == want


def test_batches_are_indexed_once_whatever_stops(spark, tmp_path, monkeypatch):
    """A stream is stopped after a segment is written and before it counts, and after it counts and before the stream knows."""
    folder, rows = tmp_path / "index", texts(random.Random(3), 30)
    for i in range(3):
        spark.createDataFrame(rows[i::3], FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: incremental.index_stream(spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(folder), str(tmp_path / "state"))
    real, calls = Store.commit, []

    def stopped(self, new):
        calls.append(new)
        if len(calls) == 2:
            raise RuntimeError("before the swap")
        done = real(self, new)
        if len(calls) == 4:
            raise RuntimeError("after the swap")
        return done

    monkeypatch.setattr(Store, "commit", stopped)
    for _ in range(4):
        try:
            stream().awaitTermination()
            break
        except Exception:  # noqa: BLE001  begun again from the checkpoint
            continue
    monkeypatch.undo()
    of = index.Index(spark, str(folder))
    assert len(calls) > 4 and of.manifest.batches == {"files": 2}
    fresh = files.line_units(spark.createDataFrame(rows, FILES), F.col("path"))
    assert answers(spark, of.units()) == answers(spark, fresh)
    assert of._table("files", index._FILE).groupBy("path").count().where("count > 1").count() == 0
    assert not incremental.index_batch(spark.createDataFrame(rows[:1], FILES), 2, str(folder))  # played again


def test_batches_with_odd_rows(spark, tmp_path):
    rows = [(None, "txt", 1, 1, "x"), ("a", "txt", 1, 1, None), ("b", "txt", 1, 1, "old"), ("b", "txt", 1, 2, "new\nnewer"), ("c", "txt", 0, 0, "")]
    assert incremental.index_batch(spark.createDataFrame(rows, FILES), 0, str(tmp_path))
    of = index.Index(spark, str(tmp_path))
    assert {r.path for r in of.files().collect()} == {"a", "b", "c"} and sorted(r.text for r in of.units().collect()) == ["new", "newer"]
    assert incremental.index_batch(spark.createDataFrame([], FILES), 1, str(tmp_path), listing=lambda: spark.createDataFrame([("a",)], "path string"))
    assert [r.path for r in index.Index(spark, str(tmp_path)).files().collect()] == ["a"]


def test_manifests_swap_and_refuse_a_second_writer(spark, tmp_path):
    store = Store(spark, str(tmp_path / "r"))
    assert store.read() is None
    one = store.commit(Manifest().with_segment(5))
    assert store.read() == one and one.segments == (Segment(1, 5),)
    two = store.commit(one.with_segment(7, (1,), now=100.0))
    with pytest.raises(RuntimeError):
        store.commit(one.with_segment(9))
    assert store.read() == two and two.gone == ((1, 100.0),)
    assert store.sweep(two, grace=50.0, now=120.0).gone == two.gone and store.sweep(two, grace=50.0, now=150.0).gone == ()
    (tmp_path / "r/manifest/000000000009.json").write_text("{}")
    with pytest.raises(ValueError):
        store.read()


def test_compaction_copies_postings_until_most_are_stale(spark, tmp_path, monkeypatch):
    folder, made = str(tmp_path), []
    rows = [(f"f{i}.txt", "txt", 1, 0, f"userName {i}\nplain line") for i in range(40)]
    usual = postings.write
    monkeypatch.setattr(postings, "write", lambda units, *a: (made.append(units.count()), usual(units, *a)))
    now = {}
    for number, (a, b) in enumerate([(0, 20), (15, 40), (0, 12)]):
        batch = [(*r[:3], number, r[4] + f"\nstep{number}") for r in rows[a:b]]
        now |= {r[0]: r for r in batch}
        incremental.index_batch(spark.createDataFrame(batch, FILES), number, folder)
    of = index.Index(spark, folder)
    assert made == [60, 75, 36]  # each text is cut once, when it comes
    assert sum(s.stale for s in of.manifest.segments) > 0
    for word in ("username", "thtion"):
        assert {(r.path, r.unit_seq) for r in of.candidates(Term(word)).collect()} == brute(now.values(), word)
