"""Whole searches over files: index life cycle, events, edits, context."""

import pytest
from test_sources import xlsx

from textloom.operators import context, index
from textloom.plans import edit
from textloom.plans.request import NamedTerm, SearchRequest
from textloom.plans.run import Session, events, search_files


def told(spark, request, folder=None):
    return list(events(spark, request, index_folder=folder))


def summary(all_events):
    return next(e for e in all_events if e["type"] == "executionSummary")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a", "user_name\nuserName x"), ("b", "other\nuzername"), ("c", "nothing")):
        (tmp_path / "in" / f"{name}.txt").write_text(text, encoding="utf-8")
    (tmp_path / "in/d.docx").write_bytes(b"broken")
    return tmp_path


def test_a_second_search_extracts_only_what_changed(spark, folder):
    request, at = SearchRequest(str(folder / "in"), "username", fuzzy=True), str(folder / "index")
    hits = lambda es: sorted((e["path"], e["location"], e["matchType"]) for e in es if e["type"] == "result")
    first = told(spark, request, at)
    assert (summary(first)["extractedFiles"], summary(first)["reusedFiles"]) == (4, 0) and hits(first) == hits(told(spark, request))
    second = told(spark, request, at)
    assert (summary(second)["extractedFiles"], summary(second)["reusedFiles"]) == (1, 3) and hits(second) == hits(first)  # the broken file is never cached
    (folder / "in/c.txt").write_text("the user name here", encoding="utf-8")
    (folder / "in/b.txt").unlink()
    third = told(spark, request, at)
    assert (summary(third)["extractedFiles"], summary(third)["reusedFiles"]) == (2, 1) and hits(third) == hits(told(spark, request))
    assert sorted(r.path[-5:] for r in index.indexed(spark, at).collect()) == ["a.txt", "c.txt"]
    for f in (folder / "in").iterdir():
        f.unlink()
    (folder / "in/b.txt").write_text("user name", encoding="utf-8")
    for _ in range(2):  # tombstones count as a segment
        assert [e["path"][-5:] for e in told(spark, request, at) if e["type"] == "result"] == ["b.txt"]
    (folder / "in/a.txt").write_text("user_name\nuserName x", encoding="utf-8")
    (folder / "in/b.txt").unlink()
    assert {e["path"][-5:] for e in told(spark, request, at) if e["type"] == "result"} == {"a.txt"}
    assert [u.text for u in index.Index(spark, at).file_units(str((folder / "in/a.txt").resolve())).collect()] == ["a.txt", "user_name", "userName x"]


def test_a_damaged_index_is_made_anew(spark, folder):
    request, at = SearchRequest(str(folder / "in"), "username", fuzzy=True), str(folder / "index")
    first = told(spark, request, at)
    for f in (folder / "index").rglob("files/**/*.parquet"):
        f.write_bytes(b"damaged")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    again = told(spark, request, at)
    assert summary(again)["reusedFiles"] == 0 and [e["type"] for e in again] == [e["type"] for e in first]


def test_files_that_change_while_they_are_read_are_not_cached(spark, folder):
    from textloom.sources import files as sources

    root = str((folder / "in").resolve())
    listed, _ = sources.discover(spark, (root,), (), ("txt",))
    changed = listed.withColumn("size", listed["size"] + (listed["path"].endswith("a.txt")).cast("long"))
    extract = lambda some: sources.extract_files(sources.read_contents(spark, some))
    units, _, extracted, reused, _ = index.refresh(spark, str(folder / "ix"), listed, extract, 0, lambda: changed)
    assert (extracted, reused) == (3, 0) and units.select("path").distinct().count() == 3
    assert sorted(r.path[-5:] for r in index.indexed(spark, str(folder / "ix")).collect()) == ["b.txt", "c.txt"]


def test_results_have_previews_ranges_and_anchors(spark, folder):
    es = told(spark, SearchRequest(str(folder / "in"), "user_name"))
    (r,) = [e for e in es if e["type"] == "result"]
    assert (r["previewText"], r["matchRanges"], r["sourceMatchRanges"], r["resultId"]) == ("user_name", [[0, 9]], [[0, 9]], 1)
    assert r["modifiedAt"] and r["editAnchor"]["lineNumber"] == 1 and r["evidence"] == []
    assert [e["phase"] for e in es if e["type"] == "progress"][:2] == ["discovery", "search"]


def test_edits_keep_all_other_bytes_and_refuse_changed_files(spark, folder):
    f = folder / "in/e.txt"
    f.write_bytes("﻿one\r\ncafé two\r\n".encode())
    (r,) = [e for e in told(spark, SearchRequest(str(folder / "in"), "two")) if e["type"] == "result"]
    draft = edit.prepare(r)
    assert (draft.before, draft.selected, draft.after) == ("café ", "two", "")
    draft.save("2\nmore")
    assert f.read_bytes() == "﻿one\r\ncafé 2\r\nmore\r\n".encode()
    with pytest.raises(edit.EditError, match="changed"):
        edit.prepare(r)
    with pytest.raises(edit.EditError, match="changed"):
        draft.save("x")
    assert sorted(p.name for p in (folder / "in").iterdir()) == ["a.txt", "b.txt", "c.txt", "d.docx", "e.txt"]


def test_conditions_give_groups_with_evidence(spark, folder):
    (folder / "in/s.xlsx").write_bytes(xlsx())
    row = {"mode": "conditions", "scope": "excelRow", "all": ["alpha", "true"]}
    (r,) = [e for e in told(spark, SearchRequest(str(folder / "in"), query_spec=row)) if e["type"] == "result"]
    assert r["sourceKind"] == "excelRow" and [e["term"] for e in r["evidence"]] == ["alpha", "true"] and r["row"] == 1
    file = {"mode": "conditions", "scope": "file", "all": ["alpha", "2"]}
    es = told(spark, SearchRequest(str(folder / "in"), query_spec=file))
    (r,) = [e for e in es if e["type"] == "result"]
    assert r["sourceKind"] == "fileMatch" and len(r["evidence"]) == 2


def test_context_of_a_result(spark, folder):
    (folder / "in/s.xlsx").write_bytes(xlsx())
    found = search_files(spark, SearchRequest(str(folder / "in"), "alpha").validated())
    (r,) = [e for e in told(spark, SearchRequest(str(folder / "in"), "alpha")) if e["type"] == "result"]
    stat = (folder / "in/s.xlsx").stat()
    focus = context.target(r, f"{stat.st_size}:{stat.st_mtime_ns}").unchanged()
    assert (focus.row, focus.column, focus.sheet_name) == (1, 1, "S1")
    cells = {(c.row, c.column): (c.text, c.match_ranges) for c in context.window(found.units, focus).collect()}
    assert cells[1, 1] == ("alpha", [[0, 5]]) and cells[1, 2] == ("TRUE", [])
    (folder / "in/s.xlsx").write_bytes(xlsx() + b" ")
    with pytest.raises(context.ContextError) as e:
        focus.unchanged()
    assert e.value.code == "changedSinceSearch"
    assert context.target(r | {"fileType": "txt"}) is None
    assert context.distinct_ranges([[3, 4], [0, 1], [3, 4]]) == [(0, 1), (3, 4)]


def test_one_search_at_a_time(spark, folder):
    session = Session(spark)
    first = session.run(SearchRequest(str(folder / "in"), "username", fuzzy=True))
    assert next(first)["type"] == "started"
    second = session.run(SearchRequest(str(folder / "in"), "other"))
    assert next(second)["type"] == "started"
    rest = list(first)
    assert rest[-1]["type"] == "finished" and rest[-1]["reason"] == "cancelled"
    assert list(second)[-1]["reason"] == "completed"


def test_unicode_terms_hit_in_all_query_forms(spark):
    from pyspark.sql import functions as F

    from textloom.operators import search
    from textloom.plans.request import parse_batch, parse_conditions
    from textloom.sources import files

    pairs = [("οδοσ", "ΟΔΟΣ"), ("café", "café"), ("file", "ﬁle"), ("song", "ſong"), ("STRASSE", "Straße"), ("aa.aa", "xaa.aa.aa")]
    units = files.line_units(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(pairs)], "id int, text string"), F.concat(F.lit("f"), "id"))
    for i, (term, _) in enumerate(pairs):
        assert [r.path for r in search.plain(units, term).collect()] == [f"f{i}"]
        assert [r.path for r in search.where(units, parse_conditions({"mode": "conditions", "all": [term]})).collect()] == [f"f{i}"]
        none = parse_conditions({"mode": "conditions", "scope": "file", "any": [p for p, _ in pairs], "not": [term]})
        assert sorted(r.path for r in search.where(units, none).collect()) == [f"f{j}" for j in range(len(pairs)) if j != i]
    got = search.batch_hits(units, parse_batch({"mode": "batch", "terms": [p for p, _ in pairs]})).collect()
    assert sorted((r.path, r.term_ord) for r in got) == [(f"f{i}", i) for i in range(len(pairs))]
    assert {r.path: (r.hit.kind, r.hit.start, r.hit.end) for r in got} == {"f0": ("caseFolded", 0, 4), "f1": ("caseFolded", 0, 5), "f2": ("caseFolded", 0, 3), "f3": ("caseFolded", 0, 4), "f4": ("caseFolded", 0, 6), "f5": ("substring", 1, 6)}
    ids = search.batch_hits(units, parse_batch({"mode": "batch", "matchMode": "identifier", "terms": ["file", "song"]})).collect()
    assert sorted((r.path, r.hit.start, r.hit.end) for r in ids) == [("f2", 0, 3), ("f3", 0, 4)]


def test_native_forms_and_matches_are_the_exact_ones(spark):
    import random

    from pyspark.sql import functions as F

    from textloom.functions import forms, matcher
    from textloom.functions import text as X
    from textloom.functions.matcher import Term
    from textloom.operators import search
    from textloom.sources import files

    rnd = random.Random(1)
    letters = "aAbB_-./ éÉéßΣσςİＡカかｶﾞ①ﬁ\U0001f600ǅ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in df.select("text", X.fold("text").alias("base"), X.width("text").alias("width"), X.kana("text").alias("kana"), X.loose("text").alias("loose"), X.grams(X.loose("text"), 2).alias("grams")).collect():
        assert (r.base, r.width, r.kana, r.loose) == tuple(forms.FORMS[f](r.text) for f in ("base", "width", "kana", "loose"))
        assert set(r.grams) == forms.grams(r.loose, 2) and len(set(r.grams)) == len(r.grams)
    units = files.line_units(df, F.col("id").cast("string"))
    terms = [t for t in ("a", "ab", "é", "ss", "σ", "a.a", "B_", "fi", "e", "カ") if t]
    got = search.matched(units, tuple(NamedTerm(str(i), t) for i, t in enumerate(terms))).collect()
    native = {(int(r.path), r.term_ord): (r.hit.kind, r.hit.score, r.hit.start, r.hit.end) for r in got}
    want = {}
    for i, t in enumerate(texts):
        for j, term in enumerate(terms):
            if h := matcher.match(t, Term(term)):
                want[i, j] = (h["kind"], h["score"], h["start"], h["end"])
    assert native == want


def test_stores_that_only_spark_reads(spark, folder):
    (folder / "in/sub").mkdir()
    (folder / "in/sub/e.md").write_text("user_name", encoding="utf-8")
    (folder / "in/sub/f.txt").write_text("user_name", encoding="utf-8")
    (folder / "in/out").mkdir()
    (folder / "in/out/g.txt").write_text("user_name", encoding="utf-8")
    at = f"file://{folder}/in"
    request = SearchRequest(at, "user_name", excluded_directories=(f"{at}/out",))
    for index_folder in (None, str(folder / "index"), str(folder / "index")):
        es = told(spark, request, index_folder)
        assert sorted(e["path"].rsplit("/", 1)[-1] for e in es if e["type"] == "result") == ["a.txt", "f.txt"]
    assert summary(es)["reusedFiles"] == 4
