"""Reports: files, matrices, records, event lines; and views on results."""

import io
import json

import pytest
from pyspark.sql import functions as F

from textloom import catalogue
from textloom.functions import text as X
from textloom.functions.matcher import bounded_distance
from textloom.operators import ranking, report, search
from textloom.plans.request import parse_batch, remembered
from textloom.sources import files

ROWS = [("b/2.txt", "=alpha one\nsecond"), ("a/1.txt", 'say "alpha", twice\n-alpha\tx'), ("a/3.txt", "nothing")]


@pytest.fixture(scope="module")
def units(spark):
    d = spark.createDataFrame(ROWS, "p string, text string")
    return files.line_units(d, F.col("p"))


@pytest.fixture(scope="module")
def rankings(spark, units):
    hits = search.plain(units, "alpha")
    return ranking.ranked(hits.select("path", F.lit("query").alias("term_key"), F.col("hit.score").alias("score"), "part_key", "unit_key", "row", "content_class", "source_kind"))


def test_rankings_have_reasons(rankings):
    got = {r.path: (r.file_rank, r.quality, r.distinct_evidence, r.reasons) for r in rankings.collect()}
    assert got == {"a/1.txt": (1, 100, 2, ["1語に一致", "本文に根拠あり"]), "b/2.txt": (2, 100, 1, ["1語に一致", "本文に根拠あり"])}


def test_tables_are_escaped_guarded_and_marked(units, rankings, tmp_path):
    table = report.rows(search.plain(units, "alpha"), rankings)
    assert report.write_table(table, str(tmp_path / "r.csv")) == 3
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith("﻿ファイル名,".encode()) and raw.count(b"\r\n") == 4
    lines = raw.decode("utf-8-sig").split("\r\n")
    assert lines[1] == '1.txt,a/1.txt,txt,テキスト行,本文,行 1,"say ""alpha"", twice",なし,完全一致,一致検索,1語に一致 / 本文に根拠あり'
    assert lines[2].split(",")[6] == "'-alpha\tx" and lines[3].split(",")[6] == "'=alpha one"
    report.write_table(table, str(tmp_path / "r.tsv"), "tsv")
    assert (tmp_path / "r.tsv").read_text(encoding="utf-8").split("\n")[2].split("\t")[6] == "'-alpha\\tx"


def test_batch_tables_name_their_terms_and_summaries_count(spark, units, tmp_path):
    b = parse_batch({"mode": "batch", "terms": ["alpha", "none", "second"]})
    hits = search.batch_hits(units, b)
    report.write_table(report.rows(hits, batch=True), str(tmp_path / "b.csv"), batch=True)
    assert (tmp_path / "b.csv").read_text(encoding="utf-8-sig").split("\n")[0].rstrip("\r").endswith("検索語ID,検索語,順位理由")
    for issues, cancelled, status in ((0, False, "確認完了"), (2, False, "未確定（一部エラーあり）"), (2, True, "未確定（中断）")):
        told = [(r.term, r.file_count, r.hit_count, r.status) for r in search.batch_summary(hits, b, issues, cancelled).orderBy("term_ord").collect()]
        assert told == [("alpha", 2, 3, status), ("none", 0, 0, "指定範囲内で該当なし" if status == "確認完了" else status), ("second", 1, 1, status)]


def test_matrix():
    summary = [{"term_id": "batch:1", "term": "=a", "status": "確認完了"}, {"term_id": "batch:2", "term": "b,c", "status": "確認完了"}]
    text = report.matrix_text(summary, {("batch:1", "x.txt"): 2}, ["x.txt", "y.txt"], "all")
    assert text == "検索語ID,検索語,確認状態,出力範囲,x.txt,y.txt\r\nbatch:1,'=a,確認完了,all,2,0\r\nbatch:2,\"b,c\",確認完了,all,0,0\r\n"


def test_records_and_event_lines():
    made = report.record({"q": "é"}, {"reason": "completed"}, [{"a": 1}], [], [])
    assert report.read_record(made)["rows"] == [{"a": 1}] and "é" in made
    for bad in (made.replace("completed", "odd"), made.replace('"schemaVersion": 1', '"schemaVersion": 2'), json.dumps({"schemaVersion": 1})):
        with pytest.raises(ValueError, match="reason|record"):
            report.read_record(bad)
    out = io.StringIO()
    report.write_events([{"sequence": 1, "type": "é"}, {"sequence": 2, "type": "finished"}], out)
    assert [json.loads(x)["sequence"] for x in out.getvalue().splitlines()] == [1, 2] and "é" in out.getvalue()


def test_edited_files_leave_the_results(spark, units):
    left = ranking.without_edited(search.plain(units, "alpha"), spark.createDataFrame([("a/1.txt",)], "path string"))
    assert {r.path for r in left.collect()} == {"b/2.txt"}


def test_histories():
    assert remembered(["C:\\A\\", "/x/y"], "c:/a") == ["c:/a", "/x/y"]
    assert len(remembered([f"/f{i}" for i in range(30)], "/new")) == 20 and remembered([], " ") == []


def test_evidence_is_listed_in_the_order_of_terms(units):
    from textloom.plans.request import parse_conditions

    (g,) = search.where(units, parse_conditions({"mode": "conditions", "scope": "file", "all": ["second", "alpha"], "any": ["one", "zzz"]})).collect()
    assert [(e.term, e.best.unit_seq, e.best.hit.start) for e in g.evidence] == [("second", 2, 0), ("alpha", 1, 1), ("one", 1, 7)] and g.category == "standard"


def test_group_category_is_fuzzy_where_a_term_is(spark):
    from textloom.plans.request import parse_conditions

    d = files.line_units(spark.createDataFrame([("x", "receve it"), ("y", "receive it")], "p string, text string"), F.col("p"))
    got = search.where(d, parse_conditions({"mode": "conditions", "all": ["receive"]}), fuzzy=True).collect()
    assert {r.path: r.category for r in got} == {"x": "fuzzy", "y": "standard"} and bounded_distance("receive", "receve", 1) == 1


def test_addresses_in_a_sheet_and_below_its_last_row(spark, tmp_path):
    named = ["A1", "XFD1048576", "XFD1048577", "ABC99999999", "XFE1", "A0", "a1", "A", "7", "A12B", None, "B123456789012345678"]
    got = spark.createDataFrame([(n,) for n in named], "a string").select(X.address("a").alias("inside"), X.address_parts("a").alias("any")).collect()
    pair = lambda x: x and tuple(x)
    assert [pair(r["any"]) for r in got] == [(1, 1), (1048576, 16384), (1048577, 16384), (99999999, 731), *[None] * 7, (123456789012345678, 2)]
    assert [pair(r.inside) for r in got] == [(1, 1), (1048576, 16384), *[None] * 10]
    keys = [0, 1_048_575, 1_048_576, 400_000_000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    told = sorted(tuple(r)[1:] for r in catalogue.q38_a1_address(spark, str(tmp_path)).collect())
    assert told == [(k + 1, (k + 1) * 7 % 16384 + 1) for k in keys]
