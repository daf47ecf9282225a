"""Searches in waves of files, and the command line."""

import json

import pytest
from test_sources import xlsx

from textloom import __main__ as command
from textloom.plans import run
from textloom.plans.request import SearchRequest

TEXTS = ("user_name", "nothing", "userName x\nuser name", "other\nuzername", "username\nusername here", "", "the user_name", "alpha user_name")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for i, text in enumerate(TEXTS):
        (tmp_path / "in" / ("sub" if i % 3 == 2 else ".") / f"f{i}.txt").write_text(text, encoding="utf-8")
    (tmp_path / "in/s.xlsx").write_bytes(xlsx())
    (tmp_path / "in/z.docx").write_bytes(b"broken")
    return tmp_path


def told(spark, request, **more):
    return [{k: v for k, v in e.items() if k != "sequence"} for e in run.events(spark, request, **more)]


def quiet(es):
    """Without issues, which are told with their wave, and their count on the way."""
    return [e | {"counts": {k: v for k, v in e["counts"].items() if k != "issues"}} if e["type"] == "progress" else e for e in es if e["type"] != "issue"]


BATCH = {"mode": "batch", "terms": ["user", "name", "absent"]}
ROWS = {"mode": "conditions", "scope": "file", "any": ["user_name", "alpha"], "not": ["nothing"]}


def test_waves_tell_what_one_wave_tells(spark, folder, monkeypatch):
    requests = [SearchRequest(str(folder / "in"), "username", fuzzy=True), SearchRequest(str(folder / "in"), query_spec=BATCH), SearchRequest(str(folder / "in"), query_spec=ROWS)]
    one = [told(spark, r) for r in requests]
    monkeypatch.setattr(run, "WAVE_FILES", 3)
    for request, want in zip(requests, one, strict=True):
        got = told(spark, request)
        assert quiet(got) == quiet(want)
        assert sorted(map(str, (e for e in got if e["type"] == "issue"))) == sorted(map(str, (e for e in want if e["type"] == "issue")))
        ids = [e["resultId"] for e in got if e["type"] == "result"]
        assert ids == list(range(1, len(ids) + 1)) and ids
        kept = [e for e in told(spark, request, index_folder=str(folder / f"index{requests.index(request)}")) if e["type"] in ("result", "fileRanked", "rankingSummary", "batchSummary", "finished")]
        assert kept == [e for e in want if e["type"] in ("result", "fileRanked", "rankingSummary", "batchSummary", "finished")]


def test_results_come_before_the_next_wave_is_read(spark, folder, monkeypatch):
    read, real = [], run.Waves.of
    monkeypatch.setattr(run, "WAVE_FILES", 2)
    monkeypatch.setattr(run.Waves, "of", lambda self, n: read.append(n) or real(self, n))
    es = run.events(spark, SearchRequest(str(folder / "in"), "user"))
    first = next(e for e in es if e["type"] == "result")
    assert first["resultId"] == 1 and len(read) == 1
    rest = list(es)
    assert len(read) == 5 and rest[-1]["reason"] == "completed" and rest[-1]["counts"]["processed"] == 10


def test_a_cancelled_search_keeps_what_it_gave(spark, folder, monkeypatch):
    monkeypatch.setattr(run, "WAVE_FILES", 2)
    seen = []
    for e in run.events(spark, SearchRequest(str(folder / "in"), "user"), cancelled=lambda: any(x["type"] == "fileRanked" for x in seen)):
        seen.append(e)
    assert seen[-1] == {"sequence": len(seen), "type": "finished", "reason": "cancelled", "counts": seen[-1]["counts"]}
    assert seen[-1]["counts"]["processed"] < 10 and sum(e["type"] == "result" for e in seen) == seen[-1]["counts"]["results"] > 0
    (ranks,) = [e["files"] for e in seen if e["type"] == "rankingSummary"]
    assert {e["path"] for e in seen if e["type"] == "fileRanked"} <= set(ranks)


def test_waves_of_bytes_and_of_nothing(spark, folder, monkeypatch):
    monkeypatch.setattr(run, "WAVE_BYTES", 10)
    assert [e["type"] for e in told(spark, SearchRequest(str(folder / "in"), "username"))].count("fileRanked") == 2
    (folder / "none").mkdir()
    es = told(spark, SearchRequest(str(folder / "none"), "username"))
    assert [e["type"] for e in es] == ["started", "progress", "progress", "rankingSummary", "executionSummary", "finished"] and es[-1]["counts"]["discovered"] == 0


def test_command_line(spark, folder, capsys):
    assert command.main([str(folder / "in"), "username", "--fuzzy-search", "--extensions", "txt", "--exclude-directory", str(folder / "in/sub")], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [e["sequence"] for e in lines] == list(range(1, len(lines) + 1)) and lines[-1]["reason"] == "completed"
    assert {e["path"].rsplit("/", 1)[-1] for e in lines if e["type"] == "result"} == {"f0.txt", "f3.txt", "f4.txt", "f6.txt", "f7.txt"}
    assert command.main([str(folder / "in"), "", "--query-spec-json", json.dumps(ROWS), "--use-index", str(folder / "ix")], spark) == 0
    assert any(json.loads(x)["type"] == "result" for x in capsys.readouterr().out.splitlines())
    assert command.main([str(folder / "in"), "user", "--cancel-on-start"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["reason"] == "cancelled"
    for wrong in ([str(folder / "in"), " "], [str(folder / "absent"), "x"], [str(folder / "in"), "x", "--extensions", ""], [str(folder / "in"), "x", "--extensions", "exe"]):
        assert command.main(wrong, spark) == 2
    assert "extensions" in capsys.readouterr().err
    for wrong in (["only"], [str(folder), "x", "--what"], [str(folder), "x", "--query-spec-json", "{"], [str(folder), "x", "--add-directory"]):
        with pytest.raises(SystemExit) as e:
            command.main(wrong, spark)
        assert e.value.code == 2
