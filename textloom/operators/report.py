"""Reports: CSV and TSV tables, the term-by-file matrix, JSON records, events."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X

# Headers of the table.
HEADERS = ("ファイル名", "ファイルパス", "ファイル形式", "検索元", "内容区分", "場所", "プレビュー", "省略", "一致種別", "一致区分")
MATRIX_HEADERS = ("検索語ID", "検索語", "確認状態", "出力範囲")


def rows(hits: DataFrame, rankings: DataFrame | None = None, batch: bool = False) -> DataFrame:
    """The report's columns, labelled, before escaping; hits need ``path, file_type, source_kind, content_class, location, text, hit``."""
    shown = X.preview("text", F.col("hit.start"), F.col("hit.end"))
    out = hits.withColumn("p", shown)
    if rankings is not None:
        out = out.join(rankings.select("path", F.array_join("reasons", " / ").alias("why")), "path", "left")
    more = [F.col("term_id"), F.col("term")] if batch else []
    return out.select(
        "path", "document_order", F.element_at(F.split("path", "/"), -1).alias("c0"), F.col("path").alias("c1"), F.col("file_type").alias("c2"), X.label("source_kind", X.SOURCE_LABELS).alias("c3"), X.label("content_class", X.CONTENT_LABELS).alias("c4"),
        X.location_text("source_kind", "location").alias("c5"), F.col("p.text").alias("c6"), F.when(F.col("p.truncated"), "あり").otherwise("なし").alias("c7"), X.label("hit.kind", X.MATCH_LABELS).alias("c8"), X.label("hit.category", X.CATEGORY_LABELS).alias("c9"),
        *more, (F.coalesce("why", F.lit("")) if rankings is not None else F.lit("")).alias("c10"),
    )


def lines(report: DataFrame, kind: str = "csv", batch: bool = False) -> DataFrame:
    """One escaped line per row, in the report's order of files and places."""
    cell, sep = (X.csv_cell, ",") if kind == "csv" else (X.tsv_cell, "\t")
    columns = [*(f"c{i}" for i in range(10)), *(["term_id", "term"] if batch else []), "c10"]
    return report.select("path", "document_order", F.concat_ws(sep, *(cell(F.coalesce(c, F.lit(""))) for c in columns)).alias("line"))


def write_table(report: DataFrame, file: str, kind: str = "csv", batch: bool = False) -> int:
    """One file with CRLF line ends; CSV begins with a byte-order mark. Rows stream through the driver, they aren't collected."""
    head = [*HEADERS, *(["検索語ID", "検索語"] if batch else []), "順位理由"]
    n = 0
    with Path(file).open("w", encoding="utf-8-sig" if kind == "csv" else "utf-8", newline="") as f:
        f.write(("," if kind == "csv" else "\t").join(head) + "\r\n")
        for r in lines(report, kind, batch).orderBy("path", "document_order").select("line").toLocalIterator():
            f.write(r.line + "\r\n")
            n += 1
    return n


def safe(value: str) -> str:
    lead = value.lstrip()
    while lead and ord(lead[0]) < 32:
        lead = lead[1:].lstrip()
    return f"'{value}" if lead[:1] and lead[0] in "=+-@" else value


def matrix_text(summary: list[dict], counts: dict[tuple[str, str], int], files: list[str], scope: str, kind: str = "csv") -> str:
    """The term-by-file table of a finished batch, zeros included."""
    if kind == "csv":
        sep, cell = ",", lambda v: (lambda t: '"' + t.replace('"', '""') + '"' if any(c in t for c in ',"\r\n') else t)(safe(v))
    else:
        sep, cell = "\t", lambda v: safe(v).replace("\\", "\\\\").replace("\t", "\\t").replace("\r", "\\r").replace("\n", "\\n")
    out = [sep.join(cell(x) for x in (*MATRIX_HEADERS, *files))]
    out += [sep.join([*(cell(x) for x in (t["term_id"], t["term"], t["status"], scope)), *(str(counts.get((t["term_id"], p), 0)) for p in files)]) for t in summary]
    return "".join(line + "\r\n" for line in out)


def record(request: dict, summary: dict, hits: list[dict], rankings: list[dict], issues: list[dict]) -> str:
    """A JSON record of an investigation, from which the report can be made again."""
    return json.dumps({"schemaVersion": 1, "request": request, "summary": summary, "rows": hits, "rankings": rankings, "issues": issues}, ensure_ascii=False, indent=2)


def read_record(text: str) -> dict:
    found = json.loads(text)
    if found.get("schemaVersion") != 1 or set(found) != {"schemaVersion", "request", "summary", "rows", "rankings", "issues"}:
        raise ValueError("not an investigation record of this version")
    if found["summary"].get("reason") not in ("completed", "cancelled", "failed"):
        raise ValueError("unknown reason")
    return found


def write_events(events: Iterator[dict], file) -> None:
    """One event per line."""
    for e in events:
        file.write(json.dumps(e, ensure_ascii=False) + "\n")
