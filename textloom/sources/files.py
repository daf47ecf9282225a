"""Files and tables as ``units``: discovery, decoding, extraction."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import model
from textloom.functions import text as X
from textloom.session import reachable
from textloom.sources import ooxml

LISTED = T.StructType([T.StructField("path", T.StringType()), T.StructField("file_type", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified_ns", T.LongType())])


def file_type(name: str, extensions: tuple[str, ...]) -> str | None:
    """The extension of a file that is searched, in lower case; office lock files aren't."""
    stem, dot, ext = name.rpartition(".")
    ext = ext.lower()
    if not dot or not stem or ext not in extensions or name.startswith("~$") and ext in model.OFFICE_EXTENSIONS:
        return None
    return ext


def discover(spark: SparkSession, roots: tuple[str, ...], excluded: tuple[str, ...] = (), extensions: tuple[str, ...] = model.DEFAULT_EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """``files`` and ``issues`` of local folders; symbolic links aren't followed, an unreadable folder is an issue."""
    found, issues, work = [], [], [r for r in roots if not any(within(r, x) for x in excluded)]
    while work:
        folder = work.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            issues.append(("discovery", folder, "accessDenied" if isinstance(e, PermissionError) else "unreadable", str(e)))
            continue
        for e in entries:
            if e.is_symlink():
                continue
            if e.is_dir():
                if not any(within(e.path, x) for x in excluded):
                    work.append(e.path)
            elif e.is_file() and (ext := file_type(e.name, extensions)):
                stat = e.stat()
                found.append((e.path, ext, stat.st_size, stat.st_mtime_ns))
    found.sort(key=lambda f: f[0].split("/"))
    return spark.createDataFrame(found, LISTED), spark.createDataFrame(issues, model.ISSUE)


def scan(spark: SparkSession, roots: tuple[str, ...], excluded: tuple[str, ...] = (), extensions: tuple[str, ...] = model.DEFAULT_EXTENSIONS) -> DataFrame:
    """``path, file_type, size, modified_ns, content`` of the files below folders of any store that Spark reads (``scheme://...``).

    Spark lists the folders in parallel and reads contents only where they are selected; links are followed as the store does.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(path, "^([a-z0-9+.-]+):/+(?=[^/])", "$1:///") if all(r.startswith("file:") for r in roots) else path
    found = raw.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), "content")
    found = select_paths(found, excluded=excluded, extensions=extensions)
    return found.select("path", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("file_type"), "size", "modified_ns", "content")


def within(path: str, folder: str) -> bool:
    a, b = path.split("/"), folder.rstrip("/").split("/")
    return a[: len(b)] == b


def select_paths(files: DataFrame, path: str = "path", roots: tuple[str, ...] = (), excluded: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a table of paths below the roots and not below the excluded folders, with searched extensions: filters that reach the scan."""
    under = lambda folder: F.col(path).startswith(folder.rstrip("/") + "/")
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))
    out = files
    if roots:
        ok = F.lit(False)
        for r in roots:
            ok = ok | under(r)
        out = out.where(ok)
    for x in excluded:
        out = out.where(~under(x))
    if extensions:
        out = out.where(ext.isin(*extensions) & ~(name.startswith("~$") & ext.isin(*model.OFFICE_EXTENSIONS)))
    return out


def decode(content: bytes) -> str:
    """UTF-8 (a byte-order mark decides), else Shift_JIS, without replacement."""
    try:
        if content.startswith(b"\xef\xbb\xbf"):
            return content[3:].decode("utf-8")
        try:
            return content.decode("utf-8")
        except UnicodeDecodeError:
            return content.decode("cp932")
    except UnicodeDecodeError as e:
        raise ooxml.Unreadable("neither UTF-8 nor Shift_JIS", "unsupportedEncoding") from e


def split_lines(text: str) -> list[str]:
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x.rstrip("\r") for x in out]


def order_of(u: dict, seq: int) -> list[int]:
    """The unit's place in its document, as a list that compares element by element."""
    place = u["location"]
    if "sheetIndex" in place:
        at = ooxml.address(place.get("cellAddress") or u["anchor"]) or (None, None)
        last = 2**63 - 1
        kind = {"cell": 0, "formula": 1, "excelComment": 2}.get(u["source_kind"], 3)
        return [1, place["sheetIndex"], *(x if x is not None else last for x in (u["row"] or at[0], u["column"] or at[1])), kind, seq]
    return [1, place.get("lineNumber") or place.get("slideNumber") or seq, seq]


def extracted_units(path: str, ext: str, content: bytes | None, formulas: bool, notes: bool) -> tuple[list[dict], list[dict], list[tuple]]:
    """Units (the file's name first), sheets and issues of one file; a name is a unit even if the content can't be read."""
    name = path.rsplit("/", 1)[-1]
    common = {"path": path, "file_type": ext}
    units = [common | {"unit_seq": 0, "source_kind": "fileName", "text": name, "unit_key": "0", "part_key": "", "group_key": "fileName", "row": None, "column": None, "content_class": "fileName", "anchor": None, "location": "{}", "document_order": [0]}]
    try:
        if ext in model.OFFICE_EXTENSIONS:
            found, sheets, faults = ooxml.extract(content or b"", ext, formulas, notes)
        else:
            if len(content or b"") > model.MAX_TEXT_BYTES:
                raise ooxml.Unreadable("the text file is too large", "resourceLimit")
            found = [ooxml.unit("textLine", t, "", {"lineNumber": i}) for i, t in enumerate(split_lines(decode(content or b"")), 1)]
            sheets, faults = [], []
    except ooxml.Unreadable as e:
        return units, [], [("read", path, e.code, e.reason)]
    for seq, u in enumerate(found, 1):
        group = f"{u['part_key']}#row:{u['row']}" if u["source_kind"] in ("cell", "formula") and u["row"] else f"unit:{seq}"
        units.append(common | u | {"unit_seq": seq, "unit_key": str(seq), "group_key": group, "location": ooxml.canonical(u["location"]), "document_order": order_of(u, seq)})
    return units, [common | s for s in sheets], [("read", path, code, reason) for code, reason in faults]


def extract_files(files: DataFrame, formulas: bool = False, notes: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``units, sheets, issues`` of files listed as ``path, file_type, content``; one file is in memory at a time."""
    reachable(files.sparkSession)
    inner = T.StructType([T.StructField("units", T.ArrayType(model.UNIT)), T.StructField("sheets", T.ArrayType(model.SHEET)), T.StructField("issues", T.ArrayType(model.ISSUE))])

    def run(batches: Iterator) -> Iterator:
        import json

        import pandas as pd

        for batch in batches:
            rows = []
            for path, ext, content in zip(batch["path"], batch["file_type"], batch["content"], strict=True):
                units, sheets, issues = extracted_units(path, ext, content, formulas, notes)
                sheets = [{**s, "layout": json.dumps(s["layout"])} for s in sheets]
                rows.append({"units": [{f: u[f] for f in model.UNIT.names} for u in units], "sheets": [{f: s[f] for f in model.SHEET.names} for s in sheets], "issues": [dict(zip(model.ISSUE.names, i, strict=True)) for i in issues]})
            yield pd.DataFrame(rows, columns=["units", "sheets", "issues"])

    got = files.select("path", "file_type", "content").mapInPandas(run, inner)
    return tuple(got.select(F.inline(c)) for c in ("units", "sheets", "issues"))


def read_contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``files`` with their bytes, read by the executors."""
    paths = [r.path for r in files.select("path").toLocalIterator()]
    if not paths:
        return files.select("*", F.lit(None).cast("binary").alias("content"))
    raw = spark.read.format("binaryFile").load(paths).select(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/").alias("path"), "content")
    return files.join(raw, "path")


def line_units(table: DataFrame, path: Column, text: str = "text", kind: str = "txt") -> DataFrame:
    """Rows of a table of texts as files, their lines as units; everything stays in the JVM."""
    lines = table.select(path.alias("path"), F.posexplode(X.lines(text)).alias("n", "text"))
    seq = F.col("n") + 1
    return lines.select(
        "path", F.lit(kind).alias("file_type"), seq.alias("unit_seq"), F.lit("textLine").alias("source_kind"), "text", seq.cast("string").alias("unit_key"), F.lit("").alias("part_key"),
        F.concat(F.lit("unit:"), seq).alias("group_key"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("column"), F.lit("body").alias("content_class"), F.lit(None).cast("string").alias("anchor"),
        F.concat(F.lit('{"lineNumber":'), seq, F.lit("}")).alias("location"), F.array(F.lit(1), seq, seq).cast("array<bigint>").alias("document_order"),
    )


def name_units(table: DataFrame, path: Column, kind: str = "txt") -> DataFrame:
    """The file-name unit of each row of a table of files."""
    return table.select(
        path.alias("path"), F.lit(kind).alias("file_type"), F.lit(0).alias("unit_seq"), F.lit("fileName").alias("source_kind"), F.element_at(F.split(path, "/"), -1).alias("text"), F.lit("0").alias("unit_key"), F.lit("").alias("part_key"),
        F.lit("fileName").alias("group_key"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("column"), F.lit("fileName").alias("content_class"), F.lit(None).cast("string").alias("anchor"), F.lit("{}").alias("location"), F.array(F.lit(0)).cast("array<bigint>").alias("document_order"),
    )


def cell_units(table: DataFrame, sheet: str, row: str, columns: list[str], sheet_index: int = 0) -> DataFrame:
    """A table as a sheet: one cell unit for each row and column with a non-empty value."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("text")) for i, c in enumerate(columns, 1)))).alias("c")
    seq = ((F.col("row") - 1) * len(columns) + F.col("c.column")).cast("int")
    out = table.select(F.col(row).cast("int").alias("row"), cells).where("c.text is not null and c.text <> ''")
    where = F.concat(X.column_letters(F.col("c.column")), F.col("row"))
    return out.select(
        F.lit(f"{sheet}.xlsx").alias("path"), F.lit("xlsx").alias("file_type"), seq.alias("unit_seq"), F.lit("cell").alias("source_kind"), F.col("c.text").alias("text"), seq.cast("string").alias("unit_key"), F.lit(sheet).alias("part_key"),
        F.concat(F.lit(f"{sheet}#row:"), "row").alias("group_key"), "row", F.col("c.column").alias("column"), F.lit("body").alias("content_class"), F.lit(None).cast("string").alias("anchor"),
        F.concat(F.lit('{"cellAddress":"'), where, F.lit(f'","sheetIndex":{sheet_index},"sheetName":"{sheet}"}}')).alias("location"),
        F.array(F.lit(1), F.lit(sheet_index), F.col("row"), F.col("c.column"), F.lit(0), seq).cast("array<bigint>").alias("document_order"),
    )


__all__ = ["cell_units", "decode", "discover", "extract_files", "file_type", "line_units", "name_units", "pa", "read_contents", "select_paths", "split_lines", "within"]
