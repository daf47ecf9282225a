"""Office packages (xlsx, xlsm, pptx, docx) as typed text units: standard-library ZIP and XML only, run inside Arrow batches."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from posixpath import dirname
from xml.etree import ElementTree

from textloom import model

_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_A1 = re.compile(r"([A-Z]{1,3})([1-9][0-9]{0,6})\Z")


class Unreadable(Exception):
    def __init__(self, reason: str, code: str = "unreadable"):
        super().__init__(reason)
        self.code, self.reason = code, reason


def name(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def every(node, *names: str) -> Iterator:
    return (x for x in node.iter() if name(x) in names)


def child(node, tag: str):
    return next((x for x in node if name(x) == tag), None) if node is not None else None


def attr(node, key: str) -> str | None:
    if key == "id" and _RELATION in node.attrib:
        return node.attrib[_RELATION]
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == key), None)


def joined(node, tag: str) -> str:
    """The texts of all ``tag`` elements below, run together."""
    return "".join(x.text or "" for x in every(node, tag))


def visible(node) -> str:
    """A spreadsheet string without its phonetic runs."""
    if name(node) in ("rPh", "phoneticPr"):
        return ""
    return (node.text or "") if name(node) == "t" else "".join(visible(x) for x in node)


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def address(text: str | None) -> tuple[int, int] | None:
    """Row and column of an upper-case A1 address inside a sheet."""
    m = _A1.match(text or "")
    if not m:
        return None
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return (int(m[2]), column) if int(m[2]) <= model.MAX_ROW and column <= model.MAX_COLUMN else None


def inside(base: str, target: str) -> str:
    """The part that a relationship target names; it may not leave the package."""
    if ":" in target or target.startswith("//") or "\\" in target:
        raise Unreadable("an external or malformed target")
    steps = [] if target.startswith("/") else [x for x in dirname(base).split("/") if x]
    for step in target.split("/"):
        if step == "..":
            if not steps:
                raise Unreadable("a target outside the package")
            steps.pop()
        elif step not in ("", "."):
            steps.append(step)
    return "/".join(steps)


class Package:
    """The XML parts of one file; a part that can't be read fails when it is asked for."""

    def __init__(self, content: bytes):
        if len(content) > model.MAX_PACKAGE_BYTES:
            raise Unreadable("the file is too large", "resourceLimit")
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            raise Unreadable("not a ZIP package") from e
        with archive:
            infos = archive.infolist()
            if len(infos) > model.MAX_PARTS:
                raise Unreadable("too many parts", "resourceLimit")
            self.parts: dict[str, bytes | Unreadable] = {}
            total = 0
            for info in infos:
                if info.flag_bits & 1:
                    raise Unreadable("the package is encrypted", "encrypted")
                if not info.filename.endswith((".xml", ".rels", ".vml")):
                    continue
                if info.filename.startswith("/") or "../" in info.filename or "\\" in info.filename:
                    raise Unreadable("a malformed part name")
                if info.filename in self.parts:
                    raise Unreadable("a part occurs twice")
                total += info.file_size
                if total > model.MAX_PACKAGE_BYTES:
                    raise Unreadable("the package unpacks to too much", "resourceLimit")
                self.parts[info.filename] = self._read(archive, info)
        self._trees: dict = {}

    @staticmethod
    def _read(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes | Unreadable:
        if info.file_size > model.MAX_PART_BYTES:
            return Unreadable("the part is too large", "resourceLimit")
        try:
            with archive.open(info) as f:
                data = f.read(model.MAX_PART_BYTES + 1)
            data.decode("utf-8")
        except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError) as e:
            return Unreadable(f"the part can't be decoded: {e}")
        return data if len(data) <= model.MAX_PART_BYTES else Unreadable("the part is too large", "resourceLimit")

    def tree(self, part: str):
        if part not in self._trees:
            data = self.parts.get(part, Unreadable(f"part {part} is missing"))
            if isinstance(data, Unreadable):
                raise data
            if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
                raise Unreadable(f"part {part} declares a document type")
            try:
                self._trees[part] = ElementTree.fromstring(data)
            except ElementTree.ParseError as e:
                raise Unreadable(f"part {part} isn't XML") from e
        return self._trees[part]

    @staticmethod
    def rels(part: str) -> str:
        folder, _, file = part.rpartition("/")
        return f"{folder}/_rels/{file}.rels" if folder else f"_rels/{file}.rels"

    def links(self, part: str, *kinds: str) -> dict[str, tuple[str, str]]:
        """Relationship id → (part, kind); external ones are left out."""
        if self.rels(part) not in self.parts:
            return {}
        out = {}
        for r in every(self.tree(self.rels(part)), "Relationship"):
            kind = (attr(r, "Type") or "").rpartition("/")[2]
            if attr(r, "TargetMode") == "External" or kinds and kind not in kinds or attr(r, "Id") is None or attr(r, "Target") is None:
                continue
            out[attr(r, "Id")] = (inside(part, attr(r, "Target")), kind)
        return out

    def main(self, root: str) -> str:
        for part, kind in self.links("").values():
            if kind == "officeDocument" and name(self.tree(part)) == root:
                return part
        raise Unreadable("no main document part")

    def notes(self, part: str, kinds: tuple[str, ...], issues: list, wanted: str | None = None) -> list[str]:
        """Parts of annotations; whatever is wrong with them becomes an issue, the body stays."""
        rels = self.rels(part)
        try:
            if rels not in self.parts:
                if wanted is not None:
                    raise Unreadable("the annotation's relationships are missing")
                return []
            tree = self.tree(rels)
        except Unreadable as e:
            issue(issues, rels, e)
            return []
        out, met = [], False
        for r in every(tree, "Relationship"):
            if wanted is not None and attr(r, "Id") != wanted or (attr(r, "Type") or "").rpartition("/")[2] not in kinds:
                continue
            met, target = True, attr(r, "Target") or ""
            try:
                if attr(r, "TargetMode") == "External" or not target:
                    raise Unreadable(f"an external or empty annotation target: {target}")
                found = inside(part, target)
                if found not in out:
                    out.append(found)
            except Unreadable as e:
                issue(issues, rels, e)
        if wanted is not None and not met:
            issue(issues, rels, Unreadable("no part has the annotation's id"))
        return out


def issue(issues: list, part: str, error: Unreadable) -> None:
    """One issue for each code and message of a document."""
    found = (error.code, f"annotation part {part}: {error.reason}")
    if found not in issues:
        issues.append(found)


def unit(kind: str, text: str, part: str, location: dict, content: str = "body", row: int | None = None, column: int | None = None, anchor: str | None = None) -> dict:
    return {"source_kind": kind, "text": text, "part_key": part, "location": location, "content_class": content, "row": row, "column": column, "anchor": anchor}


def named(shape, index: int, word: str) -> str:
    mark = next(every(shape, "cNvPr"), None)
    return (attr(mark, "name") if mark is not None else None) or f"{word} {index + 1}"


def number(text: str | None) -> int | None:
    return int(text) if text and text.strip().isascii() and text.strip().isdigit() else None


def workbook(package: Package, formulas: bool, notes: bool) -> tuple[list[dict], list[dict], list]:
    book = package.main("workbook")
    links = package.links(book)
    strings: list[str] = []
    if shared := next((p for p, k in links.values() if k == "sharedStrings"), None):
        strings = [visible(x) for x in every(package.tree(shared), "si")]
    units, sheets, issues, seen = [], [], [], set()
    for index, sheet in enumerate(every(package.tree(book), "sheet")):
        title = attr(sheet, "name") or "(名称なし)"
        part, kind = links.get(attr(sheet, "id") or "", ("", ""))
        if kind != "worksheet":
            raise Unreadable("a sheet's part is missing")
        tree, first = package.tree(part), len(units)
        sheets.append(sheet_facts(tree, part, title) | {"layout": layout(package, links, tree)})
        for cell in every(tree, "c"):
            units += cell_units(cell, part, title, strings, formulas)
        commented = set()
        for p in package.notes(part, ("comments", "threadedComment"), issues) if notes else ():
            if p not in seen:
                seen.add(p)
                try:
                    found = comments(package.tree(p), p, title)
                    commented |= {u["location"].get("cellAddress") for u in found}
                    units += found
                except Unreadable as e:
                    issue(issues, p, e)
        drawings = list(every(tree, "drawing", "legacyDrawing"))
        targets = package.links(part, "drawing", "vmlDrawing") if drawings else {}
        for d in drawings:
            if (attr(d, "id") or "") in targets:
                p = targets[attr(d, "id")][0]
                units += vml(package.tree(p), p, title, commented) if name(d) == "legacyDrawing" else drawing(package.tree(p), p, title)
        for u in units[first:]:
            u["location"]["sheetIndex"] = index
    return units, sheets, issues


def cell_units(cell, part: str, sheet: str, strings: list[str], formulas: bool) -> Iterator[dict]:
    where = attr(cell, "r")
    if not where:
        return
    row, column = address(where) or (None, None)
    formula = child(cell, "f")
    shared = {"sharedIndex": attr(formula, "si")} if formula is not None and attr(formula, "si") is not None else {}
    if formulas and formula is not None and formula.text:
        more = {"formulaType": attr(formula, "t") or "normal"} | shared | ({"formulaRange": attr(formula, "ref")} if attr(formula, "ref") else {})
        yield unit("formula", f"={formula.text}", part, {"sheetName": sheet, "cellAddress": where} | more, "formula", row, column)
    kind = attr(cell, "t") or "n"
    held = child(cell, "is") if kind == "inlineStr" else child(cell, "v")
    value = "" if held is None else visible(held) if kind == "inlineStr" else held.text or ""
    if not value or kind == "e":
        return
    if kind == "s":
        if number(value) is None or number(value) >= len(strings):
            raise Unreadable("a shared string is missing")
        value = strings[number(value)]
    elif kind == "b":
        value = "TRUE" if value == "1" else "FALSE"
    yield unit("cell", value, part, {"sheetName": sheet, "cellAddress": where} | shared, "body", row, column)


def spans(numbers: list[tuple[int, int]]) -> list[list[int]]:
    return [[a, b] for a, b in numbers]


def sheet_facts(tree, part: str, title: str) -> dict:
    merges = []
    for m in every(tree, "mergeCell"):
        a, _, b = (attr(m, "ref") or "").partition(":")
        if (p := address(a)) and (q := address(b)) and p[0] <= q[0] and p[1] <= q[1]:
            merges.append(f"{a}:{b}")
    hidden = lambda x: attr(x, "hidden") in ("1", "true")
    rows = [(n, n) for r in every(tree, "row") if hidden(r) and (n := number(attr(r, "r"))) and n <= model.MAX_ROW]
    columns = [(a, b) for c in every(tree, "col") if hidden(c) and (a := number(attr(c, "min"))) and (b := number(attr(c, "max"))) and a <= b <= model.MAX_COLUMN]
    return {"part_key": part, "sheet_name": title, "merges": merges, "hidden_rows": spans(rows), "hidden_columns": spans(columns)}


def positive(text: str | None) -> float | None:
    try:
        value = float(text or "")
    except ValueError:
        return None
    return value if 0 < value < float("inf") else None


def layout(package: Package, links: dict, tree) -> dict:
    """Stored formats: the style table, row heights and styles, column widths and styles, cell styles."""
    styles: list[dict] = []
    notes: list[str] = []
    part = next((p for p, k in links.values() if k == "styles"), None)
    try:
        root = package.tree(part) if part else None
    except Unreadable:
        root = None
    if root is None:
        notes.append("no stored cell formats")
    else:
        table = lambda tag: list(child(root, tag)) if child(root, tag) is not None else []
        fonts, fills, bases = table("fonts"), table("fills"), table("cellStyleXfs")
        for xf in table("cellXfs"):
            n = number(attr(xf, "xfId"))
            low = bases[n] if n is not None and n < len(bases) else None

            def ref(key: str, apply: str, xf=xf, low=low) -> int:
                own = None if attr(xf, apply) == "0" else attr(xf, key)
                return number(own if own is not None else (attr(low, key) if low is not None else None)) or 0

            font = fonts[ref("fontId", "applyFont")] if ref("fontId", "applyFont") < len(fonts) else None
            fill = fills[ref("fillId", "applyFill")] if ref("fillId", "applyFill") < len(fills) else None
            color = next((c for c in every(fill, "fgColor")), None) if fill is not None else None
            ink = child(font, "color")
            size = child(font, "sz")
            styles.append(
                {
                    "bold": child(font, "b") is not None,
                    "italic": child(font, "i") is not None,
                    "size": positive(attr(size, "val")) if size is not None else None,
                    "color": rgb(attr(ink, "rgb")) if ink is not None else None,
                    "fill": rgb(attr(color, "rgb")) if color is not None else None,
                    "numFmtId": ref("numFmtId", "applyNumberFormat"),
                }
            )
    if next(every(tree, "conditionalFormatting"), None) is not None:
        notes.append("conditional formats aren't computed")
    form = next(every(tree, "sheetFormatPr"), None)
    rows = [{"row": n, "height": positive(attr(r, "ht")), "style": number(attr(r, "s"))} for r in every(tree, "row") if (n := number(attr(r, "r"))) and n <= model.MAX_ROW]
    columns = [{"first": a, "last": b, "width": positive(attr(c, "width")), "style": number(attr(c, "style"))} for c in every(tree, "col") if (a := number(attr(c, "min"))) and (b := number(attr(c, "max"))) and a <= b <= model.MAX_COLUMN]
    cells = [{"row": p[0], "column": p[1], "style": number(attr(c, "s"))} for c in every(tree, "c") if (p := address(attr(c, "r"))) and attr(c, "s") is not None]
    default = {"rowHeight": positive(attr(form, "defaultRowHeight")), "columnWidth": positive(attr(form, "defaultColWidth"))} if form is not None else {}
    return {"styles": styles, "rows": rows, "columns": columns, "cells": cells, "default": default, "notes": notes}


def rgb(text: str | None) -> str | None:
    """``#rrggbb`` of an (alpha and) colour in hexadecimal."""
    return f"#{text[-6:].lower()}" if text and re.fullmatch(r"(?:[0-9A-Fa-f]{2})?[0-9A-Fa-f]{6}", text) else None


def comments(tree, part: str, sheet: str) -> list[dict]:
    """Legacy and threaded comments; a reply without an address has its parent's."""
    if name(tree) not in ("comments", "ThreadedComments"):
        raise Unreadable("not a comment part")
    nodes = list(every(tree, "comment", "threadedComment"))
    parents = {attr(n, "id"): attr(n, "parentId") for n in nodes if attr(n, "id")}
    at = {attr(n, "id"): attr(n, "ref") for n in nodes if attr(n, "id") and attr(n, "ref")}

    def where(node) -> str | None:
        key = attr(node, "id")
        if attr(node, "ref") or key is None:
            return attr(node, "ref")
        for _ in range(model.MAX_REPLY_DEPTH + 1):
            if key is None or key in at:
                return at.get(key)
            key = parents.get(key)
        return None

    out = []
    for i, n in enumerate(nodes):
        threaded = name(n) == "threadedComment"
        text = "".join(child(n, "text").itertext()) if threaded and child(n, "text") is not None else "" if threaded else joined(n, "t")
        if text:
            place = where(n)
            row, column = address(place) or (None, None)
            location = {"sheetName": sheet, "commentId": attr(n, "id") or str(i + 1), "commentType": "threaded" if threaded else "legacy", "partName": part}
            out.append(unit("excelComment", text, part, location | ({"cellAddress": place} if place else {}), "note", row, column))
    return out


def place_of(row: int | None, column: int | None) -> str | None:
    """A1 address of a row and column counted from 0."""
    return f"{letters(column + 1)}{row + 1}" if row is not None and column is not None and row < model.MAX_ROW and column < model.MAX_COLUMN else None


def drawing(tree, part: str, sheet: str) -> Iterator[dict]:
    for holder in every(tree, "twoCellAnchor", "oneCellAnchor", "absoluteAnchor"):
        start = child(holder, "from")
        text = lambda tag, start=start: number(child(start, tag).text) if start is not None and child(start, tag) is not None else None
        anchor = place_of(text("row"), text("col"))
        for i, shape in enumerate(every(holder, "sp")):
            body = child(shape, "txBody")
            if body is not None and (t := joined(body, "t")):
                yield unit("shape", t, part, {"sheetName": sheet, "shapeName": named(shape, i, "図形")} | ({"anchor": anchor} if anchor else {}), anchor=anchor)


def vml(tree, part: str, sheet: str, commented: set) -> Iterator[dict]:
    """Legacy shapes; a note's shape is left out where its cell has a comment."""
    for i, shape in enumerate(every(tree, "shape")):
        box = next(every(shape, "textbox"), None)
        t = "".join(box.itertext()) if box is not None else ""
        if not t:
            continue
        spot = lambda tag, shape=shape: number(next((x.text for x in every(shape, tag)), None))
        anchor = place_of(spot("Row"), spot("Column"))
        if anchor in commented and any(attr(x, "ObjectType") == "Note" for x in every(shape, "ClientData")):
            continue
        yield unit("shape", t, part, {"sheetName": sheet, "shapeName": attr(shape, "id") or f"図形 {i + 1}"} | ({"anchor": anchor} if anchor else {}), anchor=anchor)


def slides(package: Package, notes: bool) -> tuple[list[dict], list[dict], list]:
    show = package.main("presentation")
    links, units, issues, seen = package.links(show), [], [], set()
    for n, slide in enumerate(every(package.tree(show), "sldId"), 1):
        part, kind = links.get(attr(slide, "id") or "", ("", ""))
        if kind != "slide":
            raise Unreadable("a slide's part is missing")
        tree = package.tree(part)
        for i, shape in enumerate(every(tree, "sp")):
            body = child(shape, "txBody")
            if body is not None and (t := joined(body, "t")):
                units.append(unit("shape", t, part, {"slideNumber": n, "shapeName": named(shape, i, "図形")}))
        for i, frame in enumerate(every(tree, "graphicFrame")):
            table = next(every(frame, "tbl"), None)
            for r, tr in enumerate([x for x in table if name(x) == "tr"] if table is not None else [], 1):
                for c, tc in enumerate([x for x in tr if name(x) == "tc"], 1):
                    if t := joined(tc, "t"):
                        units.append(unit("slideTableCell", t, part, {"slideNumber": n, "tableName": named(frame, i, "表"), "row": r, "column": c}))
        for p in package.notes(part, ("notesSlide",), issues) if notes else ():
            if p not in seen:
                seen.add(p)
                try:
                    units += slide_notes(package.tree(p), p, n)
                except Unreadable as e:
                    issue(issues, p, e)
    return units, [], issues


def slide_notes(tree, part: str, slide: int) -> Iterator[dict]:
    if name(tree) != "notes":
        raise Unreadable("not a notes part")
    for i, shape in enumerate(every(tree, "sp")):
        holder, body, mark = next(every(shape, "ph"), None), child(shape, "txBody"), next(every(shape, "cNvPr"), None)
        if holder is not None and attr(holder, "type") in ("dt", "ftr", "hdr", "sldNum", "sldImg") or body is None:
            continue
        title = (attr(mark, "name") if mark is not None else None) or "ノート"
        key = (attr(mark, "id") if mark is not None else None) or str(i + 1)
        for k, p in enumerate([x for x in body if name(x) == "p"], 1):
            if t := joined(p, "t"):
                yield unit("note", t, part, {"slideNumber": slide, "shapeName": title, "shapeId": key, "paragraphNumber": k, "partName": part}, "note")


def document(package: Package, notes: bool) -> tuple[list[dict], list[dict], list]:
    part = package.main("document")
    tree = package.tree(part)
    body = next(every(tree, "body"), None)
    if body is None:
        raise Unreadable("no body")
    units, issues, seen = list(paragraphs(body, part, [])), [], set()
    if notes:
        wanted: list[tuple[str, str, str]] = []
        for r in every(tree, "headerReference", "footerReference"):
            kind = name(r).removesuffix("Reference")
            if attr(r, "id") is None:
                issue(issues, part, Unreadable("a header or footer without an id"))
                continue
            wanted += [(p, kind, attr(r, "type") or "default") for p in package.notes(part, (kind,), issues, attr(r, "id"))]
        wanted += [(p, "comment", "") for p in package.notes(part, ("comments",), issues)]
        for p, kind, section in wanted:
            if p not in seen:
                seen.add(p)
                try:
                    units += annotation(package.tree(p), p, kind, section)
                except Unreadable as e:
                    issue(issues, p, e)
    return units, [], issues


def paragraphs(holder, part: str, path: list[dict]) -> Iterator[dict]:
    """Paragraphs of a body or table cell in order; empty ones count but give no unit."""
    n = tables = 0
    for x in holder:
        if name(x) == "p":
            n += 1
            if t := joined(x, "t"):
                yield unit("wordTableParagraph" if path else "paragraph", t, part, ({"tablePath": path} if path else {}) | {"paragraphNumber": n})
        elif name(x) == "tbl":
            if len(path) >= model.MAX_TABLE_DEPTH:
                raise Unreadable("tables are nested too deep", "resourceLimit")
            tables += 1
            for r, tr in enumerate([y for y in x if name(y) == "tr"], 1):
                for c, tc in enumerate([y for y in tr if name(y) == "tc"], 1):
                    yield from paragraphs(tc, part, [*path, {"table": tables, "row": r, "column": c}])


def annotation(tree, part: str, kind: str, section: str) -> list[dict]:
    if name(tree) != {"header": "hdr", "footer": "ftr", "comment": "comments"}[kind]:
        raise Unreadable("not an annotation part")
    out = []
    for i, holder in enumerate(every(tree, "comment") if kind == "comment" else [tree], 1):
        for u in paragraphs(holder, part, []):
            more = {"commentId": attr(holder, "id") or str(i)} if kind == "comment" else {"sectionType": section}
            out.append(u | {"source_kind": "word" + kind.title(), "content_class": "note", "location": u["location"] | {"partName": part} | more})
    return out


def extract(content: bytes, file_type: str, formulas: bool = False, notes: bool = False) -> tuple[list[dict], list[dict], list[tuple[str, str]]]:
    """Units, sheets and issues of one file; ``Unreadable`` if there is no body to be had."""
    package = Package(content)
    if file_type in ("xlsx", "xlsm"):
        return workbook(package, formulas, notes)
    return slides(package, notes) if file_type == "pptx" else document(package, notes)


def canonical(location: dict) -> str:
    return json.dumps(location, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
