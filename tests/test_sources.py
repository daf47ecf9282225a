import io
import zipfile

from textloom import model
from textloom.plans.request import InputError, SearchRequest, distinct_terms, parse_batch, parse_conditions, without_nested
from textloom.sources import files, ooxml

RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
LINK = '<Relationship Id="{}" Type="http://x/{}" Target="{}"/>'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def xlsx():
    return package(
        {
            "_rels/.rels": RELS.format(LINK.format("a", "officeDocument", "xl/workbook.xml")),
            "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": RELS.format(LINK.format("r1", "worksheet", "worksheets/s1.xml") + LINK.format("r2", "sharedStrings", "strings.xml")),
            "xl/strings.xml": "<sst><si><t>alpha</t><rPh><t>skip</t></rPh></si></sst>",
            "xl/worksheets/s1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="b"><v>1</v></c><c r="C1" t="e"><v>#N/A</v></c></row>'
            '<row r="2" hidden="1"><c r="A2"><f>1+1</f><v>2</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>',
        }
    )


def test_workbook_cells_formulas_and_facts():
    units, sheets, issues = ooxml.extract(xlsx(), "xlsx", formulas=True)
    assert [(u["source_kind"], u["text"]) for u in units] == [("cell", "alpha"), ("cell", "TRUE"), ("formula", "=1+1"), ("cell", "2")]
    assert sheets[0]["merges"] == ["A1:B2"] and sheets[0]["hidden_rows"] == [[2, 2]] and not issues


def test_document_tables_count_empty_paragraphs():
    body = "<w:document xmlns:w='w'><w:body><w:p/><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>cell</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    units, _, _ = ooxml.extract(package({"_rels/.rels": RELS.format(LINK.format("a", "officeDocument", "word/document.xml")), "word/document.xml": body}), "docx")
    assert [u["location"] for u in units] == [{"paragraphNumber": 2}, {"tablePath": [{"table": 1, "row": 1, "column": 1}], "paragraphNumber": 1}]


def test_slides_in_order():
    slide = "<p:sld xmlns:p='p' xmlns:a='a'><p:sp><p:cNvPr name='Title'/><p:txBody><a:t>Hi</a:t></p:txBody></p:sp></p:sld>"
    parts = {
        "_rels/.rels": RELS.format(LINK.format("a", "officeDocument", "ppt/p.xml")),
        "ppt/p.xml": f"<presentation {R}><sldId id='256' r:id='r1'/></presentation>",
        "ppt/_rels/p.xml.rels": RELS.format(LINK.format("r1", "slide", "slides/s1.xml")),
        "ppt/slides/s1.xml": slide,
    }
    units, _, _ = ooxml.extract(package(parts), "pptx")
    assert units[0]["location"] == {"slideNumber": 1, "shapeName": "Title"}


def test_broken_packages_are_issues_and_names_still_units():
    units, _, issues = files.extracted_units("/a/b.docx", "docx", b"no zip", False, False)
    assert [u["text"] for u in units] == ["b.docx"] and issues[0][2] == "unreadable"


def test_decoding():
    assert files.decode("é".encode()) == "é" and files.decode("日本".encode("cp932")) == "日本"
    units, _, issues = files.extracted_units("/a.txt", "txt", b"\xef\xbb\xbf\xff", False, False)
    assert issues[0][2] == "unsupportedEncoding"


def test_lines():
    assert files.split_lines("a\r\nb\n") == ["a", "b"] and files.split_lines("") == [] and files.split_lines("\n") == [""]


def test_extensions():
    assert len(model.EXTENSIONS) == len(set(model.EXTENSIONS)) == 93
    assert files.file_type("A.TXT", ("txt",)) == "txt" and files.file_type("~$a.docx", ("docx",)) is None


def test_requests():
    assert without_nested(["/a/b", "/a", "/ab"]) == ["/a", "/ab"]
    assert [t.text for t in distinct_terms([" Foo ", "foo", "", "bar"], "all", 32, 128)] == ["Foo", "bar"]
    for bad in ({"mode": "conditions", "all": ["a"], "not": ["A"]}, {"mode": "conditions"}, {"mode": "conditions", "all": ["a"], "x": 1}):
        try:
            parse_conditions(bad)
            raise AssertionError
        except InputError as e:
            assert e.field == "querySpec"
    try:
        parse_batch({"mode": "batch", "matchMode": "identifier", "terms": ["a b"]})
        raise AssertionError
    except InputError:
        pass


def test_search_over_files(spark, tmp_path):
    from textloom.plans.run import events

    (tmp_path / "a.txt").write_text("alpha beta\nAlpha", encoding="utf-8")
    (tmp_path / "b.xlsx").write_bytes(xlsx())
    (tmp_path / "c.docx").write_bytes(b"broken")
    told = list(events(spark, SearchRequest(str(tmp_path), "alpha")))
    assert [e["sequence"] for e in told] == list(range(1, len(told) + 1))
    assert told[0]["type"] == "started" and told[-1]["type"] == "finished" and told[-1]["counts"]["results"] == 3
    assert [e["code"] for e in told if e["type"] == "issue"] == ["unreadable"]


def test_index_changes_nothing(spark, tmp_path):
    from textloom.plans.run import search_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("user_name\nuserName x\nother\nuzername", encoding="utf-8")
    request = SearchRequest(str(tmp_path / "in"), "username", fuzzy=True)
    key = lambda r: sorted((h.path, h.unit_seq, h.hit.kind, h.hit.start) for h in r.hits.collect())
    assert key(search_files(spark, request)) == key(search_files(spark, request, str(tmp_path / "index"))) != []
