"""Text functions that stay in the JVM: folding, words, lines, previews, addresses, escapes, labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import forms

WORD = r"\p{IsAlphabetic}\p{N}"
_HIRA = "".join(map(chr, range(0x3041, 0x3097)))
_KATA = "".join(map(chr, range(0x30A1, 0x30F7)))
#: Blocks of which characters can be plain: Latin, Greek, Cyrillic, punctuation, kana, common ideographs, Hangul, full width.
_BLOCKS = ((0x00, 0x24F), (0x370, 0x52F), (0x2010, 0x2064), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E))


def _usual(c: str) -> bool:
    """A character that folds to its lower case and nothing else, whatever stands beside it."""
    return c not in "\rΣς" and c.casefold() == c.lower() and len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and unicodedata.category(c) not in ("Mn", "Me", "Cn", "Cf")


def _ranges(kept=_usual) -> str:
    out: list[list[int]] = []
    for low, high in _BLOCKS:
        for i in range(low, high + 1):
            if kept(chr(i)):
                if out and out[-1][1] == i - 1:
                    out[-1][1] = i
                else:
                    out.append([i, i])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


#: A character that isn't plain: it folds to several, composes with a neighbour, or folds to another than its lower case. ASCII is told first.
UNUSUAL = rf"[[^\x00-\x0C\x0E-\x7F]&&[^{_ranges()}]]"


def _tokens_usual(c: str) -> bool:
    return _usual(c) and unicodedata.normalize("NFKC", c) == c


#: A character that width forms and tokens change to more than its lower case (but for ß, which is ss there).
UNTOKENED = rf"[[^\x00-\x0C\x0E-\x7F]&&[^\r{_ranges(_tokens_usual)}ß]]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain(c: Column | str) -> Column:
    """Whether the text is of plain characters only: then its folding is its lower case, character by character."""
    return ~col(c).rlike(UNUSUAL)


def _java(of: str, method: str, *args: Column) -> Column:
    return F.reflect(F.lit(of), F.lit(method), *args)


def composed(c: Column | str) -> Column:
    """NFC of a text that isn't null, by the Unicode library that Spark brings along."""
    return _java("com.ibm.icu.text.Normalizer", "compose", col(c), F.lit(False))


def fold(c: Column | str) -> Column:
    """Full case folding of the NFC form, as ``forms.base``; plain text takes the short way."""
    t = col(c)
    return F.when(plain(t), F.lower(t)).when(t.isNotNull(), _java("com.ibm.icu.lang.UCharacter", "foldCase", composed(t), F.lit(True)))


fold_text = forms.base


def width(c: Column | str) -> Column:
    """Full case folding of the NFKC form, as ``forms.width``."""
    t = col(c)
    wide = _java("com.ibm.icu.text.Normalizer", "compose", t, F.lit(True))
    return F.when(~t.rlike(UNTOKENED), F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))).when(t.isNotNull(), _java("com.ibm.icu.lang.UCharacter", "foldCase", wide, F.lit(True)))


def kana(c: Column | str) -> Column:
    """The width form with hiragana as katakana, as ``forms.kana``."""
    return F.translate(width(c), _HIRA, _KATA)


def loose(c: Column | str) -> Column:
    """The kana form without separators, as ``forms.loose``."""
    return F.regexp_replace(kana(c), r"[\p{IsWhite_Space}_\-./]", "")


def quoted(t: str) -> str:
    return "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def whole(t: str, word: str = WORD) -> str:
    """A pattern for ``t`` where no letter or number adjoins it (an underscore may). The literal comes first, which is quick to look for."""
    return f"{quoted(t)}(?<![{word}]{quoted(t)})(?![{word}])"


def identifier(t: str) -> str:
    """A pattern for ``t`` where no letter, number or underscore adjoins it."""
    return whole(t, WORD + "_")


def at(c: Column, pattern: str) -> Column:
    """Characters before the first match, in plain text."""
    return F.regexp_instr(c, F.lit(pattern)) - 1


def overlaps(t: str) -> bool:
    """Whether occurrences of a term can overlap such that one that isn't whole hides one that is."""
    return not all(map(forms.alphanumeric, t)) and any(t.startswith(t[i:]) for i in range(1, len(t)))


def held(text: Column, base: Column, usual: Column, term: str) -> Column:
    """Whether a standard search finds the term: in the folded text, or as a whole in the text as it stands."""
    return base.contains(fold_text(term)) | (~usual & text.contains(term) & text.rlike(whole(term)))


def standard_kind(text: Column, base: Column, term: str) -> Column:
    """``exact``, ``caseFolded`` or ``substring``, for plain text that holds the term."""
    return F.when(text.contains(term) & text.rlike(whole(term)), "exact").when(base.rlike(whole(fold_text(term))), "caseFolded").otherwise("substring")


def standard_start(text: Column, base: Column, term: str, kind: Column) -> Column:
    folded = fold_text(term)
    return F.when(kind == "exact", at(text, whole(term))).when(kind == "caseFolded", at(base, whole(folded))).otherwise(F.locate(folded, base) - 1)


def lines(c: Column | str) -> Column:
    """Lines without their ends; empty text has none, a final line break begins no further one."""
    t = col(c)
    whole_ = F.when(t.endswith("\n"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    bare = F.when(t.contains("\r"), F.regexp_replace(whole_, r"\r+(?=\n|\z)", "")).otherwise(whole_)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(bare, "\n", -1))


def grams(c: Column | str, n: int) -> Column:
    """Distinct runs of ``n`` characters: those that begin at each remainder of ``n``, cut out by one pattern each."""
    t = col(c)
    return F.array_distinct(F.concat(*(F.regexp_extract_all(F.substring(t, F.lit(i + 1), F.length(t)), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for i in range(n))))


def tokens(c: Column | str) -> Column:
    """Identifier tokens of ASCII text, folded: words cut at case changes and between digits and letters."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[A-Z])"), 1), F.lower)


#: Stands between tokens, as it is in none.
JOINT = "\x1f"
_LETTER = rf"[[{WORD}]&&[^0-9]]"
_TOKEN = rf"[0-9]+|(?={_LETTER})(?:(?![a-z][A-Z]|[A-Z][A-Z][a-z]){_LETTER})*+{_LETTER}?"


def joined_tokens(c: Column | str) -> Column:
    """Identifier tokens of a text without ``UNTOKENED`` characters, folded, as ``forms.tokens``, with ``JOINT`` between."""
    return F.replace(F.lower(F.array_join(F.regexp_extract_all(col(c), F.lit(_TOKEN), F.lit(0)), JOINT)), F.lit("ß"), F.lit("ss"))


def tokens_of_scripts(c: Column | str) -> Column:
    """The same as an array."""
    return F.filter(F.split(joined_tokens(c), JOINT), lambda t: t != "")


def preview(text: Column | str, start: Column, end: Column) -> Column:
    """``struct<text, truncated, start, end>``: texts of over 240 characters are cut around the match."""
    t = col(text)
    n = F.length(t)
    a = F.least(F.greatest(start - 60, F.lit(0)), n)
    b = F.least(a + F.greatest(F.lit(180), end - a + 60), n)
    before, after = F.when(a > 0, "… ").otherwise(""), F.when(b < n, " …").otherwise("")
    part = F.concat(before, F.substring(t, a + 1, b - a), after)
    return F.when(n <= 240, F.struct(t.alias("text"), F.lit(False).alias("truncated"), start.alias("start"), end.alias("end"))).otherwise(
        F.struct(part.alias("text"), F.lit(True).alias("truncated"), (start - a + F.length(before)).alias("start"), (end - a + F.length(before)).alias("end"))
    )


def clip(text: Column | str, n: int = 300) -> Column:
    t = col(text)
    return F.struct(F.substring(t, 1, n).alias("text"), (F.length(t) > n).alias("truncated"))


def safe_cell(c: Column | str) -> Column:
    """An apostrophe before what a spreadsheet would take for a formula."""
    t = col(c)
    return F.when(t.rlike(r"^[\p{IsWhite_Space}\p{Cc}]*[=+\-@]"), F.concat(F.lit("'"), t)).otherwise(t)


def csv_cell(c: Column | str) -> Column:
    t = safe_cell(c)
    return F.when(t.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def tsv_cell(c: Column | str) -> Column:
    t = safe_cell(c)
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def column_number(letters: Column | str) -> Column:
    """A=1 … XFD=16384; null for anything else."""
    t = col(letters)
    n = F.aggregate(F.split(t, ""), F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise(acc * 26 + F.ascii(x) - 64))
    return F.when(t.rlike("^[A-Z]{1,3}$") & (n <= 16384), n)


def column_letters(n: Column | str) -> Column:
    t = col(n)
    low, mid = (t - 1) % 26, F.floor((t - 27) / 26) % 26
    high = F.floor((t - 703) / 676)
    letter = lambda x: F.chr(x + 65)
    return F.concat(F.when(t > 702, letter(high)).otherwise(""), F.when(t > 26, letter(mid)).otherwise(""), letter(low))


def address_parts(c: Column | str) -> Column:
    """``struct<row, column>`` (``long``, ``int``) of an upper-case A1 address whose column is in a sheet, its row any number of up to 18 digits; else null."""
    t = col(c)
    shape = r"^([A-Z]{1,3})([1-9][0-9]{0,17})$"
    row, column = F.regexp_extract(t, shape, 2), column_number(F.regexp_extract(t, shape, 1))
    return F.when((row != "") & column.isNotNull(), F.struct(F.when(row != "", row.cast("long")).alias("row"), column.alias("column")))


def address(c: Column | str) -> Column:
    """``struct<row, column>`` of an upper-case A1 address inside a sheet, else null."""
    parts = address_parts(c)
    return F.when(parts["row"] <= 1_048_576, F.struct(parts["row"].cast("int").alias("row"), parts["column"].alias("column")))


# Labels of reports.
SOURCE_LABELS = {
    "fileName": "ファイル名", "cell": "セル", "formula": "Excel数式文字列", "note": "PowerPointノート", "excelComment": "Excelコメント",
    "wordHeader": "Wordヘッダー", "wordFooter": "Wordフッター", "wordComment": "Wordコメント", "excelRow": "Excelの行", "fileMatch": "ファイル全体",
    "shape": "図形", "slideTableCell": "スライド表のセル", "paragraph": "本文段落", "wordTableParagraph": "Word表内の段落", "textLine": "テキスト行",
}
CONTENT_LABELS = {"body": "本文", "fileName": "ファイル名", "note": "注記", "formula": "数式文字列"}
MATCH_LABELS = {"exact": "完全一致", "caseFolded": "表記揺れ", "normalized": "表記揺れ", "separatorVariant": "表記揺れ", "kanaVariant": "表記揺れ", "identifier": "識別子一致", "prefix": "前方一致", "substring": "部分一致", "editDistance": "タイプミス候補"}
CATEGORY_LABELS = {"standard": "一致検索", "fuzzy": "あいまい検索"}


def label(c: Column | str, labels: dict[str, str]) -> Column:
    """The label, or the value itself where there is none."""
    t = col(c)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), t), t)


def location_text(kind: Column | str, location: Column | str) -> Column:
    """Display text of a location (JSON)."""
    k, j = col(kind), col(location)
    s = lambda key: F.coalesce(F.get_json_object(j, f"$.{key}"), F.lit(""))
    n = lambda key: F.coalesce(F.get_json_object(j, f"$.{key}"), F.lit("0"))
    cell = F.concat(s("sheetName"), F.lit("!"), s("cellAddress"))
    shared = F.get_json_object(j, "$.sharedIndex")
    has = lambda key: F.get_json_object(j, f"$.{key}").isNotNull()
    path = F.from_json(F.get_json_object(j, "$.tablePath"), "array<struct<table:int,row:int,column:int>>")
    places = F.array_join(F.transform(path, lambda x: F.format_string("表 %d / 行 %d / 列 %d", x["table"], x["row"], x["column"])), " / ")
    in_table = F.concat(places, F.lit(" / 段落 "), n("paragraphNumber"))
    note = lambda name, key: F.concat(F.lit(f"{name} "), s("partName"), F.lit(" "), s(key), F.lit(" / "), F.when(has("tablePath"), in_table).otherwise(F.concat(F.lit("段落 "), n("paragraphNumber"))))
    return (
        F.when(k == "fileName", "ファイル名")
        .when(k == "cell", cell)
        .when(k == "formula", F.concat(cell, F.lit(" / 数式"), F.when(shared.isNotNull(), F.concat(F.lit("（共有式 "), shared, F.lit("）"))).otherwise("")))
        .when(k == "excelComment", F.concat(cell, F.lit(" / コメント "), s("commentId")))
        .when(k == "note", F.concat(F.lit("スライド "), n("slideNumber"), F.lit(" / ノート "), s("shapeName"), F.lit(" / 段落 "), n("paragraphNumber")))
        .when(k == "wordHeader", note("ヘッダー", "sectionType"))
        .when(k == "wordFooter", note("フッター", "sectionType"))
        .when(k == "wordComment", note("コメント", "commentId"))
        .when(k == "excelRow", F.concat(s("sheetName"), F.lit(" / 行 "), n("row")))
        .when(k == "fileMatch", "ファイル全体")
        .when((k == "shape") & has("slideNumber"), F.concat(F.lit("スライド "), n("slideNumber"), F.lit(" / "), s("shapeName")))
        .when(k == "shape", F.concat(s("sheetName"), F.lit(" / "), s("shapeName"), F.when(has("anchor"), F.concat(F.lit(" ("), s("anchor"), F.lit(")"))).otherwise("")))
        .when(k == "slideTableCell", F.concat(F.lit("スライド "), n("slideNumber"), F.lit(" / "), s("tableName"), F.lit(" / 行 "), n("row"), F.lit(" / 列 "), n("column")))
        .when(k == "paragraph", F.concat(F.lit("本文 段落 "), n("paragraphNumber")))
        .when(k == "wordTableParagraph", in_table)
        .when(k == "textLine", F.concat(F.lit("行 "), n("lineNumber")))
        .otherwise("場所不明")
    )
