"""Matching of one term against one text: kind, category, score and source range."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import forms
from textloom.functions.forms import Folded, alphanumeric
from textloom.model import MATCH, SCORES


@dataclass(frozen=True)
class Term:
    """A search term with the forms that the rules need."""

    raw: str
    base: str = field(init=False)
    width: str = field(init=False)
    kana: str = field(init=False)
    loose: str = field(init=False)
    tokens: tuple[str, ...] = field(init=False)
    typo: str | None = field(init=False)
    numeric: bool = field(init=False)
    allow_loose: bool = field(init=False)

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        raw = forms.trim(self.raw)
        put("raw", raw)
        for form in ("base", "width", "kana"):
            put(form, forms.FORMS[form](raw))
        put("tokens", tuple(forms.tokens(raw)))
        one = self.tokens[0] if len(self.tokens) == 1 else ""
        put("typo", one if len(one) >= 6 and one.isascii() and one.isalpha() else None)
        put("numeric", all("0" <= c <= "9" or forms.separator(c) for c in raw))
        put("loose", self.kana if self.numeric else forms.loose(raw))
        put("allow_loose", not self.numeric and len(self.loose) >= 3)

    @property
    def edits(self) -> int:
        return 2 if len(self.typo or "") >= 11 else 1


class Text:
    """A text whose forms are made once, whatever the number of terms."""

    def __init__(self, text: str):
        self.text = text
        self._forms: dict[str, Folded] = {}
        self._plain: dict[str, str] = {}
        self._tokens: list[tuple[str, int, int]] | None = None

    def form(self, name: str) -> Folded:
        if name not in self._forms:
            self._forms[name] = Folded(self.text, name)
        return self._forms[name]

    def holds(self, form: str, needle: str) -> bool:
        """Whether the form holds the needle, before the form's source ranges are made."""
        if form not in self._plain:
            self._plain[form] = forms.FORMS[form](self.text)
        return needle in self._plain[form]

    def tokens(self) -> list[tuple[str, int, int]]:
        if self._tokens is None:
            self._tokens = forms.spans_of_tokens(self.text)
        return self._tokens

    def first(self, form: str, needle: str) -> tuple[int, int] | None:
        if not self.holds(form, needle):
            return None
        folded = self.form(form)
        return next((folded.range(at, len(needle)) for at in folded.places(needle)), None)

    def whole(self, form: str, needle: str) -> tuple[int, int] | None:
        """The first occurrence that no alphanumeric adjoins in the source."""
        if not self.holds(form, needle):
            return None
        folded, t = self.form(form), self.text
        for at in folded.places(needle):
            a, b = folded.range(at, len(needle))
            if not (a and alphanumeric(t[a - 1])) and not (b < len(t) and alphanumeric(t[b])):
                return a, b
        return None

    def identifier(self, needle: str) -> tuple[int, int] | None:
        """The first occurrence that no alphanumeric and no underscore adjoins in the folded text."""
        folded = self.form("base")
        inside = lambda c: c == "_" or alphanumeric(c)
        for at in folded.places(needle):
            end = at + len(needle)
            if not (at and inside(folded.value[at - 1])) and not (end < len(folded.value) and inside(folded.value[end])):
                return folded.range(at, len(needle))
        return None


def found(kind: str, span: tuple[int, int], category: str) -> dict:
    return {"kind": kind, "category": category, "score": SCORES[kind], "start": span[0], "end": span[1]}


def standard(text: Text, term: Term) -> dict | None:
    for kind, span in (("exact", text.whole("raw", term.raw)), ("caseFolded", text.whole("base", term.base)), ("substring", text.first("base", term.base))):
        if span:
            return found(kind, span, "standard")
    return None


def bounded_distance(a: str, b: str, most: int) -> int | None:
    """Edit distance, None above ``most``; only the diagonal band that can stay within it is filled."""
    if abs(len(a) - len(b)) > most:
        return None
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, c in enumerate(a, 1):
        now: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, most + 1) + 1
            if j:
                best = min(best, now.get(j - 1, most + 1) + 1, row.get(j - 1, most + 1) + (c != b[j - 1]))
            now[j] = best
        if min(now.values()) > most:
            return None
        row = now
    return row[len(b)] if row.get(len(b), most + 1) <= most else None


def fuzzy(text: Text, term: Term) -> dict | None:
    """The first rule that fits, in this order: whole occurrences in five forms, tokens, part of a word, typing error."""
    for form, kind in (("raw", "exact"), ("base", "caseFolded"), ("width", "normalized"), ("kana", "kanaVariant")):
        if span := text.whole(form, getattr(term, form)):
            return found(kind, span, "fuzzy")
    if term.allow_loose and (span := text.whole("loose", term.loose)):
        apart = any(c in "./" or c.isspace() for c in term.raw + text.text)
        return found("separatorVariant" if apart else "identifier", span, "fuzzy")
    if len(term.tokens) == 1:
        one = term.tokens[0]
        for token, a, b in text.tokens():
            if token == one:
                return found("identifier", (a, b), "fuzzy")
            if len(one) >= 3 and token.startswith(one):
                return found("prefix", (a, b), "fuzzy")
    if span := text.first("loose", term.loose) if term.allow_loose else text.first("kana", term.kana):
        return found("substring", span, "fuzzy")
    if term.typo:
        for token, a, b in text.tokens():
            if token.isascii() and token.isalpha() and token[0] == term.typo[0]:
                d = bounded_distance(term.typo, token, term.edits)
                if d and d * 5 <= len(term.typo):
                    return found("editDistance", (a, b), "fuzzy")
    return None


def match(text: Text | str, term: Term, allow_fuzzy: bool = False) -> dict | None:
    text = Text(text) if isinstance(text, str) else text
    if not allow_fuzzy:
        return standard(text, term)
    hit = fuzzy(text, term)
    if hit and standard(text, term):
        hit["category"] = "standard"
    return hit


def candidate(text: str, term: Term) -> bool:
    """Cheap test that every match passes."""
    if term.loose in forms.loose(text) if term.allow_loose else term.kana in forms.kana(text):
        return True
    if len(term.tokens) == 1:
        one = term.tokens[0]
        if any(t == one or len(one) >= 3 and t.startswith(one) for t, _, _ in forms.spans_of_tokens(text)):
            return True
    if term.numeric or not term.typo:
        return False
    return any(t[:1] == term.typo[0] and abs(len(t.encode()) - len(term.typo)) <= term.edits for t in forms.tokens(text))


HITS = T.ArrayType(T.StructType([T.StructField("term_ord", T.IntegerType()), T.StructField("hit", MATCH)]))


def hits_column(text: Column, terms: list[Term], allow_fuzzy: bool = False) -> Column:
    """The terms' matches in a text as an Arrow-batched column of ``HITS``; the text's forms are made once for all terms."""

    @F.pandas_udf(HITS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                one = Text(t) if t is not None else None
                found_ = [(i, match(one, term, allow_fuzzy)) for i, term in enumerate(terms)] if one else []
                out.append([{"term_ord": i, "hit": h} for i, h in found_ if h])
            yield pd.Series(out)

    return run(text)


def exact_column(text: Column, term: Column, identifiers: bool = False) -> Column:
    """The standard (or identifier) match of each row's own term in its text as an Arrow-batched column of ``MATCH``; null texts have none."""

    @F.pandas_udf(MATCH)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names, known = [f.name for f in MATCH.fields], {}

        def judged(t: str | None, raw: str) -> dict:
            if t is None:
                return dict.fromkeys(names)
            if raw not in known:
                known[raw] = Term(raw)
            if identifiers:
                span = Text(t).identifier(known[raw].base)
                return found("identifier", span, "standard") if span else dict.fromkeys(names)
            return match(t, known[raw]) or dict.fromkeys(names)

        for texts, raws in batches:
            yield pd.DataFrame([judged(t, r) for t, r in zip(texts, raws, strict=True)], columns=names).astype({"score": "Int32", "start": "Int32", "end": "Int32"})

    return run(text, term)


def form_column(text: Column, form: str) -> Column:
    """A normal form as an Arrow-batched column."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        fold = forms.FORMS[form]
        return s.map(lambda t: None if t is None else fold(t))

    return run(text)


def tokens_column(text: Column) -> Column:
    """Index-side tokens, distinct, in order of first occurrence."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else list(dict.fromkeys(forms.tokens(t))))

    return run(text)


__all__ = ["Term", "Text", "bounded_distance", "candidate", "form_column", "exact_column", "fuzzy", "hits_column", "match", "pa", "standard", "tokens_column"]
