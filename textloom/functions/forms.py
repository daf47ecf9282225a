"""Normal forms of text, in Python, where Unicode needs more than Spark's built-in functions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

SEPARATORS = frozenset("_-./")
_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]")
_SPACE = regex.compile(r"\p{White_Space}")
_GRAPHEME = regex.compile(r"\X")
_SEPARATOR = regex.compile(r"[\p{White_Space}_\-./]")
_KATAKANA = {i: i + 0x60 for i in range(0x3041, 0x3097)}


@lru_cache(maxsize=1 << 16)
def alphanumeric(c: str) -> bool:
    return bool(_WORD.match(c))


@lru_cache(maxsize=1 << 16)
def separator(c: str) -> bool:
    return c in SEPARATORS or bool(_SPACE.match(c))


def trim(text: str) -> str:
    return regex.sub(r"^\p{White_Space}+|\p{White_Space}+$", "", text)


def base(text: str) -> str:
    return unicodedata.normalize("NFC", text).casefold()


def width(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def kana(text: str) -> str:
    return width(text).translate(_KATAKANA)


def loose(text: str) -> str:
    return _SEPARATOR.sub("", kana(text))


FORMS = {"raw": lambda t: t, "base": base, "width": width, "kana": kana, "loose": loose}


def graphemes(text: str) -> list[str]:
    return _GRAPHEME.findall(text)


def _upper(c: str) -> bool:
    return "A" <= c <= "Z"


def _lower(c: str) -> bool:
    return "a" <= c <= "z"


def spans_of_tokens(text: str, digits: bool = False) -> list[tuple[str, int, int]]:
    """Identifier tokens and their places: cut at non-alphanumerics, before a capital after a small letter, before the last
    capital of a run that a small letter follows, and, if ``digits``, between ASCII digits and others."""
    out, start = [], 0
    for i in range(len(text) + 1):
        if i < len(text) and alphanumeric(text[i]):
            if i == start:
                continue
            a, b = text[i - 1], text[i]
            camel = _lower(a) and _upper(b) or _upper(a) and _upper(b) and i + 1 < len(text) and _lower(text[i + 1])
            number = digits and ("0" <= a <= "9") != ("0" <= b <= "9")
            if not camel and not number:
                continue
        if start < i:
            out.append((width(text[start:i]), start, i))
        start = i if i < len(text) and alphanumeric(text[i]) else i + 1
    return out


def tokens(text: str) -> list[str]:
    """Tokens as queries and the index have them."""
    return [t for t, _, _ in spans_of_tokens(text, digits=True)]


def grams(text: str, n: int) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def _alone(c: str) -> bool:
    """A character that is a cluster of its own and folds to its lower case in all forms."""
    return c.casefold() == c.lower() and len(c.lower()) == 1 and unicodedata.normalize("NFKC", c) == c and unicodedata.category(c) not in ("Mn", "Me", "Mc", "Cn", "Cf")


#: Texts of such Latin characters alone.
_ALONE = regex.compile("[" + "".join(regex.escape(c, special_only=False) for c in map(chr, range(0x250)) if _alone(c)) + "]*")


class Folded:
    """A text in one normal form, with the source range of each of its characters.

    Grapheme clusters are folded one by one; where a cluster isn't one character in both texts, each folded character stands
    for the whole cluster.
    """

    def __init__(self, text: str, form: str):
        self.text, self.source = text, None
        fold = FORMS[form]
        if form == "raw":
            self.value = text
            return
        if _ALONE.fullmatch(text) and "\r\n" not in text:
            self.value = fold(text)
            if form == "loose":
                self.source = [(i, i + 1) for i, c in enumerate(text) if not separator(c)]
            return
        parts, self.source, at = [], [], 0
        for g in graphemes(text):
            f = fold(g)
            parts.append(f)
            self.source += [(at, at + len(g))] * len(f)
            at += len(g)
        self.value = "".join(parts)

    def range(self, start: int, length: int) -> tuple[int, int]:
        if self.source is None:
            return start, start + length
        return self.source[start][0], self.source[start + length - 1][1]

    def places(self, needle: str):
        at = self.value.find(needle) if needle else -1
        while at >= 0:
            yield at
            at = self.value.find(needle, at + len(needle))
