"""Search requests: dataclasses that are validated before any DataFrame is built."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path

from textloom import model
from textloom.functions import forms
from textloom.functions.matcher import Term


class InputError(ValueError):
    """A rejected request; ``field`` is the first input that failed."""

    def __init__(self, field_: str, message: str):
        super().__init__(message)
        self.field = field_


class Scope(Enum):
    UNIT = "unit"
    EXCEL_ROW = "excelRow"
    FILE = "file"


@dataclass(frozen=True)
class NamedTerm:
    id: str
    text: str

    @property
    def key(self) -> str:
        return forms.base(self.text)

    @property
    def term(self) -> Term:
        return Term(self.text)


@dataclass(frozen=True)
class Conditions:
    scope: Scope
    all: tuple[NamedTerm, ...] = ()
    any: tuple[NamedTerm, ...] = ()
    none: tuple[NamedTerm, ...] = ()


@dataclass(frozen=True)
class Batch:
    terms: tuple[NamedTerm, ...]
    identifiers: bool = False


def distinct_terms(values: list[str], prefix: str, most: int, raw_most: int, field_: str = "querySpec") -> tuple[NamedTerm, ...]:
    """Trimmed terms without blanks; of equal folded ones the first stays. Ids count what is kept, from 1."""
    if len(values) > raw_most:
        raise InputError(field_, f"more than {raw_most} terms")
    kept: dict[str, str] = {}
    for v in values:
        t = forms.trim(v)
        if len(t) > model.MAX_TERM_CHARS:
            raise InputError(field_, f"a term of more than {model.MAX_TERM_CHARS} characters")
        if t:
            kept.setdefault(forms.base(t), t)
    if len(kept) > most:
        raise InputError(field_, f"more than {most} different terms")
    return tuple(NamedTerm(f"{prefix}:{i}", t) for i, t in enumerate(kept.values(), 1))


def _only(spec: dict, names: set[str]) -> None:
    if unknown := sorted(set(spec) - names):
        raise InputError("querySpec", f"unknown fields: {', '.join(unknown)}")


def parse_conditions(spec: dict) -> Conditions:
    _only(spec, {"mode", "scope", "all", "any", "not"})
    try:
        scope = Scope(spec.get("scope", "unit"))
    except ValueError:
        raise InputError("querySpec", "unknown scope") from None
    groups = [distinct_terms(list(spec.get(k) or []), k, model.MAX_CONDITION_TERMS, model.MAX_RAW_CONDITIONS) for k in ("all", "any", "not")]
    if not groups[0] and not groups[1]:
        raise InputError("querySpec", "at least one positive term is needed")
    if {t.key for t in groups[0]} & {t.key for t in groups[2]}:
        raise InputError("querySpec", "a term is both wanted and excluded")
    return Conditions(scope, *groups)


def parse_batch(spec: dict) -> Batch:
    _only(spec, {"mode", "terms", "matchMode"})
    mode = spec.get("matchMode", "text")
    if mode not in ("text", "identifier"):
        raise InputError("querySpec", "unknown match mode")
    terms = distinct_terms(list(spec.get("terms") or []), "batch", model.MAX_BATCH_TERMS, model.MAX_RAW_BATCH)
    if not terms:
        raise InputError("querySpec", "no terms")
    if mode == "identifier" and not all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", t.text) for t in terms):
        raise InputError("querySpec", "a term isn't an identifier")
    return Batch(terms, mode == "identifier")


@dataclass(frozen=True)
class SearchRequest:
    root_directory: str
    query: str = ""
    query_spec: dict | None = None
    additional_directories: tuple[str, ...] = ()
    excluded_directories: tuple[str, ...] = ()
    extensions: tuple[str, ...] = model.DEFAULT_EXTENSIONS
    recursive: bool = True
    use_index: bool = False
    fuzzy: bool = False
    include_notes: bool = False
    include_formulas: bool = False
    roots: tuple[str, ...] = field(default=(), compare=False)

    def validated(self) -> SearchRequest:
        """The request with its directories made absolute; InputError names the first field that fails."""
        if self.query_spec is not None:
            if self.query.strip():
                raise InputError("querySpec", "a plain term and a query specification exclude each other")
            self.spec()
        elif not self.query.strip():
            raise InputError("query", "a term is needed")
        if not self.recursive:
            raise InputError("rootDirectory", "only searches with subfolders are supported")
        if not self.extensions:
            raise InputError("extensions", "at least one extension is needed")
        if any(x not in model.EXTENSIONS for x in self.extensions):
            raise InputError("extensions", "an extension isn't supported")
        roots = [directory(self.root_directory, "rootDirectory"), *(directory(d, "additionalDirectories") for d in self.additional_directories)]
        out = [directory(d, "excludedDirectories") for d in self.excluded_directories]
        return SearchRequest(**{**self.__dict__, "roots": tuple(without_nested(roots)), "excluded_directories": tuple(without_nested(out))})

    def spec(self) -> Conditions | Batch | NamedTerm:
        if self.query_spec is None:
            return NamedTerm("query", self.query)
        return parse_batch(self.query_spec) if self.query_spec.get("mode") == "batch" else parse_conditions(self.query_spec)


def directory(path: str, field_: str) -> str:
    if "://" in path:  # a store that only Spark reads; a folder that isn't there shows when it is listed
        return path.rstrip("/")
    found = Path(path).expanduser()
    if not path.strip() or not found.is_dir():
        raise InputError(field_, "no such directory")
    return str(found.resolve())


def without_nested(paths: list[str]) -> list[str]:
    """Paths that no other one holds, shortest first; equal ones once."""
    kept: list[list[str]] = []
    for p in sorted((p.rstrip("/").split("/") for p in paths), key=len):
        if not any(p[: len(k)] == k for k in kept):
            kept.append(p)
    return ["/".join(k) or "/" for k in kept]


#: Folders that a history keeps.
HISTORY = 20


def remembered(history: list[str], folder: str) -> list[str]:
    """A history of folders with ``folder`` first; paths that differ in case, slashes or a slash at the end are one."""
    kept: dict[str, str] = {}
    for p in (folder, *history):
        key = re.sub(r"(?<=[^/:])/+$", "", re.sub(r"(?<!^)/+", "/", p.strip().replace("\\", "/"))).casefold()
        if key:
            kept.setdefault(key, p.strip())
    return list(kept.values())[:HISTORY]
