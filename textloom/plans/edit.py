"""Editing one line of a text file that a search found. It runs where the file is, on the driver, and never on executors.

A draft is prepared from a result's edit anchor and saved only if neither the file's size and time nor the line have changed
since the search. All other bytes stay as they are: encoding, byte-order mark and line ends included.
"""

from __future__ import annotations

import hashlib
import os
import stat
import tempfile
from dataclasses import dataclass
from pathlib import Path

from textloom import model


class EditError(ValueError):
    """A refused edit; ``code`` tells why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Draft:
    path: Path
    content: bytes
    start: int
    end: int
    encoding: str
    newline: str
    selected: str
    before: str
    after: str

    def save(self, replacement: str) -> None:
        """Puts ``replacement`` in place of the match: into a file beside the old one, which then takes its place at once."""
        if checked(self.path) != self.content:
            raise EditError("changed", "the file has changed since the draft was made")
        text = replacement.replace("\r\n", "\n").replace("\r", "\n").replace("\n", self.newline)
        try:
            made = self.content[: self.start] + text.encode(self.encoding) + self.content[self.end :]
        except UnicodeEncodeError as e:
            raise EditError("encoding", "the file's encoding lacks a character") from e
        if len(made) > model.MAX_TEXT_BYTES:
            raise EditError("resourceLimit", "the file would be too large")
        handle, name = tempfile.mkstemp(prefix=".textloom-edit-", dir=self.path.parent)
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(made)
                f.flush()
                os.fsync(f.fileno())
            Path(name).chmod(stat.S_IMODE(self.path.stat().st_mode))
            if checked(self.path) != self.content:
                raise EditError("changed", "the file has changed while it was saved")
            Path(name).replace(self.path)
        finally:
            Path(name).unlink(missing_ok=True)


def checked(path: Path) -> bytes:
    """The file's bytes, if it is a plain file that may be written."""
    if path.is_symlink():
        raise EditError("link", "links can't be edited")
    if not path.is_file():
        raise EditError("missing", "the file is gone")
    if not os.access(path, os.W_OK):
        raise EditError("readOnly", "the file is read-only")
    if path.stat().st_size > model.MAX_TEXT_BYTES:
        raise EditError("resourceLimit", "the file is too large")
    return path.read_bytes()


def prepare(result: dict, evidence: int | None = None) -> Draft:
    """A draft from a result event; of a result with evidence, ``evidence`` says which place."""
    place = result
    if result["evidence"]:
        if evidence is None or not 0 <= evidence < len(result["evidence"]):
            raise EditError("evidence", "one of the result's places must be chosen")
        place = result["evidence"][evidence]
    elif evidence is not None:
        raise EditError("evidence", "the result has no further places")
    anchor, path = place["editAnchor"], Path(result["path"])
    if anchor is None or path.suffix[1:].lower() not in model.TEXT_EXTENSIONS:
        raise EditError("unsupported", "only lines of text files can be edited")
    content, told = checked(path), path.stat()
    if f"{told.st_size}:{told.st_mtime_ns}" != anchor["sourceRevision"]:
        raise EditError("changed", "the file has changed since the search")
    mark = 3 if content.startswith(b"\xef\xbb\xbf") else 0
    encoding = "utf-8"
    try:
        text = content[mark:].decode("utf-8")
    except UnicodeDecodeError:
        encoding, text = "cp932", content.decode("cp932")
    lines = text.split("\n")
    if anchor["lineNumber"] > len(lines):
        raise EditError("changed", "the line is gone")
    line = lines[anchor["lineNumber"] - 1].rstrip("\r")
    raw = line.encode()
    if f"{len(raw)}:{hashlib.sha1(raw).hexdigest()}" != anchor["lineRevision"] or (mark + len(text.encode(encoding))) != len(content):
        raise EditError("changed", "the line has changed since the search")
    a, b = anchor["start"], anchor["end"]
    start = mark + len("\n".join([*lines[: anchor["lineNumber"] - 1], line[:a]]).encode(encoding))
    newline = "\r\n" if "\r\n" in text else "\n"
    return Draft(path, content, start, start + len(line[a:b].encode(encoding)), encoding, newline, line[a:b], line[:a], line[b:])
