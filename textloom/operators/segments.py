"""The manifest of an index: which segments are live, swapped at once; tiers of segments; what may be removed.

A manifest is a small JSON file named by its version; the one of the highest version counts. A new one is written beside and then renamed,
so that readers see the state before or after and never between. A segment is a folder; it counts when a manifest names it, and what
a killed writer left behind is overwritten by the next, or swept away. Segments that a compaction replaced stay for a grace time, for
readers that began before. One writer at a time; any number of readers.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from textloom.session import remove

#: Seconds that replaced segments and unnamed folders stay; versions of the manifest that stay.
GRACE, KEPT = 3600.0, 3
#: Segments of more units than this are never merged.
LARGEST = 1 << 32


@dataclass(frozen=True)
class Segment:
    id: int
    size: int  # units and tombstones
    stale: int = 0  # units that are no longer there, but still have postings


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next: int = 1
    segments: tuple[Segment, ...] = ()  # oldest first
    gone: tuple[tuple[int, float], ...] = ()  # replaced segments, and when
    batches: dict[str, int] = field(default_factory=dict)  # last micro-batch of each stream

    def with_segment(self, size: int, replaces: tuple[int, ...] = (), now: float | None = None, stale: int = 0) -> Manifest:
        """The manifest with the segment ``next``, in the place of the newest ones that it ``replaces``."""
        kept = tuple(s for s in self.segments if s.id not in replaces)
        at = time.time() if now is None else now
        return Manifest(self.version, self.next + 1, (*kept, Segment(self.next, size, stale)), (*self.gone, *((i, at) for i in replaces)), self.batches)


class Store:
    """Manifests below a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def _list(self, at: str) -> dict[str, float]:
        """Names in a folder, with their times in seconds."""
        if not self.fs.exists(self.path(at)):
            return {}
        return {x.getPath().getName(): x.getModificationTime() / 1000 for x in self.fs.listStatus(self.path(at))}

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._list(f"{self.root}/manifest") if n.endswith(".json") and n[:-5].isdigit())

    def _file(self, version: int) -> str:
        return f"{self.root}/manifest/{version:012d}.json"

    def read(self) -> Manifest | None:
        """The current manifest; None if there is none. Damaged ones raise ValueError."""
        if not (found := self.versions()):
            return None
        stream = self.fs.open(self.path(self._file(found[-1])))
        try:
            told = json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            return Manifest(found[-1], told["next"], tuple(Segment(**s) for s in told["segments"]), tuple((i, at) for i, at in told["gone"]), told["batches"])
        except (KeyError, TypeError) as e:
            raise ValueError("a damaged manifest") from e
        finally:
            stream.close()

    def commit(self, new: Manifest) -> Manifest:
        """Swaps ``new`` in for the manifest that it was made of; fails if another writer was faster."""
        told = asdict(new)
        version = told.pop("version") + 1
        aside, at = self.path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self.path(self._file(version))
        self.fs.mkdirs(self.path(f"{self.root}/manifest"))
        out = self.fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(told).encode()))
        finally:
            out.close()
        if self.fs.exists(at) or not self.fs.rename(aside, at):
            self.fs.delete(aside, False)
            raise RuntimeError("another writer has changed the index")
        for old in self.versions()[:-KEPT]:
            self.fs.delete(self.path(self._file(old)), False)
        return Manifest(version, new.next, new.segments, new.gone, new.batches)

    def folder(self, segment: int) -> str:
        return f"{self.root}/segments/{segment}"

    def sweep(self, m: Manifest, grace: float = GRACE, now: float | None = None) -> Manifest:
        """Removes replaced segments and unnamed folders whose grace time is over."""
        now = time.time() if now is None else now
        over = [i for i, at in m.gone if at + grace <= now]
        live = {str(s.id) for s in m.segments} | {str(i) for i, _ in m.gone}
        for name, at in self._list(f"{self.root}/segments").items():
            if name not in live and at + grace <= now:
                remove(self.spark, f"{self.root}/segments/{name}")
        if not over:
            return m
        new = self.commit(Manifest(m.version, m.next, m.segments, tuple(g for g in m.gone if g[0] not in over), m.batches))
        for i in over:
            remove(self.spark, self.folder(i))
        return new


def due(sizes: list[int], largest: int = LARGEST) -> int | None:
    """From which place on the segments (oldest first) are to be merged into one, so that each is at least twice the next; None if
    they are so already. There are then never more than the logarithm of the whole size, and a unit is rewritten as often."""
    if len(sizes) < 2:
        return None
    start, total = len(sizes) - 1, sizes[-1]
    while start > 0 and sizes[start - 1] < 2 * total and sizes[start - 1] <= largest:
        start -= 1
        total += sizes[start]
    return start if start < len(sizes) - 1 else None
