"""Two-dimensional neighbourhoods of sheet hits: cells, merges, hidden rows and columns, styles."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.model import MAX_COLUMN, MAX_ROW, MERGE_CAP, WINDOW_SIDE
from textloom.operators.ranges import overlapping

#: Rows and columns of a tile: a window touches four at most.
TILE = 2 * WINDOW_SIDE + 1


@dataclass(frozen=True)
class Range:
    first_row: int
    first_column: int
    last_row: int
    last_column: int

    @classmethod
    def around(cls, row: int, column: int, side: int = WINDOW_SIDE) -> Range:
        """Five by five cells, moved inside the sheet at its edges."""
        a = max(1, min(row - side, MAX_ROW - 2 * side))
        b = max(1, min(column - side, MAX_COLUMN - 2 * side))
        return cls(a, b, a + 2 * side, b + 2 * side)

    def validated(self, focus_row: int) -> Range:
        if not (1 <= self.first_row <= self.last_row <= MAX_ROW and 1 <= self.first_column <= self.last_column <= MAX_COLUMN) or self.last_row - self.first_row > 4 or self.last_column - self.first_column > 4:
            raise ValueError("a range of at most 5 by 5 cells inside the sheet is needed")
        if not self.first_row <= focus_row <= self.last_row:
            raise ValueError("the range must hold the row of the hit")
        return self


class ContextError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Target:
    """The cell around which a result is shown."""

    path: str
    part_key: str
    sheet_name: str
    row: int
    column: int
    kind: str
    revision: str | None
    evidence: tuple[tuple[int, int], ...] = ()
    ranges: dict[tuple[int, int], list[tuple[int, int]]] = field(default_factory=dict)

    def window(self) -> Range:
        return Range.around(self.row, self.column)

    def unchanged(self) -> Target:
        """Raises ``changedSinceSearch`` if the file isn't the one that was searched."""
        try:
            told = os.stat(self.path)
        except OSError:
            told = None
        if told is None or f"{told.st_size}:{told.st_mtime_ns}" != self.revision:
            raise ContextError("changedSinceSearch", "the file was changed, moved or deleted after the search")
        return self


def distinct_ranges(ranges) -> list[tuple[int, int]]:
    """Ranges in order, equal ones once."""
    return sorted({tuple(r) for r in ranges})


def joined_ranges(ranges: DataFrame, keys: list[str], start: str = "start_at", end: str = "end_at") -> DataFrame:
    """``keys, start, end``: of each key the ranges that touch or overlap as one; empty ranges have no part."""
    w = Window.partitionBy(*keys).orderBy(start, end)  # a text's own ranges
    cut = ranges.where(F.col(end) > F.col(start)).withColumn("_high", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    part = cut.withColumn("_part", F.sum(F.when(F.col("_high") >= F.col(start), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*keys, "_part").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_part")


def threads(comments: DataFrame, thread: str, turn: str, ref: str) -> DataFrame:
    """``thread, turn, ref``: the comments that have a reference, or a parent (the turn before) that has or inherits one. A chain of
    any length is followed in one pass, and a comment is told once."""
    w = Window.partitionBy(thread).orderBy(turn)  # a thread's own comments
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = comments.where(F.col(turn).isNotNull()).withColumn("_cut", F.when(F.col(turn) - F.lag(turn).over(w) > 1, F.col(turn)))
    near = F.when(F.col(ref).isNotNull(), F.struct(F.col(turn).alias("turn"), F.col(ref).alias("ref")))
    told = cut.withColumns({"_near": F.max(near).over(upto), "_cut": F.max("_cut").over(upto)})
    return told.where(F.col("_near.turn") >= F.coalesce("_cut", "_near.turn")).select(thread, turn, F.coalesce(ref, "_near.ref").alias(ref))


def target(result: dict, revision: str | None = None) -> Target | None:
    """The target of a result event of a sheet's cell, formula, row or shape; None for all others.

    Ranges are those of the cells that show a match; in a row they come from its evidence in the same sheet."""
    if result["fileType"] not in ("xlsx", "xlsm") or result["sourceKind"] not in ("cell", "formula", "excelRow", "shape"):
        return None
    place = json.loads(result["location"])
    at = lambda x: parse_address(json.loads(x["location"]).get("cellAddress") or x.get("anchor") or json.loads(x["location"]).get("anchor"))
    same = [e for e in result["evidence"] if e["sourceKind"] in ("cell", "formula") and e["partKey"] == result["partKey"] and e["row"] == result["row"]]
    if result["sourceKind"] == "excelRow":
        spots = [p for p in map(at, same) if p]
        focus = (result["row"], spots[0][1] if spots else 1) if result["row"] else None
    else:
        spots, focus = [], at(result)
    if not place.get("sheetName") or not focus:
        return None
    ranges: dict[tuple[int, int], list] = {}
    for e in result["evidence"] or [result]:
        if e["sourceKind"] == "cell" and e["partKey"] == result["partKey"] and (spot := at(e)):
            ranges.setdefault(spot, []).extend(e["sourceMatchRanges"])
    ranges = {k: distinct_ranges(v) for k, v in ranges.items()}
    return Target(result["path"], result["partKey"], place["sheetName"], *focus, result["sourceKind"], revision, tuple(spots), ranges)


def parse_address(text: str | None) -> tuple[int, int] | None:
    """Row and column of an A1 address, None for anything else."""
    letters = (text or "").rstrip("0123456789")
    digits = (text or "")[len(letters) :]
    if not digits or digits[0] == "0" or not 1 <= len(letters) <= 3 or not all("A" <= c <= "Z" for c in letters):
        return None
    column = 0
    for c in letters:
        column = 26 * column + ord(c) - 64
    return (int(digits), column) if int(digits) <= MAX_ROW and column <= MAX_COLUMN else None


def window(units: DataFrame, focus: Target, r: Range | None = None) -> DataFrame:
    """``row, column, text, truncated, match_ranges`` of the cells around a target; ranges that a cut hides are left out."""
    r = (r or focus.window()).validated(focus.row)
    there = cells(units.where(F.col("path") == focus.path), focus.part_key, r)
    rows = [(a, b, [list(x) for x in v]) for (a, b), v in focus.ranges.items()]
    known = units.sparkSession.createDataFrame(rows, "row int, column int, ranges array<array<int>>")
    kept = F.filter(F.coalesce("ranges", F.array().cast("array<array<int>>")), lambda x: x[1] <= F.length("text"))
    return there.join(F.broadcast(known), ["row", "column"], "left").select("row", "column", "text", "truncated", kept.alias("match_ranges"))  # known: cells of one result


def cells(units: DataFrame, part: str, r: Range) -> DataFrame:
    """``row, column, text, truncated``: the first value of each cell in the range."""
    there = units.where((F.col("part_key") == part) & (F.col("source_kind") == "cell") & F.col("row").between(r.first_row, r.last_row) & F.col("column").between(r.first_column, r.last_column))
    first = there.groupBy("row", "column").agg(F.min_by("text", "unit_seq").alias("text"))
    return first.select("row", "column", X.clip("text").alias("c")).select("row", "column", "c.*")


def windows(targets: DataFrame) -> DataFrame:
    """``targets(target, path, part_key, row, column)`` with the range around each, as ``Range.around``."""
    edge = lambda c, most: F.greatest(F.lit(1), F.least(F.col(c) - WINDOW_SIDE, F.lit(most - 2 * WINDOW_SIDE)))
    out = targets.withColumns({"first_row": edge("row", MAX_ROW), "first_column": edge("column", MAX_COLUMN)})
    return out.select("target", "path", "part_key", "first_row", "first_column", (F.col("first_row") + 2 * WINDOW_SIDE).alias("last_row"), (F.col("first_column") + 2 * WINDOW_SIDE).alias("last_column"))


def cells_of(targets: DataFrame, units: DataFrame) -> DataFrame:
    """``target, row, column, text, truncated``: the cells around many targets, by a join on tiles of a window's size."""
    tile = lambda c: F.floor((F.col(c) - 1) / TILE)
    each = windows(targets).withColumn("_r", F.explode(F.sequence(tile("first_row"), tile("last_row")))).withColumn("_c", F.explode(F.sequence(tile("first_column"), tile("last_column"))))
    there = units.where((F.col("source_kind") == "cell") & F.col("row").isNotNull() & F.col("column").isNotNull())
    first = there.groupBy("path", "part_key", "row", "column").agg(F.min_by("text", "unit_seq").alias("text")).withColumns({"_r": tile("row"), "_c": tile("column")})
    met = each.join(first, ["path", "part_key", "_r", "_c"]).where(F.col("row").between(F.col("first_row"), F.col("last_row")) & F.col("column").between(F.col("first_column"), F.col("last_column")))
    return met.select("target", "row", "column", X.clip("text").alias("c")).select("target", "row", "column", "c.*")


def merges_of(targets: DataFrame, ranges: DataFrame) -> DataFrame:
    """``target`` and the merged ranges ``path, part_key, first_row, ..., last_column`` that meet its window, for many targets; their
    number isn't capped, as no result shows them all."""
    names = ("first_row", "first_column", "last_row", "last_column")
    mine = windows(targets).withColumnsRenamed({c: f"w_{c}" for c in names})
    met = overlapping(mine, ranges, ["path", "part_key"], ("w_first_row", "w_last_row"), ("first_row", "last_row"))
    met = met.where((F.col("first_column") <= F.col("w_last_column")) & (F.col("last_column") >= F.col("w_first_column")))
    return met.select("target", "path", "part_key", *names)


def merges(ranges: DataFrame, r: Range) -> DataFrame:
    """Merged ranges that meet the window: ``first_row, first_column, last_row, last_column``. Over ``MERGE_CAP`` is an error."""
    met = ranges.where((F.col("first_row") <= r.last_row) & (F.col("last_row") >= r.first_row) & (F.col("first_column") <= r.last_column) & (F.col("last_column") >= r.first_column))
    if met.limit(MERGE_CAP + 1).count() > MERGE_CAP:
        raise ValueError("resourceLimit: too many merged ranges")
    return met


def anchored(met: DataFrame, units: DataFrame, part: str) -> DataFrame:
    """Merges with the value of their first cell, wherever that is."""
    values = units.where((F.col("part_key") == part) & (F.col("source_kind") == "cell")).groupBy(F.col("row").alias("first_row"), F.col("column").alias("first_column")).agg(F.min_by("text", "unit_seq").alias("anchor_text"))
    return met.join(values, ["first_row", "first_column"], "left")


def hidden(ranges: DataFrame, low: int, high: int) -> DataFrame:
    """Hidden numbers between ``low`` and ``high`` from ranges ``first, last``."""
    met = ranges.where((F.col("first") <= high) & (F.col("last") >= low))
    return met.select(F.explode(F.sequence(F.greatest("first", F.lit(low)), F.least("last", F.lit(high)))).alias("number")).distinct()


def styles(grid: DataFrame, cell: DataFrame, row: DataFrame, column: DataFrame) -> DataFrame:
    """The style of each ``row, column``: the cell's, else the row's, else the last column rule's that holds it, else 0."""
    columns = grid.select("column").distinct()
    rules = overlapping(columns, column, [], ("column", "column"), ("first", "last")).groupBy("column").agg(F.max_by("column_style", "ord").alias("column_style"))
    return grid.join(cell, ["row", "column"], "left").join(row, "row", "left").join(rules, "column", "left").select("row", "column", F.coalesce("cell_style", "row_style", "column_style", F.lit(0)).alias("style"))


def merge_table(sheets: DataFrame) -> DataFrame:
    """``path, part_key, first_row, first_column, last_row, last_column`` of the sheets' merges."""
    each = sheets.select("path", "part_key", F.explode("merges").alias("m")).select("path", "part_key", X.address(F.split_part("m", F.lit(":"), F.lit(1))).alias("a"), X.address(F.split_part("m", F.lit(":"), F.lit(2))).alias("b"))
    return each.select("path", "part_key", F.col("a.row").alias("first_row"), F.col("a.column").alias("first_column"), F.col("b.row").alias("last_row"), F.col("b.column").alias("last_column"))
