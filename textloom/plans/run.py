"""A whole search: discovery, extraction or index, matching, ranking, and its ordered events."""

from __future__ import annotations

import itertools
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.matcher import Term
from textloom.model import ISSUE
from textloom.operators import index, ranking, search
from textloom.plans.request import Batch, Conditions, Scope, SearchRequest
from textloom.session import Scratch, numbered
from textloom.sources import files as sources

#: Files that are found between two reports of progress.
PROGRESS = 32
#: Files of a wave, and bytes after which the next begins: what a wave finds is given before the next one is read.
WAVE_FILES, WAVE_BYTES = 256, 256 << 20


@dataclass
class Result:
    files: DataFrame
    units: DataFrame
    sheets: DataFrame | None
    issues: DataFrame
    hits: DataFrame
    rankings: DataFrame
    terms: DataFrame | None = None
    extracted: int = 0
    reused: int = 0
    held: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        """Gives back what the search keeps in memory."""
        for df in self.held:
            df.unpersist()


def condition_hits(units: DataFrame, spec: Conditions, fuzzy: bool) -> tuple[DataFrame, DataFrame]:
    """Groups that meet the conditions, one row each with their ``evidence``; and the same evidence, a row each."""
    groups = search.where(units, spec, fuzzy)
    each = groups.select("path", "file_type", "scope_key", "category", F.explode("evidence").alias("e")).select("path", "file_type", "scope_key", "category", F.col("e.term_id").alias("term_id"), F.col("e.term").alias("term"), F.col("e.best.*"))
    one = F.col("evidence")[0]["best"]
    row = F.col("scope_key").startswith("row:")
    file = F.col("scope_key") == "file"
    place = F.from_json(one["location"], "sheetIndex int, sheetName string")
    in_row = F.to_json(F.struct(one["row"].alias("row"), place["sheetIndex"].alias("sheetIndex"), place["sheetName"].alias("sheetName")))
    least = lambda c: F.array_min(F.transform("evidence", lambda e: e["best"][c])).alias(c)
    hits = groups.select(
        "path", "file_type", "scope_key", "evidence", least("unit_seq"), least("document_order"), one["text"].alias("text"), one["hit"].withField("category", F.col("category")).alias("hit"),
        F.when(file, "fileMatch").when(row, "excelRow").otherwise(one["source_kind"]).alias("source_kind"),
        F.when(file, "file").otherwise(one["unit_key"]).alias("unit_key"), F.when(file, "").otherwise(one["part_key"]).alias("part_key"), F.when(file, "file").otherwise(one["group_key"]).alias("group_key"),
        F.when(~file, one["row"]).alias("row"), one["content_class"].alias("content_class"), F.when(file, "{}").when(row, in_row).otherwise(one["location"]).alias("location"),
    )
    return hits, each


class Source:
    """The files that a request names: listed, and read into units."""

    def __init__(self, spark: SparkSession, request: SearchRequest):
        self.spark, self.request = spark, request
        self.where = (request.roots, request.excluded_directories, request.extensions)
        self.stored = any("://" in r for r in request.roots)

    def listing(self) -> tuple[DataFrame, DataFrame]:
        if self.stored:
            return sources.scan(self.spark, *self.where).drop("content"), self.spark.createDataFrame([], ISSUE)
        return sources.discover(self.spark, *self.where)

    def extract(self, some: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        contents = sources.scan(self.spark, *self.where).join(some.select("path"), "path", "left_semi") if self.stored else sources.read_contents(self.spark, some)
        return sources.extract_files(contents, self.request.include_formulas, self.request.include_notes)

    def refreshed(self, files: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, int, int, list[DataFrame]]:
        bits = index.scope_bits(self.request.include_notes, self.request.include_formulas)
        return index.refresh(self.spark, folder, files, self.extract, bits, lambda: self.listing()[0])

    def candidates(self, units: DataFrame, files: DataFrame, folder: str, term: str) -> DataFrame:
        """Of the units of ``files`` those that an index can't rule out, and those of files that it doesn't hold."""
        held = index.Index(self.spark, folder)
        live = held.candidates(Term(term)).join(files.select("path"), "path", "left_semi")
        return live.unionByName(units.join(held.files().select("path"), "path", "left_anti"))


def matches(units: DataFrame, read_issues: DataFrame, spec, fuzzy: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Hits of a query form, the evidence that files are ranked by, and terms that meet in a row of a sheet."""
    same_row = None
    if isinstance(spec, Batch):
        hits = evidence = search.batch_hits(units, spec, fuzzy)
    elif isinstance(spec, Conditions):
        if spec.scope is Scope.FILE:  # a file that wasn't read whole can't satisfy a condition on all of it
            units = units.join(read_issues.select("path").distinct(), "path", "left_anti")
            same_row = search.same_row_terms(units.where(F.col("file_type").isin("xlsx", "xlsm")), (*spec.all, *spec.any))
        hits, evidence = condition_hits(units, spec, fuzzy)
    else:
        hits = evidence = search.plain(units, spec.text, fuzzy)
    term_key = X.fold("term") if "term" in evidence.columns else F.lit("query")
    keyed = evidence.select("path", term_key.alias("term_key"), F.col("hit.score").alias("score"), "part_key", "unit_key", "row", "content_class", "source_kind")
    return hits, keyed, same_row


def search_files(spark: SparkSession, request: SearchRequest, index_folder: str | None = None) -> Result:
    """Lazy DataFrames of a validated request; an index changes what is read, never what is found."""
    request = request.validated()
    spec, of = request.spec(), Source(spark, request)
    files, found_issues = of.listing()
    sheets, terms = None, None
    if index_folder:
        units, read_issues, extracted, reused, held = of.refreshed(files, index_folder)
    else:
        units, sheets, read_issues = of.extract(files)
        units, read_issues = units.persist(), read_issues.persist()
        held, extracted, reused = [units, read_issues], files.count(), 0
    issues = found_issues.unionByName(read_issues)
    looked = units
    if index_folder and request.fuzzy and not isinstance(spec, (Batch, Conditions)):
        looked = of.candidates(units, files, index_folder, spec.text)
    hits, keyed, same_row = matches(looked, read_issues, spec, request.fuzzy)
    if isinstance(spec, Batch):
        terms = search.batch_summary(hits, spec, issues.count())
    return Result(files, units, sheets, issues, hits, ranking.ranked(keyed, same_row), terms, extracted, reused, held)


def shown(hit: Column, text: Column) -> Column:
    return X.preview(text, hit["start"], hit["end"])


def anchor(kind: Column, location: Column, text: Column, hit: Column) -> Column:
    """Where a line of text can be edited: ``struct<lineNumber, start, end, lineRevision>``; null for other units."""
    revision = F.concat(F.octet_length(text), F.lit(":"), F.sha1(text))
    return F.when(kind == "textLine", F.struct(F.get_json_object(location, "$.lineNumber").cast("int").alias("lineNumber"), hit["start"].alias("start"), hit["end"].alias("end"), revision.alias("lineRevision")))


def projected(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits as results: preview with its range, edit anchor, the file's time and revision, result id; evidence alike."""
    out = hits.withColumn("term_id", F.col("term_id") if "term_id" in hits.columns else F.lit(None).cast("string")).withColumn("term", F.col("term") if "term" in hits.columns else F.lit(None).cast("string"))
    out = out.withColumn("preview", shown(F.col("hit"), F.col("text"))).withColumn("edit_anchor", anchor(F.col("source_kind"), F.col("location"), F.col("text"), F.col("hit")))
    if "evidence" in hits.columns:
        one = lambda e: F.struct(e["term_id"].alias("term_id"), e["term"].alias("term"), e["best"].alias("best"), shown(e["best"]["hit"], e["best"]["text"]).alias("preview"), anchor(e["best"]["source_kind"], e["best"]["location"], e["best"]["text"], e["best"]["hit"]).alias("edit_anchor"))
        out = out.withColumn("evidence", F.transform("evidence", one)).withColumn("edit_anchor", F.lit(None).cast(out.schema["edit_anchor"].dataType))
    stamps = files.select("path", F.col("modified_ns").alias("modified_at"), F.concat("size", F.lit(":"), "modified_ns").alias("revision"))
    return ranking.with_result_ids(out).join(stamps, "path", "left")


def result_event(r) -> dict:
    """A result as its event's fields."""

    def place(x, preview, edit) -> dict:
        told = {"sourceKind": x["source_kind"], "unitKey": x["unit_key"], "partKey": x["part_key"], "row": x["row"], "contentClass": x["content_class"], "location": x["location"], "documentOrder": x["document_order"]}
        told |= {"previewText": preview["text"], "previewTruncated": preview["truncated"], "matchRanges": [[preview["start"], preview["end"]]], "sourceMatchRanges": [[x["hit"]["start"], x["hit"]["end"]]]}
        told |= {"matchType": x["hit"]["kind"], "matchCategory": x["hit"]["category"], "score": x["hit"]["score"]}
        return told | {"editAnchor": edit.asDict() | {"sourceRevision": r["revision"]} if edit else None}

    out = {"resultId": r["result_id"], "path": r["path"], "fileType": r["file_type"], "groupKey": r["group_key"], "modifiedAt": r["modified_at"], "termId": r["term_id"], "term": r["term"], "text": r["text"]}
    evidence = [{"termId": e["term_id"], "term": e["term"]} | place(e["best"], e["preview"], e["edit_anchor"]) for e in r["evidence"]] if "evidence" in r else []
    return out | place(r, r["preview"], r["edit_anchor"]) | {"evidence": evidence}


class Session:
    """One active search at a time: a new one cancels the jobs of the one before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.lock = spark, None, threading.Lock()

    def begin(self) -> str:
        with self.lock:
            if self.tag:
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self.tag = f"search-{uuid.uuid4().hex}"
            return self.tag

    def run(self, request: SearchRequest, **more) -> Iterator[dict]:
        tag = self.begin()
        yield from events(self.spark, request, lambda: self.tag != tag, tag=tag, **more)

    def cancel(self) -> None:
        with self.lock:
            tag, self.tag = self.tag, None
        if tag:
            self.spark.sparkContext.cancelJobsWithTag(tag)


class Waves:
    """A search wave by wave, in the order of the paths. The driver holds what one wave gives; of earlier ones it holds counts."""

    def __init__(self, spark: SparkSession, request: SearchRequest, index_folder: str | None):
        self.spark, self.request, self.spec = spark, request, request.spec()
        self.source, self.scratch = Source(spark, request), Scratch(spark, "waves")
        self.extracted = self.reused = 0
        self.held: list[DataFrame] = []
        files, self.issues = self.source.listing()
        order = [F.split("path", "/").asc()]
        placed = numbered(numbered(files, order, "place"), order, "bytes_before", "size")
        wave = F.floor((F.col("place") - 1) / WAVE_FILES) + F.floor(F.col("bytes_before") / WAVE_BYTES)
        self.files = self.scratch.save(placed.select(*files.columns, wave.cast("long").alias("wave")), "files")
        self.units = self.read_issues = None
        if index_folder:
            self._indexed(index_folder)

    def _indexed(self, folder: str) -> None:
        """Units of all files, from the index and from files that it lacks, lie by wave."""
        units, issues, self.extracted, self.reused, self.held = self.source.refreshed(self.files.drop("wave"), folder)
        if self.request.fuzzy and not isinstance(self.spec, (Batch, Conditions)):
            units = self.source.candidates(units, self.files, folder, self.spec.text)
        at = f"{self.scratch.root}/units"
        units.join(self.files.select("path", "wave"), "path").write.partitionBy("wave").parquet(at)
        self.units = self.spark.read.schema(units.schema.add("wave", "long")).parquet(at)
        self.read_issues = issues.join(self.files.select("path", "wave"), "path")

    def numbers(self) -> Iterator[int]:
        for r in self.files.select("wave").distinct().orderBy("wave").toLocalIterator():
            yield r.wave

    def of(self, number: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[DataFrame]]:
        """A wave's files, issues, hits and the evidence of its files; and what it keeps in memory."""
        files = self.files.where(F.col("wave") == number).drop("wave")
        if self.units is None:
            units, _, issues = self.source.extract(files)
            units, issues = units.persist(), issues.persist()
            held = [units, issues]
            self.extracted += files.count()
        else:
            units, issues = (df.where(F.col("wave") == number).drop("wave") for df in (self.units, self.read_issues))
            held = []
        hits, keyed, same_row = matches(units, issues, self.spec, self.request.fuzzy)
        told = self.scratch.save(ranking.file_evidence(keyed, same_row), f"ranks/{number}")
        return files, issues.select(*ISSUE.names), hits, told, held

    def ranks(self, numbers: list[int]) -> Iterator[str]:
        """Paths in the order of all ranks: what the waves wrote is put in one order by Spark."""
        each = [self.spark.read.parquet(f"{self.scratch.root}/ranks/{n}") for n in numbers]
        if each:
            for r in ranking.in_order(reduce(DataFrame.union, each)).orderBy("file_rank").select("path").toLocalIterator():
                yield r.path

    def close(self) -> None:
        for df in self.held:
            df.unpersist()
        self.scratch.close()


def events(spark: SparkSession, request: SearchRequest, cancelled: Callable[[], bool] = lambda: False, index_folder: str | None = None, tag: str | None = None) -> Iterator[dict]:
    """The ordered protocol: started, progress, issues, results and rankings by file, ranking and execution summaries, a batch's
    summary, finished. Results that were given before a cancellation stay; nothing follows ``finished``.

    Files are searched in waves, so the first results are given before later files are read. A file's ranking tells its evidence; its
    place among all files is in the summary.
    """
    number = itertools.count(1)
    event = lambda kind, **more: {"sequence": next(number), "type": kind} | more
    counts = {"discovered": 0, "processed": 0, "results": 0, "issues": 0}
    request = request.validated()
    yield event("started")
    yield event("progress", phase="discovery", counts=dict(counts))
    if tag:
        spark.sparkContext.addJobTag(tag)
    waves = None
    try:
        waves = Waves(spark, request, index_folder)
        total = waves.files.count()
        for n in range(PROGRESS, total + 1, PROGRESS):
            counts["discovered"] = n
            yield event("progress", phase="discovery", counts=dict(counts))
        counts["discovered"] = total
        yield event("progress", phase="search", counts=dict(counts))

        def issue_events(issues: DataFrame) -> Iterator[dict]:
            for r in issues.toLocalIterator():
                counts["issues"] += 1
                yield event("issue", **r.asDict())

        yield from issue_events(waves.issues)
        reason, done, by_term = "completed", [], {}
        for w in waves.numbers():
            if cancelled():
                reason = "cancelled"
                break
            files, issues, hits, evidence, held = waves.of(w)
            done.append(w)
            try:
                yield from issue_events(issues)
                if isinstance(waves.spec, Batch):
                    for r in search.batch_counts(hits).collect():  # 256 terms at most
                        a, b = by_term.get(r.term_id, (0, 0))
                        by_term[r.term_id] = a + r.file_count, b + r.hit_count
                ranks = {r.path: r.asDict() for r in evidence.withColumn("reasons", ranking.reasons()).collect()}  # a wave's files at most
                before, results = counts["results"], projected(hits, files).orderBy("result_id").toLocalIterator()
                r = next(results, None)
                for f in files.select("path").orderBy(F.split("path", "/")).collect():
                    while r is not None and r.path == f.path and not cancelled():
                        counts["results"] += 1
                        yield event("result", **(result_event(r) | {"resultId": before + r["result_id"]}))
                        r = next(results, None)
                    if cancelled():
                        reason = "cancelled"
                        break
                    counts["processed"] += 1
                    if f.path in ranks:
                        of = ranks[f.path]
                        yield event("fileRanked", path=f.path, quality=of["quality"], matchedTerms=of["matched_terms"], sameRowTerms=of["same_row_terms"], bodyEvidence=of["body_evidence"], distinctEvidence=of["distinct_evidence"], reasons=of["reasons"])
                    yield event("progress", phase="search", counts=dict(counts))
            finally:
                for df in held:
                    df.unpersist()
            if reason != "completed":
                break
        yield event("rankingSummary", files=list(waves.ranks(done)))
        yield event("executionSummary", extractedFiles=waves.extracted, reusedFiles=waves.reused)
        if isinstance(waves.spec, Batch):
            told = search.summary_of([(t, *n) for t, n in by_term.items()], waves.spec, counts["issues"], reason == "cancelled", spark)
            yield event("batchSummary", terms=[r.asDict() for r in told.orderBy("term_ord").collect()])
        yield event("finished", reason=reason, counts=dict(counts))
    except (Py4JJavaError, PySparkException):
        if not cancelled():
            raise
        yield event("finished", reason="cancelled", counts=dict(counts))  # its jobs were stopped
    finally:
        if waves:
            waves.close()
        if tag:
            spark.sparkContext.removeJobTag(tag)


__all__ = ["Result", "Session", "Waves", "condition_hits", "events", "projected", "result_event", "search_files"]
