"""File ranking from hits, and the views on results: order, filters, roll-ups, pages."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.session import numbered


def file_evidence(hits: DataFrame, same_row: DataFrame | None = None) -> DataFrame:
    """``path, quality, matched_terms, same_row_terms, body_evidence, distinct_evidence`` from ``path, term_key, score, part_key,
    unit_key, row, content_class, source_kind``: one row per file.

    One pass over the hits: each counts for its term, its place and (in sheets) its row. ``same_row(path, same_row_terms)`` has counts
    over all units of a file, where hits are only its evidence; the larger count holds.
    """
    nothing = F.lit(None).cast("string")
    in_row = F.col("source_kind").isin("cell", "formula") & F.col("row").isNotNull()
    as_ = lambda kind, a, b, term: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), term.alias("t"))
    views = F.array_compact(F.array(as_("term", F.col("term_key"), nothing, nothing), as_("place", F.col("part_key"), F.col("unit_key"), nothing), F.when(in_row, as_("row", F.col("part_key"), F.col("row").cast("string"), F.col("term_key")))))
    each = hits.select("path", F.col("score").alias("score"), (F.col("content_class") == "body").cast("int").alias("body"), F.explode(views).alias("v")).select("path", "score", "body", "v.*")
    each = each.groupBy("path", "kind", "a", "b", "t").agg(F.max("score").alias("score"), F.max("body").alias("body"))
    each = each.groupBy("path", "kind", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"), F.max("body").alias("body"))
    of = lambda kind, c=F.lit(1): F.when(F.col("kind") == kind, c)
    told = each.groupBy("path").agg(
        F.min(of("term", F.col("score"))).alias("quality"),
        F.count(of("term")).alias("matched_terms"),
        F.max(of("row", F.col("n"))).alias("most"),
        F.least(F.sum(of("place", F.col("body"))), F.lit(5)).alias("body_evidence"),
        F.least(F.count(of("place")), F.lit(5)).alias("distinct_evidence"),
    )
    most = F.when(F.col("most") > 1, F.col("most"))
    if same_row is not None:
        told = told.join(same_row.select("path", F.col("same_row_terms").alias("over_all")), "path", "left")
        most = F.greatest(most, "over_all")
    return told.select("path", "quality", "matched_terms", F.coalesce(most, F.lit(0)).alias("same_row_terms"), "body_evidence", "distinct_evidence")


def reasons() -> Column:
    return F.array_compact(
        F.array(
            F.concat(F.col("matched_terms"), F.lit("語に一致")),
            F.when(F.col("same_row_terms") > 1, F.concat(F.lit("同じ行で"), F.col("same_row_terms"), F.lit("語に一致"))),
            F.when(F.col("body_evidence") > 0, F.lit("本文に根拠あり")),
        )
    )


def ranked(hits: DataFrame, same_row: DataFrame | None = None) -> DataFrame:
    """Files by quality, terms, same-row terms, body places, places, folded path, path."""
    return in_order(file_evidence(hits, same_row)).withColumn("reasons", reasons())


def in_order(evidence: DataFrame) -> DataFrame:
    """``file_evidence`` with ``file_rank``."""
    order = [F.desc(c) for c in ("quality", "matched_terms", "same_row_terms", "body_evidence", "distinct_evidence")]
    return numbered(evidence.withColumn("_folded", X.fold("path")), [*order, F.asc("_folded"), F.asc("path")], "file_rank").drop("_folded")


def in_file_order(hits: DataFrame) -> DataFrame:
    """The rank of each hit within its file: place in the document, term, unit key, result."""
    return hits.withColumn("rank_in_file", F.row_number().over(Window.partitionBy("path").orderBy("document_order", "term_id", "unit_key", "unit_seq")))


def with_result_ids(hits: DataFrame) -> DataFrame:
    """Ordinals over all hits by path components, unit and term. Counts per file are summed first, so that only files, never
    hits, are put in one order."""
    files = hits.groupBy("path").agg(F.count(F.lit(1)).alias("_n")).withColumn("_parts", F.split("path", "/"))
    before = numbered(files, [F.asc("_parts")], "_b", "_n").select("path", "_b")
    rank = F.row_number().over(Window.partitionBy("path").orderBy("unit_seq", "term_id"))
    return hits.withColumn("_k", rank).join(before, "path").withColumn("result_id", F.col("_b") + F.col("_k")).drop("_b", "_k")


def result_types(hits: DataFrame) -> DataFrame:
    """``file_type`` of the results, each once, in order."""
    return hits.select("file_type").distinct().orderBy("file_type")


def filter_summary(hits: DataFrame, **filters: str) -> DataFrame:
    """``files, hits, all_files, all_hits``: what a filter leaves, and what there is without it."""
    told = hits.select("path", keeps(**filters).alias("kept"))
    by_file = told.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_file.agg(F.count_if(F.col("k") > 0).alias("files"), total("k").alias("hits"), F.count(F.lit(1)).alias("all_files"), total("n").alias("all_hits"))


def without_edited(hits: DataFrame, edited: DataFrame) -> DataFrame:
    """Hits of files that weren't edited since: the others' places no longer hold."""
    return hits.join(edited.select("path").distinct(), "path", "left_anti")


def compared(old: DataFrame, new: DataFrame, first: int = 5) -> DataFrame:
    """``rank, old_path, new_path`` of the first files of two rankings."""
    top = lambda df, name: df.where(F.col("file_rank") <= first).select(F.col("file_rank").alias("rank"), F.col("path").alias(name))
    return top(old, "old_path").join(top(new, "new_path"), "rank", "full")


def keeps(path: str = "", file_type: str = "", include: str = "", exclude: str = "", sheet: str = "") -> Column:
    """Whether a hit passes filters on parts of path, preview and sheet name, composed and in lower case."""
    has = lambda c, t: F.lower(X.composed(c)).contains(unicodedata.normalize("NFC", t).lower())
    ok = F.lit(True)
    if file_type:
        ok = ok & (F.lower("file_type") == file_type.lower())
    if path:
        ok = ok & has(F.col("path"), path)
    if sheet:
        ok = ok & F.lower("file_type").isin("xlsx", "xlsm") & has(F.get_json_object("location", "$.sheetName"), sheet)
    if include:
        ok = ok & has(F.col("preview"), include)
    if exclude:
        ok = ok & ~has(F.col("preview"), exclude)
    return ok


def filtered(hits: DataFrame, **filters: str) -> DataFrame:
    """The hits that ``keeps`` lets pass."""
    return hits.where(keeps(**filters))


def parent(path: Column | str) -> Column:
    return F.regexp_replace(X.col(path), "/[^/]*$", "")


def by_directory(hits: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """``directory, files, hits, errors``."""
    files = hits.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    bad = issues.select("path").distinct().withColumn("bad", F.lit(1)) if issues is not None else None
    files = files.join(bad, "path", "left") if bad is not None else files.withColumn("bad", F.lit(None).cast("int"))
    return files.groupBy(parent("path").alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("hits"), F.count("bad").alias("errors"))


def page(df: DataFrame, order: list, number: int, size: int = 200) -> DataFrame:
    """The ``number``-th page (from 0) of a total order: a top-k, not a full sort."""
    return df.orderBy(*order).offset(number * size).limit(size)


def matrix(hits: DataFrame, terms: DataFrame, files: list[str]) -> DataFrame:
    """Hits by term and file, zero-filled, for the files of a report (a column each) in their order."""
    return terms.join(hits.groupBy("term_id").pivot("path", files).agg(F.count(F.lit(1))), "term_id", "left").na.fill(0, files)
