"""The three query forms over ``units``: a plain term, boolean conditions over groups, a batch of terms.

Whether a unit holds a term is judged in the JVM for every standard search, over the fully folded text. Kind and range are native for
plain characters; only units with others (characters that fold to several, or compose) go to the exact matcher, and only where
they hold the term. Searches of many terms look for all of them at once, by an automaton over the folded text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import automaton
from textloom.functions import text as X
from textloom.functions.matcher import Term, exact_column, hits_column
from textloom.model import MATCH, SCORES
from textloom.operators import index
from textloom.plans.request import Batch, Conditions, NamedTerm, Scope
from textloom.session import reachable


def _by_term(terms: tuple[NamedTerm, ...], make) -> Column:
    """``make(term)`` of the row's own term: one branch is evaluated a row, each with patterns that are compiled once."""
    if len(terms) == 1:
        return make(terms[0].text)
    out = F
    for i, t in enumerate(terms):
        out = out.when(F.col("term_ord") == i, make(t.text))
    return out


def _named(terms: tuple[NamedTerm, ...], value) -> Column:
    return F.element_at(F.array(*(F.lit(value(t)) for t in terms)), F.col("term_ord") + 1)


def _tested(based: DataFrame, terms: tuple[NamedTerm, ...], every: tuple[NamedTerm, ...], identifiers: bool) -> tuple[DataFrame, Column, Column]:
    """A row for each term that a test of its own, in the JVM, finds in a text; and the kind and start that hold for plain texts."""
    text, base, usual = F.col("text"), F.col("_base"), F.col("_usual")
    if identifiers:
        has = [base.contains(X.fold_text(t.text)) & base.rlike(X.identifier(X.fold_text(t.text))) for t in every]
    else:
        has = [X.held(text, base, usual, t.text) for t in every]
    if len(every) == 1:
        each = based.where(has[0]).withColumn("term_ord", F.lit(0))
    else:
        each = based.withColumn("term_ord", F.explode(F.array_compact(F.array(*(F.when(h, F.lit(i)) for i, h in enumerate(has))))))
    if identifiers:
        return each, F.lit("identifier"), _by_term(terms, lambda t: X.at(base, X.identifier(X.fold_text(t))))
    each, kind = each.withColumn("_kind", _by_term(terms, lambda t: X.standard_kind(text, base, t))), F.col("_kind")
    return each, kind, _by_term(terms, lambda t: X.standard_start(text, base, t, kind))


def matched(units: DataFrame, terms: tuple[NamedTerm, ...], fuzzy: bool = False, identifiers: bool = False, excluded: tuple[NamedTerm, ...] = ()) -> DataFrame:
    """One row per unit and term that it holds: ``units``' columns, ``term_ord, term_id, term, hit``. No shuffle.

    ``excluded`` terms have ordinals after those of ``terms``; they are literal, and their ``hit`` is null.
    """
    spark, every = units.sparkSession, (*terms, *excluded)
    based = units.withColumns({"_usual": X.plain("text"), "_base": X.fold("text")})
    text, base, usual, term_ord = F.col("text"), F.col("_base"), F.col("_usual"), F.col("term_ord")
    if fuzzy and not identifiers:
        reachable(spark)
        likely = F.lit(False)  # whatever can't match isn't shown to Python
        for t in terms:
            likely = likely | index.possible("text", Term(t.text))
        for t in excluded:
            likely = likely | X.held(text, base, usual, t.text)
        based = based.where(likely)
        found = hits_column(text, [Term(t.text) for t in terms], True) if terms else F.array().cast("array<struct<term_ord:int,hit:struct<kind:string,category:string,score:int,start:int,end:int>>>")
        out = F.array_compact(F.array(*(F.when(X.held(text, base, usual, t.text), F.struct(F.lit(i).alias("term_ord"), F.lit(None).cast(MATCH).alias("hit"))) for i, t in enumerate(excluded, len(terms)))))
        each = based.withColumn("_m", F.explode(F.concat(found, out) if excluded else found)).withColumns({"term_ord": F.col("_m.term_ord"), "hit": F.col("_m.hit")}).drop("_m")
    else:
        reachable(spark)
        odd = [i for i, t in enumerate(terms) if X.overlaps(X.fold_text(t.text)) or X.overlaps(t.text)] if not identifiers else []
        if len(every) > automaton.MANY and automaton.ahocorasick is not None:
            found = automaton.found_column(text, base, usual, [X.fold_text(t.text) for t in every], [t.text for t in every], identifiers)
            each = based.withColumn("_m", F.explode(found)).withColumns({"term_ord": F.col("_m.term_ord"), "_kind": F.col("_m.kind"), "_at": F.col("_m.start")}).drop("_m")
            kind, start = F.col("_kind"), F.col("_at")
        else:
            each, kind, start = _tested(based, terms, every, identifiers)
        score = F.lit(None).cast("int")
        for k in ("substring", "identifier", "caseFolded", "exact"):
            score = F.when(kind == k, SCORES[k]).otherwise(score)
        easy = usual & ~term_ord.isin(odd) if odd else usual
        raw = _named(every, lambda t: t.text)
        each = each.withColumns({"_easy": easy, "_start": F.when(easy, start)})
        exact = exact_column(F.when(~F.col("_easy") & (term_ord < len(terms)), text), raw, identifiers)
        native = F.struct(kind.alias("kind"), F.lit("standard").alias("category"), score.alias("score"), F.col("_start").alias("start"), (F.col("_start") + _named(every, lambda t: len(X.fold_text(t.text)))).alias("end"))
        hit = F.when(F.col("_easy"), native).otherwise(exact)
        each = each.withColumn("hit", F.when(term_ord < len(terms), hit) if excluded else hit)
        if odd:  # only here can a term be held without a match
            each = each.where(~term_ord.isin(odd) | F.col("hit.kind").isNotNull())
    return each.select(*units.columns, "term_ord", _named(every, lambda t: t.id).alias("term_id"), _named(every, lambda t: t.text).alias("term"), "hit")


def plain(units: DataFrame, term: str, fuzzy: bool = False) -> DataFrame:
    """``units`` that match the term, with ``hit``: a filter and a projection, no shuffle."""
    return matched(units, (NamedTerm("query", Term(term).raw),), fuzzy).select(*units.columns, "hit")


def scope_key(scope: Scope) -> Column:
    row = F.col("file_type").isin("xlsx", "xlsm") & F.col("source_kind").isin("cell", "formula") & F.col("row").isNotNull()
    if scope is Scope.FILE:
        return F.lit("file")
    unit = F.concat(F.lit("unit:"), F.col("unit_seq"))
    return F.when(row, F.concat(F.lit("row:"), "part_key", F.lit(":"), "row")).otherwise(unit) if scope is Scope.EXCEL_ROW else unit


def evidence(units: DataFrame, terms: tuple[NamedTerm, ...], key: Column, fuzzy: bool = False, excluded: tuple[NamedTerm, ...] = ()) -> DataFrame:
    """``path, file_type, scope_key, term_ord, term_id, term, best``: each term's best unit in each group (score, then body, then first)."""
    each = matched(units.withColumn("scope_key", key), terms, fuzzy, excluded=excluded)
    rank = F.struct(F.col("hit.score").alias("score"), (F.col("content_class") == "body").cast("int").alias("body"), (-F.col("unit_seq")).alias("first"))
    best = F.struct("unit_seq", "source_kind", "text", "unit_key", "part_key", "group_key", "row", "content_class", "location", "document_order", "hit")
    return each.groupBy("path", "file_type", "scope_key", "term_ord", "term_id", "term").agg(F.max_by(best, rank).alias("best"))


def where(units: DataFrame, spec: Conditions, fuzzy: bool = False) -> DataFrame:
    """One row per group that meets the conditions: ``path, scope_key, evidence, category``.

    ``evidence`` lists the best units of all wanted terms in their order, then of the optional ones that match. Excluded
    terms are literal, never fuzzy, and judge the whole group. In file scope the file's name is part of the group. All terms
    are looked for in one pass over the units.
    """
    terms = (*spec.all, *spec.any)
    found = evidence(units, terms, scope_key(spec.scope), fuzzy, spec.none)
    n_all, n_terms = len(spec.all), len(terms)
    wanted = F.col("term_ord") < n_terms
    item = F.when(wanted, F.struct("term_ord", "term_id", "term", "best"))
    standard = F.col("best.hit.category") == "standard"
    groups = found.groupBy("path", "file_type", "scope_key").agg(
        F.sort_array(F.collect_list(item)).alias("evidence"),
        F.count(F.when(F.col("term_ord") < n_all, 1)).alias("n_all"),
        F.count(F.when((F.col("term_ord") >= n_all) & wanted, 1)).alias("n_any"),
        F.count(F.when(~wanted, 1)).alias("n_none"),
        F.count(F.when(standard & (F.col("term_ord") < n_all), 1)).alias("std_all"),
        F.count(F.when(standard & (F.col("term_ord") >= n_all) & wanted, 1)).alias("std_any"),
    )
    groups = groups.where((F.col("n_all") == n_all) & (F.lit(not spec.any) | (F.col("n_any") > 0)) & (F.col("n_none") == 0))
    plain_too = (F.col("std_all") == n_all) & (F.lit(not spec.any) | (F.col("std_any") > 0))
    return groups.select("path", "file_type", "scope_key", "evidence", F.when(plain_too, "standard").otherwise("fuzzy").alias("category"))


def terms_by_row(units: DataFrame, terms: tuple[NamedTerm, ...]) -> DataFrame:
    """``path, part_key, row, n``: how many of the terms each sheet row holds, if any."""
    cells = units.where(F.col("source_kind").isin("cell", "formula") & F.col("row").isNotNull())
    return matched(cells, terms).groupBy("path", "part_key", "row").agg(F.countDistinct("term_ord").alias("n"))


def same_row_terms(units: DataFrame, terms: tuple[NamedTerm, ...]) -> DataFrame:
    """``path, same_row_terms``: most different terms in one sheet row, if more than one."""
    return terms_by_row(units, terms).where("n > 1").groupBy("path").agg(F.max("n").alias("same_row_terms"))


def term_table(spark: SparkSession, batch: Batch) -> DataFrame:
    """The terms of a batch, at most 256."""
    return spark.createDataFrame([(i, t.id, t.text) for i, t in enumerate(batch.terms)], "term_ord int, term_id string, term string")


def batch_hits(units: DataFrame, batch: Batch, fuzzy: bool = False) -> DataFrame:
    """One row per unit and matching term: the terms (256 at most) are literals of one projection, so units aren't joined."""
    return matched(units, batch.terms, fuzzy, batch.identifiers)


def batch_counts(hits: DataFrame) -> DataFrame:
    """``term_id, file_count, hit_count`` of the terms that have hits."""
    by_file = hits.groupBy("term_id", "path").agg(F.count(F.lit(1)).alias("n"))
    return by_file.groupBy("term_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("n").alias("hit_count"))


def batch_summary(hits: DataFrame, batch: Batch, issues: int = 0, cancelled: bool = False) -> DataFrame:
    """``term_ord, term_id, term, file_count, hit_count, status`` of every term, zero-hit ones included."""
    return _summary(batch_counts(hits), batch, issues, cancelled)


def summary_of(counts: list[tuple[str, int, int]], batch: Batch, issues: int, cancelled: bool, spark: SparkSession) -> DataFrame:
    """The same from counts ``term_id, file_count, hit_count`` that were summed before."""
    return _summary(spark.createDataFrame(counts, "term_id string, file_count long, hit_count long"), batch, issues, cancelled)


def _summary(counts: DataFrame, batch: Batch, issues: int, cancelled: bool) -> DataFrame:
    status = "未確定（中断）" if cancelled else "未確定（一部エラーあり）" if issues else "確認完了"
    n = F.coalesce("hit_count", F.lit(0))
    told = F.when((n == 0) & F.lit(status == "確認完了"), "指定範囲内で該当なし").otherwise(status)
    terms = F.broadcast(term_table(counts.sparkSession, batch)).select("term_ord", "term_id", "term")
    return terms.join(counts, "term_id", "left").select("term_ord", "term_id", "term", F.coalesce("file_count", F.lit(0)).alias("file_count"), n.alias("hit_count"), told.alias("status"))
