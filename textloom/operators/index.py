"""The optional n-gram and token index: it only prunes, a matcher always judges what it leaves.

An index is a few segments under a manifest (``segments``). A segment holds the units of files that were new or changed, numbered; posting
blocks of their grams and tokens (``postings``); the files' stamps; and tombstones of files that are gone. A file's rows are those of
its newest segment. Segments are merged in tiers, so there are never more than the logarithm of the index's size.
"""

from __future__ import annotations

from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import model
from textloom.functions import forms, matcher
from textloom.functions import text as X
from textloom.functions.matcher import Term
from textloom.model import EXTRACTION_VERSION, INDEX_VERSION
from textloom.operators import postings
from textloom.operators.segments import GRACE, LARGEST, Manifest, Segment, Store, due
from textloom.session import Scratch, reachable, remove

#: Largest side that is broadcast, in bytes of its rows.
BROADCAST_BYTES = 32 << 20
#: Zones with candidates up to which the scan of units is told of them.
FEW_ZONES = 256
_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("file_type", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified_ns", T.LongType()), T.StructField("version", T.IntegerType()), T.StructField("scope", T.IntegerType()), T.StructField("gone", T.BooleanType())])
_POSTING = T.StructType([*postings.POSTING.fields, T.StructField("bucket", T.IntegerType())])
NUMBERED = T.StructType([*model.UNIT.fields, T.StructField("unit_no", T.LongType())])


def scope_bits(notes: bool, formulas: bool) -> int:
    return int(notes) | int(formulas) << 1


def grams_of(units: DataFrame) -> DataFrame:
    """``path, unit_seq, n, gram``: distinct 2- and 3-grams of each unit's loose form."""
    held = units.select("path", "unit_seq", X.loose("text").alias("loose"))
    return held.select("path", "unit_seq", F.explode(F.concat(X.grams("loose", 2), X.grams("loose", 3))).alias("gram")).select("path", "unit_seq", F.length("gram").alias("n"), "gram")


def _words(text: Column, spark: SparkSession, exact: bool = True) -> Column:
    """The distinct tokens of a text; ``exact``: of all scripts, texts with characters that fold to several by the Python function."""
    if not exact:
        return F.array_distinct(X.tokens(text))
    reachable(spark)
    other = text.rlike(X.UNTOKENED)
    return F.when(other, matcher.tokens_column(F.when(other, text))).otherwise(F.array_distinct(X.tokens_of_scripts(text)))


def tokens_of(units: DataFrame, exact: bool = True) -> DataFrame:
    """``path, unit_seq, token, first, length``."""
    words = _words(F.col("text"), units.sparkSession, exact)
    return units.select("path", "unit_seq", F.explode(words).alias("token")).select("path", "unit_seq", "token", F.substring("token", 1, 1).alias("first"), F.length("token").alias("length"))


def root(folder: str) -> str:
    return f"{folder}/v{INDEX_VERSION}"


def write(units: DataFrame, files: DataFrame, sheets: DataFrame, store: Store, segment: int, ordered: bool = False) -> int:
    """One segment, which counts when a manifest names it; what a killed writer left there is overwritten. Returns its size.

    ``ordered``: the units of a file come together and in order, so that they needn't be shuffled.
    """
    at = store.folder(segment)
    spark = units.sparkSession
    dealt = units.select(*model.UNIT.names)
    if not ordered:
        dealt = dealt.repartitionByRange("path", "unit_seq").sortWithinPartitions("path", "unit_seq")
    held = _write_units(dealt.withColumn("unit_no", F.monotonically_increasing_id()), at)
    n = held.count()
    postings.write(held, f"{at}/postings", n)
    return n + _write_rest(files, sheets, at)


def _write_units(numbered: DataFrame, at: str) -> DataFrame:
    # As many blocks of rows as zones, so that the few units of a look-up are a small part of a file.
    numbered.write.mode("overwrite").option("parquet.block.size", str(8 << 20)).option("compression", "zstd").parquet(f"{at}/units")
    return numbered.sparkSession.read.schema(NUMBERED).parquet(f"{at}/units")


def _write_rest(files: DataFrame, sheets: DataFrame, at: str) -> int:
    """Sheets and files of a segment; how many tombstones it has."""
    sheets.select(*model.SHEET.names).write.mode("overwrite").parquet(f"{at}/sheets")
    files.select(*_FILE.names).write.mode("overwrite").parquet(f"{at}/files")
    return files.sparkSession.read.schema(_FILE).parquet(f"{at}/files").where("gone").count()


def joined(of: Index, merged: list[Segment], units: DataFrame, files: DataFrame, sheets: DataFrame, segment: int) -> tuple[int, int] | None:
    """The segments ``merged`` as one whose units keep their order and whose postings are copied: zones get new numbers, no text is cut
    again. Returns its size and stale units; None, before postings are written, if more of them would be stale than live.

    Postings of units that are gone stay until then: a page that holds none of the others is found and its units aren't there.
    """
    at, zone = of.store.folder(segment), 1 << postings.PAGE_BITS + postings.ZONE_BITS
    ids = [s.id for s in merged]
    own = of._table("units", NUMBERED).where(F.col("segment").isin(ids)).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max("unit_no").alias("last"))
    told, base, before = {r.segment: r for r in own.collect()}, {}, 0  # a row for each segment
    for i in ids:
        base[i] = before
        before += (told[i].last // zone + 1) * zone if i in told else 0
    first = F.element_at(F.create_map(*(F.lit(x) for i in ids for x in (i, base[i]))), F.col("segment")).cast("long")
    held = _write_units(units.withColumn("unit_no", F.col("unit_no") + first).select(*NUMBERED.names).sortWithinPartitions("unit_no"), at)
    live = held.count()
    stale = sum(s.stale for s in merged) + sum(r.n for r in told.values()) - live
    if stale > live:
        return None
    there = held.select(F.shiftright("unit_no", postings.PAGE_BITS + postings.ZONE_BITS).alias("zone")).distinct()
    blocks = of.postings().where(F.col("segment").isin(ids)).withColumn("zone", F.col("zone") + F.shiftright(first, postings.PAGE_BITS + postings.ZONE_BITS))
    postings.copy(blocks.join(F.broadcast(there), "zone", "left_semi") if stale else blocks, f"{at}/postings", live + stale)  # a row for each 65,536 units
    return live + _write_rest(files, sheets, at), stale


class Index:
    """An index as one manifest names it; it stays readable while others are written, for the grace time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, root(folder))
        self.manifest = self.store.read() or Manifest()
        self._dead: tuple[DataFrame, int, int] | None = None

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        """A table of all live segments, with the number of each."""
        out = None
        for s in self.manifest.segments:  # a few, by the tiers
            one = self.spark.read.schema(schema).parquet(f"{self.store.folder(s.id)}/{name}").withColumn("segment", F.lit(s.id))
            out = one if out is None else out.union(one)
        return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("segment", T.IntegerType())])) if out is None else out

    def latest(self) -> DataFrame:
        """Each file's last state, gone ones included, with the segment that tells it. Newer segments have higher numbers."""
        every = self._table("files", _FILE)
        return every.groupBy("path").agg(F.max_by(F.struct(*(c for c in every.columns if c != "path")), "segment").alias("f")).select("path", "f.*")

    def files(self) -> DataFrame:
        """The live files, with the ``segment`` that holds their rows."""
        return self.latest().where("not gone")

    def _live(self, name: str, schema: T.StructType) -> DataFrame:
        """A table without the rows of files that a newer segment tells anew, or that are gone."""
        if self._dead is None:
            every = self._table("files", _FILE).select("path", "segment")
            dead = every.join(self.files().select("path", "segment"), ["path", "segment"], "left_anti")
            dead = Scratch(self.spark, "dead").save(dead, "dead")
            n, chars = dead.agg(F.count(F.lit(1)), F.sum(F.octet_length("path"))).first()
            self._dead = dead, n, 64 * n + (chars or 0)
        dead, n, size = self._dead
        rows = self._table(name, schema)
        if not n:
            return rows
        return rows.join(F.broadcast(dead) if size <= BROADCAST_BYTES else dead, ["path", "segment"], "left_anti")

    def units(self) -> DataFrame:
        return self._live("units", NUMBERED).select(*model.UNIT.names)

    def sheets(self) -> DataFrame:
        return self._live("sheets", model.SHEET).drop("segment")

    def postings(self) -> DataFrame:
        return self._table("postings", _POSTING)

    def file_units(self, path: str) -> DataFrame:
        """All units of one file, in their order: the filter reaches the scan."""
        return self.units().where(F.col("path") == path).orderBy("unit_seq")

    def pages(self, term: Term) -> DataFrame | None:
        """``segment, page`` that can hold a candidate of a fuzzy search; None if the index can't tell."""
        wanted = wanted_grams(term)
        if not wanted:
            return None
        blocks = self.postings()
        found = postings.holding_all(blocks, wanted)
        if len(term.tokens) == 1 or term.typo:
            firsts = [*(t[0] for t in term.tokens if t), *(term.typo or "")[:1]]
            found = found.union(postings.holding_any(blocks, firsts, _token_test(term, F.col("key"), F.substring("key", 1, 1), F.length("key"))))
        return found.distinct()

    def candidates(self, term: Term) -> DataFrame:
        """Units that can match: the units of the pages found, judged one by one by the same test as ``candidate``. Terms without
        grams, or with separators, keep all units."""
        pages = self.pages(term)
        if pages is None:
            return self.units()
        pages = Scratch(self.spark, "pages").save(pages, "pages")
        zones = pages.select("segment", F.shiftright("page", postings.ZONE_BITS).alias("zone")).distinct().limit(FEW_ZONES + 1).collect()
        units = self._live("units", NUMBERED).withColumn("page", F.shiftright("unit_no", postings.PAGE_BITS))
        if len(zones) <= FEW_ZONES:  # then the scan reads these zones' blocks of rows alone
            size = postings.PAGE_BITS + postings.ZONE_BITS
            near = F.lit(False)
            for segment, first, last in _runs(sorted((r.segment, r.zone) for r in zones)):
                near = near | ((F.col("segment") == segment) & F.col("unit_no").between(first << size, ((last + 1) << size) - 1))
            units = units.where(near)
        held = units.join(F.broadcast(pages) if 64 * pages.count() <= BROADCAST_BYTES else pages, ["segment", "page"], "left_semi")
        # Few texts have characters that only Python cuts into tokens; the others aren't shown to it.
        odd = F.col("text").rlike(X.UNTOKENED)
        usual = held.where(~odd).where(_test(term, X.loose("text"), X.tokens_of_scripts("text"), _may_have_token(term)))
        other = held.where(odd).where(_test(term, X.loose("text"), matcher.tokens_column(F.col("text"))))
        reachable(self.spark)
        return usual.unionByName(other).select(*model.UNIT.names)


def _runs(zones: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Segment, first and last zone of each run of neighbours."""
    out: list[tuple[int, int, int]] = []
    for s, z in zones:
        if out and out[-1][0] == s and out[-1][2] == z - 1:
            out[-1] = (s, out[-1][1], z)
        else:
            out.append((s, z, z))
    return out


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    return Index(spark, folder).files()


def clear(spark: SparkSession, folder: str) -> None:
    remove(spark, root(folder))


def commit(spark: SparkSession, folder: str, units: DataFrame, files: DataFrame, sheets: DataFrame, stream: tuple[str, int] | None = None, ordered: bool = False) -> Manifest:
    """Adds a segment and swaps the manifest; ``stream``: a micro-batch's stream and number, noted by the same swap. ``ordered``: see ``write``."""
    store = Store(spark, root(folder))
    now = store.read() or Manifest()
    new = now.with_segment(write(units, files, sheets, store, now.next, ordered))
    if stream:
        new = replace(new, batches=now.batches | dict([stream]))
    return store.commit(new)


def compact(spark: SparkSession, folder: str, grace: float = GRACE, largest: int = LARGEST) -> Manifest:
    """Merges the newest segments until each is at least twice the next, and removes what was replaced before the grace time.

    Only live rows are copied; postings are copied, too, and made anew where most of them would be stale. A tombstone stays while an older
    segment holds its file.
    """
    store = Store(spark, root(folder))
    while True:
        of = Index(spark, folder)
        m = of.manifest
        at = due([s.size for s in m.segments], largest)
        if at is None:
            return store.sweep(m, grace)
        merged = [s.id for s in m.segments[at:]]
        latest = of.latest().where(F.col("segment").isin(merged))
        older = of._table("files", _FILE).where(~F.col("segment").isin(merged)).select("path").distinct()
        files = latest.where("not gone").union(latest.where("gone").join(older, "path", "left_semi"))
        part = lambda name, schema: of._live(name, schema).where(F.col("segment").isin(merged))
        units, sheets = part("units", NUMBERED), part("sheets", model.SHEET)
        done = joined(of, m.segments[at:], units, files, sheets, m.next)
        size, stale = done or (write(units, files, sheets, store, m.next), 0)
        store.commit(m.with_segment(size, tuple(merged), stale=stale))


def refresh(spark: SparkSession, folder: str, files: DataFrame, extract, bits: int, again=None) -> tuple[DataFrame, DataFrame, int, int, list[DataFrame]]:
    """Brings an index up to date with the listing ``files``; returns units and issues of all of them, how many were extracted and
    reused, and the frames that it keeps in memory.

    ``extract(files)`` gives units, sheets and issues. Files with issues, and files whose size or time in ``again()``, a listing
    made after they were read, differs, aren't cached: the next search reads them again. A damaged index is dropped and
    made anew; folders of other versions are never read.
    """
    held = Index(spark, folder) if sound(spark, folder) else None
    if held is None:
        for old in range(1, INDEX_VERSION + 1):  # what earlier versions wrote is never read again
            remove(spark, f"{folder}/v{old}")
        held = Index(spark, folder)
    live = held.files()
    told = freshness(files, live, bits).persist()
    stale, reused = told.where("not reuse").drop("reuse"), told.where("reuse").drop("reuse")
    n_stale, n_reused = told.agg(F.count_if(~F.col("reuse")), F.count_if("reuse")).first()
    units, sheets, issues = extract(stale)
    units, issues = units.persist(), issues.persist()
    gone = tombstones(missing(live, files))
    clean = stale.join(issues.select("path").distinct(), "path", "left_anti")
    if again is not None:
        units.count(), issues.count()  # the files are read before they are listed again
        clean = clean.join(again().select("path", "size", "modified_ns"), ["path", "size", "modified_ns"], "left_semi")
    fresh_ = clean.select("path", "file_type", "size", "modified_ns", F.lit(EXTRACTION_VERSION).alias("version"), F.lit(bits).alias("scope"), F.lit(False).alias("gone"))
    # Rows of a file that is read again but not cached would be an old version's.
    lost = tombstones(live.join(stale.select("path"), "path", "left_semi").join(clean.select("path"), "path", "left_anti"))
    # The segments that are read below stay for the grace time, whatever is merged.
    stored = held.units().join(reused.select("path"), "path", "left_semi") if n_reused else units.limit(0)
    state = fresh_.union(gone).union(lost).persist()
    if state.limit(1).count():
        keep = clean.select("path")
        commit(spark, folder, units.join(keep, "path", "left_semi"), state, sheets.join(keep, "path", "left_semi"))
        compact(spark, folder)
    state.unpersist()
    return units.unionByName(stored), issues, n_stale, n_reused, [told, units, issues]


def sound(spark: SparkSession, folder: str) -> bool:
    """Whether the index is there and can be read."""
    try:
        of = Index(spark, folder)
        of.files().count(), of.units().limit(1).count()
        return of.manifest.version > 0
    except (PySparkException, Py4JJavaError, ValueError):
        return False


def tombstones(live: DataFrame) -> DataFrame:
    return live.select("path", "file_type", "size", "modified_ns", "version", "scope", F.lit(True).alias("gone"))


def wanted_grams(term: Term, fuzzy: bool = True) -> list[str]:
    """The grams that every match of a term holds, at most three; none for standard searches and terms with separators."""
    n = 3 if len(term.loose) >= 3 else 2
    wanted = [] if not fuzzy or any(forms.separator(c) for c in term.loose) else [term.loose[i : i + n] for i in range(len(term.loose) - n + 1)]
    return list(dict.fromkeys(wanted))[:3]


def _token_test(term: Term, token, first, length, measured: bool = False) -> Column:
    """Whether a token makes its unit a candidate: the term's own, one that it begins, or one a typing error away (``measured``: by its
    distance, not by its length alone)."""
    ok = F.lit(False)
    if len(term.tokens) == 1:
        one = term.tokens[0]
        ok = ok | (token == one) | (F.lit(len(one) >= 3) & token.startswith(one))
    if term.typo:
        near = (first == term.typo[0]) & length.between(len(term.typo) - term.edits, len(term.typo) + term.edits)
        ok = ok | (near & (F.levenshtein(token, F.lit(term.typo), term.edits) >= 0) if measured else near)
    return ok


def _may_have_token(term: Term) -> Column:
    """A cheap test that every text passes which has a token of the term or one a typing error away and none of ``X.UNTOKENED``.

    A token begins after what is no letter or number, with a capital, or after a digit; ß counts as two characters in it.
    """
    text, ok = F.col("text"), F.lit(False)
    if len(term.tokens) == 1:
        ok = ok | X.width("text").contains(term.tokens[0])
    if term.typo:
        c, n = term.typo[0], len(term.typo) - term.edits - 1
        longer = lambda least: text.rlike(f"(?:(?<![{X.WORD}])[{c}{c.upper()}]|{c.upper()}|(?<=[0-9]){c})[{X.WORD}]{{{least}}}")
        ok = ok | F.when(text.contains("ß"), longer((n + 1) // 2)).otherwise(longer(n))
    return ok


def _test(term: Term, loose: Column, words: Column, first: Column | None = None) -> Column:
    """Whether a unit has the first three grams of the term, or its token, or one a typing error away; tokens are looked at where
    ``first`` holds."""
    ok = F.lit(True)
    for g in wanted_grams(term):
        ok = ok & loose.contains(g)
    if len(term.tokens) == 1 or term.typo:
        has = F.exists(words, lambda t: _token_test(term, t, F.substring(t, 1, 1), F.length(t)))
        ok = ok | (has if first is None else F.when(first, has).otherwise(F.lit(False)))
    return ok


def candidate(text: str, term: Term, fuzzy: bool = True) -> Column:
    """Whether a unit can match, judged on its text without an index: the same test as ``Index.candidates``, for ASCII tokens. Standard
    searches, and terms without grams or with separators, keep all units."""
    return _test(term, X.loose(text), X.tokens(text)) if wanted_grams(term, fuzzy) else F.lit(True)


def possible(text: str, term: Term) -> Column:
    """Whether a text of any script can have a fuzzy match: as ``candidate``, but the distance of typing errors is measured. Texts with
    characters that only Python cuts into tokens, and all texts of terms without grams or with separators, can."""
    if not wanted_grams(term):
        return F.lit(True)
    ok = F.col(text).rlike(X.UNTOKENED)
    grams = F.lit(True)
    for g in wanted_grams(term):
        grams = grams & X.loose(text).contains(g)
    ok = ok | grams
    if len(term.tokens) == 1 or term.typo:
        has = F.exists(X.tokens_of_scripts(text), lambda t: _token_test(term, t, F.substring(t, 1, 1), F.length(t), measured=True))
        ok = ok | F.when(_may_have_token(term), has).otherwise(F.lit(False))
    return ok


def freshness(files: DataFrame, indexed: DataFrame, bits: int) -> DataFrame:
    """``files`` with ``reuse``: whether the index holds this size, time, extraction version and scope."""
    held = indexed.select("path", F.col("size").alias("i_size"), F.col("modified_ns").alias("i_ns"), F.col("version").alias("i_version"), F.col("scope").alias("i_scope"))
    same = (F.col("size") == F.col("i_size")) & (F.col("modified_ns") == F.col("i_ns")) & (F.col("i_version") == EXTRACTION_VERSION) & (F.col("i_scope") == bits)
    return files.join(held, "path", "left").select(*files.columns, F.coalesce(same, F.lit(False)).alias("reuse"))


def missing(indexed: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed files that are gone."""
    return indexed.join(files, "path", "left_anti")


def cacheable(units: DataFrame, issues: DataFrame) -> DataFrame:
    """Units of files that were read without an issue: only these may be indexed."""
    return units.join(issues.select("path").distinct(), "path", "left_anti")
