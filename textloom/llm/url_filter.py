"""URL filters: rules by host and path, and a character language-model ratio for the URLs that no rule fits.

The URLs that the rules allow and block are the accepted and rejected examples. Each URL becomes a key over a small alphabet
(host and path in lower case, every digit 0, anything else unusual ``?``), so that millions of pages share few keys; all
counts are taken over all pages. Two variable-order Markov models of up to ``ORDER`` symbols, smoothed by Witten-Bell
interpolation, give each gram a log-likelihood difference, kept as whole millionths so that sums don't depend on their
order. A URL's score is the mean difference per symbol; the cut is calibrated on a fifth of the labelled keys, which the
models haven't seen: midway between the two neighbouring grid cells that split it best (the sum of both kinds' shares).

Everything is DataFrame code. Gram tables are bounded by the alphabet (at most 40 ** 4 rows), whatever the number of pages.

Cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by its end symbol alone; empty
tables give empty results; without held-back examples of both kinds the cut is 0; repeated rows are judged alike; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._store import Scratch, small

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER, SYMBOLS, MICRO = 4, 40, 1_000_000
#: The cut's grid: hundredths of a nat.
CELL = 10_000


def parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(F.split_part(F.split_part(rest, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit(""))
    slash = F.instr(rest, "/")
    name = F.when(slash > 0, F.substring(rest, F.lit(1), slash - 1)).otherwise(rest)
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.when(slash > 0, F.substring(rest, slash, F.length(rest))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{tail}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def grams(keys: DataFrame) -> DataFrame:
    """``keys`` with a row ``g`` for each symbol and its context."""
    padded = F.concat(F.lit("^" * (ORDER - 1)), "key", F.lit("$"))
    at = F.explode(F.sequence(F.lit(1), F.length("key") + 1)).alias("i")
    return keys.select("*", at).withColumn("g", F.substring(padded, F.col("i"), F.lit(ORDER))).drop("i")


def ratios(counts: DataFrame) -> DataFrame:
    """``g, na, nr`` → ``g, micro``: millionths of the log-likelihood difference of the gram's last symbol after the others."""
    p: DataFrame | None = None
    for k in range(1, ORDER + 1):
        g = F.expr(f"right(g, {k})")
        level = counts.groupBy(g.alias("g")).agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
        after = Window.partitionBy(F.expr(f"left(g, {k - 1})"))  # at most SYMBOLS rows
        level = level.select("*", *(f(x).over(after).alias(f"{t}{x}") for x in ("na", "nr") for t, f in (("t", F.sum), ("d", lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))))))
        if p is None:
            level = level.withColumns({"pa": F.lit(1.0 / SYMBOLS), "pr": F.lit(1.0 / SYMBOLS)})
        else:
            level = level.withColumn("low", F.expr(f"right(g, {k - 1})")).join(p.withColumnRenamed("g", "low"), "low")
        mixed = lambda n, q: F.when(F.col(f"t{n}") > 0, (F.col(n) + F.col(f"d{n}") * F.col(q)) / (F.col(f"t{n}") + F.col(f"d{n}"))).otherwise(F.col(q))
        p = level.select("g", mixed("na", "pa").alias("pa"), mixed("nr", "pr").alias("pr"))
    return p.select("g", F.round((F.log("pa") - F.log("pr")) * MICRO).cast("long").alias("micro"))


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score, cut`` for every row; scores and cuts in grid cells of 0.01 nats a symbol."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = parts("url")
    cut = urls.select("page_id", host.alias("host"), path.alias("path"))
    ruled = cut.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allows = F.col("rule").isin([r for v, r in rules if v == "allow"])
    lower = F.translate(F.concat("host", "path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    ruled = ruled.withColumn("key", F.regexp_replace(lower, "[^a-z0/._~%-]", "?"))

    keys = ruled.groupBy("key").agg(F.sum(F.when(allows, 1).otherwise(0)).alias("na"), F.sum(F.when(F.col("rule").isNotNull() & ~allows, 1).otherwise(0)).alias("nr"))
    keys = scratch.save(keys.withColumn("held", F.substring(F.md5("key"), 1, 1).isin("0", "1", "2")), "keys")
    learned = lambda c: F.sum(F.when(F.col("held"), 0).otherwise(F.col(c))).alias(c)
    table = scratch.save(ratios(grams(keys).groupBy("g").agg(learned("na"), learned("nr"))), "ratios")
    scores = grams(keys).join(small(table), "g").groupBy("key", "na", "nr", "held").agg(F.sum("micro").alias("total"), F.count(F.lit(1)).alias("n"))
    scores = scratch.save(scores.select("key", "na", "nr", "held", F.floor(F.col("total") / (F.col("n") * CELL)).cast("long").alias("score")), "scores")

    cells = scores.where("held and (na > 0 or nr > 0)").groupBy("score").agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
    up = Window.orderBy("score")  # a row for each grid cell
    told = cells.select("score", F.lag("score").over(up).alias("below"), F.sum("nr").over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("low"), F.sum("na").over(up.rowsBetween(0, Window.unboundedFollowing)).alias("high"), F.sum("na").over(Window.partitionBy()).alias("all_a"), F.sum("nr").over(Window.partitionBy()).alias("all_r"))
    right = F.col("high") * F.col("all_r") + F.coalesce("low", F.lit(0)) * F.col("all_a")
    best = told.where("all_a > 0 and all_r > 0").select(F.ceil((F.col("score") + F.coalesce("below", "score")) / 2).cast("long").alias("at"), right.alias("right")).orderBy(F.desc("right"), F.abs("at"), "at").limit(1).collect()
    at = int(best[0]["at"]) if best else 0

    met = ruled.join(small(scores.select("key", "score")), "key", "left")
    verdict = F.when(allows, "allow").when(F.col("rule").isNotNull(), "block").when(F.col("score") >= at, "allow").otherwise("block")
    return met.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(at).cast("long").alias("cut"))
