"""Words a typing error away, for many words at once: a join of deletion neighbourhoods.

Two words are at most k edits apart only if deleting at most k characters from each can make them equal. So each side is entered
under what such deletions leave, the sides meet by equality, and the distance is taken of the pairs that met. As a match has the
same first character, that one is never deleted, which keeps neighbourhoods small and spreads them. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rule: shortest word, shortest word that may have two errors, and characters to an error.
LEAST, LONG, SHARE = 6, 11, 5


def edits(word: Column) -> Column:
    return F.when(F.length(word) >= LONG, 2).otherwise(1)


def _shorter(word: Column) -> Column:
    """The word without each of its characters but the first."""
    places = F.when(F.length(word) > 1, F.sequence(F.lit(2), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def neighbourhood(word: Column, most: Column) -> Column:
    """The word, and what deleting up to ``most`` (1 or 2) characters leaves."""
    one = _shorter(word)
    two = F.when(most >= 2, F.flatten(F.transform(one, _shorter))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


def near(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """``word, token, distance``: of distinct ``words(word)`` those ``tokens(token)`` that are a typing error away.

    Words are of ASCII letters and ``LEAST`` characters; a token has the same first character, is not the word, and differs by at
    most 1 edit (2 from ``LONG`` characters on). Null and other words have no neighbours.
    """
    asked = words.select("word").where(F.col("word").rlike(f"^[A-Za-z]{{{LEAST},}}$")).distinct()
    known = tokens.select("token").where(F.length("token") >= LEAST - 1).distinct()
    mine = asked.select("word", F.explode(neighbourhood(F.col("word"), edits(F.col("word")))).alias("_key"))
    # A token that is two edits from a word has at most two characters fewer than the word.
    theirs = known.select("token", F.explode(neighbourhood(F.col("token"), F.when(F.length("token") >= LONG - 2, 2).otherwise(1))).alias("_key"))
    met = mine.join(theirs, "_key").select("word", "token").distinct()
    told = met.withColumn("distance", F.levenshtein("word", "token"))
    return told.where((F.col("distance") > 0) & (F.col("distance") <= edits(F.col("word"))) & (F.col("distance") * SHARE <= F.length("word")))
