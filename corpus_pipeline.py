"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, source mixing.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes each one's result to the shared folder and reads it as the next one's
documents. All but the last return the columns of ``documents``; the last adds its own, to which columns of the same names give
way. Cases: an empty table stays empty; a null or empty text is scored as clean, is no copy, repeats nothing and takes no words;
a document with a null id stays through all stages but is no other's copy; of rows with the same id and text one stays; of
equal documents and passages that of the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import benchmark_decontam, near_dedup, source_mixing, substring_dedup, toxicity
from textloom.llm._store import Scratch, rows_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, rows_of(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return near_dedup.drop_near_duplicates(docs, k=5, percent=80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and passages are cut from all texts but the first that holds them."""
    return substring_dedup.drop_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its error budget, go."""
    return benchmark_decontam.drop_contaminated(docs, rows_of(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their words and how many times they are taken."""
    told = source_mixing.mix(docs).where("repeats_taken > 0")
    return told.drop("pattern")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("source mixing", mix_sources),
]

#: The classifier and the near-duplicate stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = rows_of(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, str(i))
    return docs
