"""The registered queries of this package: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import benchmark_decontam, chat_format, fill_middle, html_extract, language_id, media_chunks, near_dedup, source_mixing, substring_dedup, token_packing, toxicity, url_filter, whitening
from textloom.llm._store import rows_of
from textloom.llm.oracle import ORACLE as ORACLE

HELD_OUT = "pmod(crc32(cast(doc_id as string)), 4) = 2"


def op1_url_ratio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(rows_of(spark, sf_dir, "pages"))


def op2_media_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media(rows_of(spark, sf_dir, "documents"))


def op3_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = rows_of(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.formatted(rows))


def op4_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_decontam.matches(rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "benchmark"))


def op5_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents")
    told = language_id.predicted(docs.select("doc_id", "text"), language_id.trained(docs))
    return told.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op6_convolution_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents")
    told = toxicity.scored(docs.select("doc_id", "text"), toxicity.fit(docs, rows_of(spark, sf_dir, "labels")))
    return told.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")


def op7_paragraph_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(rows_of(spark, sf_dir, "documents")).drop("text_hash")


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(rows_of(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(rows_of(spark, sf_dir, "documents"), k=4, percent=80)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(rows_of(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = fill_middle.transformed(rows_of(spark, sf_dir, "documents"), rate=100, spm=50, seed=7, units="lines")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_packing.pack_documents(rows_of(spark, sf_dir, "documents"), token_packing.Limits(tokens=2048, segments=256, loss=2048))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(rows_of(spark, sf_dir, "embeddings"), components=8)


QUERIES = {
    f.__name__: f
    for f in (op1_url_ratio_filter, op2_media_chunking, op3_chat_masks, op4_pigeonhole_decontamination, op5_kneser_ney_language, op6_convolution_toxicity, op7_paragraph_minhash_dedup, op8_wrapper_induction, op9_minhash_near_dedup, op10_source_mixing, op11_fill_middle, op12_vector_packing, op13_exact_whitening)
}
