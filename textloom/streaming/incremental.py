"""Structured Streaming variants: a stateless search over a stream of texts, and exactly-once indexing by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.model import EXTRACTION_VERSION, SHEET
from textloom.operators import index, search
from textloom.session import Scratch
from textloom.sources.files import line_units

#: Results are handed on in batches of so many.
FLUSH = 128


def stream_units(spark: SparkSession, folder: str, schema, path, text: str = "text") -> DataFrame:
    """Lines of a stream of Parquet files of texts; files that appear later are read once each."""
    return line_units(spark.readStream.schema(schema).parquet(folder), path, text)


def stream_search(units: DataFrame, term: str) -> DataFrame:
    """Append-mode hits: filter and projection only, so no state and no watermark."""
    return search.plain(units, term)


def run_available(hits: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there into Parquet files below ``folder``, each row once, and reads them."""
    query = hits.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/hits").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return hits.sparkSession.read.schema(hits.schema).parquet(f"{folder}/hits")


def flush_batches(hits: DataFrame, send: Callable[[list], None], checkpoint: str):
    """Hands each micro-batch's rows on, ``FLUSH`` at a time."""

    def each(batch: DataFrame, _: int) -> None:
        held: list = []
        for row in batch.toLocalIterator():
            held.append(row)
            if len(held) == FLUSH:
                send(held)
                held = []
        if held:
            send(held)

    return hits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_batch(batch: DataFrame, number: int, folder: str, stream: str = "files", listing: Callable[[], DataFrame] | None = None, units_of=line_units) -> bool:
    """Adds one micro-batch of files ``path, file_type, size, modified_ns, text`` to an index, exactly once; whether it did.

    The segment, its tombstones and the batch's number come into being by one swap of the manifest. A batch that is played again
    after that changes nothing; before, it writes the same segment anew. Of a path that comes more than once the state of the latest
    time counts (of equal times the larger text). ``listing()`` gives the paths that there are; indexed files that are missing there
    are gone. Null texts have no units; null paths are no files.
    """
    spark = batch.sparkSession
    held = index.Index(spark, folder)
    if held.manifest.batches.get(stream, -1) >= number:
        return False
    files = batch.where("path is not null").select("path", "file_type", "size", "modified_ns", "text")
    again = files.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path")
    if not again.isEmpty():  # only the texts of these are shuffled
        again = Scratch(spark, "batch").save(again, "again")
        last = files.join(again, "path", "left_semi").groupBy("path").agg(F.max_by(F.struct("file_type", "size", "modified_ns", "text"), F.struct("modified_ns", "text")).alias("f"))
        files = files.join(again, "path", "left_anti").union(last.select("path", "f.*"))
    state = files.select("path", "file_type", "size", "modified_ns", F.lit(EXTRACTION_VERSION).alias("version"), F.lit(index.scope_bits(False, False)).alias("scope"), F.lit(False).alias("gone"))
    if listing is not None:
        there, live = listing().select("path").distinct(), held.files()
        files = files.join(there, "path", "left_semi")
        gone = live.join(there, "path", "left_anti").join(state.select("path"), "path", "left_anti")
        state = state.join(there, "path", "left_semi").union(index.tombstones(gone.union(live.join(state.join(there, "path", "left_anti").select("path"), "path", "left_semi"))))
    index.commit(spark, folder, units_of(files, F.col("path")), state, spark.createDataFrame([], SHEET), (stream, number), ordered=True)
    index.compact(spark, folder)
    return True


def index_stream(files: DataFrame, folder: str, checkpoint: str, stream: str = "files", listing: Callable[[], DataFrame] | None = None):
    """Indexes a stream of files by micro-batches, each exactly once, whatever is stopped and begun again: the checkpoint numbers the
    batches, the manifest knows which are in."""
    each = lambda batch, number: index_batch(batch, number, folder, stream, listing)
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["F", "flush_batches", "index_batch", "index_stream", "run_available", "stream_search", "stream_units"]
