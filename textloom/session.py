"""Session helpers: code for the executors, tables in the shared folder, ordinals over ordered rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def reachable(spark: SparkSession) -> SparkSession:
    """Ships this package to Python workers, as a zip file that Spark hands to each executor; once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_textloom_shipped", None) != sc.applicationId:
        here = Path(__file__).resolve().parent
        made = Path(tempfile.mkdtemp(prefix="textloom-code-"), "textloom.zip")
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(str(made))
        sc._textloom_shipped = sc.applicationId
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one of this machine only where it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="textloom-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Intermediate tables of one operator run, written as Parquet to the shared folder: lineage is cut and survives lost executors.

    What isn't dropped before goes when the driver ends, since results are lazy and read from here.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{tag}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{tag}")

    def drop(self, *tags: str) -> None:
        for tag in tags:
            remove(self.spark, f"{self.root}/{tag}")

    def close(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has ended before
            return


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``name``: the rows (or the sum of ``weight``) before each in a total order, plus 1 (or 0).

    Rows are dealt by ranges of the order and sorted there; only a row for each range meets in one task.
    """
    scratch = Scratch(df.sparkSession, "order")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = scratch.save(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "rows")
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    parts = held.groupBy("_part").agg(size.alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(parts.select("_part", before.alias("_before")))  # a row for each range
    if weight is None:
        place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    else:
        place = F.coalesce(F.sum(weight).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("_place", place).join(parts, "_part").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))
