"""Tables in the shared folder of the cluster, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import Scratch as Scratch
from textloom.session import reachable
from textloom.session import shared_dir as shared_dir

#: Largest side that is ever broadcast, in bytes of its rows; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def _bytes(c: Column, kind: T.DataType) -> Column | None:
    """Bytes of a value besides its 8 in the row; None if there are none."""
    if isinstance(kind, _FIXED):
        return None
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(kind, T.StructType) and all(isinstance(f.dataType, _FIXED) for f in kind.fields):
        return F.lit(8 + 8 * len(kind))
    if isinstance(kind, T.ArrayType) and _bytes(c, kind.elementType) is None:
        return 16 + 8 * F.size(c)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and all(isinstance(f.dataType, _FIXED) for f in kind.elementType.fields):
        return 16 + F.size(c) * (16 + 8 * len(kind.elementType))
    return F.octet_length(F.to_json(F.struct(c.alias("c"))))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted and measured, fit in ``limit`` bytes, else as it is, so that the join shuffles.

    A row counts 32 bytes and 8 for each column, and what strings, binaries, arrays and structs take besides.
    """
    size = df.count() * (32 + 8 * len(df.columns))
    wide = [x for f in df.schema.fields if (x := _bytes(F.col(f"`{f.name}`"), f.dataType)) is not None]
    if wide and size <= limit:
        size += df.agg(F.sum(sum((F.coalesce(x.cast("long"), F.lit(0)) for x in wide[1:]), F.coalesce(wide[0].cast("long"), F.lit(0))))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores added until they clash with none of ``columns``, whatever the case."""
    held, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in held:
            n = f"_{n}"
        held.add(n.lower())
        out.append(n)
    return out


def carried(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that every expression can use, and the original name of each: the columns ``needed`` keep theirs, all others
    are called by position, so that dots, back-ticks, blanks and twins that differ in case do no harm."""
    names = docs.columns
    used = [f"_{i}" for i in range(len(names))]
    for n in needed:
        at = names.index(n) if n in names else next((i for i, c in enumerate(names) if c.lower() == n.lower()), None)
        if at is not None:
            used[at] = n
    return docs.toDF(*used), dict(zip(used, names, strict=True))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that long texts stay within a Python worker's memory. All operators set the same."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def rows_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
