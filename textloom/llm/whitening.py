"""Embedding whitening from an exact integer scatter.

An entry c becomes the integer x = floor(``SCALE`` * c) + ``OFFSET``. Each task subtracts a common shift (the first fitted vector's
entries, so that what is summed is small) and sums the differences y and their cross-products without rounding: y is split in limbs of 20
bits, limb products of up to 4,096 rows are float64 matrix products that stay below 2^53 and so are exact, and these are added
as 64-bit and then as Python integers. Spark adds the tasks' sums limb by limb as decimals. On the driver n·YᵀY − SSᵀ is formed
in arbitrary precision; it doesn't depend on the shift, and n² times the covariance is known exactly. Only then it becomes float, each
entry rounded once, and ``eigh`` decomposes it. The result is the same however the rows are dealt.

What meets on the driver is a row for each pair of dimensions, never one for each vector or task. The projection is a pass over the
vectors without a shuffle; the error of the whitened covariance is measured by another.

Cases: a null vector, one without entries, and one with null or non-finite entries is left out; so are vectors of another number of dimensions than most
have (of equally many, the larger number). Null ids stay; repeated rows count as often as they occur; further columns are
ignored; an empty table, and one without variance, give an empty result. Components whose eigenvalue is not above the rounding of the
largest (``RANK`` times it) have no direction and are not returned. Entries beyond ±2^61 / ``SCALE`` count as these bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._store import Scratch, bounded_batches

SCALE, OFFSET = 1024, 100_000
COMPONENTS, RANK = 8, 1e-12
#: Bits of a limb of the products, rows of one exact product, and bits of a limb of the sums that Spark adds.
LIMB, ROWS, WIDE = 20, 1 << 12, 40


def integers(vectors: np.ndarray) -> np.ndarray:
    """``x`` of each entry, as 64-bit integers."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -(2.0**61), 2.0**61).astype(np.int64) + OFFSET


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """``y`` = sum of limb k times 2^(LIMB k); all but the last are 0 to 2^LIMB - 1, as floats."""
    out = []
    while True:
        last = np.abs(y).max(initial=0) < 1 << LIMB
        out.append((y if last else y & ((1 << LIMB) - 1)).astype(np.float64))
        if last:
            return out
        y = y >> LIMB


class Scatter:
    """Exact sums and cross-products of integer vectors that come in batches."""

    def __init__(self, dims: int):
        self.n = 0
        self.sums = np.zeros(dims, dtype=object)
        self.products = np.zeros((dims, dims), dtype=object)
        self.held: dict[int, list] = {}  # by power of two: how many were added as 64-bit numbers, and their sums

    def add(self, y: np.ndarray) -> None:
        self.n += len(y)
        for a in range(0, len(y), ROWS):
            limbs = _limbs(y[a : a + ROWS])
            for i, p in enumerate(limbs):
                self.sums += p.sum(axis=0).astype(np.int64).astype(object) << LIMB * i
                for j, q in enumerate(limbs):
                    self._keep(LIMB * (i + j), (p.T @ q).astype(np.int64))

    def _keep(self, power: int, product: np.ndarray) -> None:
        now = self.held.setdefault(power, [0, np.zeros_like(product)])
        now[0] += 1
        now[1] += product
        if now[0] == 1 << 9:
            self._settle(power)

    def _settle(self, power: int) -> None:
        self.products += self.held.pop(power)[1].astype(object) << power

    def told(self) -> tuple[int, np.ndarray, np.ndarray]:
        for power in list(self.held):
            self._settle(power)
        return self.n, self.sums, self.products


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column
    return np.asarray(values, dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _wide(value: int) -> list[int]:
    """Limbs of ``WIDE`` bits, the last with the sign."""
    out = []
    while not -(1 << WIDE) < value < 1 << WIDE:
        out.append(value & ((1 << WIDE) - 1))
        value >>= WIDE
    return [*out, value]


def _scattered(shift: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter(len(shift))
        by = np.array(shift, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total.add(integers(_matrix(batch.column(0))) - by)
        n, sums, products = total.told()
        if not n:
            return
        rows = [(-1, -1, 0, n)]
        for i in range(len(shift)):
            rows += [(-1, i, k, v) for k, v in enumerate(_wide(int(sums[i])))]
            rows += [(i, j, k, v) for j in range(i, len(shift)) for k, v in enumerate(_wide(int(products[i, j])))]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["i", "j", "limb", "value"])

    return run


class Whitening(NamedTuple):
    """Of the fit list: rows, shift and exact sums of x - shift; unit eigenvectors (a row each) and eigenvalues, falling; trace."""

    n: int
    shift: list[int]
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def decomposed(n: int, shift: list[int], sums: list[int], products: list[list[int]], components: int) -> Whitening:
    dims = len(shift)
    exact = [[n * products[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    v = np.array([[m / (n * n) for m in row] for row in exact], dtype=np.float64).reshape(dims, dims)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors.T[::-1]
    kept = int((values > RANK * max(values[0] if dims else 0.0, 0.0)).sum()) if dims and values[0] > 0 else 0
    kept = min(kept, components)
    return Whitening(n, shift, sums, np.ascontiguousarray(vectors[:kept]), values[:kept], sum(exact[i][i] for i in range(dims)) / (n * n))


def remaining(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` (doubles) of the vectors that count."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    held = rows.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("vector")).where("size(vector) > 0")
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    held = held.where(F.coalesce(finite, F.lit(False)))
    sizes = held.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return held.where(F.size("vector") == (sizes["dims"] if sizes else 0))


def fitted(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all remaining vectors; None if there are none."""
    bounded_batches(rows.sparkSession)
    return _fitted(remaining(rows, id_col, vector_col), components)


def _fitted(held: DataFrame, components: int) -> Whitening | None:
    one = held.first()
    if one is None:
        return None
    shift = [int(x) for x in integers(np.array([one["vector"]], dtype=np.float64).reshape(1, -1))[0]]
    told = held.select("vector").mapInArrow(_scattered(shift), "i int, j int, limb int, value long")
    told = told.groupBy("i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    n, sums, dims = 0, [0] * len(shift), len(shift)
    products = [[0] * dims for _ in range(dims)]
    for i, j, limb, value in told.collect():  # a few rows for each pair of dimensions
        value = int(value) << WIDE * limb
        if j < 0:
            n += value
        elif i < 0:
            sums[j] += value
        else:
            products[i][j] += value
            if i != j:
                products[j][i] += value
    return decomposed(n, shift, sums, products, components)


def centred(vectors: np.ndarray, w: Whitening) -> tuple[np.ndarray, list[int]]:
    """x - S/n of each row, rounded once, and the exact sum of (n*x - S)^2."""
    y = integers(vectors) - np.array(w.shift, dtype=np.int64)
    largest, most = int(np.abs(y).max(initial=0)), max((abs(s) for s in w.sums), default=0)
    if w.n * largest + most < 1 << 62:
        whole = y * np.int64(w.n) - np.array(w.sums, dtype=np.int64)
    else:
        whole = y.astype(object) * w.n - np.array(w.sums, dtype=object)
    bound = w.n * largest + most
    if bound * bound * max(len(w.shift), 1) < 1 << 63:
        squares = (whole * whole).sum(axis=1).tolist()
    else:
        squares = [int(s) for s in (whole.astype(object) ** 2).sum(axis=1)]
    return (whole / w.n).astype(np.float64), squares


def _projected(w: Whitening):
    scale = np.sqrt(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c, squares = centred(_matrix(batch.column(1)), w)
            z = c @ w.vectors.T / scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * len(scale), pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(s) for s in squares]), lists], ["vec_id", "squares", "z"])

    return run


def _summed(k: int):
    """Rows, sums and products of whitened vectors, a row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = _matrix(batch.column(0))
            if len(z):
                n, s, p = n + len(z), s + z.sum(axis=0), p + z.T @ z
        if n:
            values = np.concatenate([[float(n)], s, p.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["at", "value"])

    return run


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``z`` minus the identity; the means are of rounding's size, so that subtracting
    their products afterwards centres it without loss."""
    told = whitened.select("z").mapInArrow(_summed(k), "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    v = np.array([r["value"] for r in told.orderBy("at").collect()])  # 1 + k + k * k numbers
    mean = v[1 : 1 + k] / v[0]
    return float(np.abs(v[1 + k :].reshape(k, k) / v[0] - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component: ``vec_id, component, n, deviation`` (null where it exceeds a long, which
    ``deviation_exact`` as a string doesn't), ``whitened, explained, identity_error``."""
    spark = rows.sparkSession
    bounded_batches(spark)
    held = remaining(rows, id_col, vector_col)
    kind = dict(held.dtypes)["vec_id"]
    w = _fitted(held, components)
    k = len(w.values) if w else 0
    if not k:
        schema = f"vec_id {kind}, component int, n long, deviation long, deviation_exact string, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], schema)
    told = Scratch(spark, "whitening").save(held.mapInArrow(_projected(w), f"vec_id {kind}, squares string, z array<double>"), "whitened")
    error = identity_error(told, k)
    explained = F.array(*(F.lit(float(e / w.trace)) for e in w.values))
    each = told.select("vec_id", "squares", F.posexplode("z").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(w.n).cast("long").alias("n"),
        F.expr("try_cast(squares as bigint)").alias("deviation"),
        F.col("squares").alias("deviation_exact"),
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
