"""Matrices made from a range: Laplacians and stencils. Every entry is computed from its own number, so no rows are exchanged."""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.matrix import COOMatrix, CSRMatrix
from tessera.operators.vector import coordinates
from tessera.types import IndexOrder, Rect

Stencil = list[tuple[tuple[int, ...], float]]


def _faces(dim: int, centre: float, side: float) -> Stencil:
    unit = lambda d, s: tuple(s * (e == d) for e in range(dim))
    return [((0,) * dim, centre), *((unit(d, s), side) for d in range(dim) for s in (-1, 1))]


STENCILS: dict[str, Stencil] = {
    "1d3": _faces(1, 2.0, -1.0),
    "2d5": _faces(2, 4.0, -1.0),
    "3d7": _faces(3, 6.0, -1.0),
    "3d27": [((x, y, z), (88.0, -6.0, -3.0, -2.0)[abs(x) + abs(y) + abs(z)] / 26.0) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)],
}


def laplacian_entries(spark: SparkSession, n: int) -> DataFrame:
    k = F.col("id")
    row = F.expr("(id + 1) div 3")
    return spark.range(3 * n - 2).select(k.alias("k"), row.alias("row"), (k - 2 * row).alias("col"), F.when(k % 3 == 0, 2.0).otherwise(-1.0).alias("entry"))


def laplacian_coo(spark: SparkSession, n: int) -> COOMatrix:
    return COOMatrix(laplacian_entries(spark, n))


def laplacian_rowptr(spark: SparkSession, n: int) -> DataFrame:
    r = F.col("id")
    return spark.range(n).select(r.alias("row"), F.greatest(3 * r - 1, F.lit(0)).alias("lo"), F.least(3 * r + 1, F.lit(3 * n - 3)).alias("hi"))


def laplacian_csr(spark: SparkSession, n: int) -> CSRMatrix:
    return CSRMatrix(laplacian_entries(spark, n).drop("row"), laplacian_rowptr(spark, n))


def laplacian_2d_size(height: int, width: int) -> int:
    return 5 * height * width - 2 * height - 2 * width


def sorted_stencil(stencil: Stencil, order: IndexOrder = IndexOrder.ROW_MAJOR) -> Stencil:
    """By offset, its first coordinate first in row-major order and its last in column-major order, then by entry."""
    return sorted(stencil, key=lambda x: (x[0] if order is IndexOrder.ROW_MAJOR else x[0][::-1], x[1]))


def stencil_size(stencil: Stencil, rect: Rect) -> int:
    return sum(prod(max(0, n - abs(o)) for n, o in zip(rect.shape, offset, strict=True)) for offset, _ in stencil)


def _before(point: list[Column], box: list[tuple[int, int]]) -> Column:
    """How many points of the box [lo, hi) come before the point, the first coordinate major."""
    total, inside = F.lit(0).cast("long"), F.lit(True)
    for d, (lo, hi) in enumerate(box):
        rest = prod(max(0, h - l) for l, h in box[d + 1 :])
        own = F.greatest(F.least(point[d], F.lit(hi)) - lo, F.lit(0)) * rest
        total = total + F.when(inside, own).otherwise(0)
        inside = inside & (point[d] >= lo) & (point[d] < hi)
    return total


def _rows(spark: SparkSession, stencil: Stencil, rect: Rect, order: IndexOrder) -> DataFrame:
    """(row, c0.., lo, hits): hits are the neighbours within the bounds, in order; lo is the number of the first."""
    shape, dims = rect.shape, range(len(rect.shape))
    df = coordinates(spark.range(rect.volume).select(F.col("id").alias("row")), Rect.of(*shape), order, "row")
    offsets = sorted_stencil(stencil, order)
    major = list(dims) if order is IndexOrder.ROW_MAJOR else list(reversed(dims))
    point = [F.col(f"c{d}") for d in major]
    lo = reduce(lambda a, b: a + b, (_before(point, [(max(0, -o[d]), min(shape[d], shape[d] - o[d])) for d in major]) for o, _ in offsets))
    step = [prod(shape[e] for e in major[major.index(d) + 1 :]) for d in dims]
    all_of = F.array(*(F.struct(*(F.lit(x).cast("long").alias(f"o{d}") for d, x in enumerate(o)), F.lit(sum(x * s for x, s in zip(o, step, strict=True))).cast("long").alias("shift"), F.lit(v).alias("entry")) for o, v in offsets))
    inside = lambda x: reduce(lambda a, b: a & b, ((F.col(f"c{d}") + x[f"o{d}"]).between(0, shape[d] - 1) for d in dims))
    return df.withColumn("lo", lo.cast("long")).withColumn("hits", F.filter(all_of, inside))


def stencil_entries(spark: SparkSession, stencil: Stencil, rect: Rect, order: IndexOrder = IndexOrder.ROW_MAJOR) -> DataFrame:
    """k, row, col (linear indices) and entry."""
    df = _rows(spark, stencil, rect, order).select("row", "lo", F.posexplode("hits").alias("p", "x"))
    return df.select((F.col("lo") + F.col("p")).alias("k"), "row", (F.col("row") + F.col("x.shift")).alias("col"), F.col("x.entry").alias("entry"))


def stencil_coo(spark: SparkSession, stencil: Stencil, rect: Rect, order: IndexOrder = IndexOrder.ROW_MAJOR) -> COOMatrix:
    return COOMatrix(stencil_entries(spark, stencil, rect, order))


def stencil_points(spark: SparkSession, stencil: Stencil, rect: Rect, order: IndexOrder = IndexOrder.ROW_MAJOR) -> DataFrame:
    """The entries with their points instead of linear indices: k, r0.., d0.., entry."""
    df = _rows(spark, stencil, rect, order).select("*", F.posexplode("hits").alias("p", "x"))
    dims = range(len(rect.shape))
    return df.select((F.col("lo") + F.col("p")).alias("k"), *((F.col(f"c{d}") + rect.lo[d]).alias(f"r{d}") for d in dims), *((F.col(f"c{d}") + F.col(f"x.o{d}") + rect.lo[d]).alias(f"d{d}") for d in dims), F.col("x.entry").alias("entry"))


def stencil_csr_points(spark: SparkSession, stencil: Stencil, rect: Rect, order: IndexOrder = IndexOrder.ROW_MAJOR) -> tuple[DataFrame, DataFrame]:
    """Compressed rows with points instead of linear indices: the kernel (k, d0.., entry), and the pointers (r0.., lo, hi)."""
    kernel = stencil_points(spark, stencil, rect, order)
    dims = range(len(rect.shape))
    points = ((F.col(f"c{d}") + rect.lo[d]).alias(f"r{d}") for d in dims)
    rowptr = _rows(spark, stencil, rect, order).select(*points, "lo", (F.col("lo") + F.size("hits") - 1).alias("hi"))
    return kernel.drop(*(f"r{d}" for d in dims)), rowptr


def stencil_csr(spark: SparkSession, stencil: Stencil, rect: Rect, order: IndexOrder = IndexOrder.ROW_MAJOR) -> CSRMatrix:
    rowptr = _rows(spark, stencil, rect, order).select("row", "lo", (F.col("lo") + F.size("hits") - 1).alias("hi"))
    return CSRMatrix(stencil_entries(spark, stencil, rect, order).drop("row"), rowptr)
