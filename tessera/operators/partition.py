"""Partitions of index spaces as DataFrames (color, i), and those derived through matrices.

A derived partition may hold an index under several colors (ghosts). Images are joins followed by distinct, which
Spark aggregates before it exchanges rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def equal(spark: SparkSession, n: int, colors: int) -> DataFrame:
    """Contiguous blocks: color = floor(i colors / n)."""
    return spark.range(n).select(F.expr(f"cast(id * {colors} div {n} as int)").alias("color"), F.col("id").alias("i"))


def _through(entries: DataFrame, part: DataFrame, key: str, to: str) -> DataFrame:
    other = part.select("color", F.col("i").alias(key))
    return entries.join(other, key).select("color", F.col(to).alias("i")).distinct()


def coo_kernel_from_domain(a, part: DataFrame) -> DataFrame:
    return _through(a.entries, part, "col", "k")


def coo_kernel_from_range(a, part: DataFrame) -> DataFrame:
    return _through(a.entries, part, "row", "k")


def coo_domain_from_kernel(a, part: DataFrame) -> DataFrame:
    return _through(a.entries, part, "k", "col")


def coo_range_from_kernel(a, part: DataFrame) -> DataFrame:
    return _through(a.entries, part, "k", "row")


csr_kernel_from_domain = coo_kernel_from_domain
csr_domain_from_kernel = coo_domain_from_kernel


def csr_kernel_from_range(a, part: DataFrame) -> DataFrame:
    """The image of the row pointers' ranges; an empty row gives nothing."""
    rows = a.rowptr.join(part.select("color", F.col("i").alias("row")), "row").where("lo <= hi")
    return rows.select("color", F.explode(F.sequence("lo", "hi")).alias("i")).distinct()


def csr_range_from_kernel(a, part: DataFrame) -> DataFrame:
    """Rows whose range of the kernel meets the color."""
    return _through(a.pointers(), part, "k", "row")


def domain_from_range(a, part: DataFrame) -> DataFrame:
    return a.domain_from_kernel(a.kernel_from_range(part))


def range_from_domain(a, part: DataFrame) -> DataFrame:
    return a.range_from_kernel(a.kernel_from_domain(part))


def overlaps(part: DataFrame) -> DataFrame:
    """Indices of more than one color; none if the partition is disjoint."""
    return part.distinct().groupBy("i").agg(F.count("*").alias("colors")).where("colors > 1").select("i")


def missing(part: DataFrame, space: DataFrame) -> DataFrame:
    """Indices (column i) of the space without a color; none if the partition is complete."""
    return space.select("i").join(part, "i", "left_anti")


def is_disjoint(part: DataFrame) -> bool:
    return overlaps(part).isEmpty()


def is_complete(part: DataFrame, space: DataFrame) -> bool:
    return missing(part, space).isEmpty()


def lines(part: DataFrame) -> DataFrame:
    """In order of color and index, for printing."""
    return part.select("color", "i").orderBy("color", "i")


def show(part: DataFrame, name: str = "partition") -> None:
    print(f"{name}:")
    for r in lines(part).toLocalIterator():
        print(f"  color {r.color}: {r.i}")
