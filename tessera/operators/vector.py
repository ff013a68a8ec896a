"""Dense vectors as DataFrames (i, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import Scalar, alpha, lit
from tessera.types import ENTRY_TYPES, IndexOrder, Rect


class Vector:
    """A vector over an index space. Every operation returns a new one; columns are computed by Catalyst when read.

    Two vectors must have the same indices: a result read where they differ is an error. check=True counts the indices
    before an operation joins two frames, and so raises ValueError at once."""

    def __init__(self, df: DataFrame, name: str = "v", dtype: str = "double", partition: DataFrame | None = None, check: bool = False):
        if dtype not in ENTRY_TYPES:
            raise ValueError(f"entries are one of {ENTRY_TYPES}")
        self.df, self.name, self.dtype, self.partition, self.check = df.select(F.col("i").cast("long").alias("i"), F.col("v").cast(dtype).alias("v")), name, dtype, partition, check

    @classmethod
    def of_size(cls, spark: SparkSession, n: int, value: float = 0.0, **options) -> Vector:
        return cls(spark.range(n).select(F.col("id").alias("i"), F.lit(float(value)).alias("v")), **options)

    @classmethod
    def of_column(cls, df: DataFrame, index: str, value: str | Column, **options) -> Vector:
        """A view of a table's column. Rows with a null index or value are left out."""
        v = F.col(value) if isinstance(value, str) else value
        return cls(df.select(F.col(index).alias("i"), v.alias("v")).where("i is not null and v is not null"), **options)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def size(self) -> int:
        return self.df.count()

    def _like(self, df: DataFrame) -> Vector:
        return Vector(df, self.name, self.dtype, self.partition, self.check)

    def _map(self, f) -> Vector:
        return self._like(self.df.select("i", f(F.col("v")).alias("v")))

    def _with(self, x: Vector, f) -> Vector:
        if self.dtype != x.dtype:
            raise TypeError("entry types differ")
        mine, its = self.df.withColumn("mine", F.lit(True)), x.df.select("i", F.col("v").alias("x"), F.lit(True).alias("its"))
        both = mine.join(its, "i", "full")
        if self.check and not self.size() == x.size() == both.where("mine and its").count():
            raise ValueError("index spaces differ")
        alone = F.col("mine").isNull() | F.col("its").isNull()
        value = F.when(alone, F.raise_error(F.lit("index spaces differ")).cast(self.dtype)).otherwise(f(F.col("v"), F.col("x")).cast(self.dtype))
        return self._like(both.select("i", value.alias("v")))

    def _coefficient(self, f: tuple) -> Column:
        return lit(alpha(*f)).cast(self.dtype)

    def fill(self, value: float | Scalar) -> Vector:
        return self._map(lambda v: lit(value))

    def zero_fill(self) -> Vector:
        return self.fill(0.0)

    def copy(self) -> Vector:
        return self._like(self.df)

    def random_fill(self, seed: int | None = None) -> Vector:
        return self._map(lambda v: F.rand(seed))

    def scal(self, *f: float | Scalar) -> Vector:
        return self._map(lambda v: (self._coefficient(f) * v).cast(self.dtype))

    def axpy(self, *f_and_x) -> Vector:
        """self + alpha(f...) x; the last argument is x."""
        *f, x = f_and_x
        a = self._coefficient(tuple(f))
        return self._with(x, lambda v, w: v + (a * w).cast(self.dtype))

    def xpay(self, *f_and_x) -> Vector:
        """alpha(f...) self + x; the last argument is x."""
        *f, x = f_and_x
        a = self._coefficient(tuple(f))
        return self._with(x, lambda v, w: (a * v).cast(self.dtype) + w)

    def dot_df(self, x: Vector) -> DataFrame:
        """One row (value) of the entry type. Products are of that type, their sum is a double until the end; partial sums
        come before the exchange; the sum of nothing is 0."""
        return self._with(x, lambda v, w: (v * w).cast(self.dtype)).df.agg(F.coalesce(F.sum("v"), F.lit(0.0)).cast(self.dtype).alias("value"))

    def dot(self, x: Vector) -> Scalar:
        return Scalar.of(self.dot_df(x), self.dtype)

    def norm2(self) -> Scalar:
        return self.dot(self).sqrt()


def coordinates(df: DataFrame, rect: Rect, order: IndexOrder = IndexOrder.ROW_MAJOR, index: str = "i") -> DataFrame:
    """df with the point c0, c1, ... of each linear index."""
    dims = list(range(len(rect.shape)))
    rest = F.col(index)
    for d in reversed(dims) if order is IndexOrder.ROW_MAJOR else dims:
        df = df.withColumn(f"c{d}", (rest % rect.shape[d] + rect.lo[d]).cast("long"))
        rest = ((rest - rest % rect.shape[d]) / rect.shape[d]).cast("long")
    return df


def linear(rect: Rect, order: IndexOrder = IndexOrder.ROW_MAJOR, prefix: str = "c") -> Column:
    """The linear index of the point in columns c0, c1, ..."""
    dims = list(range(len(rect.shape)))
    out = F.lit(0).cast("long")
    for d in dims if order is IndexOrder.ROW_MAJOR else reversed(dims):
        out = out * rect.shape[d] + (F.col(f"{prefix}{d}") - rect.lo[d])
    return out
