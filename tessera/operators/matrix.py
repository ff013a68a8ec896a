"""Sparse matrices as DataFrames, and their products with vectors."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import partition
from tessera.operators.vector import Vector


class LinearOperator(ABC):
    """What derives a partition of one space from one of the other. Subclass it for an operator of your own."""

    @abstractmethod
    def domain_from_range(self, part: DataFrame) -> DataFrame: ...

    @abstractmethod
    def range_from_domain(self, part: DataFrame) -> DataFrame: ...


class Matrix(LinearOperator):
    """A matrix with a kernel space of stored entries: `entries` has the columns k, row, col, entry."""

    entries: DataFrame

    @abstractmethod
    def kernel_from_domain(self, part: DataFrame) -> DataFrame: ...

    @abstractmethod
    def kernel_from_range(self, part: DataFrame) -> DataFrame: ...

    @abstractmethod
    def domain_from_kernel(self, part: DataFrame) -> DataFrame: ...

    @abstractmethod
    def range_from_kernel(self, part: DataFrame) -> DataFrame: ...

    def domain_from_range(self, part: DataFrame) -> DataFrame:
        return partition.domain_from_range(self, part)

    def range_from_domain(self, part: DataFrame) -> DataFrame:
        return partition.range_from_domain(self, part)

    def kernel_space(self) -> DataFrame:
        return self.entries.select("k")

    def auxiliary(self) -> dict[str, DataFrame]:
        return {}

    def _product(self, x: Vector, y: Vector, key: str, to: str) -> Vector:
        """Sums by `to` are partial before the exchange. A side small enough is broadcast, as Catalyst finds; entries
        outside either vector's indices are left out; rows without an entry are 0."""
        sums = self.entries.join(x.df.select(F.col("i").alias(key), "v"), key).groupBy(F.col(to).alias("i")).agg(F.sum(F.col("entry") * F.col("v")).alias("s"))
        return Vector(y.df.select("i").join(sums, "i", "left").select("i", F.coalesce("s", F.lit(0.0)).alias("v")), y.name, y.dtype, y.partition)

    def matvec(self, x: Vector, y: Vector) -> Vector:
        """A x over y's indices; y's values don't matter."""
        return self._product(x, y, "col", "row")

    def rmatvec(self, x: Vector, y: Vector) -> Vector:
        """The transpose's product."""
        return self._product(x, y, "row", "col")

    def lines(self) -> DataFrame:
        return self.entries.select("k", "entry", "row", "col").orderBy("k")

    def show(self) -> None:
        for r in self.lines().toLocalIterator():
            print(f"{r.k}: entry {r.entry} at ({r.row}, {r.col})")


class COOMatrix(Matrix):
    """Coordinate form. Entries at one place add up. Rows with a null are left out."""

    def __init__(self, entries: DataFrame):
        self.entries = entries.select(*(F.col(c).cast("long").alias(c) for c in ("k", "row", "col")), "entry").dropna()

    @classmethod
    def of_columns(cls, df: DataFrame, row: str, col: str, entry: str) -> COOMatrix:
        """A view of a table whose rows are entries; k isn't dense, but differs from row to row."""
        return cls(df.select(F.monotonically_increasing_id().alias("k"), F.col(row).alias("row"), F.col(col).alias("col"), F.col(entry).alias("entry")))

    def transpose(self) -> COOMatrix:
        return COOMatrix(self.entries.select("k", F.col("col").alias("row"), F.col("row").alias("col"), "entry"))

    def kernel_from_domain(self, part: DataFrame) -> DataFrame:
        return partition.coo_kernel_from_domain(self, part)

    def kernel_from_range(self, part: DataFrame) -> DataFrame:
        return partition.coo_kernel_from_range(self, part)

    def domain_from_kernel(self, part: DataFrame) -> DataFrame:
        return partition.coo_domain_from_kernel(self, part)

    def range_from_kernel(self, part: DataFrame) -> DataFrame:
        return partition.coo_range_from_kernel(self, part)

    def to_csr(self, rows: DataFrame) -> CSRMatrix:
        """Compressed rows for the rows in column i. Entries are numbered by row, then column: counts per row, summed
        in ranges of rows, then a rank in each row, so no task sorts everything."""
        per = rows.select(F.col("i").alias("row")).join(self.entries.groupBy("row").agg(F.count("*").alias("n")), "row", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        size = 65_536
        blocks = per.groupBy(F.floor(F.col("row") / size).alias("b")).agg(F.sum("n").alias("bn"))
        blocks = blocks.select("b", F.expr("coalesce(sum(bn) over (order by b rows between unbounded preceding and 1 preceding), 0)").alias("base"))
        within = F.expr("coalesce(sum(n) over (partition by b order by row rows between unbounded preceding and 1 preceding), 0)")
        ptr = per.withColumn("b", F.floor(F.col("row") / size)).withColumn("own", within).join(blocks, "b")
        ptr = ptr.select("row", (F.col("base") + F.col("own")).cast("long").alias("lo"), (F.col("base") + F.col("own") + F.col("n") - 1).cast("long").alias("hi"))
        ranked = self.entries.withColumn("at", F.expr("row_number() over (partition by row order by col, k)")).join(ptr, "row")
        return CSRMatrix(ranked.select((F.col("lo") + F.col("at") - 1).alias("k"), "row", "col", "entry"), ptr)


class Gram(LinearOperator):
    """scale times the transpose of a matrix times the matrix, never multiplied out: a product goes to the rows and back, so it
    takes as long as the factor has entries, however many columns share a row. Each product reads the factor twice; have it
    saved, in buckets by row if it is large."""

    def __init__(self, factor: Matrix, scale: float = 1.0):
        self.factor, self.scale = factor, scale

    def _to_itself(self, part: DataFrame) -> DataFrame:
        return self.factor.domain_from_range(self.factor.range_from_domain(part))

    domain_from_range = range_from_domain = _to_itself

    def sums(self, x: DataFrame, columns: list[str]) -> DataFrame:
        """(i, columns): the products with x's columns, in the rows that have an entry."""
        entries = self.factor.entries.select("row", "col", "entry")
        rows = entries.join(x.withColumnRenamed("i", "col"), "col").groupBy("row").agg(*(F.sum(F.col("entry") * F.col(c)).alias(c) for c in columns))
        return entries.join(rows, "row").groupBy(F.col("col").alias("i")).agg(*((self.scale * F.sum(F.col("entry") * F.col(c))).alias(c) for c in columns))


class CSRMatrix(Matrix):
    """Compressed rows: kernel (k, col, entry), and rowptr (row, lo, hi) with an inclusive range of k per row, empty where hi = lo - 1.

    A kernel that has a column row already needs no join with the pointers to get its entries."""

    def __init__(self, kernel: DataFrame, rowptr: DataFrame):
        self.kernel, self.rowptr = kernel, rowptr

    def pointers(self) -> DataFrame:
        """(row, k)"""
        return self.rowptr.where("lo <= hi").select("row", F.explode(F.sequence("lo", "hi")).alias("k"))

    @property
    def entries(self) -> DataFrame:
        rows = self.kernel if "row" in self.kernel.columns else self.kernel.join(self.pointers(), "k")
        return rows.select("k", "row", "col", "entry")

    def to_coo(self) -> COOMatrix:
        return COOMatrix(self.entries)

    def auxiliary(self) -> dict[str, DataFrame]:
        return {"rowptr": self.rowptr}

    def local_pointers(self, part: DataFrame) -> DataFrame:
        """(color, row, begin): each row's begin counted from its color's first entry."""
        rows = self.rowptr.join(part.select("color", F.col("i").alias("row")), "row")
        return rows.join(rows.groupBy("color").agg(F.min("lo").alias("least")), "color").select("color", "row", (F.col("lo") - F.col("least")).alias("begin"))

    def kernel_from_domain(self, part: DataFrame) -> DataFrame:
        return partition.csr_kernel_from_domain(_Kernel(self.kernel), part)

    def kernel_from_range(self, part: DataFrame) -> DataFrame:
        return partition.csr_kernel_from_range(self, part)

    def domain_from_kernel(self, part: DataFrame) -> DataFrame:
        return partition.csr_domain_from_kernel(_Kernel(self.kernel), part)

    def range_from_kernel(self, part: DataFrame) -> DataFrame:
        return partition.csr_range_from_kernel(self, part)


class _Kernel:
    def __init__(self, entries: DataFrame):
        self.entries = entries
