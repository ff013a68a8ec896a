"""Square systems of several components.

All vectors of a system are columns of one frame keyed by (space, i), so copies, sums and dot products are column
expressions without a join. Only a product with the operators joins, and writes the frame to the shared folder, which keeps plans short.

A frame of many rows is kept in buckets by (space, i), and the operators by the same columns of their domain. A product then
exchanges nothing but the partial sums of its result. A Gram operator's products are summed apart and added."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import storage
from tessera.functions.scalar import Scalar, alpha, lit
from tessera.operators.matrix import Gram, Matrix
from tessera.operators.vector import Vector

SOL, RHS = 0, 1
#: Frames of this many rows are kept in buckets; smaller ones Spark broadcasts or exchanges at little cost.
BUCKET_ROWS = 1_000_000


class SquarePlanner:
    def __init__(self, spark: SparkSession, dtype: str = "double", bucket_rows: int = BUCKET_ROWS):
        self.spark, self.dtype, self.bucket_rows = spark, dtype, bucket_rows
        self.buckets: int | None = None
        self.sol: list[Vector] = []
        self.rhs: list[Vector] = []
        self.matrices: list[tuple[Matrix | Gram, int, int]] = []
        self.workspace: int | None = None
        self.table: storage.Table | None = None
        self.state: DataFrame | None = None
        self.operators: DataFrame | None = None

    def _add(self, to: list[Vector], v: Vector) -> int:
        if self.workspace is not None:
            raise RuntimeError("the workspace is already allocated")
        if v.dtype != self.dtype:
            raise TypeError("entry types differ")
        to.append(v)
        return len(to) - 1

    def add_sol_vector(self, v: Vector) -> int:
        return self._add(self.sol, v)

    def add_rhs_vector(self, v: Vector) -> int:
        return self._add(self.rhs, v)

    @property
    def num_spaces(self) -> int:
        if len(self.sol) != len(self.rhs):
            raise ValueError("a square system has as many solution as right-hand side vectors")
        return len(self.sol)

    def add_row_partitioned_matrix(self, a: Matrix | Gram, domain: int, range_: int) -> None:
        """May be called several times for one pair of spaces; products add up. Partitions follow Spark's own of the operators' rows."""
        self.matrices.append((a, domain, range_))
        self.operators = None

    def allocate_workspace(self, n: int) -> None:
        if self.workspace is not None:
            raise RuntimeError("the workspace is already allocated")
        frames = []
        for space in range(self.num_spaces):
            x, b = self.sol[space].df.withColumnRenamed("v", "sol"), self.rhs[space].df.withColumnRenamed("v", "rhs")
            frames.append(x.join(b, "i", "full").select(F.lit(space).alias("space"), "i", "sol", "rhs"))
        df = frames[0]
        for f in frames[1:]:
            df = df.union(f)
        self.workspace = n
        df = df.select("*", *(F.lit(0.0).cast(self.dtype).alias(f"w{k}") for k in range(n)))
        self._save(df)
        rows, odd = self.state.agg(F.count("*"), F.count_if(F.col("sol").isNull() | F.col("rhs").isNull())).first()
        if odd:
            raise ValueError("a solution and its right-hand side have different index spaces")
        if rows >= self.bucket_rows:
            self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self._save(self.state)

    def name(self, v: int) -> str:
        return ("sol", "rhs")[v] if v < 2 else f"w{v - 2}"

    def _save(self, df: DataFrame) -> None:
        old, self.table = self.table, storage.save_bucketed(df, self.buckets, "space", "i") if self.buckets else storage.save(df)
        self.state = self.table.df
        if old:
            storage.delete(self.spark, old)

    def _set(self, dst: int, value: Column) -> None:
        self.state = self.state.withColumn(self.name(dst), value.cast(self.dtype))

    def zero_fill(self, dst: int) -> None:
        self._set(dst, F.lit(0.0))

    def copy(self, dst: int, src: int) -> None:
        self._set(dst, F.col(self.name(src)))

    def scal(self, dst: int, *f: float | Scalar) -> None:
        self._set(dst, lit(alpha(*f)).cast(self.dtype) * F.col(self.name(dst)))

    def axpy(self, dst: int, *f_and_src) -> None:
        *f, src = f_and_src
        self._set(dst, F.col(self.name(dst)) + lit(alpha(*f)).cast(self.dtype) * F.col(self.name(src)))

    def xpay(self, dst: int, *f_and_src) -> None:
        *f, src = f_and_src
        self._set(dst, lit(alpha(*f)).cast(self.dtype) * F.col(self.name(dst)) + F.col(self.name(src)))

    def dots(self, *pairs: tuple[int, int]) -> list[Scalar]:
        """Several dot products over all spaces by one aggregation."""
        row = self.state.agg(*(F.coalesce(F.sum(F.col(self.name(a)) * F.col(self.name(b))), F.lit(0.0)).alias(f"d{k}") for k, (a, b) in enumerate(pairs))).first()
        return [Scalar(x, self.dtype) for x in row]

    def dot(self, a: int, b: int) -> Scalar:
        return self.dots((a, b))[0]

    def _operators(self) -> DataFrame | None:
        """The entries of all matrices; none if all operators are Gram's."""
        matrices = [m for m in self.matrices if not isinstance(m[0], Gram)]
        if self.operators is None and matrices:
            df = None
            for a, d, r in matrices:
                one = a.entries.select(F.lit(d).alias("dspace"), F.lit(r).alias("rspace"), "row", "col", "entry")
                df = one if df is None else df.union(one)
            self.operator_table = storage.save_bucketed(df, self.buckets, "dspace", "col") if self.buckets else storage.save(df)
            self.operators = self.operator_table.df
        return self.operators

    def _sums(self, *sources: int) -> DataFrame:
        """(space, i, y0, y1, ...): the products with the sources in the rows that have an entry."""
        names = [f"y{k}" for k in range(len(sources))]
        x = self.state.select("space", "i", *(F.col(self.name(s)).alias(y) for s, y in zip(sources, names, strict=True)))
        out, grams = [], [m for m in self.matrices if isinstance(m[0], Gram)]
        if (operators := self._operators()) is not None:
            values = x.withColumnsRenamed({"space": "dspace", "i": "col"})
            out.append(operators.join(values, ["dspace", "col"]).groupBy(F.col("rspace").alias("space"), F.col("row").alias("i")).agg(*(F.sum(F.col("entry") * F.col(y)).alias(y) for y in names)))
        for a, d, r in grams:
            out.append(a.sums(x.where(F.col("space") == d).drop("space"), names).select(F.lit(r).alias("space"), "i", *names))
        df = reduce(DataFrame.union, out)
        return df.groupBy("space", "i").agg(*(F.sum(y).alias(y) for y in names)) if len(out) > 1 else df

    def _product(self, *pairs: tuple[int, int]) -> DataFrame:
        """The state with the products of all operators with the sources, each in its destination."""
        df, columns = self.state.join(self._sums(*(s for _, s in pairs)), ["space", "i"], "left"), self.state.columns
        for k, (dst, _) in enumerate(pairs):
            df = df.withColumn(self.name(dst), F.coalesce(f"y{k}", F.lit(0.0)).cast(self.dtype))
        return df.select(*columns)

    def matvecs(self, *pairs: tuple[int, int]) -> None:
        """Several products by one join and one aggregation."""
        self._save(self._product(*pairs))

    def matvec(self, dst: int, src: int) -> None:
        self.matvecs((dst, src))

    def vector(self, v: int, space: int = 0) -> Vector:
        return Vector(self.state.where(F.col("space") == space).select("i", F.col(self.name(v)).alias("v")), dtype=self.dtype)

    def close(self) -> None:
        """Delete the system's tables; vectors taken from it can't be read any more."""
        for t in (self.table, getattr(self, "operator_table", None)):
            if t:
                storage.delete(self.spark, t)
