"""Scalars with IEEE arithmetic on the driver, and the same division for columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"double": np.float64, "float": np.float32}


class Scalar:
    """An immutable float64 or float32. Division by zero and roots of negatives give inf or nan, never an error."""

    __slots__ = ("dtype", "value")

    def __init__(self, value: float | Scalar, dtype: str = "double"):
        object.__setattr__(self, "dtype", dtype)
        object.__setattr__(self, "value", TYPES[dtype](value.value if isinstance(value, Scalar) else value))

    def __setattr__(self, *_: object) -> None:
        raise AttributeError("scalars are immutable")

    @classmethod
    def of(cls, df: DataFrame, dtype: str = "double") -> Scalar:
        """The first column of df's only row; null is 0, the sum of nothing."""
        x = df.first()
        return cls(0.0 if x is None or x[0] is None else x[0], dtype)

    def _with(self, other: float | Scalar, f) -> Scalar:
        with np.errstate(all="ignore"):
            return Scalar(f(self.value, TYPES[self.dtype](other.value if isinstance(other, Scalar) else other)), self.dtype)

    def __add__(self, o): return self._with(o, np.add)  # noqa: E704
    def __sub__(self, o): return self._with(o, np.subtract)  # noqa: E704
    def __mul__(self, o): return self._with(o, np.multiply)  # noqa: E704
    def __truediv__(self, o): return self._with(o, np.divide)  # noqa: E704
    def __pos__(self): return self  # noqa: E704
    def __neg__(self): return Scalar(-self.value, self.dtype)  # noqa: E704
    def __float__(self): return float(self.value)  # noqa: E704
    def __eq__(self, o): return bool(self.value == (o.value if isinstance(o, Scalar) else o))  # noqa: E704
    def __hash__(self): return hash((self.dtype, float(self.value)))  # noqa: E704
    def __repr__(self): return f"Scalar({self.value!r})"  # noqa: E704

    def sqrt(self) -> Scalar:
        with np.errstate(all="ignore"):
            return Scalar(np.sqrt(self.value), self.dtype)

    def rsqrt(self) -> Scalar:
        return Scalar(1.0, self.dtype) / self.sqrt()

    def get(self) -> float:
        return float(self.value)

    def show(self) -> None:
        print(self.value)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.range(1).select(lit(self).alias("value"))


def lit(x: float | Scalar) -> Column:
    """A literal that keeps inf and nan."""
    return F.lit(float(x)).cast(x.dtype if isinstance(x, Scalar) else "double")


def alpha(*f: float | Scalar) -> float | Scalar:
    """A coefficient from up to four factors: 1, f0, f0 / f1, f0 f1 / f2, f0 f1 / (f2 f3)."""
    x = [v if isinstance(v, Scalar) else Scalar(v) for v in f]
    match len(x):
        case 0:
            return Scalar(1.0)
        case 1:
            return x[0]
        case 2:
            return x[0] / x[1]
        case 3:
            return x[0] * x[1] / x[2]
        case 4:
            return x[0] * x[1] / (x[2] * x[3])
    raise ValueError("at most four factors")


def divide(n: Column, d: Column) -> Column:
    """IEEE division of doubles; the sign of a negative zero is not seen."""
    inf = lambda s: F.lit(float(f"{s}inf"))
    return F.when(d != 0, n / d).when(n > 0, inf("")).when(n < 0, inf("-")).otherwise(F.lit(float("nan")))
