"""Shapes shared by the library."""

from __future__ import annotations

from enum import Enum
from math import prod
from typing import NamedTuple

VECTOR = "i long, v double"
COO = "k long, row long, col long, entry double"
CSR_KERNEL = "k long, col long, entry double"
CSR_ROWPTR = "row long, lo long, hi long"
PARTITION = "color int, i long"
HISTORY = "it int, rr double"
ENTRY_TYPES = ("double", "float")
#: Unsigned 32-bit indices are kept in a long.
INDEX_TYPES = {"int32": "int", "uint32": "long", "int64": "long"}
MAX_DIM = 3


class IndexOrder(Enum):
    ROW_MAJOR = "row"
    COLUMN_MAJOR = "column"


class Rect(NamedTuple):
    """Inclusive bounds of an index space of one to three dimensions."""

    lo: tuple[int, ...]
    hi: tuple[int, ...]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(max(0, h - l + 1) for l, h in zip(self.lo, self.hi, strict=True))

    @property
    def volume(self) -> int:
        return prod(self.shape)

    @classmethod
    def of(cls, *shape: int) -> Rect:
        if not 1 <= len(shape) <= MAX_DIM:
            raise ValueError(f"1 to {MAX_DIM} dimensions")
        return cls((0,) * len(shape), tuple(n - 1 for n in shape))
