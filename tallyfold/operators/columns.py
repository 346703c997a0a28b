"""Small helpers for naming columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def names(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def col(name: str) -> Column:
    """The column with exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(value: str | Sequence[str]) -> list[Column]:
    return [col(n) for n in names(value)]


def ordering(version: str | Sequence[str]) -> Column:
    """One comparable column out of one or more version columns; it is never null, and a null version is the oldest."""
    return F.struct(*(part for v in cols(version) for part in (v.isNotNull(), v)))


def hash128(value: Column) -> Column:
    """128 bits that stand for a value: two hashes of it with different seeds."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))
