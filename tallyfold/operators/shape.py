"""Projection, filter, sort and limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators.columns import cols

# The answers treated as a failed request, besides the whole range 500 to 505.
FAILED_STATUS = (400, 404, 499)
FAILED_STATUS_RANGE = (500, 505)


def head_rows(df: DataFrame, n: int = 10, order: str | Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows; give ``order`` for a stable answer."""
    return (df.orderBy(*cols(order)) if order else df).limit(n)


def ordered(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Rows in order. Equal keys are ordered by a hash of the row, so a common key is cut into several ranges."""
    hashed = [f.name for f in df.schema if not _holds_map(f.dataType)]
    return df.orderBy(*cols(by), F.xxhash64(*cols(hashed)))


def _holds_map(data_type: T.DataType) -> bool:
    # Spark does not hash maps.
    return "map<" in data_type.simpleString()


def project(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*cols(wanted))


def line_matches(line: Column, include: str, exclude: str | None = None) -> Column:
    """True where the line matches ``include`` and not ``exclude``, in any case."""
    found = line.rlike(f"(?i){include}")
    return found & ~line.rlike(f"(?i){exclude}") if exclude else found


def match_count(df: DataFrame, line: str, include: str, exclude: str | None = None) -> DataFrame:
    """How many lines match, as one row ``matches``."""
    return df.where(line_matches(F.col(line), include, exclude)).agg(F.count("*").alias("matches"))


def failed_requests(df: DataFrame, status: str = "status") -> DataFrame:
    """Requests answered with one of the failure codes."""
    code = F.col(status)
    return df.where(code.isin(*FAILED_STATUS) | code.between(*FAILED_STATUS_RANGE))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows left after a delete; a condition that is null keeps its row."""
    return df.where(~F.coalesce(condition, F.lit(False)))
