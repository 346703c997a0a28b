"""Physical values of typed columns, as a storage format would keep them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(column: Column, data_type: T.DataType) -> Column:
    """Microseconds since the epoch; a zone-free timestamp counts from the epoch on its own clock."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column)
    minutes = (F.unix_date(column.cast("date")).cast("bigint") * 24 + F.hour(column)) * 60 + F.minute(column)
    second = F.extract(F.lit("SECOND"), column)
    return minutes * 60_000_000 + (second * 1_000_000).cast("bigint")


def physical_value(column: Column, data_type: T.DataType) -> Column:
    """Date: days since the epoch. Timestamp: whole milliseconds, rounded down. String: UTF-8 bytes.

    Every other type stays as it is.
    """
    if isinstance(data_type, T.DateType):
        return F.unix_date(column)
    if isinstance(data_type, T.TimestampType):
        return F.unix_millis(column)
    if isinstance(data_type, T.TimestampNTZType):
        return F.floor(epoch_micros(column, data_type) / 1000)
    if isinstance(data_type, T.StringType):
        return F.encode(column, "UTF-8")
    return column


def physical_values(df: DataFrame) -> DataFrame:
    """One projection that turns every column into its physical value."""
    return df.select(*[physical_value(df[f.name], f.dataType).alias(f.name) for f in df.schema])
