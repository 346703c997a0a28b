"""Managed tables, literal rows, and time-partitioned folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators.columns import cols
from tallyfold.session import shared_folder

COMMENT = "comment"
DAY = "day"


def create_table(
    spark: SparkSession, name: str, schema: T.StructType, comment: str | None = None, location: str | None = None
) -> None:
    """Create a gzip Parquet table unless it is there; column comments come from the field metadata.

    ``CharType`` and ``VarcharType`` lengths are enforced on insert. ``location`` puts the files elsewhere
    than the warehouse.
    """
    columns = ", ".join(_column(f) for f in schema)
    place = f" LOCATION {_quoted(location)}" if location else ""
    note = f" COMMENT {_quoted(comment)}" if comment else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (compression 'gzip'){place}{note}"
    )


def _column(field: T.StructField) -> str:
    quoted = "`" + field.name.replace("`", "``") + "`"
    note = field.metadata.get(COMMENT)
    return f"{quoted} {field.dataType.simpleString()}" + (f" COMMENT {_quoted(note)}" if note else "")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def append_rows(df: DataFrame, rows: Sequence[tuple], columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` with literal rows appended, bound by column name; columns left out are null."""
    named = list(columns or df.columns)
    literal = df.sparkSession.createDataFrame(list(rows), T.StructType([df.schema[c] for c in named]))
    return df.unionByName(literal, allowMissingColumns=True)


def replace_rows(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Make ``rows`` the content of a table they may themselves be read from, as an upsert or delete does.

    The rows are first written below the shared folder, so the table is never read while it is overwritten,
    and a failed overwrite can be done again from there.
    """
    staged = shared_folder(spark, "staged")
    rows.select(*cols(spark.table(name).columns)).write.parquet(staged)
    spark.read.parquet(staged).write.insertInto(name, overwrite=True)


def retained(df: DataFrame, ts: str, keep_hours: int = 168) -> DataFrame:
    """Rows no older than ``keep_hours`` before the newest one; rows without a time are left out.

    The newest time is a scalar subquery; the comparison is pushed down to the scan.
    """
    oldest = df.agg(F.max(ts) - F.expr(f"INTERVAL {int(keep_hours)} HOURS")).scalar()
    return df.where(F.col(ts) >= oldest)


def write_partitioned(df: DataFrame, path: str, ts: str, keep_hours: int = 168) -> None:
    """Write the retained rows partitioned by day, so that reading a time range touches those days only.

    Rows are gathered by day with the rebalance hint: adaptive execution cuts a crowded day into several
    tasks and joins thin ones.
    """
    daily = retained(df, ts, keep_hours).withColumn(DAY, F.to_date(ts)).hint("rebalance", F.col(DAY))
    daily.write.mode("overwrite").partitionBy(DAY).parquet(path)
