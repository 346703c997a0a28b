"""Time-partitioned folders that are kept up step by step: new rows by day, old days dropped as folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import shared_folder
from tallyfold.sources.folders import Folder
from tallyfold.sources.tables import DAY

UNDATED = f"{DAY}=__HIVE_DEFAULT_PARTITION__"


def append_retained(df: DataFrame, path: str, ts: str, keep_hours: int = 168) -> None:
    """Add ``df`` to the folder of daily partitions, then drop what is older than ``keep_hours`` before the newest row.

    Only the days of the new rows get files, no file is written anew. Rows are gathered by day with the rebalance
    hint: adaptive execution cuts a crowded day into several tasks and joins thin ones. Rows without a time go to a
    partition of their own and are never dropped.
    """
    daily = df.withColumn(DAY, F.to_date(ts)).hint("rebalance", F.col(DAY))
    daily.write.mode("append").partitionBy(DAY).parquet(path)
    drop_old(df.sparkSession, path, ts, keep_hours)


def days(spark: SparkSession, path: str) -> list[str]:
    """The days that have a folder, in order, from the folders' names."""
    found = (n.removeprefix(f"{DAY}=") for n in Folder(spark, path).names() if n.startswith(f"{DAY}=") and n != UNDATED)
    return sorted(found)


def drop_old(spark: SparkSession, path: str, ts: str, keep_hours: int = 168) -> None:
    """Drop rows older than ``keep_hours`` before the newest one; can be run again after a failure.

    The newest time is looked for in the newest day alone. Older days go as folders; of the day that the
    bound falls in, rows are rewritten if any of them is too old. All other days are not read and not touched.
    """
    known = days(spark, path)
    if not known:
        return
    newest = spark.read.parquet(f"{path}/{DAY}={known[-1]}").select(ts)
    kind = newest.schema[ts].dataType.simpleString()
    bound = F.max(ts) - F.expr(f"INTERVAL {int(keep_hours)} HOURS")
    oldest, border = newest.agg(bound.alias("t")).select(F.col("t").cast("string"), F.to_date("t").cast("string")).first()
    if oldest is None:
        return
    folder = Folder(spark, path)
    for day in known:
        if day < border:
            folder.remove(f"{DAY}={day}")
    if border in known:
        _cut_border(spark, path, border, F.col(ts) >= F.lit(oldest).cast(kind))


def _cut_border(spark: SparkSession, path: str, day: str, kept: Column) -> None:
    rows = spark.read.parquet(f"{path}/{DAY}={day}")
    if rows.where(~kept).isEmpty():
        return
    # Written aside first: the day is never read while it is replaced, and a failed swap can be done again.
    staged = shared_folder(spark, "border")
    rows.where(kept).write.parquet(staged)
    if spark.read.schema(rows.schema).parquet(staged).isEmpty():  # an overwrite with nothing would leave the day as it is
        Folder(spark, path).remove(f"{DAY}={day}")
        return
    dated = spark.read.schema(rows.schema).parquet(staged).withColumn(DAY, F.lit(day).cast("date"))
    swap = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    swap.partitionBy(DAY).parquet(path)
