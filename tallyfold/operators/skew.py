"""Hot keys and measured bounds: finding the keys that hold too much, joins that can be cut, checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.columns import cols, names
from tallyfold.session import shared_folder


def heavy_keys(
    df: DataFrame,
    keys: str | Sequence[str],
    most: int = 4096,
    floor: int = 1_000_000,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """The keys with the most rows, where these are more than ``floor``, with their number ``rows``.

    There are never more than ``most`` of them, so the result is safe to broadcast whatever the size of the
    table; and any other key holds less than one part in ``most`` of all rows. ``extra`` adds aggregates
    per key. Only the columns named are read, and counts are combined before the shuffle.
    """
    counts = df.groupBy(*cols(keys)).agg(F.count("*").alias("rows"), *extra)
    return counts.where(F.col("rows") > floor).orderBy(F.desc("rows"), *cols(keys)).limit(most)


def broadcast_if_small(df: DataFrame, rows: int | None) -> DataFrame:
    """Mark ``df`` for broadcast if a count shows at most ``rows`` rows; otherwise leave the choice to Spark.

    The count is a job of its own. It pays where the other side of the join is far larger: adaptive
    execution learns a side's size only while it already shuffles the other one.
    """
    if rows is not None and df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def splittable_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str) -> DataFrame:
    """A left, semi or anti join whose left side may be hot on ``keys`` and whose right side was aggregated by them.

    Adaptive execution cuts a hot partition only if both sides are shuffled for the join itself, but Spark
    would reuse the aggregate's partitioning on the right. A second join column, always zero, has the right side,
    which is the small one, shuffled once more.
    """
    slot = F.pmod(F.hash(*cols(keys)), F.lit(1))
    joined = left.withColumn("_slot", slot).join(right.withColumn("_slot", slot), [*names(keys), "_slot"], how)
    return joined.drop("_slot")


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read back: a small side table that several joins use."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
