"""Keyed tables: merge, upsert, delete, insert once, wide-column cells, buckets.

Every "newest wins" here is a ``max_by`` aggregate, not a window: each map task first reduces a key
to one row, so a key that holds a third of the table still reaches its reducer as a handful of rows.
A version must be unique within its key; give several version columns to break ties. A null version is older than
any other, so a row is never lost for want of one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.columns import col, cols, names, ordering
from tallyfold.operators.skew import broadcast_if_small, splittable_join

Names = str | Sequence[str]


def latest_by_key(df: DataFrame, keys: Names, version: Names) -> DataFrame:
    """The newest whole row of every key."""
    keys = names(keys)
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*cols(keys)).agg(F.max_by(F.struct(*cols(rest)), ordering(version)).alias("_newest"))
    return newest.select(*cols(keys), "_newest.*").select(*cols(df.columns))


def merge_replace_if_not_null(df: DataFrame, keys: Names, version: Names) -> DataFrame:
    """Aggregate-key merge: per key, the last non-null value of each column on its own.

    A column that was never set for a key stays null. Version columns are used up.
    """
    keys, versions = names(keys), names(version)
    order = ordering(versions)
    values = [c for c in df.columns if c not in keys and c not in versions]
    merged = [F.max_by(col(c), F.when(col(c).isNotNull(), order)).alias(c) for c in values]
    return df.groupBy(*cols(keys)).agg(*merged)


def upsert(
    base: DataFrame, changes: DataFrame, keys: Names, version: Names, broadcast_rows: int | None = None
) -> DataFrame:
    """``base`` after ``changes``: the newest row of every key.

    Without the version columns in ``base`` every change is newer than it, and they are dropped; with them
    a late change does not undo a newer row. Columns are bound by name and ``base`` holds one row per key.
    ``base`` is only filtered by the changed keys, so a small change set is broadcast and ``base`` is not
    shuffled. With ``broadcast_rows`` the changed keys are counted first, and broadcast if there are no more.
    """
    keys, versions = names(keys), names(version)
    changed = broadcast_if_small(changes.select(*cols(keys)).distinct(), broadcast_rows)
    if set(versions) <= set(base.columns):
        rivals = base.join(changed, keys, "left_semi").unionByName(changes.select(*cols(base.columns)))
    else:
        rivals = changes
    newest = latest_by_key(rivals, keys, versions).select(*cols(base.columns))
    return base.join(changed, keys, "left_anti").unionByName(newest)


def delete_keys(
    base: DataFrame, gone: DataFrame, keys: Names, broadcast_rows: int | None = None, unique: bool = False
) -> DataFrame:
    """Rows of ``base`` whose key is not listed in ``gone``; ``broadcast_rows`` as in ``upsert``.

    Any number of rows may share a key. If there is one row per key, say ``unique``: a bucketed ``base`` is
    then joined where it lies.
    """
    keys = names(keys)
    listed = broadcast_if_small(gone.select(*cols(keys)).distinct(), broadcast_rows)
    if unique:
        return base.join(listed, keys, "left_anti")
    return splittable_join(base, listed, keys, "left_anti")


def insert_if_absent(
    base: DataFrame, new: DataFrame, keys: Names, order: Names, broadcast_rows: int | None = None
) -> DataFrame:
    """``base`` plus the first new row, by ``order``, of every key it does not hold yet.

    ``base`` is reduced to the distinct keys that ``new`` also has before the two meet, so a small
    ``new`` never makes ``base`` shuffle and a repeated key never piles up in one task.
    ``broadcast_rows`` as in ``upsert``.
    """
    keys = names(keys)
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*cols(keys)).agg(F.min_by(F.struct(*cols(rest)), ordering(order)).alias("_first"))
    first = first.select(*cols(keys), "_first.*")
    offered = broadcast_if_small(new.select(*cols(keys)).distinct(), broadcast_rows)
    held = base.select(*cols(keys)).distinct().join(offered, keys, "left_semi")
    added = first.join(held, keys, "left_anti")
    return base.unionByName(added.select(*cols(base.columns)))


def last_definition(df: DataFrame, keys: Names = ("file", "key"), pos: str = "pos") -> DataFrame:
    """Of repeated definitions, the last one in file order wins."""
    return latest_by_key(df, keys, pos)


def to_cells(
    df: DataFrame, row_key: str, families: Mapping[str, Sequence[str]], version: Column | None = None
) -> DataFrame:
    """Wide rows as cells ``(row_key, family, qualifier, version, value)``; a null gives no cell."""
    cells = [
        F.struct(F.lit(family).alias("family"), F.lit(name).alias("qualifier"), col(name).cast("string").alias("value"))
        for family, qualifiers in families.items()
        for name in qualifiers
    ]
    stamped = df.select(
        col(row_key).cast("string").alias("row_key"),
        (F.lit(0) if version is None else version).cast("bigint").alias("version"),
        F.inline(F.array(*cells)),
    )
    return stamped.where(F.col("value").isNotNull()).select("row_key", "family", "qualifier", "version", "value")


def scan_cells(cells: DataFrame, in_order: bool = True) -> DataFrame:
    """The newest version of every cell, one row per cell, in key order."""
    newest = latest_by_key(cells, ["row_key", "family", "qualifier"], "version")
    return newest.orderBy("row_key", "family", "qualifier") if in_order else newest


def scan_wide(cells: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """The newest version of the named cells, one row per row key, columns ``family:qualifier``."""
    columns = [
        F.max_by("value", F.when((F.col("family") == family) & (F.col("qualifier") == name), ordering("version"))).alias(
            f"{family}:{name}"
        )
        for family, qualifiers in families.items()
        for name in qualifiers
    ]
    return cells.groupBy("row_key").agg(*columns)


def bucketed(df: DataFrame, keys: Names, n: int, name: str = "bucket") -> DataFrame:
    """Add each row's hash bucket, numbered as Spark's own bucketed tables number it. Moves no row."""
    return df.withColumn(name, F.pmod(F.hash(*cols(keys)), F.lit(n)))


def write_bucketed(
    df: DataFrame, table: str, keys: Names, n: int, mode: str = "append", path: str | None = None
) -> None:
    """Save as a table of ``n`` hash buckets, so that later joins and merges on the key need no shuffle.

    Rows are first gathered by bucket with the rebalance hint, which lets adaptive execution cut an
    oversized bucket into several tasks and so into several files, and gives a small one a single file.
    """
    keys = names(keys)
    gathered = bucketed(df, keys, n, "_bucket").hint("rebalance", F.col("_bucket")).drop("_bucket")
    writer = gathered.write.mode(mode).bucketBy(n, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)
