"""Changing stored Parquet tables in place by file: only files that hold changed rows are written anew.

Changed rows name their files (``_metadata.file_path``). Their files' rows are written, changed, into a hidden folder
of the table, then moved to the place of the old files. A journal in the hidden folder says which files go; with it an
interrupted swap is finished by the next change (or ``recover``), without it the hidden folder is dropped. Between the
first move and the last removal a reader may see rows twice, and two writers at a time are not supported: that
takes a table format with a log of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import keyed
from tallyfold.operators.columns import cols, names
from tallyfold.operators.skew import broadcast_if_small
from tallyfold.sources.folders import Folder

SWAP, JOURNAL = "_swap-", "_journal"
FILE = "_metadata.file_path"
Names = str | Sequence[str]


def location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").collect()
    return rows[-1].data_type


def upsert_stored(spark: SparkSession, name: str, changes: DataFrame, keys: Names, version: Names) -> list[str]:
    """Bring ``changes`` into a table as ``keyed.upsert`` does; gives the files that were replaced.

    Rows with new keys come in files of their own. Files without a changed key stay as they are, byte for byte.
    """
    recover(spark, name)
    keys = names(keys)
    touched = _files_of(spark.table(name), changes.select(*cols(keys)).distinct(), keys)
    after = keyed.upsert(_rows_in(spark, name, touched), changes, keys, version)
    return _replace(spark, name, touched, after)


def delete_stored_keys(spark: SparkSession, name: str, gone: DataFrame, keys: Names) -> list[str]:
    """Delete the rows of the keys in ``gone``; gives the files that were replaced."""
    recover(spark, name)
    keys = names(keys)
    gone = gone.select(*cols(keys)).distinct()
    touched = _files_of(spark.table(name), gone, keys)
    return _replace(spark, name, touched, _rows_in(spark, name, touched).join(gone, keys, "left_anti"))


def delete_stored_where(spark: SparkSession, name: str, condition: Column) -> list[str]:
    """Delete the rows that meet a condition; gives the files that were replaced. A condition that is null keeps the row.

    The condition reaches the scan, so files whose statistics exclude it are not read.
    """
    recover(spark, name)
    files = spark.table(name).where(condition).select(F.col(FILE).alias("file")).distinct()
    touched = sorted(r.file for r in files.collect())
    return _replace(spark, name, touched, _rows_in(spark, name, touched).where(~F.coalesce(condition, F.lit(False))))


def _files_of(table: DataFrame, changed: DataFrame, keys: list[str]) -> list[str]:
    """Only the key columns are read. Null keys equal none, as in ``keyed``."""
    placed = table.select(*cols(keys), F.col(FILE).alias("_file"))
    files = placed.join(broadcast_if_small(changed, 1_000_000), keys, "left_semi").select("_file").distinct()
    return sorted(r._file for r in files.collect())


def _rows_in(spark: SparkSession, name: str, files: list[str]) -> DataFrame:
    """The rows of these files; Spark leaves the other files out of the scan."""
    return spark.table(name).where(F.col(FILE).isin(files) if files else F.lit(False))


def _replace(spark: SparkSession, name: str, touched: list[str], rows: DataFrame) -> list[str]:
    place = location(spark, name)
    folder, swap = Folder(spark, place), SWAP + uuid.uuid4().hex
    # A passing table of the same kind: its format, compression, partitions and length checks are those of the table.
    passing = f"swap_{uuid.uuid4().hex}"
    target = str(folder.at(swap).toString())
    spark.sql(f"CREATE TABLE {passing} LIKE {name} LOCATION '{target}'")
    try:
        rows.select(*cols(spark.table(name).columns)).write.insertInto(passing)
    finally:
        spark.sql(f"DROP TABLE {passing}")
    root = folder.root.toUri().getPath().rstrip("/") + "/"
    gone = [folder.jvm.java.net.URI(f).getPath().removeprefix(root) for f in touched]
    folder.put(f"{swap}/{JOURNAL}", json.dumps({"gone": gone}))
    _finish(folder, swap)
    spark.catalog.refreshTable(name)
    return gone


def _finish(folder: Folder, swap: str) -> None:
    """Can be run again: what is moved or removed already is passed over."""
    for file in folder.files(swap):
        folder.move(f"{swap}/{file}", file)
    for file in json.loads(folder.get(f"{swap}/{JOURNAL}"))["gone"]:
        folder.remove(file)
    folder.remove(swap)


def recover(spark: SparkSession, name: str) -> None:
    """Finish a change that was interrupted during its swap; drop one that was interrupted before."""
    folder = Folder(spark, location(spark, name))
    for swap in folder.names():
        if swap.startswith(SWAP):
            if folder.exists(f"{swap}/{JOURNAL}"):
                _finish(folder, swap)
            else:
                folder.remove(swap)
    spark.catalog.refreshTable(name)
