"""What the text operators share: row keys, learning folds, tables cut from their lineage, checked broadcasts."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import CHECKPOINT_DIR, shared_folder

ROW = "_llm_row"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def keyed(docs: DataFrame, *columns: str, **named: Column) -> DataFrame:
    """The columns asked for, with a key for each row: repeated rows and null ids stay apart.

    The key is the row's place in its input split, so ``docs`` must come from files or a written table, which
    give the same splits when a lost task is run again.
    """
    return docs.select(
        F.monotonically_increasing_id().alias(ROW), *(F.col(c) for c in columns), *(c.alias(n) for n, c in named.items())
    )


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: later work does not repeat what made it."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the folder that ``spark.checkpoint.dir`` names (a local one in tests)."""
    spark = df.sparkSession
    if not spark.conf.get(CHECKPOINT_DIR, None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return df.checkpoint()


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bound the bytes of one Arrow batch, unless the session has a bound: long texts then come a few at a time."""
    if spark.conf.get(BATCH_BYTES).rstrip("b") == str(2**31 - 1):
        spark.conf.set(BATCH_BYTES, most)


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows; otherwise the join shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``, which deals out the folds for learning; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def task_index() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def runs(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most about ``most`` characters in all, at least one text each."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def one_batch(table: Iterable[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    whole = pa.Table.from_batches(list(table), schema).combine_chunks()
    return whole.to_batches()[0] if whole.num_rows else pa.RecordBatch.from_pylist([], schema)


def single_thread() -> None:
    """Tokenizers must not start threads of their own: each task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
