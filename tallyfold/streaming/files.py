"""Tailing folders of text and delimited files.

A file source takes in files that appear in the folder; lines added later to a file it has already
seen are not read again. The checkpoint remembers the position, as a tail agent's position file does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators.shape import line_matches
from tallyfold.sources.delimited import read_options, text_schema, typed_columns


def tail_text(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of the files that appear in ``folder``; ``max_files`` bounds one batch, as a channel's capacity does."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder)


def stream_delimited(
    spark: SparkSession, folder: str, schema: T.StructType, sep: str, max_files: int | None = None
) -> DataFrame:
    """Rows of the delimited files that appear in ``folder``, read as the batch loader reads them."""
    reader = spark.readStream.schema(text_schema(schema)).options(**read_options(sep))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(folder).select(*typed_columns(schema))


def stream_match_count(stream: DataFrame, line: str, include: str, exclude: str | None = None) -> DataFrame:
    """Running count of matching lines; write it in complete mode."""
    return stream.where(line_matches(F.col(line), include, exclude)).groupBy().agg(F.count("*").alias("matches"))


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append all that is available to a Parquet folder, exactly once per input, then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def drain_totals(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Bring a folder with running totals up to date, then stop. A batch run twice writes the same totals."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = stream.writeStream.outputMode("complete").foreachBatch(replace)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_load(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    sep: str,
    out: str,
    checkpoint: str,
    max_files: int | None = None,
) -> None:
    """Load the files that have appeared in ``folder`` since the last run into a Parquet folder."""
    drain(stream_delimited(spark, folder, schema, sep, max_files), out, checkpoint)
