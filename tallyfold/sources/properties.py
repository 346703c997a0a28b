"""Properties files and XML property lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.text import BLANKS, first_field, last_field, strip_line, translate_with_suffix
from tallyfold.operators.keyed import last_definition


def scan_properties(
    spark: SparkSession, paths: str | list[str], comment: str = "#", sep: str = "=", value_rule: str = "last"
) -> DataFrame:
    """Every definition in the files, rows ``(file, pos, key, value)``; ``pos`` sorts in file order.

    Blank and comment lines are dropped and a line is cut at the first comment mark. The value is the
    last field (``value_rule="last"``) or all that follows the first separator (``"rest"``). Files are read
    by line, so a large one is split over tasks: ``pos`` is the block's offset and the line's rank in it.
    """
    if value_rule not in ("last", "rest"):
        raise ValueError("value_rule is 'last' or 'rest'")
    lines = spark.read.option("lineSep", "\n").text(paths)
    where = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )
    param = strip_line(F.substring_index(strip_line(F.col("value")), comment, 1))
    found = lines.select(F.col("_metadata.file_path").alias("file"), where.alias("pos"), param.alias("param"))
    found = found.where(F.col("param") != "")
    whole = F.col("param")
    key = first_field(whole, sep)
    if value_rule == "last":
        value = last_field(whole, sep)
    else:
        # Without a separator the only field is both key and value.
        after = F.substr(whole, F.length(key) + F.lit(len(sep) + 1))
        value = F.when(F.contains(whole, F.lit(sep)), after).otherwise(whole)
    blanks = F.lit(BLANKS)
    return found.select("file", "pos", F.btrim(key, blanks).alias("key"), F.btrim(value, blanks).alias("value"))


def read_properties(
    spark: SparkSession, paths: str | list[str], comment: str = "#", sep: str = "=", value_rule: str = "last"
) -> DataFrame:
    """The definitions that hold: the last one of each key in each file."""
    return last_definition(scan_properties(spark, paths, comment, sep, value_rule))


def look_up(params: DataFrame, key: str, source: str = "", target: str = "", suffix: str = "") -> DataFrame:
    """The value of one key, its characters mapped from ``source`` to ``target`` and ``suffix`` added."""
    value = translate_with_suffix(F.col("value"), source, target, suffix)
    return params.where(F.col("key") == key).select(value.alias("value"))


def read_xml_properties(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``name, value`` of every ``<property>`` in XML files; commented-out ones are skipped.

    Each file is one document, read by one task. A document that is not well formed is an error: rows
    after the flaw would be lost otherwise.
    """
    reader = spark.read.format("xml").options(rowTag="property", mode="FAILFAST").schema("name string, value string")
    blanks = F.lit(" \t\r\n")
    return reader.load(path).select(F.btrim("name", blanks).alias("name"), F.btrim("value", blanks).alias("value"))
