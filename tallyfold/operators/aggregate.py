"""Counts over text and rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyfold.operators.columns import hash128
from tallyfold.operators.shape import line_matches

# Fixed pattern: the blanks a word count splits on. Not \s, which differs between engines.
WORD_BREAK = "[ \\t\\n\\r\\f]+"


def word_count(df: DataFrame, text: str) -> DataFrame:
    """How often each word occurs. Counts are combined before the shuffle, so common words are cheap."""
    words = df.select(F.explode(F.split(F.col(text), WORD_BREAK)).alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("n"))


def distinct_match_count(df: DataFrame, line: str, include: str) -> DataFrame:
    """How many different lines match, as one row ``matches``. Lines are told apart by 128-bit hashes; no text is shuffled."""
    matching = df.where(line_matches(F.col(line), include) & F.col(line).isNotNull()).select(hash128(F.col(line)).alias("line"))
    return matching.distinct().agg(F.count("*").alias("matches"))


def count_named(
    df: DataFrame, counters: Mapping[str, Column], group: str, initial: Mapping[str, int] | None = None
) -> DataFrame:
    """Named counters as rows ``(group, name, initial, value)``; each counts the rows meeting its condition.

    The value starts from the counter's initial value.
    """
    start = initial or {}
    rows = [
        F.struct(
            F.lit(group).alias("group"),
            F.lit(name).alias("name"),
            F.lit(start.get(name, 0)).cast("bigint").alias("initial"),
            (F.count_if(condition) + start.get(name, 0)).alias("value"),
        )
        for name, condition in counters.items()
    ]
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def observe_named(df: DataFrame, counters: Mapping[str, Column], group: str) -> tuple[DataFrame, Observation]:
    """Let counters ride along with whatever action runs on the returned frame; no extra pass.

    After the action, ``counter_snapshot`` reads them.
    """
    seen = Observation(group)
    watched = df.observe(seen, *[F.count_if(c).alias(f"{group}_{name}") for name, c in counters.items()])
    return watched, seen


def counter_snapshot(seen: Observation, group: str, initial: Mapping[str, int] | None = None) -> dict[str, int]:
    """Counter values after the action, initial values added."""
    start = initial or {}
    cut = len(group) + 1
    return {name[cut:]: value + start.get(name[cut:], 0) for name, value in seen.get.items()}
