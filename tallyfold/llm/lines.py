"""Removal of repeated runs of lines by winnowing, in DataFrame operations only.

A run counts from ``words`` words on. From every line starts the shortest run of that many words; its smallest line
hash is its fingerprint (window minima: two equal runs have equal fingerprints, wherever they stand). Positions
are joined by fingerprint, which leaves the runs that can repeat at all. These are extended both ways: the run
that grows forward from a line and the one that grows backward from it are compared with the earliest equal run.
Every line of a repeated run of any length lies in a repeated run of one of the two kinds, so their union is the
whole extension of all matches, and no positions are ever paired within a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import ROW, keyed, saved
from tallyfold.operators.skew import splittable_join


def line_table(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: the row's key and id, the line's place, its hash and where its words start and end."""
    lines = keyed(docs, doc_id=F.col("doc_id").cast("long"), lines=F.split("text", "\n"))
    lines = lines.select(ROW, "doc_id", F.posexplode("lines").alias("line", "content"))
    count = F.regexp_count("content", F.lit(r"[^\x20\x09-\x0D]+"))
    lines = lines.select(ROW, "doc_id", "line", F.xxhash64("content").alias("hash"), count.alias("count")).where("count > 0")
    ends = F.sum("count").over(Window.partitionBy(ROW).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("ends", ends)
    return lines.withColumn("starts", F.col("ends") - F.col("count"))


def runs_of(lines: DataFrame, words: int) -> DataFrame:
    """The shortest runs of ``words`` words that start or end at each line: first and last line, fingerprint, hash of all."""
    ahead = Window.partitionBy(ROW).orderBy("starts").rangeBetween(0, words - 1)
    behind = Window.partitionBy(ROW).orderBy("ends").rangeBetween(1 - words, 0)

    def run(first: Column, last: Column, span: Column, frame) -> Column:
        # null where the text has too few words left for a run
        hashes = F.collect_list("hash").over(frame)
        whole = F.struct(
            first.alias("first"), last.alias("last"), F.array_min(hashes).alias("fingerprint"),
            F.xxhash64(hashes).alias("run"),
        )
        return F.when(span >= words, whole)

    forward = run(F.col("line"), F.max("line").over(ahead), F.max("ends").over(ahead) - F.col("starts"), ahead)
    backward = run(F.min("line").over(behind), F.col("line"), F.col("ends") - F.min("starts").over(behind), behind)
    both = lines.select(ROW, "doc_id", F.array(forward, backward).alias("runs"))
    both = both.select(ROW, "doc_id", F.explode(F.array_distinct(F.array_compact("runs"))).alias("r"))
    return both.select(ROW, "doc_id", "r.*")


def repeated_runs(docs: DataFrame, words: int = 50) -> DataFrame:
    """The runs that repeat an earlier one: the row's key, first and last line.

    Earlier is by doc_id (null last), then the row's place in the table, then the line. A run does not repeat one of the
    same text that it overlaps.
    """
    runs = saved(runs_of(line_table(docs), words), "line-runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW, "first", "last")
    shared = runs.groupBy("fingerprint").agg(F.min(F.struct(ROW, "first")).alias("low"), F.max(F.struct(ROW, "first")).alias("high"))
    shared = shared.where("low <> high").select("fingerprint")
    matched = splittable_join(runs, shared, "fingerprint", "left_semi")
    earliest = matched.groupBy("run").agg(F.min(place).alias("earliest"), F.count("*").alias("times"))
    joined = splittable_join(matched, earliest.where("times > 1").drop("times"), "run", "inner")
    apart = (F.col(ROW) != F.col(f"earliest.{ROW}")) | (F.col("first") > F.col("earliest.last"))
    return joined.where(apart).select(ROW, "first", "last")


def without_repeated_runs(docs: DataFrame, words: int = 50) -> DataFrame:
    """``docs`` with ``text`` less the lines in repeated runs, and ``removed``: how many lines went.

    Lines end at line feeds and count as repeated only if equal in every character. Lines without a word belong to no run
    but go with one around them. A text that repeats others altogether becomes empty. Null texts stay null; null ids
    come last; repeated rows are rows of their own, of which the first keeps its text. Other columns stay as
    they are, whatever their names, but for one called ``removed``, which is replaced.
    """
    names = [c for c in docs.columns if c != "removed"]
    gone = repeated_runs(docs, words).groupBy(ROW).agg(
        F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(first, last)")))).alias("gone")
    )
    held = F.struct(*(F.col(f"`{c}`") for c in names))
    rows = keyed(docs, held=held, lines=F.split("text", "\n"))
    joined = rows.join(gone, ROW, "left")
    # Kept places as a set difference, then one look-up each: linear in the lines of a text.
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("held.text")).otherwise(
        F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    )
    columns = [text.alias(c) if c == "text" else F.col(f"held.`{c}`").alias(c) for c in names]
    return joined.select(*columns, F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
