"""Round-trip latency: summaries per host, and saved ping reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import integer_part


def latency_summary(df: DataFrame, host: str, value: str, ok: Column) -> DataFrame:
    """Per host: integer part of least, greatest and mean latency of the answered probes, and loss in percent.

    The mean is that of the values as they are written, so it does not depend on the order in which they are added.
    """
    answered = F.when(ok, F.col(value))
    lost = F.count_if(~F.coalesce(ok, F.lit(False)))
    return df.groupBy(F.col(host).alias("host")).agg(
        F.floor(F.min(answered)).alias("min"),
        F.floor(F.max(answered)).alias("max"),
        _whole_mean(answered).alias("avg"),
        F.floor(100 * lost / F.count("*")).alias("loss"),
    )


def _whole_mean(values: Column) -> Column:
    """The floor of the mean, from a sum of decimals: a sum of doubles may come out just below a whole number, or not.

    Digits after the twelfth decimal are rounded. The mean of doubles takes its place where that sum cannot hold the values.
    """
    count = F.count(values)
    total = F.try_sum(values.try_cast("decimal(38,12)"))
    held = (F.count(values.try_cast("decimal(38,12)")) == count) & (F.abs(total) < F.lit(10**15) * count)
    # The remainder first: the quotient of decimals is rounded.
    exact = (total - F.pmod(total, count)) / count
    return F.when(held, exact.cast("bigint")).otherwise(F.floor(F.avg(values)))


def parse_ping(df: DataFrame, report: str, sent: int | None = None) -> DataFrame:
    """Add ``min, max, avg, loss`` read from whole ping reports, Linux or Windows wording.

    Linux loss comes from counting reply lines against ``sent``, or against the number of packets the
    report says were transmitted. A report without a summary gives nulls.
    """
    text = F.col(report)

    def whole(value: Column) -> Column:
        # Casting an empty text costs an exception per row; a null does not.
        return F.nullif(integer_part(value), F.lit("")).try_cast("bigint")

    # Fixed patterns: the summary lines of the two tools. One match each, then cut by separator.
    linux = F.split(F.regexp_extract(text, r"min/avg/max/mdev = ([\d./]+)", 1), "/")
    windows = F.regexp_extract_all(F.regexp_extract(text, r" = \d+ms[,，][^\n]*", 0), F.lit(r" = (\d+)ms"), 1)
    lost_percent = whole(F.regexp_extract(text, r"\((\d+)%", 1))

    transmitted = F.lit(sent) if sent else whole(F.regexp_extract(text, r"(\d+) packets transmitted", 1))
    def is_reply(line: Column) -> Column:
        return F.contains(line, F.lit("icmp_seq")) & F.contains(line, F.lit("ttl"))

    answered = F.size(F.filter(F.split(F.lower(text), "\n"), is_reply))
    linux_loss = F.floor(100 * (transmitted - answered) / transmitted)

    parts = df.select("*", linux.alias("_l"), windows.alias("_w"))
    first, second, third = F.lit(0), F.lit(1), F.lit(2)
    return parts.select(
        *[F.col(c) for c in df.columns],
        F.coalesce(whole(F.get("_l", first)), whole(F.get("_w", first))).alias("min"),
        F.coalesce(whole(F.get("_l", third)), whole(F.get("_w", second))).alias("max"),
        F.coalesce(whole(F.get("_l", second)), whole(F.get("_w", third))).alias("avg"),
        F.coalesce(lost_percent, linux_loss).alias("loss"),
    )
