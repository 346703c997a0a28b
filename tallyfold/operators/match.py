"""An expected roster of services against the processes really seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.skew import splittable_join

RUNNING, STOP, PARTIAL = "RUNNING", "STOP", "PARTIAL"


def match_processes(
    ps: DataFrame, services: Sequence[str], owner: str | None = None, exclude: Sequence[str] = ("grep",)
) -> DataFrame:
    """Processes ``(host, owner, cmd)`` with the service each belongs to, one row per match, any case.

    The service names are a literal list tested inside the scan, so nothing is joined or shuffled.
    """
    command = F.col("_command")
    kept = ps.withColumn("_command", F.lower("cmd"))
    for word in exclude:
        kept = kept.where(~F.contains(command, F.lit(word.lower())))
    if owner is not None:
        kept = kept.where(F.contains(F.lower("owner"), F.lit(owner.lower())))
    hits = F.array(*[F.when(F.contains(command, F.lit(s.lower())), F.lit(s)) for s in services])
    return kept.select("*", F.explode(hits).alias("service")).where(F.col("service").isNotNull()).drop("_command")


def check_roster(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Every roster row with the number of processes seen and whether that is the expected number.

    An unknown expectation (null) is never met, so ``ok`` is never null.

    ``expected`` has ``host, service, expected`` and any other columns; ``observed`` one row per process.
    Processes are counted per (host, service) before they meet the roster.
    """
    counts = observed.groupBy("host", "service").agg(F.count("*").alias("observed"))
    joined = expected.join(counts, ["host", "service"], "left")
    seen = F.coalesce("observed", F.lit(0).cast("bigint"))
    return joined.withColumn("observed", seen).withColumn("ok", F.col("observed").eqNullSafe(F.col("expected")))


def rollup_status(checks: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster: RUNNING if all checks passed, STOP if none did, else PARTIAL; with both counts.

    A check without a result counts as failed.
    """
    checks = checks.withColumn("ok", F.coalesce("ok", F.lit(False)))
    status = (
        F.when(F.bool_and("ok"), RUNNING).when(~F.bool_or("ok"), STOP).otherwise(PARTIAL)
    )
    return checks.groupBy(cluster).agg(
        status.alias("status"),
        F.count_if(F.col("ok")).alias("passed"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


def failing_checks(checks: DataFrame, cluster: str = "cluster") -> DataFrame:
    """The report lines of partly failing clusters: one row per failing (host, service).

    The failures stay rows rather than one list per cluster, so a large cluster never sits in one task.
    """
    partial = rollup_status(checks, cluster).where(F.col("status") == PARTIAL).select(cluster)
    return splittable_join(checks.where(~F.coalesce("ok", F.lit(False))), partial, cluster, "left_semi").select(
        cluster, "host", "service", "expected", "observed", _message().alias("message")
    )


def _message() -> Column:
    return F.format_string("host (%s): service (%s) is not in order", F.col("host").cast("string"), F.col("service"))
