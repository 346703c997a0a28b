"""Web access logs in two formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.text import iso_to_timestamp

# The mark between fields, and the field names of both formats in order.
MARK = r"-\|-"
MAIN_FIELDS = ("time", "client", "status", "host", "bytes", "request_time", "request", "agent")
JSON_FIELDS = (
    "timestamp",
    "host",
    "client",
    "status",
    "size",
    "response-time",
    "domain",
    "url",
    "referer",
    "agent",
    "x_forwarded_for",
)
# Fixed pattern: method, address and protocol of a request line.
REQUEST = r"^(\S+) (\S+)(?: (\S+))?$"


def parse_access_main(df: DataFrame, line: str) -> DataFrame:
    """Lines of eight fields joined by ``-|-``; the agent, being last, may hold the mark itself.

    Fields that do not fit their type are null. The request is also split into method, uri, protocol.
    """
    parts = df.select(F.split(F.col(line), MARK, len(MAIN_FIELDS)).alias("p"))
    f = {name: F.get("p", F.lit(i)) for i, name in enumerate(MAIN_FIELDS)}
    return parts.select(
        iso_to_timestamp(f["time"]).alias("time"),
        f["client"].alias("client"),
        f["status"].try_cast("int").alias("status"),
        f["host"].alias("host"),
        f["bytes"].try_cast("bigint").alias("bytes"),
        f["request_time"].try_cast("double").alias("request_time"),
        f["request"].alias("request"),
        F.regexp_extract(f["request"], REQUEST, 1).alias("method"),
        F.regexp_extract(f["request"], REQUEST, 2).alias("uri"),
        F.regexp_extract(f["request"], REQUEST, 3).alias("protocol"),
        f["agent"].alias("agent"),
    )


def parse_access_json(df: DataFrame, line: str) -> DataFrame:
    """JSON lines of eleven string fields, typed; a line that is no JSON is kept in ``corrupt``."""
    corrupt = "_corrupt"
    fields = [T.StructField(name, T.StringType()) for name in (*JSON_FIELDS, corrupt)]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    parsed = df.select(F.from_json(F.col(line), T.StructType(fields), options).alias("r"))
    return parsed.select(
        iso_to_timestamp(F.col("r.timestamp")).alias("time"),
        "r.host",
        "r.client",
        F.col("r.status").try_cast("int").alias("status"),
        F.col("r.size").try_cast("bigint").alias("bytes"),
        F.col("r.response-time").try_cast("double").alias("request_time"),
        "r.domain",
        "r.url",
        "r.referer",
        "r.agent",
        "r.x_forwarded_for",
        F.col(f"r.{corrupt}").alias("corrupt"),
    )
