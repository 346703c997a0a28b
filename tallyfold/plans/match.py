"""Roster, template and event-sequence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import match, sequence, templates
from tallyfold.plans.registry import query, table

SERVICES = ["signup", "view", "purchase", "error"]


@query("""
    SELECT user_id AS host, 'svc' || user_id AS owner, 'java com.app.' || event_type || ' ' || props AS cmd, service
    FROM events, (VALUES ('signup'), ('view'), ('purchase'), ('error')) AS s(service)
    WHERE contains(event_type, service)
""")
def match_processes(spark: SparkSession, folder: str) -> DataFrame:
    ps = table(spark, folder, "events").select(
        F.col("user_id").alias("host"),
        F.concat(F.lit("svc"), "user_id").alias("owner"),
        F.concat(F.lit("java com.app."), "event_type", F.lit(" "), "props").alias("cmd"),
    )
    return match.match_processes(ps, SERVICES, owner="SVC", exclude=["grep", "APP.click"])


_CHECKS_SQL = """
    SELECT c_name AS cluster, c_custkey AS host, s.service, 2 AS expected, coalesce(n, 0) AS observed,
           coalesce(n, 0) = 2 AS ok
    FROM customer CROSS JOIN (VALUES ('O'), ('F'), ('P')) AS s(service)
    LEFT JOIN (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
        ON o_custkey = c_custkey AND o_orderstatus = s.service
"""


def _checks(spark: SparkSession, folder: str) -> DataFrame:
    status = F.explode(F.array(F.lit("O"), F.lit("F"), F.lit("P")))
    expected = table(spark, folder, "customer").select(
        F.col("c_name").alias("cluster"),
        F.col("c_custkey").alias("host"),
        status.alias("service"),
        F.lit(2).alias("expected"),
    )
    observed = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("host"), F.col("o_orderstatus").alias("service")
    )
    return match.check_roster(expected, observed)


@query(_CHECKS_SQL)
def roster_check(spark: SparkSession, folder: str) -> DataFrame:
    return _checks(spark, folder)


_STATUS_SQL = f"""
    SELECT cluster, CASE WHEN bool_and(ok) THEN 'RUNNING' WHEN NOT bool_or(ok) THEN 'STOP' ELSE 'PARTIAL' END AS status,
           count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed
    FROM ({_CHECKS_SQL}) GROUP BY cluster
"""


@query(_STATUS_SQL)
def status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return match.rollup_status(_checks(spark, folder))


@query(f"""
    SELECT cluster, host, service, expected, observed,
           'host (' || host || '): service (' || service || ') is not in order' AS message
    FROM ({_CHECKS_SQL})
    WHERE NOT ok AND cluster IN (SELECT cluster FROM ({_STATUS_SQL}) WHERE status = 'PARTIAL')
""")
def failing_checks(spark: SparkSession, folder: str) -> DataFrame:
    return match.failing_checks(_checks(spark, folder))


def _templates(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("${greeting} "), "c_name", F.lit(" of ${nation_"), "c_nationkey", F.lit("}: ${unset}$"))
    return table(spark, folder, "customer").select("c_custkey", "c_mktsegment", text.alias("text"))


@query("""
    SELECT c_custkey, c_mktsegment,
           'Dear ' || c_name || ' of ' || CASE c_nationkey WHEN 7 THEN 'seven'
               ELSE '${nation_' || c_nationkey || '}' END || ': ${unset}$' AS text
    FROM customer
""")
def fill_from_mapping(spark: SparkSession, folder: str) -> DataFrame:
    return templates.fill_templates(_templates(spark, folder), {"greeting": "Dear", "nation_7": "seven"})


@query("""
    SELECT c_custkey, c_mktsegment, '${greeting} ' || c_name || ' of ' || n_name || ': ${unset}$' AS text
    FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def fill_from_table(spark: SparkSession, folder: str) -> DataFrame:
    params = table(spark, folder, "nation").select(
        F.concat(F.lit("nation_"), "n_nationkey").alias("key"), F.col("n_name").alias("value")
    )
    return templates.fill_templates(_templates(spark, folder), params, keys="c_custkey")


@query("""
    SELECT 'greeting' AS key, count(*) AS uses FROM customer
    UNION ALL SELECT 'unset', count(*) FROM customer
    UNION ALL SELECT 'nation_' || c_nationkey, count(*) FROM customer GROUP BY c_nationkey
""")
def template_marks(spark: SparkSession, folder: str) -> DataFrame:
    return templates.marks_of(_templates(spark, folder))


PAIR_SQL = """
    SELECT user_id AS key, ts AS start_ts, end_ts, event_id AS start_id, end_id FROM (
        SELECT *, lead(event_type) OVER w AS next_type, lead(ts) OVER w AS end_ts, lead(event_id) OVER w AS end_id
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE event_type = 'error' AND next_type = 'error'
"""


@query(PAIR_SQL)
def sequence_batch(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return sequence.match_sequence(events, "user_id", "ts", "event_id", "event_type", ["error", "error"])


@query("""
    SELECT year(ts)::INTEGER AS key, ts AS start_ts, end_ts, event_id AS start_id, end_id FROM (
        SELECT *, lead(event_type, 1) OVER w AS second, lead(event_type, 2) OVER w AS third,
               lead(ts, 2) OVER w AS end_ts, lead(event_id, 2) OVER w AS end_id
        FROM events WINDOW w AS (PARTITION BY year(ts) ORDER BY ts, event_id))
    WHERE event_type = 'view' AND second = 'click' AND third = 'purchase'
""")
def sequence_one_key(spark: SparkSession, folder: str) -> DataFrame:
    """All events fall into one year and so under one key: the widest skew there is, matched in time slices."""
    events = table(spark, folder, "events").withColumn("year", F.year("ts"))
    pattern = ["view", "click", "purchase"]
    return sequence.match_sequence(events, "year", "ts", "event_id", "event_type", pattern, floor=1000)
