"""Keyed-table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import keyed, shape
from tallyfold.plans.registry import query, table
from tallyfold.session import shared_folder


@query("""
    SELECT user_id,
           arg_max(event_type, event_id) FILTER (WHERE event_type <> 'error') AS event_type,
           arg_max(value, event_id) FILTER (WHERE value < 100) AS value,
           arg_max(props, event_id) FILTER (WHERE event_type <> 'error') AS props
    FROM events GROUP BY user_id
""")
def agg_key_merge(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    sound = F.col("event_type") != "error"
    updates = events.select(
        "user_id",
        "event_id",
        F.when(sound, F.col("event_type")).alias("event_type"),
        F.when(F.col("value") < 100, F.col("value")).alias("value"),
        F.when(sound, F.col("props")).alias("props"),
    )
    return keyed.merge_replace_if_not_null(updates, "user_id", "event_id")


@query("""
    SELECT max(event_id) AS event_id, arg_max(ts, event_id) AS ts, user_id,
           arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value,
           arg_max(props, event_id) AS props
    FROM events GROUP BY user_id
""")
def latest_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.latest_by_key(table(spark, folder, "events"), "user_id", "event_id")


@query("""
    WITH newest AS (
        SELECT o_custkey AS k, 'order' AS origin, arg_max(o_totalprice, o_orderkey) AS amount
        FROM orders GROUP BY o_custkey)
    SELECT * FROM newest
    UNION ALL
    SELECT c_custkey, 'customer', c_acctbal FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM newest WHERE k = c_custkey)
""")
def upsert(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"), F.col("c_acctbal").alias("amount")
    )
    changes = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("k"),
        F.lit("order").alias("origin"),
        F.col("o_totalprice").alias("amount"),
        "o_orderkey",
    )
    return keyed.upsert(base, changes, "k", "o_orderkey")


@query("""
    SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
           arg_max(value, event_id) AS value
    FROM events GROUP BY user_id
""")
def upsert_versioned(spark: SparkSession, folder: str) -> DataFrame:
    """All other events as they stand, then purchases, some of them older than the event they meet."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    base = keyed.latest_by_key(events.where("event_type <> 'purchase' OR event_type IS NULL"), "user_id", "event_id")
    return keyed.upsert(base, events.where("event_type = 'purchase'"), "user_id", "event_id")


@query("""
    SELECT * FROM customer WHERE NOT EXISTS (
        SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
""")
def delete_keys(spark: SparkSession, folder: str) -> DataFrame:
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    gone = urgent.select(F.col("o_custkey").alias("c_custkey"))
    return keyed.delete_keys(table(spark, folder, "customer"), gone, "c_custkey")


@query("""
    SELECT event_id, user_id, event_type, value FROM events
    WHERE NOT coalesce(nullif(value, 6.55) > 100, FALSE)
""")
def delete_where(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return shape.delete_where(events, F.nullif(F.col("value"), F.lit(6.55)) > 100)


@query("""
    WITH base AS (SELECT c_custkey AS k, 'customer' AS origin, c_acctbal AS amount
                  FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT * FROM base
    UNION ALL
    SELECT o_custkey, 'order', arg_min(o_totalprice, o_orderkey) FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM base WHERE k = o_custkey) GROUP BY o_custkey
""")
def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"), F.col("c_acctbal").alias("amount")
    )
    new = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("k"),
        F.lit("order").alias("origin"),
        F.col("o_totalprice").alias("amount"),
        "o_orderkey",
    )
    return keyed.insert_if_absent(base, new, "k", "o_orderkey")


CUSTOMER_FAMILIES = {"info": ["c_name", "c_mktsegment"], "account": ["c_acctbal", "c_nationkey"]}
ORDER_FAMILIES = {"state": ["o_orderstatus", "o_orderpriority"], "money": ["o_totalprice"]}


@query("""
    SELECT c_custkey::VARCHAR AS row_key, u.family, u.qualifier, 0::BIGINT AS version, u.value
    FROM customer, LATERAL (VALUES ('info', 'c_name', c_name), ('info', 'c_mktsegment', c_mktsegment),
                                   ('account', 'c_acctbal', c_acctbal::VARCHAR),
                                   ('account', 'c_nationkey', c_nationkey::VARCHAR)) AS u(family, qualifier, value)
    WHERE u.value IS NOT NULL
""")
def cells_put(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.to_cells(table(spark, folder, "customer"), "c_custkey", CUSTOMER_FAMILIES)


def _order_cells(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.to_cells(table(spark, folder, "orders"), "o_custkey", ORDER_FAMILIES, F.col("o_orderkey"))


@query("""
    WITH newest AS (
        SELECT o_custkey, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS s,
               arg_max(o_orderpriority, o_orderkey) AS p, arg_max(o_totalprice, o_orderkey) AS t
        FROM orders GROUP BY o_custkey)
    SELECT o_custkey::VARCHAR AS row_key, u.family, u.qualifier, version, u.value
    FROM newest, LATERAL (VALUES ('state', 'o_orderstatus', s), ('state', 'o_orderpriority', p),
                                 ('money', 'o_totalprice', t::VARCHAR)) AS u(family, qualifier, value)
""")
def cells_scan(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.scan_cells(_order_cells(spark, folder))


@query("""
    SELECT o_custkey::VARCHAR AS row_key, arg_max(o_orderstatus, o_orderkey) AS "state:o_orderstatus",
           arg_max(o_orderpriority, o_orderkey) AS "state:o_orderpriority",
           arg_max(o_totalprice, o_orderkey)::VARCHAR AS "money:o_totalprice"
    FROM orders GROUP BY o_custkey
""")
def cells_scan_wide(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.scan_wide(_order_cells(spark, folder), ORDER_FAMILIES)


@query("SELECT o_custkey, count(*) AS n_rows, 1::BIGINT AS n_buckets, TRUE AS in_range FROM orders GROUP BY o_custkey")
def hash_buckets(spark: SparkSession, folder: str) -> DataFrame:
    rows = keyed.bucketed(table(spark, folder, "orders").select("o_custkey"), "o_custkey", 16)
    return rows.groupBy("o_custkey").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("bucket").alias("n_buckets"),
        F.bool_and(F.col("bucket").between(0, 15)).alias("in_range"),
    )


@query("SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def bucketed_table(spark: SparkSession, folder: str) -> DataFrame:
    """A saved table of hash buckets, then an aggregate on its key, which reads the buckets without a shuffle."""
    path = shared_folder(spark, "orders")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    keyed.write_bucketed(table(spark, folder, "orders"), name, "o_custkey", 8, path=path)
    by_customer = spark.table(name).groupBy("o_custkey")
    return by_customer.agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("top"))


@query("""
    SELECT event_type AS file, user_id AS key, max(event_id) AS pos, arg_max(props, event_id) AS value
    FROM events GROUP BY event_type, user_id
""")
def last_definition(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    definitions = events.select(
        F.col("event_type").alias("file"),
        F.col("user_id").alias("key"),
        F.col("event_id").alias("pos"),
        F.col("props").alias("value"),
    )
    return keyed.last_definition(definitions)


@query("SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def head_rows(spark: SparkSession, folder: str) -> DataFrame:
    return shape.head_rows(table(spark, folder, "orders"), 10, ["o_totalprice", "o_orderkey"])


@query("SELECT * FROM orders ORDER BY o_orderkey")
def ordered(spark: SparkSession, folder: str) -> DataFrame:
    return shape.ordered(table(spark, folder, "orders"), "o_orderkey")


@query("SELECT c_name, c_acctbal FROM customer")
def project(spark: SparkSession, folder: str) -> DataFrame:
    return shape.project(table(spark, folder, "customer"), ["c_name", "c_acctbal"])
