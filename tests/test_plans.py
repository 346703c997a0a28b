"""Plans that must hold at scale, for every registered query."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from oracle import duck, rows_of, rows_of_sql
from tallyfold.operators import aggregate, keyed, match, stats, templates
from tallyfold.plans import registry

QUERIES = {n: run for n, run in driver.queries().items() if n in registry.QUERIES}
# Their plans read a folder that a finished stream or write left behind.
PLAIN = [n for n in QUERIES if not n.startswith(("stream", "tail", "sequence_stream"))]


@pytest.mark.parametrize("name", PLAIN)
def test_no_pairs_and_no_python(spark, name):
    plan = QUERIES[name](spark, driver.SMOKE)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "FlatMapGroups"):
        assert word not in plan, plan


JOINS = (
    "upsert upsert_versioned delete_keys insert_if_absent roster_check failing_checks fill_from_table column_stats "
    "ndv_sketch stats_coverage"
).split()


@pytest.mark.parametrize("name", JOINS)
def test_joins_have_another_way_than_broadcast(spark, name):
    thresholds = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for threshold in thresholds:
        spark.conf.set(threshold, "-1")
    try:
        result = QUERIES[name](spark, driver.SMOKE)
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert rows_of(result) == rows_of_sql(duck(driver.SMOKE), driver.oracle_sql()[name])
    finally:
        for threshold in thresholds:
            spark.conf.unset(threshold)


SPLITTING = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "60000",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


def hot_delete(spark, rows):
    gone = spark.range(0, 100_000, 7).select((F.col("id") + 1).alias("k"))
    return keyed.delete_keys(rows, gone, "k"), rows.where("k % 7 <> 1 OR k > 100000")


def hot_null(spark, rows):
    gone = spark.range(0, 100_000, 7).select((F.col("id") + 1).alias("k"))
    nulled = rows.withColumn("k", F.nullif("k", F.lit(0)))
    return keyed.delete_keys(nulled, gone, "k"), nulled.where("k IS NULL OR k % 7 <> 1 OR k > 100000")


def hot_templates(spark, rows):
    texts = rows.select("id", F.concat(F.lit("mark ${m"), "k", F.lit("} end")).alias("text"))
    params = spark.range(50_000).selectExpr("concat('m', id) AS key", "concat('v', id) AS value")
    params = params.groupBy("key").agg(F.max("value").alias("value"))
    shown = F.when(F.col("k") < 50_000, F.concat(F.lit("v"), "k"))
    shown = F.coalesce(shown, F.concat(F.lit("${m"), "k", F.lit("}")))
    wanted = rows.select("id", F.concat(F.lit("mark "), shown, F.lit(" end")).alias("text"))
    return templates.fill_templates(texts, params, keys="id"), wanted


def hot_failures(spark, rows):
    checks = rows.selectExpr("k AS cluster", "id AS host", "'s' AS service", "1 AS expected", "id % 2 AS observed")
    checks = checks.withColumn("ok", F.col("expected") == F.col("observed"))
    found = match.failing_checks(checks).select("cluster", "host")
    return found, rows.where("k = 0 AND id % 2 = 0").selectExpr("k AS cluster", "id AS host")


@pytest.mark.parametrize("case", [hot_delete, hot_null, hot_templates, hot_failures])
def test_a_hot_key_in_a_join_is_split(spark, tmp_path, case):
    """A third of all rows under one key: adaptive execution cuts its partition, and no row is lost."""
    data = spark.range(0, 300_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    data.write.parquet(str(tmp_path / "rows"))
    before = {name: spark.conf.get(name, None) for name in SPLITTING}
    for name, value in SPLITTING.items():
        spark.conf.set(name, value)
    try:
        result, wanted = case(spark, spark.read.parquet(str(tmp_path / "rows")))
        found = result.collect()
        assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()
        assert Counter(map(tuple, found)) == Counter(map(tuple, wanted.select(*result.columns).collect()))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_scans_read_only_what_is_asked(spark):
    plan = QUERIES["agg_key_merge"](spark, driver.SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "ts:" not in plan


def test_exact_distinct_counts_take_one_scan_and_send_no_text(spark):
    source = registry.table(spark, driver.SMOKE, "orders")
    counts = stats._distinct_counts(source, ["o_orderstatus"], ["o_orderpriority", "o_custkey", "o_orderdate"])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    lines = [line for line in plan.split("\n") if "Exchange" in line]
    assert lines and not any("o_orderpriority" in line for line in lines)
    matching = aggregate.distinct_match_count(registry.table(spark, driver.SMOKE, "documents"), "text", "a")
    plan = matching._jdf.queryExecution().executedPlan().toString()
    hashes = re.findall(r"hashpartitioning\(([^)]*)", plan)
    assert hashes and not any("text" in h for h in hashes)
