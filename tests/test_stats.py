from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import stats

DAY = datetime.date


@pytest.fixture
def sample(spark):
    rows = [
        ("a", 1, 1.5, Decimal("1.25"), DAY(2024, 1, 1), "x"),
        ("a", 9, None, Decimal("7.25"), DAY(2024, 1, 31), "xyz"),
        ("a", 9, 4.5, None, None, None),
        ("b", None, 2.5, Decimal("3.00"), DAY(2023, 5, 5), "long text"),
    ]
    return spark.createDataFrame(rows, "p string, i int, d double, m decimal(9,2), t date, s string")


COLUMNS = ["i", "d", "m", "t", "s"]


@pytest.mark.parametrize("ndv", ["exact", "sketch"])
def test_column_stats(sample, ndv):
    found = {(r.p, r.column): r for r in stats.column_stats(sample, "p", COLUMNS, ndv).collect()}
    assert len(found) == 10
    i, d, m, t, s = (found["a", c] for c in COLUMNS)
    assert (i.low_long, i.high_long, i.num_nulls, i.ndv, i.type) == (1, 9, 0, 2, "long")
    assert (d.low_double, d.high_double, d.num_nulls, d.ndv) == (1.5, 4.5, 1, 2)
    assert (m.low_decimal, m.high_decimal, m.ndv) == (Decimal("1.25"), Decimal("7.25"), 2)
    assert (t.low_date, t.high_date, t.ndv) == (DAY(2024, 1, 1), DAY(2024, 1, 31), 2)
    assert (s.max_len, s.avg_len, s.num_nulls, s.ndv, s.low_long) == (3, 2.0, 1, 2, None)
    empty = found["b", "i"]
    assert (empty.low_long, empty.num_nulls, empty.ndv) == (None, 1, 0)


def test_merge_and_bounds(sample):
    parts = stats.column_stats(sample, "p", COLUMNS)
    merged = {r.column: r for r in stats.merge_stats(parts).collect()}
    assert (merged["i"].low_long, merged["i"].high_long, merged["i"].num_nulls) == (1, 9, 1)
    assert merged["t"].low_date == DAY(2023, 5, 5)
    assert (merged["s"].max_len, merged["s"].avg_len) == (9, 9.0)
    bounds = {r.column: r for r in stats.ndv_bounds(parts).collect()}
    assert (bounds["i"].ndv_lower, bounds["i"].ndv_upper, bounds["i"].density_sum) == (2, 2, 4.0)
    assert (bounds["d"].ndv_upper, bounds["d"].density_sum) == (3, 1.5)
    assert bounds["t"].density_sum == 15.0
    assert bounds["m"].density_sum == 3.0
    assert bounds["s"].density_sum is None


def test_long_density_is_a_whole_number(spark):
    df = spark.createDataFrame([("p", v) for v in (0, 3, 8)], "p string, v bigint")
    (row,) = stats.ndv_bounds(stats.column_stats(df, "p", ["v"])).collect()
    assert row.density_sum == 2.0


def test_merged_sketch_needs_every_partition(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("p"), (F.col("id") % 4000).alias("v"))
    parts = stats.column_stats(df, "p", ["v"])
    (whole,) = stats.merge_ndv(parts).collect()
    assert abs(whole.ndv - 4000) <= 200
    torn = parts.withColumn("ndv_sketch", F.when(F.col("p") > 0, F.col("ndv_sketch")))
    (row,) = stats.merge_ndv(torn).collect()
    assert row.ndv is None and row.ndv_sketch is None
    assert 0 < row.ndv_lower < row.ndv_upper


def test_coverage(spark, sample, rows):
    have = stats.column_stats(sample.where("p = 'a'"), "p", ["i", "s"])
    found = stats.stats_coverage(have, sample, "p", ["i", "d"])
    assert rows(found) == [("d", 2, 0, False, 0.0), ("i", 2, 1, False, 0.5)]


def test_other_types_are_refused(sample):
    with pytest.raises(TypeError):
        stats.column_stats(sample.withColumn("b", F.lit(True)), "p", ["b"])


def test_sketch_statistics_make_one_pass(sample):
    plan = stats.column_stats(sample, "p", COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan
