from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import keyed, shape

STUDENT = "id bigint, name string, age bigint, gender bigint"


def test_upsert_then_delete(spark, rows):
    base = spark.createDataFrame([(1001, "张三", 25, 0), (1002, "李四", 36, 1)], STUDENT)
    changes = spark.createDataFrame([(1001, "王五", 27, 1, 2), (1001, "赵六", 26, 1, 1)], STUDENT + ", v int")
    after = keyed.upsert(base, changes, "id", "v")
    assert rows(after) == [(1001, "王五", 27, 1), (1002, "李四", 36, 1)]
    assert rows(shape.delete_where(after, F.col("id") == 1001)) == [(1002, "李四", 36, 1)]
    gone = spark.createDataFrame([(1001,), (1001,), (7,)], "id bigint")
    assert rows(keyed.delete_keys(after, gone, "id")) == [(1002, "李四", 36, 1)]


def test_a_late_change_does_not_undo_a_newer_row(spark, rows):
    base = spark.createDataFrame([(1, "new", 9), (2, "old", 1), (3, "only", 5)], "k int, x string, v int")
    changes = spark.createDataFrame([("late", 1, 8), ("newer", 2, 2), ("added", 4, 1)], "x string, k int, v int")
    after = keyed.upsert(base, changes, "k", "v")
    assert rows(after) == [(1, "new", 9), (2, "newer", 2), (3, "only", 5), (4, "added", 1)]


def test_upsert_keeps_the_base_unshuffled(spark, tmp_path):
    spark.range(1000).withColumn("x", F.col("id") * 2).write.parquet(str(tmp_path / "base"))
    spark.createDataFrame([(3, 0, 1)], "id bigint, x bigint, v int").write.parquet(str(tmp_path / "changes"))
    base, changes = (spark.read.parquet(str(tmp_path / n)) for n in ("base", "changes"))
    plan = keyed.upsert(base, changes, "id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_counted_keys_are_broadcast_only_within_the_bound(spark, rows):
    base = spark.range(100).withColumn("x", F.lit(0))
    early, late = spark.range(0, 10), spark.range(5, 10)
    changes = early.selectExpr("id", "1 AS x", "id AS v").union(late.selectExpr("id", "2", "100"))
    plans = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for limit in (9, 10):
        after = keyed.upsert(base, changes, "id", "v", broadcast_rows=limit)
        assert rows(after.groupBy("x").count()) == [(0, 90), (1, 5), (2, 5)]
        gone = keyed.delete_keys(base, changes, "id", broadcast_rows=limit)
        assert gone.count() == 90
        assert keyed.insert_if_absent(gone, changes, "id", "v", broadcast_rows=limit).count() == 100
        plans[limit] = gone._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[10] and "BroadcastHashJoin" not in plans[9]


def test_replace_if_not_null(spark, rows):
    schema = "id int, name string, age int, mark string, v int"
    inserts = [
        (11, "张三", 22, "教师", 1),
        (12, "李四", 25, "学生", 2),
        (13, "王五", 28, None, 3),
        (11, None, 23, None, 4),
        (19, "赵六", 30, "校长", 5),
        (19, "田七", 30, "校长", 6),
    ]
    merged = keyed.merge_replace_if_not_null(spark.createDataFrame(inserts, schema), "id", "v")
    assert rows(merged) == [
        (11, "张三", 23, "教师"),
        (12, "李四", 25, "学生"),
        (13, "王五", 28, None),
        (19, "田七", 30, "校长"),
    ]


def test_two_version_columns_break_ties(spark, rows):
    df = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 4, 9, "c")], "k int, v int, w int, x string")
    assert rows(keyed.latest_by_key(df, "k", ["v", "w"])) == [(1, 5, 2, "b")]
    assert rows(keyed.merge_replace_if_not_null(df, "k", ["v", "w"])) == [(1, "b")]


def test_column_names_with_dots(spark, rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "`k.x` int, `v.x` int, `c.x` string")
    assert rows(keyed.latest_by_key(df, "k.x", "v.x")) == [(1, 2, "b")]


def test_insert_if_absent(spark, rows):
    base = spark.createDataFrame([(1, "old")], "k int, x string")
    new = spark.createDataFrame([(1, "n", 1), (2, "late", 9), (2, "first", 3)], "k int, x string, o int")
    assert rows(keyed.insert_if_absent(base, new, "k", "o")) == [(1, "old"), (2, "first")]


CELLS = [
    ("1", "info", "age", "22"), ("1", "info", "name", "zhao"), ("1", "info", "class", "2"),
    ("1", "address", "city", "shanghai"), ("1", "address", "area", "pudong"),
    ("2", "info", "age", "21"), ("2", "info", "name", "yang"), ("2", "info", "class", "1"),
    ("2", "address", "city", "beijing"), ("2", "address", "area", "CBD"),
]
FAMILIES = {"info": ["age", "name", "class"], "address": ["city", "area"]}


def test_cells(spark, rows):
    puts = [(r, f, q, v, i) for i, (r, f, q, v) in enumerate(CELLS)] + [("2", "info", "age", "20", -1)]
    cells = spark.createDataFrame(puts, "row_key string, family string, qualifier string, value string, version long")
    scanned = keyed.scan_cells(cells)
    assert [(r.row_key, r.family, r.qualifier) for r in scanned.collect()] == sorted(c[:3] for c in CELLS)
    assert rows(scanned, "row_key", "family", "qualifier", "value") == sorted(CELLS, key=repr)
    wide = keyed.scan_wide(cells, FAMILIES)
    assert rows(wide) == [("1", "22", "zhao", "2", "shanghai", "pudong"), ("2", "21", "yang", "1", "beijing", "CBD")]


def test_put_leaves_out_nulls(spark, rows):
    df = spark.createDataFrame([(7, "x", None), (8, None, 2)], "id int, a string, b int")
    cells = keyed.to_cells(df, "id", {"f": ["a", "b"]}, F.lit(5))
    assert rows(cells) == [("7", "f", "a", 5, "x"), ("8", "f", "b", 5, "2")]


def test_last_definition(spark, rows):
    lines = [("f", "k", 1, "a"), ("f", "k", 2, "b"), ("g", "k", 0, "c")]
    df = spark.createDataFrame(lines, "file string, key string, pos int, value string")
    assert rows(keyed.last_definition(df), "file", "key", "value") == [("f", "k", "b"), ("g", "k", "c")]


def test_bucketed_table(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    keyed.write_bucketed(df, "bucketed_rows", "id", 2, "overwrite", str(tmp_path / "t"))
    back = spark.table("bucketed_rows")
    assert back.count() == 1000
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 2
    plan = back.groupBy("id").agg(F.max("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    numbers = keyed.bucketed(df, "id", 2).groupBy("id").agg(F.count_distinct("bucket").alias("n"))
    assert numbers.where("n <> 1").count() == 0
    spark.sql("DROP TABLE bucketed_rows")


def test_a_common_sort_key_is_cut_into_ranges(spark):
    df = spark.range(40_000).select(F.lit(1).alias("k"), "id").withColumn("m", F.create_map(F.lit("a"), "id"))
    df = df.withColumn("k", F.when(F.col("id") < 10, F.col("id")).otherwise(7))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sorted_rows = shape.ordered(df, "k").select("k", F.spark_partition_id().alias("p"))
        sizes = [r["count"] for r in sorted_rows.groupBy("p").count().collect()]
        keys = [r.k for r in shape.ordered(df, "k").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 30_000
    assert keys == sorted(keys)
