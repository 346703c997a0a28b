from __future__ import annotations

import bz2
import datetime
import gzip

import pytest
from pyspark.sql import types as T

from tallyfold.sources import access_log, delimited, dump, properties, sql_script, tables

PERSON = T.StructType().add("id", "integer").add("name", "string").add("score", "double").add("born", "date")


@pytest.mark.parametrize("suffix", ["csv", "psv", "tsv", "ssv", "hsv", "txt", "CSV"])
def test_delimited(spark, rows, tmp_path, suffix):
    sep = {"csv": ",", "psv": "|", "tsv": "\t", "ssv": ";", "hsv": "-"}.get(suffix.lower(), " ")
    lines = ['1|张三|1.5|"2024-01-02"\r', f'2|"a{sep}""b"""|NULL|\r', "3||x|", '4|"NULL"|7|', "5|c\rd|8|"]
    path = tmp_path / f"person.{suffix}"
    path.write_bytes("\n".join(line.replace("|", sep) for line in lines).encode())
    found = delimited.load_delimited(spark, str(path), PERSON)
    assert found.schema["id"].dataType == T.IntegerType()
    assert rows(found) == [
        (1, "张三", 1.5, datetime.date(2024, 1, 2)),
        (2, f'a{sep}"b"', None, None),
        (3, "", None, None),
        (4, None, 7.0, None),
        (5, "cd", 8.0, None),
    ]


def test_only_asked_columns_are_parsed(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1,a,2,2024-01-01\n")
    plan = delimited.load_delimited(spark, str(tmp_path / "p.csv"), PERSON).select("name")
    assert "ReadSchema: struct<name:string>" in plan._jdf.queryExecution().executedPlan().toString()


def test_quoted_line_breaks(spark, rows, tmp_path):
    (tmp_path / "p.csv").write_text('1,"a\nb",2,2024-01-01\n')
    found = delimited.load_delimited(spark, str(tmp_path / "p.csv"), PERSON, quoted_breaks=True)
    assert rows(found, "id", "name") == [(1, "a\nb")]


def test_round_trip_keeps_nulls(spark, rows, tmp_path):
    people = [(1, 'q"|x', 2.0, None), (2, None, None, datetime.date(2020, 1, 1)), (3, "", 0.5, None)]
    df = spark.createDataFrame(people, PERSON)
    delimited.write_delimited(df, str(tmp_path / "t.psv"))
    assert rows(delimited.load_delimited(spark, str(tmp_path / "t.psv"), PERSON)) == rows(df)


def test_folder(spark, rows, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "order-items.csv").write_text("1,a\n")
    (tmp_path / "deep" / "order-items.psv").write_text("2|b\n")
    (tmp_path / "deep" / "odd[1].ssv").write_text("3;c\n")
    script = "CREATE OR REPLACE TEMPORARY VIEW from_folder AS SELECT 42 AS n; -- done\n"
    (tmp_path / "deep" / "setup.sql").write_text(script)
    schema = T.StructType().add("n", "integer").add("s", "string")
    loaded = delimited.load_folder(spark, str(tmp_path), {"order_items": schema, "odd[1]": schema})
    assert rows(loaded["order_items"]) == [(1, "a"), (2, "b")]
    assert rows(loaded["odd[1]"]) == [(3, "c")]
    assert spark.table("from_folder").first().n == 42
    with pytest.raises(KeyError):
        delimited.load_folder(spark, str(tmp_path), {"order_items": schema})


def test_folder_into_tables(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "loaded-rows.csv").write_text("1,a\n2,b\n")
    (tmp_path / "in" / "create.sql").write_text(
        f"CREATE TABLE IF NOT EXISTS loaded_rows (n int, s string) USING parquet LOCATION '{tmp_path}/t'"
    )
    for _ in range(2):
        assert delimited.load_folder_into_tables(spark, str(tmp_path / "in")) == ["loaded_rows"]
    delimited.load_into_table(spark, str(tmp_path / "in" / "loaded-rows.csv"), "loaded_rows")
    assert rows(spark.table("loaded_rows")) == [(1, "a")] * 3 + [(2, "b")] * 3
    spark.sql("DROP TABLE loaded_rows")


def test_compressed_text(spark, rows, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress("一\n".encode()))
    (tmp_path / "b.bz2").write_bytes(bz2.compress(b"two\nlines"))
    (tmp_path / "c.txt").write_text("three")
    assert rows(delimited.read_text(spark, str(tmp_path))) == [("lines",), ("three",), ("two",), ("一",)]


def test_dump_can_be_replayed(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "it's; a \\ \n b"), (2, None)], "id int, note string")
    dump.dump_tables({"notes": df}, str(tmp_path / "d"))
    lines = sorted(p.read_text() for p in (tmp_path / "d").rglob("*.txt"))
    statements = sql_script.split_statements("\n".join(lines))
    assert statements[:2] == ["DROP TABLE IF EXISTS notes", "CREATE TABLE notes (id int, note string)"]
    literals = [s.split(" VALUES ")[1] for s in statements[2:]]
    assert rows(spark.sql("SELECT * FROM VALUES " + ", ".join(literals) + " AS t(id, note)")) == rows(df)


def test_statements():
    script = "SELECT ';' AS a; -- not; this\n/* nor; this */ SELECT `x;y` FROM t;\n\n SELECT 'it''s'"
    assert sql_script.split_statements(script) == ["SELECT ';' AS a", "SELECT `x;y` FROM t", "SELECT 'it''s'"]


def test_script_files(spark, tmp_path):
    (tmp_path / "a.sql").write_text("CREATE OR REPLACE TEMPORARY VIEW s1 AS SELECT 1 AS n;")
    (tmp_path / "b.sql").write_text("SELECT n + 1 AS n FROM s1")
    result = sql_script.run_sql(spark, [str(tmp_path / "a.sql"), str(tmp_path / "b.sql")])
    assert result.first().n == 2


CONF = (
    "# all\r\nserver.user = ops   # who\r\n\n  \t\nserver.hosts=a:1,b:2\nurl = http://x?q=1\n"
    "server.user= root\n#x=1\nflag\nlast=kept"
)


def test_properties(spark, tmp_path):
    (tmp_path / "server.conf").write_bytes(CONF.encode())
    found = {r.key: r.value for r in properties.read_properties(spark, str(tmp_path)).collect()}
    assert found == {"server.user": "root", "server.hosts": "a:1,b:2", "url": "1", "flag": "flag", "last": "kept"}
    hosts = properties.look_up(properties.read_properties(spark, str(tmp_path)), "server.hosts", ",", " ", "!")
    assert hosts.first().value == "a:1 b:2!"
    rest = properties.read_properties(spark, str(tmp_path), value_rule="rest")
    assert {r.key: r.value for r in rest.collect()}["url"] == "http://x?q=1"
    assert {r.key: r.value for r in rest.collect()}["flag"] == "flag"


def test_properties_keep_file_order_over_splits(spark, tmp_path):
    text = "".join(f"k{i % 50} = {i}\n" for i in range(20_000))
    (tmp_path / "big.conf").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scanned = properties.scan_properties(spark, str(tmp_path))
        assert scanned.rdd.getNumPartitions() > 4
        found = {r.key: int(r.value) for r in properties.read_properties(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {f"k{i % 50}": i for i in range(20_000)}


XML = """<?xml version="1.0"?>
<configuration>
  <property><name>a.b</name><value>1</value></property>
  <!-- <property><name>hidden</name><value>2</value></property> -->
  <property>
    <name> c </name>
    <value>x &amp; y</value>
  </property>
</configuration>
"""


def test_xml(spark, rows, tmp_path):
    (tmp_path / "site.xml").write_text(XML)
    assert rows(properties.read_xml_properties(spark, str(tmp_path))) == [("a.b", "1"), ("c", "x & y")]


def test_access_logs(spark):
    line = "2024-01-02 03:04:05-|-10.0.0.1-|-502-|-host-|-12-|-0.125-|-POST /a b HTTP/2-|-curl -|- x"
    df = spark.createDataFrame([(line,), ("junk",)], "l string")
    good, bad = access_log.parse_access_main(df, "l").collect()
    assert good.time == datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert (good.status, good.bytes, good.request_time, good.agent) == (502, 12, 0.125, "curl -|- x")
    assert bad.time is None and bad.status is None
    text = '{"timestamp":"2024-01-02 03:04:05","status":"200","size":"-","response-time":"0.5","url":"/"}'
    good, bad = access_log.parse_access_json(spark.createDataFrame([(text,), ("{",)], "l string"), "l").collect()
    assert (good.status, good.bytes, good.request_time, good.url, good.corrupt) == (200, None, 0.5, "/", None)
    assert bad.corrupt == "{" and bad.status is None


def test_tables(spark, rows, tmp_path):
    schema = T.StructType(
        [
            T.StructField("id", T.IntegerType(), metadata={"comment": "it's the key"}),
            T.StructField("name", T.VarcharType(4)),
            T.StructField("remark", T.StringType()),
        ]
    )
    for _ in range(2):
        tables.create_table(spark, "person", schema, "people", str(tmp_path / "person"))
    spark.createDataFrame([(1, "张三", "学生")], "id int, name string, remark string").write.insertInto("person")
    more = tables.append_rows(spark.table("person"), [(2, "李四")], ["id", "name"])
    assert rows(more) == [(1, "张三", "学生"), (2, "李四", None)]
    notes = {r.col_name: r.comment for r in spark.sql("DESCRIBE person").collect()}
    assert notes["id"] == "it's the key"
    with pytest.raises(Exception, match="EXCEED_LIMIT_LENGTH"):
        spark.createDataFrame([(3, "too long", "")], "id int, name string, remark string").write.insertInto("person")
    assert any(p.name.endswith(".gz.parquet") for p in (tmp_path / "person").iterdir())
    spark.sql("DROP TABLE person")


def test_retention_is_pushed_down_and_pruned(spark, tmp_path):
    df = spark.range(400).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, id) AS ts", "id")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    plan = tables.retained(source, "ts")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,ScalarSubquery" in plan
    tables.write_partitioned(source, str(tmp_path / "out"), "ts", 24)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 25
    newest = back.where("day = date'2024-01-17'")
    assert "PartitionFilters: [isnotnull(day" in newest._jdf.queryExecution().executedPlan().toString()


def test_rows_that_do_not_fit_are_rescued(spark, rows, tmp_path):
    schema = T.StructType().add("id", "integer").add("name", "string").add("n", "double")
    text = '1,NULL,2.5\r\n2,"NULL",\n3,"a ""b"", c",NULL\n4,short\n5,x,1,2\nsix,y,z\n\n7,a"b,""\n8,"open,3\n'
    (tmp_path / "a.csv").write_text(text)
    loaded = delimited.load_rescued(spark, str(tmp_path / "a.csv"), schema)
    found = {r.rescued.line if r.rescued else None: r for r in loaded.collect()}
    good = sorted(tuple(r)[:3] for r in loaded.where("rescued IS NULL").collect())
    assert good == [(1, None, 2.5), (2, "NULL", None), (3, 'a "b", c', None), (7, 'a"b', None), (8, '"open', 3.0)]
    assert tuple(found["4,short"])[:3] == (4, "short", None) and found["4,short"].rescued.fields == 2
    assert tuple(found["5,x,1,2"])[:3] == (5, "x", 1.0) and found["5,x,1,2"].rescued.uncast == []
    assert tuple(found["six,y,z"])[:3] == (None, "y", None) and found["six,y,z"].rescued.uncast == ["id", "n"]
    assert found[""].rescued.fields == 1 and len(found) == 5
    assert delimited.load_rescued(spark, str(tmp_path / "a.csv"), schema, bad="drop").count() == 5
    with pytest.raises(Exception, match="a row does not fit"):
        delimited.load_rescued(spark, str(tmp_path / "a.csv"), schema, bad="fail").collect()
    long = '9,"' + 'x""' * 50_000 + '",1\n'
    (tmp_path / "b.psv").write_text("10|a,b|2\n")
    (tmp_path / "c.csv").write_text(long)
    more = delimited.load_rescued(spark, [str(tmp_path / "b.psv"), str(tmp_path / "c.csv")], schema).collect()
    assert sorted((r.id, len(r.name), r.rescued) for r in more) == [(9, 100_000, None), (10, 3, None)]
