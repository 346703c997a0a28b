"""A dumped database, loaded by another engine: every statement, every column of every table."""

from __future__ import annotations

import datetime
import math
import uuid
from decimal import Decimal

import duckdb
import pytest

from tallyfold.sources import dump


def test_a_database_replays(spark, tmp_path):
    name = f"db_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    odd = """SELECT * FROM VALUES
        (1, 'it\\'s; "x" \\\\n', 1.5D, 2.5F, DATE'2024-02-29', TIMESTAMP_NTZ'2024-01-01 00:00:00.123456', X'00FF', array(1.0F, null), 12.340BD, true),
        (2, 'a\\nb\\r\\n', double('NaN'), float('-Infinity'), DATE'0001-01-01', TIMESTAMP_NTZ'1969-12-31 23:59:59', X'', array(), -0.001BD, false),
        (3, '', double('Infinity'), float('NaN'), null, null, null, null, null, null),
        (-4, 'NULL', 1e300D, 1e-30F, null, null, null, array(float('NaN')), null, null)
        AS t(id, `odd "name`, d, f, day, at, raw, list, money, flag)"""
    spark.sql(odd).write.saveAsTable(f"{name}.odd_values")
    spark.sql("SELECT 1L AS `select`, timestamp'2024-07-01 12:00:00.5' AS moment").write.saveAsTable(f"{name}.`order`")
    spark.sql("SELECT 1 AS a WHERE false").write.saveAsTable(f"{name}.none")
    spark.sql(f"CREATE VIEW {name}.seen AS SELECT 1 AS a")
    out = str(tmp_path / "dump")
    assert dump.dump_database(spark, name, out) == ["none", "odd_values", "order"]

    con = duckdb.connect()
    for part in sorted((tmp_path / "dump").rglob("part-*"), key=lambda p: (p.parts[-3], p.parts[-2])):
        for line in part.read_text().split("\n"):
            if line:
                con.execute(line)
    got = {r[0]: r[1:] for r in con.execute("SELECT * FROM odd_values").fetchall()}
    day, at = datetime.date, datetime.datetime
    assert got[1][:3] == ("it's; \"x\" \\n", 1.5, 2.5) and got[1][3:] == (day(2024, 2, 29), at(2024, 1, 1, 0, 0, 0, 123456), b"\x00\xff", [1.0, None], Decimal("12.340"), True)
    assert got[2][0] == "a\nb\r\n" and math.isnan(got[2][1]) and got[2][2] == -math.inf
    assert got[2][3:7] == (day(1, 1, 1), at(1969, 12, 31, 23, 59, 59), b"", [])
    assert got[3][0] == "" and got[3][1] == math.inf and got[3][3:] == (None,) * 6
    assert got[-4][0] == "NULL" and got[-4][1] == 1e300 and math.isnan(got[-4][6][0])
    assert [d[0] for d in con.execute("SELECT * FROM odd_values").description][1] == 'odd "name'
    assert con.execute('SELECT "select", epoch_us(moment) FROM "order"').fetchall() == [(1, 1719835200500000)]
    assert con.execute("SELECT count(*) FROM none").fetchone() == (0,)
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_what_has_no_type_is_refused(spark):
    with pytest.raises(TypeError, match="take it apart"):
        dump.dump_lines({"t": spark.sql("SELECT map(1, 2) AS m")}, "ansi")
    with pytest.raises(ValueError, match="dialect"):
        dump.dump_lines({"t": spark.range(1)}, "other")
