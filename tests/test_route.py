"""Scripts with blocks, folders of any make, and the one entry for text, file and folder."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import types as T

from tallyfold.sources import delimited, route, sql_script

SCHEMA = T.StructType().add("n", "integer").add("s", "string")


def test_blocks_stay_whole():
    block = "BEGIN DECLARE x INT; IF a THEN SELECT CASE WHEN b THEN ';' END; END IF; BEGIN SELECT t.end; END; END"
    loop = "run: BEGIN WHILE x < 2 DO SET x = x + 1; END WHILE; CASE x WHEN 1 THEN SELECT 1; END CASE; END"
    script = f"SELECT CASE WHEN 1 THEN 2 END; {block}; -- END;\n{loop}; SELECT begin_at FROM t; SELECT 1 AS `begin`"
    assert sql_script.split_statements(script) == ["SELECT CASE WHEN 1 THEN 2 END", block, loop, "SELECT begin_at FROM t", "SELECT 1 AS `begin`"]


def test_a_block_runs(spark):
    last = sql_script.run_sql(spark, "BEGIN DECLARE x INT DEFAULT 1; WHILE x < 10 DO SET x = x * 3; END WHILE; SELECT x; END;")
    assert last.first()[0] == 27


@pytest.mark.parametrize("place", ["in", "in [1] + a%20b"])
def test_text_file_and_folder(spark, rows, tmp_path, place):
    base = tmp_path / place
    (base / "deep").mkdir(parents=True)
    (base / "deep" / "things").mkdir()
    (base / "deep" / "things" / "part-00000.csv").write_text("1,a\n")
    (base / "things.tsv").mkdir()
    (base / "things.tsv" / "part-00001-x.csv").write_text("2\tb\n")
    (base / "other things.hsv").write_text("3-c\n")
    view = f"v_{uuid.uuid4().hex}"
    (base / "deep" / "z.sql").write_text(f"CREATE OR REPLACE TEMPORARY VIEW {view} AS SELECT 7 AS n;")
    schemas = {"things": SCHEMA, "other things": SCHEMA}
    result, tables = route.execute(spark, str(base), schemas)
    assert result is None and spark.table(view).first().n == 7
    assert rows(tables["things"]) == [(1, "a"), (2, "b")] and rows(tables["other things"]) == [(3, "c")]
    assert len(tables["things"].inputFiles()) >= 2

    assert route.kind_of(spark, f"SELECT * FROM {view}") == "text"
    assert route.execute(spark, f"SELECT n + 1 AS m FROM {view}")[0].first().m == 8
    assert route.execute(spark, str(base / "deep" / "z.sql"))[1] == {}
    assert rows(route.execute(spark, str(base / "other things.hsv"), schemas)[1]["other things"]) == [(3, "c")]
    assert [route.kind_of(spark, x) for x in ("", "s3x://no/where", "a:b:c", str(base))] == ["text", "text", "text", "folder"]


def test_files_of_other_tables_are_not_read(spark, tmp_path):
    """The scan of one table opens its own files alone: files that cannot be read do not disturb it."""
    (tmp_path / "small.csv").write_text("1,a\n")
    (tmp_path / "broken.csv").write_text("2,b\n")
    small = delimited.load_folder(spark, str(tmp_path), {"broken": SCHEMA, "small": SCHEMA})["small"]
    (tmp_path / "broken.csv").unlink()
    assert [tuple(r) for r in small.collect()] == [(1, "a")]
