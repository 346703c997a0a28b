"""Rows and values that once were lost without a word."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as driver
from tallyfold.operators import html, keyed, match, templates
from tallyfold.plans.registry import table
from tallyfold.sources.delimited import load_delimited, write_delimited
from tallyfold.sources.sql_script import run_sql

PAIR = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])


def test_a_null_version_is_the_oldest(spark):
    base = spark.createDataFrame([(1, "base", None), (2, "old", None), (2, "new", 1)], "id int, v string, n int")
    assert sorted(map(tuple, keyed.latest_by_key(base, "id", "n").collect())) == [(1, "base", None), (2, "new", 1)]
    merged = keyed.merge_replace_if_not_null(base, "id", "n")
    assert sorted((r.id, r.v) for r in merged.collect()) == [(1, "base"), (2, "new")]
    changes = spark.createDataFrame([(1, "late", 3)], "id int, v string, n int")
    assert ("late",) in [(r.v,) for r in keyed.upsert(base.where("id = 1"), changes, "id", "n").collect()]
    cells = spark.createDataFrame([("r", "f", "q", None, "x")], "row_key string, family string, qualifier string, version long, value string")
    assert keyed.scan_cells(cells).first().value == "x"
    assert keyed.scan_wide(cells, {"f": ["q"]}).first()["f:q"] == "x"


def test_an_unknown_expectation_is_a_failure(spark):
    expected = spark.createDataFrame([("c", "h", "s", 0), ("c", "h", "t", None)], "cluster string, host string, service string, expected long")
    observed = spark.createDataFrame([], "host string, service string")
    (row,) = match.rollup_status(match.check_roster(expected, observed)).collect()
    assert (row.status, row.passed, row.failed) == ("PARTIAL", 1, 1)


def test_a_repeated_parameter_fills_once(spark):
    texts = spark.createDataFrame([(1, "x=${a} y")], "id int, text string")
    params = spark.createDataFrame([("a", "2", 0), ("a", "1", 1)], "key string, value string, pos int")
    assert templates.fill_templates(texts, params, keys="id").first().text == "x=1 y"


def test_links_of_any_spelling(spark):
    page = "<A HREF='one'>First</A> <a class=x href=two>Sec\nond</a> <a\nhref = \"three\"><b>Third</b></a> <a href='up'>Parent</a>"
    pages = spark.createDataFrame([("http://b/", page)], "base string, page string")
    found = [(r.href, r.name) for r in html.extract_links(pages, "base", "page").orderBy("pos").collect()]
    assert found == [("one", "First"), ("two", "Sec\nond"), ("three", "Third")]


def test_a_short_row_does_not_shift_the_cells(spark):
    row = "<tr><td class=link><a href='{0}'>{0}</a></td>{1}<td class='date'>d{0}</td></tr>"
    page = "<table>" + row.format("a", "") + row.format("b", '<TD CLASS="size">9</TD>') + "</table>"
    pages = spark.createDataFrame([("http://b", page)], "base string, page string")
    found = [(r.name, r["size"], r.date) for r in html.extract_listing(pages, "base", "page").collect()]
    assert sorted(found) == [("a", None, "da"), ("b", "9", "db")]


def test_each_file_has_its_separator(spark, tmp_path):
    for name, text in (("x.csv", "1,a\n"), ("y.psv", "2|b\n")):
        (tmp_path / name).write_text(text)
    rows = load_delimited(spark, [str(tmp_path / "x.csv"), str(tmp_path / "y.psv")], PAIR)
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, "b")]


def test_outer_blanks_survive(spark, tmp_path):
    rows = [(1, "  a  "), (2, 'q"|x ')]
    write_delimited(spark.createDataFrame(rows, PAIR).coalesce(1), str(tmp_path / "t.psv"))
    assert sorted(map(tuple, load_delimited(spark, str(tmp_path / "t.psv"), PAIR).collect())) == rows


def test_every_script_of_a_folder_runs(spark, tmp_path):
    (tmp_path / "a.sql").write_text("CREATE OR REPLACE TEMP VIEW one AS SELECT 1 AS x;")
    (tmp_path / "b.sql").write_text("-- nothing\n")
    (tmp_path / "c.sql").write_text("SELECT /*+ COALESCE(1) */ x + 1 AS y FROM one")
    assert run_sql(spark, [str(tmp_path)]).first().y == 2


def test_line_breaks_are_kept_or_refused(spark, tmp_path):
    rows = [(1, 'a\n"b",|\n\nc\n'), (2, "\n"), (3, None), (4, "plain")]
    frame = spark.createDataFrame(rows, PAIR).coalesce(1)
    write_delimited(frame, str(tmp_path / "t.psv"), quoted_breaks=True)
    assert sorted(map(tuple, load_delimited(spark, str(tmp_path / "t.psv"), PAIR, quoted_breaks=True).collect())) == rows
    with pytest.raises(Exception, match="line break in column name"):
        write_delimited(frame, str(tmp_path / "u.psv"))


def test_documents_load_whole(spark, tmp_path):
    documents = table(spark, driver.SMOKE, "documents")
    path = str(tmp_path / "documents.csv")
    write_delimited(documents, path, quoted_breaks=True)
    loaded = load_delimited(spark, path, documents.schema, quoted_breaks=True)
    wanted = documents.withColumn("text", F.translate("text", "\r", ""))
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, wanted.collect()))
    assert documents.where(F.contains("text", F.lit("\n"))).count() > 0
