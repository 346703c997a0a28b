from __future__ import annotations

from pyspark.sql import types as T

from tallyfold.session import shared_folder
from tallyfold.streaming import files

LINE = "Test whether the software is working"


def test_tail_remembers_its_position(spark, tmp_path):
    out, position = shared_folder(spark, "out"), shared_folder(spark, "position")
    (tmp_path / "a.log").write_text(f"{LINE}\n" * 10)
    files.drain(files.tail_text(spark, str(tmp_path), 1), out, position)
    assert spark.read.parquet(out).count() == 10
    files.drain(files.tail_text(spark, str(tmp_path), 1), out, position)
    assert spark.read.parquet(out).count() == 10
    (tmp_path / "b.log").write_text(f"{LINE}\n" * 3)
    files.drain(files.tail_text(spark, str(tmp_path), 1), out, position)
    assert spark.read.parquet(out).count() == 13


def test_running_match_count(spark, tmp_path):
    out, position = shared_folder(spark, "out"), shared_folder(spark, "position")
    for n, name in enumerate(["a", "b"]):
        (tmp_path / f"{name}.log").write_text(f"{LINE}\nother\n" * (n + 2))
        totals = files.stream_match_count(files.tail_text(spark, str(tmp_path)), "value", "SOFTWARE")
        files.drain_totals(totals, out, position)
    assert [r.matches for r in spark.read.parquet(out).collect()] == [5]


def test_stream_load(spark, rows, tmp_path):
    schema = T.StructType().add("id", "integer").add("name", "string")
    (tmp_path / "a.psv").write_bytes('1|"a|b"\r\n2|\r\n'.encode())
    out, position = shared_folder(spark, "out"), shared_folder(spark, "position")
    for _ in range(2):
        files.stream_load(spark, str(tmp_path), schema, "|", out, position)
    assert rows(spark.read.parquet(out)) == [(1, "a|b"), (2, "")]
