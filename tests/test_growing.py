"""Files that grow: every line once, half-written lines wait, stretches of any size."""

from __future__ import annotations

import random

import pytest

from tallyfold.session import shared_folder
from tallyfold.streaming import files, growing


def drained(spark, folder, out, position, **options):
    files.drain(growing.tail_growing(spark, str(folder), **options), out, position)
    return sorted((r.path.rsplit("/", 1)[-1], r.position, r.value) for r in spark.read.parquet(out).collect())


def test_appended_lines_arrive_once(spark, tmp_path):
    out, position = shared_folder(spark, "out"), shared_folder(spark, "position")
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.log").write_bytes("one\ntwo ü\r\nhal".encode())
    (tmp_path / "_hidden").write_text("no\n")
    (tmp_path / "empty.log").write_text("")
    wanted = [("a.log", 0, "one"), ("a.log", 4, "two ü\r")]
    assert drained(spark, tmp_path, out, position) == wanted
    assert drained(spark, tmp_path, out, position) == wanted
    with open(tmp_path / "a.log", "ab") as f:
        f.write(b"f\n\nthree")
    (tmp_path / "deep" / "b.log").write_bytes(b"bad \xff byte\n")
    wanted += [("a.log", 12, "half"), ("a.log", 17, ""), ("b.log", 0, "bad � byte")]
    assert drained(spark, tmp_path, out, position) == wanted
    with open(tmp_path / "a.log", "ab") as f:
        f.write(b"\n")
    assert drained(spark, tmp_path, out, position) == sorted([*wanted, ("a.log", 18, "three")])


def test_a_shorter_file_is_read_again(spark, tmp_path):
    out, position = shared_folder(spark, "out"), shared_folder(spark, "position")
    (tmp_path / "a.log").write_text("old line\nold line\n")
    assert len(drained(spark, tmp_path, out, position, pattern="*.log")) == 2
    (tmp_path / "a.log").write_text("new\n")
    (tmp_path / "a.txt").write_text("of another name\n")
    assert drained(spark, tmp_path, out, position, pattern="*.log")[0] == ("a.log", 0, "new")


def test_no_folder_yet(spark, tmp_path):
    out, position = shared_folder(spark, "out"), shared_folder(spark, "position")
    files.drain(growing.tail_growing(spark, str(tmp_path / "later")), out, position)
    (tmp_path / "later").mkdir()
    (tmp_path / "later" / "a").write_text("x\n")
    assert drained(spark, tmp_path / "later", out, position) == [("a", 0, "x")]


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
@pytest.mark.parametrize("block", [5, 4 << 20])
def test_stretches_of_any_size(tmp_path, monkeypatch, split, block):
    """The reader by itself: no stretch loses a line or reads one twice."""
    monkeypatch.setattr(growing, "BLOCK", block)
    rnd = random.Random(split)
    lines = ["x" * rnd.choice([0, 1, 5, 30, 200]) + str(i) for i in range(60)]
    (tmp_path / "a").write_text("\n".join(lines) + "\nnot yet")
    reader = growing.GrowingReader(str(tmp_path), "*", split)
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    rows = [r for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
    assert [r["value"] for r in rows] == lines
    text = (tmp_path / "a").read_text()
    assert all(text[r["position"] :].startswith(r["value"] + "\n") for r in rows)
    assert reader.partitions(end, reader.latestOffset()) == []
