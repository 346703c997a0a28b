"""Changes of stored tables by file, and folders kept up by day."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyfold.sources import retention, stored
from tallyfold.sources.folders import Folder


@pytest.fixture
def people(spark, tmp_path):
    """A table of ten files, ids in ranges; partitioned by group on request."""
    made = []

    def make(name, partitioned=False, place="people"):
        path = tmp_path / place
        by = "PARTITIONED BY (grp)" if partitioned else ""
        spark.sql(f"CREATE TABLE {name} (id INT, name VARCHAR(8), grp STRING) USING parquet OPTIONS (compression 'gzip') {by} LOCATION '{path}'")
        made.append(name)
        rows = spark.range(100).selectExpr("cast(id as int) id", "concat('n', id) name", "if(id % 2 = 0, 'e v/en', 'odd') grp")
        rows.repartitionByRange(10, "id").write.insertInto(name)
        return path

    yield make
    for name in made:
        spark.sql(f"DROP TABLE {name}")


def digests(path):
    return {str(p.relative_to(path)): hashlib.sha1(p.read_bytes()).hexdigest() for p in path.rglob("*.parquet")}


@pytest.mark.parametrize("partitioned", [False, True])
@pytest.mark.parametrize("place", ["people", "own people"])
def test_only_files_with_changed_keys_are_written(spark, people, partitioned, place):
    path = people("people_a", partitioned, place)
    before = digests(path)
    changes = spark.createDataFrame([(5, "five", "odd", 1), (5, "FIVE", "odd", 2), (500, "new", "odd", 1), (None, "none", "odd", 1)], "id int, name string, grp string, v int")
    gone = stored.upsert_stored(spark, "people_a", changes, "id", "v")
    after = digests(path)
    assert len(gone) == 1 and set(gone) <= set(before)
    assert {f: d for f, d in after.items() if f in before} == {f: d for f, d in before.items() if f not in gone}
    got = {r.id: r.name for r in spark.table("people_a").collect()}
    assert got == {**{i: f"n{i}" for i in range(100)}, 5: "FIVE", 500: "new", None: "none"}
    assert all(f.endswith(".gz.parquet") for f in after)

    more = stored.delete_stored_keys(spark, "people_a", spark.createDataFrame([(6,), (7000,)], "id int"), "id")
    assert len(more) == 1 and 6 not in {r.id for r in spark.table("people_a").collect()}
    less = stored.delete_stored_where(spark, "people_a", F.col("id") >= 95)
    assert 1 <= len(less) <= 4 and {r.id for r in spark.table("people_a").collect()} == {None, *range(95)} - {6}
    assert not [n for n in Folder(spark, str(path)).names() if n.startswith(stored.SWAP)]


def test_nothing_to_change(spark, people):
    path = people("people_b")
    before = digests(path)
    assert stored.delete_stored_where(spark, "people_b", F.col("id") > 1000) == []
    assert stored.delete_stored_keys(spark, "people_b", spark.createDataFrame([], "id int"), "id") == []
    assert {f: d for f, d in digests(path).items() if f in before} == before and spark.table("people_b").count() == 100


def test_length_checks_hold(spark, people):
    path = people("people_c")
    before = digests(path)
    long = spark.createDataFrame([(5, "much too long", "odd", 1)], "id int, name string, grp string, v int")
    with pytest.raises(Exception, match="EXCEED_LIMIT_LENGTH"):
        stored.upsert_stored(spark, "people_c", long, "id", "v")
    assert digests(path) == before and spark.table("people_c").count() == 100
    stored.recover(spark, "people_c")
    assert spark.table("people_c").count() == 100


def test_an_interrupted_swap_is_finished(spark, people, monkeypatch):
    path = people("people_d")
    remove = Folder.remove

    def fail(self, name):
        if name.endswith(".parquet"):
            raise OSError("lost")
        remove(self, name)

    monkeypatch.setattr(Folder, "remove", fail)
    with pytest.raises(OSError, match="lost"):
        stored.delete_stored_where(spark, "people_d", F.col("id") == 50)
    monkeypatch.setattr(Folder, "remove", remove)
    stored.recover(spark, "people_d")
    assert sorted(r.id for r in spark.table("people_d").collect()) == [i for i in range(100) if i != 50]
    # A journal that was never written: the change did not happen.
    folder = Folder(spark, str(path))
    folder.put(f"{stored.SWAP}x/part.parquet", "broken")
    stored.recover(spark, "people_d")
    assert spark.table("people_d").count() == 99 and not folder.exists(f"{stored.SWAP}x")


EVENTS = "timestamp_ntz'2024-01-01' + make_dt_interval(0, id) AS ts"


def test_a_second_run_rewrites_one_day(spark, tmp_path):
    path = str(tmp_path / "events")
    first = spark.range(0, 240).selectExpr(EVENTS, "id").unionAll(spark.sql("SELECT cast(null as timestamp_ntz), -1L"))
    retention.append_retained(first, path, "ts", 72)
    assert retention.days(spark, path) == [f"2024-01-{d:02}" for d in (7, 8, 9, 10)]
    # Newest is 10 Jan 23:00; kept from 7 Jan 23:00.
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [-1, *range(167, 240)]
    before = digests(tmp_path / "events")
    more = spark.range(240, 254).selectExpr(EVENTS, "id").unionAll(spark.sql("SELECT cast(null as timestamp_ntz), -2L"))
    retention.append_retained(more, path, "ts", 72)
    after = digests(tmp_path / "events")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [-2, -1, *range(181, 254)]
    kept = {f for f in before if f in after}
    assert {f.split("/")[0] for f in kept} == {retention.UNDATED, "day=2024-01-09", "day=2024-01-10"}
    assert all(before[f] == after[f] for f in kept)
    assert retention.days(spark, path) == [f"2024-01-{d:02}" for d in (8, 9, 10, 11)]
    retention.drop_old(spark, path, "ts", 72)
    assert digests(tmp_path / "events") == after


def test_a_border_day_without_a_row_in_time(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [("2024-01-01 05:00:00", 1), ("2024-01-02 05:00:00", 2), ("2024-01-02 05:00:01", 3)]
    df = spark.createDataFrame(rows, "ts string, id int").selectExpr("cast(ts as timestamp_ntz) ts", "id")
    retention.append_retained(df, path, "ts", 24)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3]


def test_only_undated_rows_and_none(spark, tmp_path):
    path = str(tmp_path / "undated")
    retention.append_retained(spark.sql("SELECT cast(null as timestamp) ts, 1 id"), path, "ts", 1)
    assert spark.read.parquet(path).count() == 1 and retention.days(spark, path) == []
    retention.drop_old(spark, str(tmp_path / "nothing"), "ts")
