from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyfold.operators import sequence
from tallyfold.operators.sequence import _with_slices, match_sequence
from tallyfold.operators.skew import heavy_keys
from tallyfold.session import shared_folder
from tallyfold.streaming import files
from tallyfold.streaming.sequence import EdgeMatcher, match_sequence_stream, state_settings

START = datetime.datetime(2024, 1, 1)


def make_events(seed, n=600, keys=("hot", "a", "b", "c")):
    """Half of all events under one key, in bursts, with many equal times."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else rng.choice(keys)
        second = rng.choice([5, 5, 5, rng.randrange(4000), rng.randrange(100_000)])
        out.append((key, START + datetime.timedelta(seconds=second), i, rng.choice("xyz")))
    rng.shuffle(out)
    return out


def brute_force(events, pattern):
    by_key = {}
    for e in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        by_key.setdefault(e[0], []).append(e)
    found = []
    for key, line in by_key.items():
        for i in range(len(line) - len(pattern) + 1):
            if all(line[i + j][3] == p for j, p in enumerate(pattern)):
                last = line[i + len(pattern) - 1]
                found.append((key, line[i][1], last[1], line[i][2], last[2]))
    return sorted(found)


SCHEMA = "k string, ts timestamp_ntz, id bigint, kind string"


@pytest.mark.parametrize("floor", [1, 20, 1_000_000])
@pytest.mark.parametrize("pattern", ["x", "xx", "xyx", "zzzz"])
def test_batch_equals_brute_force(spark, pattern, floor):
    events = make_events(len(pattern) + floor)
    df = spark.createDataFrame(events, SCHEMA)
    found = match_sequence(df, "k", "ts", "id", "kind", list(pattern), slices=20, floor=floor)
    assert sorted(tuple(r) for r in found.collect()) == brute_force(events, pattern)


def test_one_moment_for_all_events(spark):
    events = [("k", START, i, "x") for i in range(50)]
    found = match_sequence(spark.createDataFrame(events, SCHEMA), "k", "ts", "id", "kind", ["x", "x"], 20, 1)
    assert found.count() == 49


@pytest.mark.parametrize("spread", ["even", "stray", "moments"])
def test_slices_of_a_heavy_key_are_even(spark, spread):
    """One event long before all others, or most events at a few moments: no slice is much above the mean."""
    moment = {"even": "id", "stray": "if(id = 7, -100000000, id)", "moments": "if(id % 4 = 0, id, 5000 * (id % 3))"}[spread]
    slim = spark.range(20_000).selectExpr("'k' AS key", f"{moment} AS us", "id").unionAll(spark.sql("SELECT 'small', 1L, 2L"))
    cut = _with_slices(slim, 16, 100).where("key = 'k'")
    sizes = [r["count"] for r in cut.groupBy("slice").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 12 and max(sizes) <= 2 * 20_000 / 16
    ends = cut.groupBy("slice").agg(F.min(F.struct("us", "id")).alias("low"), F.max(F.struct("us", "id")).alias("high")).orderBy("slice").collect()
    assert all(tuple(a.high) < tuple(b.low) for a, b in zip(ends, ends[1:], strict=False))


def test_more_heavy_keys_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sequence, "SMALL", 1)
    events = make_events(11)
    found = match_sequence(spark.createDataFrame(events, SCHEMA), "k", "ts", "id", "kind", ["x", "x"], slices=5, floor=20)
    assert sorted(tuple(r) for r in found.collect()) == brute_force(events, "xx")


def test_heavy_keys_are_few(spark, rows):
    df = spark.range(10_000).select(F.when(F.col("id") < 4000, -1).otherwise(F.col("id")).alias("k"))
    found = heavy_keys(df, "k", floor=10)
    assert rows(found) == [(-1, 4000)]
    assert heavy_keys(df, "k", floor=4000).count() == 0
    assert heavy_keys(df, "k", most=3, floor=0).count() == 3


@pytest.mark.parametrize(("pattern", "parts", "riding"), [("x", 1, 0), ("xyx", 3, 0), ("xyx", 2, 256)])
def test_stream_equals_batch(spark, pattern, parts, riding):
    """Several batches, each out of order within the watermark delay."""
    events = sorted(make_events(7, n=400), key=lambda e: e[1])
    events = [e for e in events if e[0] != "c"]
    source = shared_folder(spark, "events")
    schema = "k string, ts timestamp, id bigint, kind string"
    step = len(events) // parts + 1
    batches = [events[i : i + step] for i in range(0, len(events), step)]
    batches.append([("beat", START + datetime.timedelta(days=9), -1, "beat")])
    out, checkpoint = shared_folder(spark, "matches"), shared_folder(spark, "state")
    for batch in batches:
        shuffled = random.Random(1).sample(batch, len(batch))
        df = spark.createDataFrame(shuffled, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        found = match_sequence_stream(stream, "k", "ts", "id", "kind", list(pattern), "1 second", 1800, 2, riding)
        with state_settings(spark, 2):
            files.drain(found, out, checkpoint)
    back = spark.read.parquet(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")})
    assert sorted(tuple(r) for r in back.collect()) == brute_force(events, pattern)


def test_edges_of_a_key_are_matched_row_by_row():
    """Rows as they come, no frame for each key; the tail of one batch meets the edges of the next."""

    class Tail:
        def __init__(self):
            self.held = []

        def getListState(self, name, schema):
            return self

        def get(self):
            return iter(self.held)

        def put(self, rows):
            self.held = rows

    def row(us, kind, settled=False, hit=False, edge=True):
        return Row(us=us, id=us, kind=kind, settled=settled, hit=hit, edge=edge, end_us=us + 1, end_id=us + 1)

    matcher, tail = EdgeMatcher(["x", "x"]), Tail()
    matcher.init(tail)
    first = [row(9, "x"), row(5, "x", True, True, False), row(1, "y", True)]
    assert [tuple(m) for m in matcher.handleInputRows(("k",), iter(first), None)] == [("k", 5, 6, 5, 6)]
    assert tail.held == [(9, 9, "x")]
    assert [tuple(m) for m in matcher.handleInputRows(("k",), iter([row(12, "x")]), None)] == [("k", 9, 12, 9, 12)]
