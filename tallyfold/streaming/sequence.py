"""Event sequences per key on a stream, equal to the batch matcher on the same events."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The state classes travel to the workers by value, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

_EVENT = ("us", "id", "kind")
_FOUND = ("start_us", "end_us", "start_id", "end_id")
_MATCH = Row("key", *_FOUND)
# Stands in the place of a slice number for rows at the edges; grouping keys must not be null.
_EDGES = -(2**62)


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Session settings a stateful stream must be started with: state in RocksDB, changes checkpointed.

    ``partitions`` fixes the number of state partitions; by default one per core of the cluster.
    """
    wanted = {**STATE_STORE, "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


class EdgeMatcher(StatefulProcessor):
    """Joins up the edges of a key's slices; settled matches pass through, many of them as a group of their own.

    A slice is closed once for all its keys, and earlier slices no later than it, so the edges of one batch
    follow those seen before. ``tail`` holds the last of them, from which a later match may start: never
    more rows than the pattern has steps.
    """

    def __init__(self, pattern: Sequence[str]) -> None:
        self.pattern = list(pattern)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState(
            "tail", T.StructType([*_longs("us", "id"), T.StructField("kind", T.StringType())])
        )

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        edges = []
        for row in rows:
            if row.hit:
                yield _MATCH(key[0], row.us, row.end_us, row.id, row.end_id)
            if row.edge:
                edges.append((row.us, row.id, row.kind, row.settled))
        if not edges:
            return
        steps = len(self.pattern) - 1
        edges.sort(key=lambda e: e[:2])
        line = [(*e, False) for e in self.tail.get()] + edges
        if steps:
            self.tail.put([e[:3] for e in line[-steps:]])
        for i, (us, place, _, settled) in enumerate(line[: len(line) - steps]):
            if not settled and all(line[i + j][2] == kind for j, kind in enumerate(self.pattern)):
                yield _MATCH(key[0], us, line[i + steps][0], place, line[i + steps][1])

    def close(self) -> None:
        pass


def match_sequence_stream(
    events: DataFrame,
    key: str,
    ts: str,
    order: str,
    kind: str,
    pattern: Sequence[str],
    delay: str,
    slice_seconds: int = 3600,
    groups: int = 16,
    riding: int = 256,
) -> DataFrame:
    """The batch matcher's rows for a stream: ``key, start_ts, end_ts, start_id, end_id``.

    ``ts`` is a timestamp; events more than ``delay`` behind the newest one are dropped. A match comes out
    once the watermark has passed the time slice of its last event. A windowed aggregate gathers the events of one
    slice and of one of ``groups`` groups of keys, and is dropped when the slice is over; built-in functions put them in order
    and match them. So ``slice_seconds`` bounds what is held: make it short where keys are busy. Only the rows at the
    slices' edges go on to a processor that joins them up by key, along with up to ``riding`` settled matches of a
    group and slice; more of them go on as groups of their own. Start the query under ``state_settings``.
    """
    known = F.col(ts).isNotNull() & F.col(key).isNotNull()
    slim = events.withWatermark(ts, delay).where(known)
    event = F.struct(F.col(key).alias("key"), F.unix_micros(ts).alias("us"), F.col(order).cast("bigint").alias("id"), F.col(kind).alias("kind"))
    key_type = slim.schema[key].dataType
    gathered = slim.groupBy(F.window(ts, f"{slice_seconds} seconds"), F.pmod(F.hash(key), F.lit(groups)).alias("group"))
    slices = gathered.agg(F.sort_array(F.collect_list(event)).alias("line"))
    sliced = slices.select(F.unix_micros("window.start").alias("slice"), F.filter(_matched(pattern), lambda e: e["edge"] | e["hit"]).alias("rows"))
    few = F.size(F.filter("rows", lambda e: e["hit"])) <= riding
    rows = sliced.select("slice", few.alias("few"), F.explode("rows").alias("e"))
    part = F.when(F.col("e.edge") | F.col("few"), _EDGES).otherwise(F.col("slice")).alias("part")
    matches = rows.select(part, "e.*").groupBy("key", "part").transformWithState(
        statefulProcessor=EdgeMatcher(pattern),
        outputStructType=T.StructType([T.StructField("key", key_type), *_longs(*_FOUND)]),
        outputMode="Append",
        timeMode="None",
    )
    return matches.select(
        "key",
        F.timestamp_micros("start_us").alias("start_ts"),
        F.timestamp_micros("end_us").alias("end_ts"),
        "start_id",
        "end_id",
    )


def _matched(pattern: Sequence[str]) -> Column:
    """The events of ``line``, in order of key and time, with what it says of each: are all events that a match starting here needs
    in the line, is there a match, where does it end, may a neighbouring slice matter."""
    steps = len(pattern) - 1

    def look(event: Column, i: Column) -> Column:
        end = F.get("line", i + steps)
        settled = F.coalesce(end["key"] == event["key"], F.lit(False))
        first = ~F.coalesce(F.get("line", i - steps)["key"] == event["key"], F.lit(False))
        fits = settled
        for j, kind in enumerate(pattern):
            fits = fits & F.coalesce(F.get("line", i + j)["kind"] == kind, F.lit(False))
        return F.struct(
            event["key"].alias("key"),
            *(event[n].alias(n) for n in _EVENT),
            settled.alias("settled"),
            fits.alias("hit"),
            ((first if steps else F.lit(False)) | ~settled).alias("edge"),
            *(end[n].alias(f"end_{n}") for n in ("us", "id")),
        )

    return F.transform("line", look)
