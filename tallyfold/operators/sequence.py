"""Matching a sequence of consecutive events per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.physical import epoch_micros
from tallyfold.operators.skew import broadcast_if_small, settled, splittable_join

#: Sets of bounds that are broadcast if there are no more: at 1024 bounds a set 8 MB.
SMALL = 1024


def match_sequence(
    events: DataFrame,
    key: str,
    ts: str,
    order: str,
    kind: str,
    pattern: Sequence[str],
    slices: int = 1024,
    floor: int = 1_000_000,
) -> DataFrame:
    """Places where a key's consecutive events have the kinds of ``pattern``, in order of ``ts, order``.

    One row per place: ``key, start_ts, end_ts, start_id, end_id``. The pattern is the caller's; ``order``
    breaks ties in time, is unique within a key and never null. Events without a key
    or a time have no place.

    Every key of more than ``floor`` events is cut at quantiles of its times into up to ``slices`` slices of about
    equal numbers of events, however its events lie in time; a moment that holds several slices' worth is cut further by
    quantiles of ``order`` (if that is a number). Slices are matched in separate tasks. Only the rows at their edges meet
    again, so matches across slices are found too and no task sorts such a key whole. The bounds are
    written below the shared folder. Keys and times are read once more to count, those of heavy keys again for the quantiles.
    """
    steps = len(pattern) - 1
    slim = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"),
        F.col(ts).alias("ts"),
        F.col(order).alias("id"),
        F.col(kind).alias("kind"),
        epoch_micros(F.col(ts), events.schema[ts].dataType).alias("us"),
    )
    slice_window = Window.partitionBy("key", "slice").orderBy("ts", "id")
    inside = _with_slices(slim, slices, floor).select(
        "*", *_look_ahead(slice_window, pattern), F.row_number().over(slice_window).alias("place")
    )
    at_edge = F.col("slice").isNotNull() & ((F.col("place") <= steps) | F.col("end_id").isNull())
    marked = inside.withColumn("edge", at_edge).where(F.col("hit") | F.col("edge"))

    # Edge rows of a key form one group; a settled match stays with its slice.
    edge_window = Window.partitionBy("key", "edge", F.when(~F.col("edge"), F.col("slice"))).orderBy("ts", "id")
    across = marked.select("*", F.struct(*_look_ahead(edge_window, pattern)).alias("wider"))
    # A row with enough followers inside its slice is settled; only a tail row takes the wider look.
    found = {n: F.when(F.col("end_id").isNotNull(), F.col(n)).otherwise(F.col(f"wider.{n}")) for n in _LOOK}
    return across.where(found["hit"]).select(
        "key",
        F.col("ts").alias("start_ts"),
        found["end_ts"].alias("end_ts"),
        F.col("id").alias("start_id"),
        found["end_id"].alias("end_id"),
    )


_LOOK = ("end_ts", "end_id", "hit")


def _look_ahead(window: Window, pattern: Sequence[str]) -> list[Column]:
    """The end of the stretch that starts at each row, and whether its kinds fit the pattern."""
    fits: Column = F.col("kind") == pattern[0]
    for i, wanted in enumerate(pattern[1:], start=1):
        fits = fits & (F.lead("kind", i).over(window) == wanted)
    steps = len(pattern) - 1
    end_ts, end_id = (F.lead(c, steps).over(window) if steps else F.col(c) for c in ("ts", "id"))
    return [end_ts.alias("end_ts"), end_id.alias("end_id"), F.coalesce(fits, F.lit(False)).alias("hit")]


def _with_slices(slim: DataFrame, slices: int, floor: int) -> DataFrame:
    """Number the slice of every event of a heavy key, in the order of its events; null for all other keys."""
    counts = slim.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > floor)
    heavy = settled(counts.select("key"), "heavy")
    if heavy.isEmpty():
        return slim.withColumn("slice", F.lit(None).cast("long"))
    bounds = settled(_quantiles(slim, heavy, ["key"], "us", slices), "bounds")
    out = _join(slim, bounds, ["key"]).withColumn("slice", _place("us", "bounds", slices) * (slices + 1)).drop("bounds")
    if not isinstance(slim.schema["id"].dataType, T.IntegralType):
        return out
    # A bound that occurs twice is a moment with at least a slice's worth of events.
    again = F.filter("bounds", lambda b, i: b == F.get("bounds", i + 1))
    moments = settled(bounds.select("key", F.explode(F.array_distinct(again)).alias("us")), "moments")
    if moments.isEmpty():
        return out
    ids = settled(_quantiles(slim, moments, ["key", "us"], "id", slices), "moment-bounds")
    # Later events of the same slice follow all of the moment.
    inside = F.coalesce(_place("id", "bounds", slices), F.lit(slices))
    return _join(out, ids, ["key", "us"]).withColumn("slice", F.col("slice") + inside).drop("bounds")


def _join(slim: DataFrame, sides: DataFrame, keys: list[str]) -> DataFrame:
    small = broadcast_if_small(sides, SMALL)
    return slim.join(small, keys, "left") if small is not sides else splittable_join(slim, sides, keys, "left")


def _quantiles(slim: DataFrame, which: DataFrame, keys: list[str], value: str, slices: int) -> DataFrame:
    """``slices - 1`` bounds between equal shares of each key's values."""
    own = slim.select(*keys, value).join(broadcast_if_small(which, 1_000_000), keys, "left_semi")
    shares = [i / slices for i in range(1, slices)]
    return own.groupBy(*keys).agg(F.percentile_approx(value, shares, 4 * slices).alias("bounds"))


def _place(value: str, bounds: str, slices: int) -> Column:
    """How many of the sorted bounds are at most the value, by halving; null without bounds."""
    steps = [1 << i for i in reversed(range(slices.bit_length()))]
    found = F.aggregate(
        F.array(*(F.lit(s) for s in steps)),
        F.lit(0),
        lambda low, step: F.when(F.get(bounds, low + step - 1) <= F.col(value), low + step).otherwise(low),
    )
    return F.when(F.col(bounds).isNotNull(), found).cast("long")
