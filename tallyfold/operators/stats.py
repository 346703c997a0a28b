"""Column statistics per partition, and merging them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators.columns import col, cols, hash128, names

FAMILIES = {
    "long": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "double": (T.FloatType, T.DoubleType),
    "decimal": (T.DecimalType,),
    "date": (T.DateType,),
    "string": (T.StringType,),
}
RANGED = ("long", "double", "decimal", "date")


def family_of(data_type: T.DataType) -> str:
    """Which of the five kinds of statistics a column type has."""
    for family, types in FAMILIES.items():
        if isinstance(data_type, types):
            return family
    raise TypeError(f"no statistics for {data_type.simpleString()}; cast the column first")


def column_stats(
    df: DataFrame, part: str | Sequence[str], columns: Sequence[str], ndv: str = "sketch"
) -> DataFrame:
    """Statistics of each column in each partition, one row per (partition, column).

    Numbers and dates: low, high, nulls, distinct count. Strings: longest, mean length, nulls, distinct
    count. ``ndv="sketch"`` keeps a mergeable sketch of fixed size, and all columns come from one pass.
    ``ndv="exact"`` counts distinct values in a second pass over all columns, which shuffles a hash for each distinct value.
    """
    if ndv not in ("sketch", "exact"):
        raise ValueError("ndv is 'sketch' or 'exact'")
    part = names(part)
    kinds = {name: family_of(df.schema[name].dataType) for name in columns}
    scale = max([df.schema[n].dataType.scale for n, k in kinds.items() if k == "decimal"], default=18)
    stored = {"long": "bigint", "double": "double", "decimal": f"decimal(38,{scale})", "date": "date"}

    wide = df.groupBy(*cols(part)).agg(
        *[_one_column(col(n), k, stored, ndv == "sketch").alias(f"_{i}") for i, (n, k) in enumerate(kinds.items())]
    )
    rows = [
        F.struct(F.lit(n).alias("column"), F.lit(k).alias("type"), F.col(f"_{i}").alias("s"))
        for i, (n, k) in enumerate(kinds.items())
    ]
    long = wide.select(*cols(part), F.inline(F.array(*rows))).select(*cols(part), "column", "type", "s.*")
    if ndv == "sketch":
        counted = long.withColumn("ndv", F.hll_sketch_estimate("ndv_sketch"))
    else:
        exact = _distinct_counts(df, part, columns)
        same = _same([*part, "column"], long, exact)
        counted = long.join(exact, same).select(*[long[f"`{c}`"] for c in long.columns], exact["ndv"])
    return counted.select(*cols(part), *STAT_COLUMNS)


STAT_COLUMNS = (
    "column",
    "type",
    *[f"{side}_{family}" for family in RANGED for side in ("low", "high")],
    "num_nulls",
    "ndv",
    "ndv_sketch",
    "max_len",
    "avg_len",
)


def _distinct_counts(df: DataFrame, part: list[str], columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts in one scan: every value as its column's number and its hash, made distinct before the shuffle.

    Hashes have 128 bits, so values themselves are not sent. A column of nulls only counts zero.
    """
    values = [F.struct(F.lit(i).alias("at"), F.when(col(n).isNotNull(), hash128(col(n))).alias("value")) for i, n in enumerate(columns)]
    single = df.select(*cols(part), F.inline(F.array(*values))).distinct()
    counts = single.groupBy(*cols(part), "at").agg(F.count("value").alias("ndv"))
    named = F.element_at(F.array(*(F.lit(n) for n in columns)), F.col("at") + 1)
    return counts.withColumn("column", named).drop("at")


def _same(by: list[str], left: DataFrame, right: DataFrame) -> Column:
    """Equality on all names; a null partition equals a null partition."""
    same = F.lit(True)
    for name in by:
        same = same & left[f"`{name}`"].eqNullSafe(right[f"`{name}`"])
    return same


def _one_column(value: Column, kind: str, stored: dict[str, str], sketch: bool) -> Column:
    fields = []
    for family in RANGED:
        low, high = (F.min(value), F.max(value)) if family == kind else (F.lit(None), F.lit(None))
        fields += [
            low.cast(stored[family]).alias(f"low_{family}"),
            high.cast(stored[family]).alias(f"high_{family}"),
        ]
    text = kind == "string"
    return F.struct(
        *fields,
        F.count_if(value.isNull()).alias("num_nulls"),
        (F.hll_sketch_agg(_sketchable(value, kind)) if sketch else F.lit(None).cast("binary")).alias("ndv_sketch"),
        (F.max(F.length(value)) if text else F.lit(None)).cast("bigint").alias("max_len"),
        (F.avg(F.length(value)) if text else F.lit(None)).cast("double").alias("avg_len"),
    )


def _sketchable(value: Column, kind: str) -> Column:
    """The sketch takes longs and strings; anything else is hashed to a long, nulls left out."""
    if kind == "string":
        return value
    if kind == "long":
        return value.cast("bigint")
    return F.when(value.isNotNull(), F.xxhash64(value))


def _groups(keys: str | Sequence[str]) -> list[Column]:
    return cols([*names(keys), "column", "type"])


def merge_stats(stats: DataFrame, keys: str | Sequence[str] = ()) -> DataFrame:
    """Fold partition statistics into one row per column, or per key and column.

    Low is the least, high the greatest, nulls add up; the merged mean length is the greatest mean.
    """
    ranges = [
        agg(f"{side}_{family}").alias(f"{side}_{family}")
        for family in RANGED
        for side, agg in (("low", F.min), ("high", F.max))
    ]
    return stats.groupBy(*_groups(keys)).agg(
        *ranges,
        F.sum("num_nulls").alias("num_nulls"),
        F.max("max_len").alias("max_len"),
        F.max("avg_len").alias("avg_len"),
    )


def ndv_bounds(stats: DataFrame, keys: str | Sequence[str] = ()) -> DataFrame:
    """What distinct counts alone say about their union: lower and upper bound, and the density sum.

    The density of a partition is (high - low) / ndv: whole numbers for longs and for days between
    dates, real numbers for doubles and decimals. Partitions without values add nothing.
    """
    ndv = F.nullif(F.col("ndv"), F.lit(0))
    wide = F.col("high_long").cast("decimal(20,0)") - F.col("low_long").cast("decimal(20,0)")
    days = F.date_diff("high_date", "low_date").cast("decimal(20,0)")
    real = (F.col("high_decimal").cast("double") - F.col("low_decimal").cast("double")) / ndv
    density = F.coalesce(
        _whole_quotient(wide, ndv),
        _whole_quotient(days, ndv),
        (F.col("high_double") - F.col("low_double")) / ndv,
        real,
    )
    return stats.groupBy(*_groups(keys)).agg(
        F.max("ndv").alias("ndv_lower"),
        F.sum("ndv").alias("ndv_upper"),
        F.sum(density).alias("density_sum"),
    )


def _whole_quotient(span: Column, ndv: Column) -> Column:
    # Ranges are never negative, so rounding down is the integer quotient.
    return F.floor(span / ndv).cast("double")


def merge_ndv(stats: DataFrame, keys: str | Sequence[str] = ()) -> DataFrame:
    """Distinct count of the union of partitions, from their sketches.

    ``ndv`` and ``ndv_sketch`` are null if any partition came without a sketch; the bounds remain.
    """
    merged = stats.groupBy(*_groups(keys)).agg(
        F.bool_and(F.col("ndv_sketch").isNotNull()).alias("_complete"),
        F.hll_union_agg("ndv_sketch", F.lit(True)).alias("_sketch"),
        F.max("ndv").alias("ndv_lower"),
        F.sum("ndv").alias("ndv_upper"),
    )
    sketch = F.when(F.col("_complete"), F.col("_sketch"))
    return merged.select(
        *_groups(keys),
        F.hll_sketch_estimate(sketch).alias("ndv"),
        "ndv_lower",
        "ndv_upper",
        sketch.alias("ndv_sketch"),
    )


def stats_coverage(
    stats: DataFrame, parts: DataFrame, part: str | Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Per column: how many of the partitions have statistics, and whether all do."""
    part = names(part)
    wanted = parts.select(*cols(part)).distinct()
    wanted = wanted.select(*cols(part), F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    have = stats.select(*cols(part), "column").distinct().withColumn("_have", F.lit(True))
    return (
        wanted.join(have, _same([*part, "column"], wanted, have), "left")
        .groupBy(wanted["column"])
        .agg(F.count("*").alias("num_parts"), F.count("_have").alias("num_parts_with_stats"))
        .withColumn("all_covered", F.col("num_parts") == F.col("num_parts_with_stats"))
        .withColumn("coverage", F.col("num_parts_with_stats") / F.col("num_parts"))
    )
