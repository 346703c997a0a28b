"""Filling ``${key}`` marks in templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.columns import cols, names

# Fixed pattern: a mark is ${ name }, with nothing but the name inside.
MARK = r"\$\{([^${}]+)\}"


def fill_templates(
    templates: DataFrame, params: Mapping[str, str] | DataFrame, text: str = "text", keys: str | Sequence[str] = ()
) -> DataFrame:
    """Replace each ``${key}`` in ``text`` by its value; a mark without a value stays as it is.

    Values are put in as they are: a mark inside a value is not filled again. With a mapping this is one
    projection. With a table ``(key, value)`` of any size the marks of all templates are joined to it;
    ``keys`` must then name the columns that identify a template.
    """
    if isinstance(params, DataFrame):
        if not names(keys):
            raise ValueError("filling from a table needs the template's key columns")
        return _fill_from_table(templates, params, text, names(keys))
    return _fill_from_mapping(templates, params, text)


def _fill_from_mapping(templates: DataFrame, params: Mapping[str, str], text: str) -> DataFrame:
    if not params:
        return templates
    values = F.create_map(*[F.lit(part) for pair in params.items() for part in pair])
    between = F.split(F.col(text), MARK, -1)
    marks = F.regexp_extract_all(F.col(text), F.lit(MARK), 1)
    filled = F.transform(
        marks, lambda key: F.coalesce(F.try_element_at(values, key), F.concat(F.lit("${"), key, F.lit("}")))
    )
    pieces = F.zip_with(between, filled, lambda plain, value: F.concat(plain, F.coalesce(value, F.lit(""))))
    return templates.withColumn(text, F.array_join(pieces, ""))


def _fill_from_table(templates: DataFrame, params: DataFrame, text: str, keys: list[str]) -> DataFrame:
    marks = F.regexp_extract_all(F.col(text), F.lit(MARK), 1)
    # One row per piece: plain text and the mark after it; the last piece has no mark. The columns that
    # are neither key nor text ride on the first piece.
    pieces = F.zip_with(
        F.split(F.col(text), MARK, -1), marks, lambda plain, key: F.struct(plain.alias("plain"), key.alias("key"))
    )
    rest = [c for c in templates.columns if c != text and c not in keys]
    exploded = templates.select(*cols(keys), F.struct(F.lit(0), *cols(rest)).alias("_rest"), F.posexplode_outer(pieces))
    exploded = exploded.select(
        *cols(keys),
        "pos",
        F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("_rest")).alias("_rest"),
        F.col("col.plain").alias("_plain"),
        F.col("col.key").alias("_key"),
    )
    # The piece without a mark has no key to join on: the slot spreads those pieces over all tasks. It is
    # zero for all others, and computed on the side of the values for the reason given in splittable_join.
    exploded = exploded.withColumn("_slot", F.when(F.col("_key").isNull(), F.xxhash64(*cols(keys))).otherwise(F.lit(0)))
    slot = F.pmod(F.hash("key"), F.lit(1)).cast("bigint")
    # One value per key: the later one by ``pos`` if there is such a column, else the largest.
    latest = F.max_by("value", F.struct("pos", "value")) if "pos" in params.columns else F.max("value")
    params = params.groupBy("key").agg(latest.alias("value"))
    values = params.select(F.col("key").alias("_key"), F.col("value").alias("_value"), slot.alias("_slot"))
    shown = F.coalesce("_value", F.concat(F.lit("${"), "_key", F.lit("}")), F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.concat("_plain", shown).alias("piece"))))
    joined = F.array_join(F.transform(ordered, lambda p: p["piece"]), "")
    filled = (
        exploded.join(values, ["_key", "_slot"], "left")
        .groupBy(*cols(keys))
        .agg(F.when(F.count("pos") > 0, joined).alias(text), F.any_value("_rest", F.lit(True)).alias("_rest"))
    )
    return filled.select("*", "_rest.*").select(*cols(templates.columns))


def marks_of(templates: DataFrame, text: str = "text") -> DataFrame:
    """How often each mark is used over all templates."""
    marks = templates.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(MARK), 1)).alias("key"))
    return marks.groupBy("key").agg(F.count("*").alias("uses"))
