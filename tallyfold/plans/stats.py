"""Column statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import stats
from tallyfold.plans.registry import query, table

# One SQL text per kind of column; each gives the whole statistics row.
_SELECT = {
    "long": "min({c})::BIGINT AS low_long, max({c})::BIGINT AS high_long, NULL::DOUBLE AS low_double,"
    " NULL::DOUBLE AS high_double, NULL::DECIMAL(38,2) AS low_decimal, NULL::DECIMAL(38,2) AS high_decimal,"
    " NULL::DATE AS low_date, NULL::DATE AS high_date, {n}, NULL::BIGINT AS max_len, NULL::DOUBLE AS avg_len",
    "double": "NULL::BIGINT AS low_long, NULL::BIGINT AS high_long, min({c}) AS low_double,"
    " max({c}) AS high_double, NULL::DECIMAL(38,2) AS low_decimal, NULL::DECIMAL(38,2) AS high_decimal,"
    " NULL::DATE AS low_date, NULL::DATE AS high_date, {n}, NULL::BIGINT AS max_len, NULL::DOUBLE AS avg_len",
    "decimal": "NULL::BIGINT AS low_long, NULL::BIGINT AS high_long, NULL::DOUBLE AS low_double,"
    " NULL::DOUBLE AS high_double, min({c})::DECIMAL(38,2) AS low_decimal, max({c})::DECIMAL(38,2) AS high_decimal,"
    " NULL::DATE AS low_date, NULL::DATE AS high_date, {n}, NULL::BIGINT AS max_len, NULL::DOUBLE AS avg_len",
    "date": "NULL::BIGINT AS low_long, NULL::BIGINT AS high_long, NULL::DOUBLE AS low_double,"
    " NULL::DOUBLE AS high_double, NULL::DECIMAL(38,2) AS low_decimal, NULL::DECIMAL(38,2) AS high_decimal,"
    " min({c}) AS low_date, max({c}) AS high_date, {n}, NULL::BIGINT AS max_len, NULL::DOUBLE AS avg_len",
    "string": "NULL::BIGINT AS low_long, NULL::BIGINT AS high_long, NULL::DOUBLE AS low_double,"
    " NULL::DOUBLE AS high_double, NULL::DECIMAL(38,2) AS low_decimal, NULL::DECIMAL(38,2) AS high_decimal,"
    " NULL::DATE AS low_date, NULL::DATE AS high_date, {n}, max(length({c}))::BIGINT AS max_len,"
    " avg(length({c})) AS avg_len",
}
_COUNTS = "count(*) FILTER (WHERE {c} IS NULL) AS num_nulls, count(DISTINCT {c}) AS ndv"


def _stats_sql(source: str, part: str, kinds: dict[str, str]) -> str:
    selects = []
    for name, kind in kinds.items():
        row = _SELECT[kind].format(c=name, n=_COUNTS.format(c=name))
        selects.append(f"SELECT {part}, '{name}' AS \"column\", '{kind}' AS type, {row} FROM {source} GROUP BY {part}")
    return " UNION ALL ".join(selects)


LINEITEM_KINDS = {
    "l_orderkey": "long",
    "l_quantity": "double",
    "price": "decimal",
    "shipped": "date",
    "l_linestatus": "string",
}
_LINEITEM_SQL = """(
    SELECT l_returnflag, l_orderkey, nullif(l_quantity, 1) AS l_quantity,
           l_extendedprice::DECIMAL(15,2) AS price, l_shipdate::DATE AS shipped, nullif(l_linestatus, 'O') AS l_linestatus
    FROM lineitem)"""
_LINEITEM_STATS = _stats_sql(_LINEITEM_SQL, "l_returnflag", LINEITEM_KINDS)


def _lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_returnflag",
        "l_orderkey",
        F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("l_quantity"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("price"),
        F.col("l_shipdate").cast("date").alias("shipped"),
        F.nullif(F.col("l_linestatus"), F.lit("O")).alias("l_linestatus"),
    )


def _lineitem_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.column_stats(_lineitem(spark, folder), "l_returnflag", list(LINEITEM_KINDS), ndv="exact")


@query(_LINEITEM_STATS)
def column_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _lineitem_stats(spark, folder).drop("ndv_sketch")


DOCUMENT_KINDS = {"doc_id": "long", "n_chars": "long", "source": "string", "text": "string"}
_DOCUMENT_STATS = _stats_sql("documents", "lang", DOCUMENT_KINDS)
# This table has no decimal column, so the decimal pair keeps its widest scale.
_DOCUMENT_STATS = _DOCUMENT_STATS.replace("DECIMAL(38,2)", "DECIMAL(38,18)")


@query(_DOCUMENT_STATS)
def column_stats_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return stats.column_stats(documents, "lang", list(DOCUMENT_KINDS), ndv="exact").drop("ndv_sketch")


@query(f"""
    SELECT "column", type, min(low_long) AS low_long, max(high_long) AS high_long, min(low_double) AS low_double,
           max(high_double) AS high_double, min(low_decimal) AS low_decimal, max(high_decimal) AS high_decimal,
           min(low_date) AS low_date, max(high_date) AS high_date, sum(num_nulls)::BIGINT AS num_nulls,
           max(max_len) AS max_len, max(avg_len) AS avg_len
    FROM ({_LINEITEM_STATS}) GROUP BY "column", type
""")
def merge_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.merge_stats(_lineitem_stats(spark, folder))


@query(f"""
    SELECT "column", type, max(ndv) AS ndv_lower, sum(ndv)::BIGINT AS ndv_upper,
           round(sum(CASE type WHEN 'long' THEN ((high_long - low_long) // nullif(ndv, 0))::DOUBLE
                         WHEN 'date' THEN (datediff('day', low_date, high_date) // nullif(ndv, 0))::DOUBLE
                         WHEN 'double' THEN (high_double - low_double) / nullif(ndv, 0)
                         WHEN 'decimal' THEN (high_decimal::DOUBLE - low_decimal::DOUBLE) / nullif(ndv, 0) END), 6)
               AS density_sum
    FROM ({_LINEITEM_STATS}) GROUP BY "column", type
""")
def ndv_bounds(spark: SparkSession, folder: str) -> DataFrame:
    bounds = stats.ndv_bounds(_lineitem_stats(spark, folder))
    return bounds.withColumn("density_sum", F.round("density_sum", 6))


@query("""
    SELECT c AS "column", count(DISTINCT v) AS exact, TRUE AS close FROM (
        SELECT unnest(['l_orderkey', 'l_partkey', 'l_quantity', 'l_extendedprice']) AS c,
               unnest([l_orderkey::DOUBLE, l_partkey::DOUBLE, l_quantity, l_extendedprice]) AS v FROM lineitem)
    GROUP BY c
""")
def ndv_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches per return flag, merged, must come within 5 % of the exact count over the whole table."""
    names = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"]
    lineitem = table(spark, folder, "lineitem")
    merged = stats.merge_ndv(stats.column_stats(lineitem, "l_returnflag", names)).select("column", "ndv")
    whole = lineitem.withColumn("whole", F.lit("all"))
    exact = stats.column_stats(whole, "whole", names, ndv="exact").select("column", F.col("ndv").alias("exact"))
    close = F.abs(F.col("ndv") - F.col("exact")) <= 0.05 * F.col("exact")
    return merged.join(exact, "column").select("column", "exact", close.alias("close"))


@query("""
    SELECT "column", (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS num_parts,
           (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_returnflag <> 'N') AS num_parts_with_stats,
           FALSE AS all_covered,
           (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_returnflag <> 'N')
               / (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS coverage
    FROM (VALUES ('l_orderkey'), ('l_quantity')) AS t("column")
""")
def stats_coverage(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    columns = ["l_orderkey", "l_quantity"]
    have = stats.column_stats(lineitem.where("l_returnflag <> 'N'"), "l_returnflag", columns)
    return stats.stats_coverage(have, lineitem, "l_returnflag", columns)
