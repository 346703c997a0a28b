"""Tables as SQL text or Parquet, one by one or a whole database.

Two dialects. ``mysql`` writes names and types as they are, backslash escapes and ``INSERT IGNORE``. ``ansi`` quotes names, maps
types, writes numbers that are none (``NaN``, infinities), dates, times, binary values and arrays as typed values, and quotes by
doubling; DuckDB and its like load it. In both a statement is one line.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators.columns import col

# Names of types in the ansi dialect; decimals keep their digits, arrays add brackets.
ANSI_TYPES = {
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "REAL",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "timestamp_ntz": "TIMESTAMP",
    "binary": "BLOB",
}


def dump_lines(tables: Mapping[str, DataFrame], dialect: str = "mysql") -> DataFrame:
    """Tables as SQL text, rows ``(table, section, line)``; section 1 recreates a table, section 2 fills it."""
    if dialect not in ("mysql", "ansi"):
        raise ValueError("dialect is 'mysql' or 'ansi'")
    parts = [part for name, df in tables.items() for part in (_head_lines(name, df, dialect), _row_lines(name, df, dialect))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _name(name: str, dialect: str) -> str:
    return name if dialect == "mysql" else '"' + name.replace('"', '""') + '"'


def _type(data_type: T.DataType, dialect: str) -> str:
    if dialect == "mysql":
        return data_type.simpleString()
    if isinstance(data_type, T.DecimalType):
        return data_type.simpleString().upper()
    if isinstance(data_type, T.ArrayType):
        return _type(data_type.elementType, dialect) + "[]"
    plain = "string" if isinstance(data_type, (T.CharType, T.VarcharType)) else data_type.simpleString()
    if plain not in ANSI_TYPES:
        raise TypeError(f"no column type for {plain}; take it apart first")
    return ANSI_TYPES[plain]


def _head_lines(name: str, df: DataFrame, dialect: str) -> DataFrame:
    fields = ", ".join(f"{_name(f.name, dialect)} {_type(f.dataType, dialect)}" for f in df.schema)
    table = _name(name, dialect)
    lines = [(name, 1, f"DROP TABLE IF EXISTS {table}; CREATE TABLE {table} ({fields});")]
    return df.sparkSession.createDataFrame(lines, "table string, section int, line string")


def _row_lines(name: str, df: DataFrame, dialect: str) -> DataFrame:
    literal = _literal if dialect == "mysql" else _ansi_literal
    values = F.concat_ws(",", *[literal(col(f.name), f.dataType) for f in df.schema])
    insert = "INSERT IGNORE INTO" if dialect == "mysql" else "INSERT INTO"
    line = F.concat(F.lit(f"{insert} {_name(name, dialect)} VALUES ("), values, F.lit(");"))
    return df.select(F.lit(name).alias("table"), F.lit(2).alias("section"), line.alias("line"))


def _literal(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(data_type, T.BinaryType):
        text = F.concat(F.lit("X'"), F.hex(value), F.lit("'"))
    else:
        # A dump is read line by line, so a line break inside a value is written as an escape.
        text = value.cast("string")
        for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        text = F.concat(F.lit("'"), text, F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def _ansi_literal(value: Column, data_type: T.DataType) -> Column:
    plain = value.cast("string") if not isinstance(data_type, T.ArrayType) else None
    if isinstance(data_type, T.ArrayType):
        parts = F.array_join(F.transform(value, lambda v: _ansi_literal(v, data_type.elementType)), ",")
        text = F.concat(F.lit("CAST(["), parts, F.lit(f"] AS {_type(data_type, 'ansi')})"))
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        kind = _type(data_type, "ansi")
        text = F.concat(F.lit("CAST('"), plain, F.lit(f"' AS {kind})"))
    elif isinstance(data_type, (T.NumericType, T.BooleanType)):
        text = plain
    elif isinstance(data_type, T.BinaryType):
        text = F.concat(F.lit("unhex('"), F.hex(value), F.lit("')"))
    elif isinstance(data_type, (T.DateType, T.TimestampNTZType)):
        text = F.concat(F.lit(f"CAST('"), plain, F.lit(f"' AS {_type(data_type, 'ansi')})"))
    elif isinstance(data_type, T.TimestampType):
        utc = F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        text = F.concat(F.lit("CAST('"), utc, F.lit("+00' AS TIMESTAMP WITH TIME ZONE)"))
    else:
        text = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("''")), F.lit("'"))
        for sign, code in (("\n", 10), ("\r", 13)):
            text = F.replace(text, F.lit(sign), F.lit(f"' || chr({code}) || '"))
    return F.coalesce(text, F.lit("NULL"))


def dump_tables(tables: Mapping[str, DataFrame], out: str, fmt: str = "sql", dialect: str = "mysql") -> None:
    """Dump every table below ``out``: as SQL text in ``table=/section=`` folders, or as Parquet.

    Read in path order the text recreates each table before it fills it. One job writes all tables.
    """
    if fmt == "sql":
        dump_lines(tables, dialect).write.mode("overwrite").partitionBy("table", "section").text(out)
    elif fmt == "parquet":
        for name, df in tables.items():
            df.write.mode("overwrite").option("compression", "gzip").parquet(f"{out.rstrip('/')}/{name}")
    else:
        raise ValueError("fmt is 'sql' or 'parquet'")


def dump_database(spark: SparkSession, database: str, out: str, fmt: str = "sql", dialect: str = "ansi") -> list[str]:
    """Dump all tables of a database of the catalog, with all their columns; gives their names. Views are left out."""
    found = sorted(t.name for t in spark.catalog.listTables(database) if t.tableType in ("MANAGED", "EXTERNAL"))
    if found:
        dump_tables({name: spark.table(f"`{database}`.`{name}`") for name in found}, out, fmt, dialect)
    return found
