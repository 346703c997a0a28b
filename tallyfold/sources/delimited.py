"""Delimited files, folders of them, compressed text, and SQL dumps."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.text import path_suffix, table_name
from tallyfold.operators.columns import col
from tallyfold.sources.sql_script import run_sql

# The separator each file suffix stands for; any other suffix means a blank.
SEPARATORS = {"csv": ",", "psv": "|", "tsv": "\t", "ssv": ";", "hsv": "-"}
OTHER_SEPARATOR = " "
QUOTE = '"'
NULL_WORD = "NULL"


def separator_for(path: str) -> str:
    return SEPARATORS.get(path.rsplit(".", 1)[-1].lower(), OTHER_SEPARATOR)


def read_options(sep: str) -> dict[str, str]:
    """Reader options shared by batch and stream loads."""
    return {"sep": sep, "quote": QUOTE, "escape": QUOTE, "lineSep": "\n", "header": "false"}


def text_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def typed_columns(schema: T.StructType) -> list[Column]:
    """Drop CRs, read the word NULL as null, then cast to the wanted type; what does not fit is null.

    An empty field is an empty string in a text column and null in any other.
    """
    out = []
    for field in schema:
        plain = F.translate(col(field.name), "\r", "")
        if isinstance(field.dataType, T.StringType):
            value = F.when(plain == NULL_WORD, None).otherwise(F.coalesce(plain, F.lit("")))
        else:
            value = plain.try_cast(field.dataType)
        out.append(value.alias(field.name, metadata=field.metadata))
    return out


def load_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    sep: str | None = None,
    quoted_breaks: bool = False,
) -> DataFrame:
    """Read delimited files by position into ``schema``; the suffix of each path picks its separator.

    Rows end at LF, quotes and their escape are ``"``. Only the columns asked for are parsed. Large files
    are split over tasks, unless ``quoted_breaks`` allows line breaks inside quotes.
    """
    by_separator: dict[str, list[str]] = {}
    for one in [path] if isinstance(path, str) else path:
        by_separator.setdefault(sep or separator_for(one), []).append(one)
    reader = spark.read.schema(text_schema(schema))
    parts = [reader.options(**read_options(s)).csv(own, multiLine=quoted_breaks) for s, own in by_separator.items()]
    return reduce(DataFrame.unionByName, parts).select(*typed_columns(schema))


RESCUED = "rescued"


def load_rescued(
    spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str | None = None, bad: str = "keep"
) -> DataFrame:
    """Read delimited files by position as ``load_delimited`` does, and say of each row what did not fit.

    The column ``rescued`` is null for a row that fits, else it holds the ``line``, its number of ``fields``, and the names of
    the columns whose text ``uncast`` to their type. Such rows keep what fits: columns that are missing or do not cast are
    null, fields beyond the schema are left to ``line``. ``bad="drop"`` leaves them out, ``bad="fail"`` ends the job at the
    first. A bare ``NULL`` is a null, a quoted one is text; an empty field is an empty string in a text column and a null in
    any other. Rows end at line feeds, quoted or not, so files are split over tasks; an empty line is a row of one empty field.
    """
    if bad not in ("keep", "drop", "fail"):
        raise ValueError("bad is 'keep', 'drop' or 'fail'")
    by_separator: dict[str, list[str]] = {}
    for one in [path] if isinstance(path, str) else path:
        by_separator.setdefault(sep or separator_for(one), []).append(one)
    parts = [_rescued(spark.read.option("lineSep", "\n").text(own), schema, s) for s, own in by_separator.items()]
    rows = reduce(DataFrame.unionByName, parts)
    if bad == "drop":
        return rows.where(F.col(RESCUED).isNull()).drop(RESCUED)
    if bad == "fail":
        said = F.concat(F.lit("a row does not fit: "), F.col(f"{RESCUED}.line"))
        return rows.where(F.when(F.col(RESCUED).isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)).drop(RESCUED)
    return rows


def _rescued(lines: DataFrame, schema: T.StructType, sep: str) -> DataFrame:
    line = F.translate("value", "\r", "")
    # Each field with the separator before it, quotes kept; one that is quoted in part only is plain text.
    mark = re.escape(sep)
    fields = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{mark}("[^"]*+(?:""[^"]*+)*+"(?={mark}|$)|[^{mark}]*+)'), 1)
    rows = lines.select(line.alias("_line"), fields.alias("_fields"))
    n = F.size("_fields")
    values, uncast = [], []
    for i, field in enumerate(schema):
        raw = F.get("_fields", F.lit(i))
        quoted = raw.startswith(QUOTE) & raw.endswith(QUOTE) & (F.length(raw) > 1)
        plain = F.when(quoted, F.replace(F.expr(f"substring(_fields[{i}], 2, length(_fields[{i}]) - 2)"), F.lit('""'), F.lit(QUOTE))).otherwise(raw)
        text = F.when(~quoted & (raw == NULL_WORD), None).otherwise(plain)
        if isinstance(field.dataType, T.StringType):
            value = text
        else:
            value = text.try_cast(field.dataType)
            given = text.isNotNull() & (text != "")
            uncast.append(F.when(given & value.isNull(), F.lit(field.name)))
        values.append(F.when(n > i, value).alias(field.name, metadata=field.metadata))
    failed = F.array_compact(F.array(*uncast)) if uncast else F.array().cast("array<string>")
    rescued = F.struct(F.col("_line").alias("line"), n.alias("fields"), failed.alias("uncast"))
    return rows.select(*values, F.when((n != len(schema)) | (F.size(failed) > 0), rescued).alias(RESCUED))


def load_into_table(spark: SparkSession, path: str | list[str], table: str, sep: str | None = None) -> None:
    """Append delimited files to an existing table; fields are bound by position."""
    load_delimited(spark, path, spark.table(table).schema, sep).write.insertInto(table)


def write_delimited(df: DataFrame, path: str, sep: str | None = None, quoted_breaks: bool = False) -> None:
    """Write a folder of delimited parts that ``load_delimited`` reads back with the same ``quoted_breaks``, nulls included.

    A value with a line break needs ``quoted_breaks``; without it, writing fails rather than cut the row in two. Loading
    drops CRs and reads the word NULL as null.
    """
    sep = sep or separator_for(path)
    rendered = []
    for name in df.columns:
        value = F.coalesce(col(name).cast("string"), F.lit(NULL_WORD))
        if not quoted_breaks:
            refused = F.raise_error(F.lit(f"a line break in column {name} needs quoted_breaks"))
            value = F.when(F.contains(value, F.lit("\n")), refused).otherwise(value)
        rendered.append(value.alias(name))
    df.select(*rendered).write.mode("overwrite").options(
        **read_options(sep), emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
    ).csv(path)


def _own_path() -> Column:
    """The path of the file that a row comes from; Spark leaves out files that a condition on it excludes."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def _kind(path: Column) -> tuple[Column, Column]:
    """The suffix and the table of a file. Parts of a data set that Spark wrote go by the name of their folder, and by
    their own suffix if the folder has none."""
    folder = F.regexp_replace(path, r"/part-\d[^/]*$", "")
    bare = ~F.contains(F.element_at(F.split(folder, "/"), -1), F.lit("."))
    return path_suffix(F.when(bare, path).otherwise(folder)), table_name(folder)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below ``folder`` with its suffix and the table it loads into. File contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(_own_path().alias("path"))
    suffix, table = _kind(F.col("path"))
    return found.select("path", suffix.alias("suffix"), table.alias("table"))


def load_folder(
    spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType] | None = None
) -> dict[str, DataFrame]:
    """Load a folder, subfolders included: ``.sql`` files are run in path order, others become tables.

    The schema of a table is taken from ``schemas``, else from the catalog's table of that name, which a
    script of the same folder may have created. A table is read as a whole for each of its separators: Spark lists the folder and
    leaves out the files of other tables. Only scripts, and the names of tables, reach the driver.
    """
    files = list_files(spark, folder)
    scripts = [f.path for f in files.where("suffix = 'sql'").orderBy("path").collect()]
    if scripts:
        run_sql(spark, [literal_path(s) for s in scripts])
    suffixes = F.when(F.col("suffix").isin(*SEPARATORS), F.col("suffix")).otherwise("")
    kinds = files.where("suffix <> 'sql'").select("table", suffixes.alias("suffix")).distinct().orderBy("table", "suffix").collect()
    known = dict(schemas or {})
    for table in sorted({k.table for k in kinds} - set(known)):
        if not spark.catalog.tableExists(f"`{table}`"):
            raise KeyError(f"no schema for {table}")
        known[table] = spark.table(f"`{table}`").schema
    tables: dict[str, DataFrame] = {}
    for kind in kinds:
        loaded = _load_kind(spark, folder, kind.table, kind.suffix, known[kind.table])
        tables[kind.table] = tables[kind.table].unionByName(loaded) if kind.table in tables else loaded
    return tables


def _load_kind(spark: SparkSession, folder: str, table: str, suffix: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(text_schema(schema)).option("recursiveFileLookup", "true")
    own, name = _kind(_own_path())
    kind = own == suffix if suffix else ~own.isin(*SEPARATORS, "sql")
    rows = reader.options(**read_options(SEPARATORS.get(suffix, OTHER_SEPARATOR))).csv(folder)
    return rows.where((name == table) & kind).select(*typed_columns(schema))


def load_folder_into_tables(spark: SparkSession, folder: str) -> list[str]:
    """Load a folder and append what it holds to the catalog's tables; returns the names of the tables."""
    loaded = load_folder(spark, folder)
    for table, rows in loaded.items():
        rows.write.insertInto(f"`{table}`")
    return sorted(loaded)


def literal_path(path: str) -> str:
    """A path whose glob signs are taken literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of plain or compressed text (gz, bz2, deflate, zst by suffix), one column ``value``.

    Plain and bz2 files are split over tasks; a file in another codec is read by one task.
    """
    return spark.read.option("lineSep", "\n").text(path)
