"""One entry for whatever there is to run or load: a SQL text, a file, a folder."""

from __future__ import annotations

from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyfold.sources import delimited
from tallyfold.sources.folders import Folder
from tallyfold.sources.sql_script import run_sql


def kind_of(spark: SparkSession, what: str) -> str:
    """``folder``, ``file`` or ``text``: a path that exists is taken as a path, all else as SQL."""
    if not what.strip() or "\n" in what:
        return "text"
    try:
        place = Folder(spark, what)
        if not place.system.exists(place.root):
            return "text"
        return "folder" if place.system.getFileStatus(place.root).isDirectory() else "file"
    except (IllegalArgumentException, Py4JJavaError):  # no path at all, or of no file system that Spark knows
        return "text"


def execute(
    spark: SparkSession, what: str, schemas: Mapping[str, T.StructType] | None = None
) -> tuple[DataFrame | None, dict[str, DataFrame]]:
    """Run or load ``what``: the last result of its SQL, and the tables that its data files hold by name.

    A text is run. A file is run if its suffix is ``sql``, else it is one table; its schema is that of ``schemas`` or of the catalog's
    table of the same name. Of a folder, subfolders included, the scripts are run in path order before its tables are read. A folder that
    Spark wrote (of parts) is one table, like a file.
    """
    kind = kind_of(spark, what)
    if kind == "text":
        return run_sql(spark, what), {}
    if kind == "file" and what.rsplit(".", 1)[-1].lower() == "sql":
        return run_sql(spark, [delimited.literal_path(what)]), {}
    loaded = delimited.load_folder(spark, delimited.literal_path(what), schemas)
    return None, loaded


def execute_into_tables(spark: SparkSession, what: str) -> DataFrame | None:
    """As ``execute``, with the rows of the data files appended to the catalog's tables of their names."""
    result, loaded = execute(spark, what)
    for table, rows in loaded.items():
        rows.write.insertInto(f"`{table}`")
    return result
