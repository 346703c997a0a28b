"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import checkpointed
from tallyfold.operators.skew import splittable_join


#: Links that a task takes in a round; fewer tasks than these need only cost time and files.
SHARE, LEAST_TASKS = 50_000, 8


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Hang neighbours of every node on the node's smallest neighbour: the larger ones, or the smaller and itself."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(turned) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _in_tasks(around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), tasks)
    joined = _in_tasks(splittable_join(around, least, "a", "inner"), tasks)
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))
        )
    return _in_tasks(moved.where("a <> b").distinct(), tasks)


def _in_tasks(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` in no more than so many tasks, if that is less than a shuffle's."""
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (two of one type): root is the component's smallest node.

    Each round costs shuffles of the links that are left; their lineage is cut by ``checkpoint()``. A hub with many
    links is joined with one row and can be cut. No links give no rows.
    """
    edges = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    while not _stars_only(edges):
        tasks = max(LEAST_TASKS, edges.count() // SHARE)
        few = _in_tasks(edges, tasks)
        edges = checkpointed(_star(_star(few, True, tasks), False, tasks))
    return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))


def _stars_only(edges: DataFrame) -> bool:
    """Does every node hang on one smaller node, on which nothing but larger ones hang?"""
    low = F.col("node") == F.least("a", "b")
    ends = edges.select("a", "b", F.explode(F.array("a", "b")).alias("node")).groupBy("node")
    hung = ends.agg(F.count_if(~low).alias("up"), F.count_if(low).alias("down"))
    return hung.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()
