"""Exact nearest candidates by inner product: a Voronoi join of queries and data around common pivots.

Components become whole numbers, ``floor(64 x)``, so scores are whole and exact. Queries and data are put in the cell of
their nearest pivot. Two summaries then say what a cell of queries needs. Each query knows a score that at least ``k``
other rows reach: the ``k + 1``-th best of its scores with a fixed number of reference vectors, the pivots among them.
And a vector ``v`` of the cell of pivot ``p`` scores at most ``q.p + |q| |v - p|``, so of that cell a query needs only vectors
as far from ``p`` as ``(least score - q.p) / |q|`` or farther. The least such distance over a cell's queries, for each pair
of cells, is all the driver holds: a square of the number of pivots. Neighbouring cells of queries form groups; a vector is
sent to the groups that need it and only these, and each group is solved by itself, in blocks of bounded size.

Unit vectors that do not cluster are all about as far from any pivot as from each other; no bound excludes them, and
every group is sent all data. The groups are therefore large: what is sent is at most the data times the number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import ROW, keyed, saved, small_batches
from tallyfold.operators.skew import splittable_join

SCALE = 64
MOST = 2**31 - 1
IDS = "array<struct<none: boolean, vec_id: long, row: long>>"
FOUND = "query long, score long, none boolean, vec_id long, row long"
SLACK = 1e-9


def whole_vector(vector: Column) -> Column:
    """``floor(64 x)`` of every component, held within 32 bits; null if the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = F.transform(x, lambda v: F.greatest(F.least(F.floor(SCALE * v), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return F.when(~bad, scaled)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows; shorter ones are filled up with zeros."""
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(starts)
    if (sizes == width).all():
        return flat.reshape(len(lists), width).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole rows, held within 64 bits; by floating point where that is exact."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    return np.clip((a.astype(object) @ b.astype(object).T), -(2**63), 2**63 - 1).astype(np.int64)


@dataclass
class Cells:
    """Pivots, the first of the reference vectors, and what is known of them."""

    references: np.ndarray
    pivots: int

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its distance from the cell's pivot."""
        centres = self.references[: self.pivots].astype(float)
        rows = rows.astype(float)
        cell = ((centres**2).sum(1)[None] - 2 * rows @ centres.T).argmin(1)
        return cell, np.sqrt(((rows - centres[cell]) ** 2).sum(1))

    def least(self, queries: np.ndarray, k: int) -> np.ndarray:
        """A score that at least ``k`` rows besides the query's own reach, made a little smaller for rounding."""
        if len(self.references) <= k:
            return np.full(len(queries), -np.inf)
        scores = products(queries, self.references)
        sure = np.partition(scores, len(self.references) - k - 1, axis=1)[:, len(self.references) - k - 1]
        return sure - self._slack(queries)

    def reach(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each query and cell the distance from its pivot below which no vector can reach ``least``."""
        towards = queries.astype(float) @ self.references[: self.pivots].astype(float).T
        norms = np.sqrt((queries.astype(float) ** 2).sum(1))
        gap = least[:, None] - towards - self._slack(queries)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(norms[:, None] > 0, gap / norms[:, None], -np.inf)

    def _slack(self, queries: np.ndarray) -> np.ndarray:
        long = np.sqrt((self.references.astype(float) ** 2).sum(1).max(initial=0))
        return SLACK * (1 + np.sqrt((queries.astype(float) ** 2).sum(1)) * long)


def join_groups(centres: np.ndarray, queries: np.ndarray, most: int) -> np.ndarray:
    """A group for each cell: the nearest cells together until they hold about ``most`` queries. -1 where there is none."""
    group = np.full(len(centres), -1)
    left = queries > 0
    number = 0
    while left.any():
        first = int(np.flatnonzero(left)[0])
        apart = ((centres - centres[first]) ** 2).sum(1)
        held = 0
        for cell in np.argsort(apart, kind="stable"):
            if left[cell] and (held == 0 or held + queries[cell] <= most):
                group[cell], left[cell] = number, False
                held += int(queries[cell])
        number += 1
    return group


def best_by_product(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    pivots: int = 256,
    references: int = 4096,
    group: int = 1 << 15,
    chunk: int = 1 << 15,
) -> DataFrame:
    """The ``k`` rows of highest inner product for every row that ``is_query`` selects: ``query_id, rank, vec_id, score``.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on its columns. Ties go to the smaller ``vec_id``,
    null ids last. Every row but the query's own is a candidate, also rows with the query's id or its vector; rows that
    repeat an id are vectors of their own. Vectors that are null or hold a null or non-finite component take no part; of
    vectors of different length the shorter is filled up with zeros. Components are held within 32 bits, scores within 64.
    Equal vectors are compared once, and of a vector's rows only the first ``k + 1`` can be among the best. Fewer candidates
    give fewer rows, an empty table none. ``pivots`` (at most the square root of the vectors) and ``references`` bound what the
    driver knows of the table; both are found by the order of a hash. ``group`` bounds the queries and ``chunk`` the vectors,
    about, of one task. Makes Arrow batches of the session small unless it has set their size.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    whole = whole_vector(F.col("embedding"))
    rows = keyed(vectors, vec_id=F.col("vec_id").cast("long"), vec=whole, asks=F.coalesce(is_query, F.lit(False)))
    rows = saved(rows.where("vec IS NOT NULL"), "vectors")
    order = [F.col("vec_id").isNull(), F.col("vec_id"), F.col(ROW)]
    ids = F.struct(*(c.alias(n) for c, n in zip(order, ("none", "vec_id", "row"), strict=True)))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy(*order))).where(F.col("place") <= k + 1)
    data = saved(first.groupBy("vec").agg(F.array_sort(F.collect_list(ids)).alias("ids")), "candidates")
    asking = rows.where("asks")
    queries = saved(asking.groupBy("vec").agg(F.min(ROW).alias("query")), "queries")

    total, width = data.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    sample = data.orderBy(F.xxhash64("vec"), "vec").limit(references).select("vec").toArrow()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    known = matrix(sample.column(0).combine_chunks(), width)
    cells = Cells(known, min(pivots, len(known), int(np.ceil(np.sqrt(total)))))
    shared = spark.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = shared.value.place(matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["vec", "ids", "cell", "far"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column(0), width)
            new = [shared.value.place(own)[0], shared.value.least(own, k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], names=["vec", "query", "cell", "least"])

    placed = saved(data.mapInArrow(place, f"vec array<int>, ids {IDS}, cell long, far double"), "placed")
    asked = saved(queries.mapInArrow(ask, "vec array<int>, query long, cell long, least double"), "asked")
    reach, counts = _summaries(asked, shared, width)
    groups = join_groups(known[: cells.pivots].astype(float), counts, group)
    found = _solve(asked, placed, groups, reach, counts, width, k, group, chunk)

    near = Window.partitionBy("query").orderBy(F.desc("score"), "none", "vec_id", "row")
    best = found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1)
    kept = F.array_sort(F.collect_list(F.struct("place", "score", "vec_id", "row"))).alias("best")
    named = splittable_join(asking.select("vec_id", ROW, "vec"), queries, "vec", "inner").drop("vec")
    lists = splittable_join(named, best.groupBy("query").agg(kept), "query", "inner")
    others = F.slice(F.filter("best", lambda b: b["row"] != F.col(ROW)), 1, k)
    ranked = lists.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id"), F.col("b.score"))


def _summaries(asked: DataFrame, shared, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every pair of cells the least distance at which the queries of the first need vectors of the second; queries a cell."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        reach, counts = np.full((cells.pivots, cells.pivots), np.inf), np.zeros(cells.pivots, np.int64)
        for batch in batches:
            cell = batch.column(2).to_numpy()
            np.minimum.at(reach, cell, cells.reach(matrix(batch.column(0), width), batch.column(3).to_numpy()))
            np.add.at(counts, cell, 1)
        at = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * cells.pivots), pa.array(reach[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at]), lists], names=["cell", "n", "reach"])

    parts = asked.mapInArrow(summarise, "cell long, n long, reach array<double>").select("cell", "n", F.posexplode("reach").alias("to", "far"))
    rows = parts.groupBy("cell", "to").agg(F.sum("n"), F.min("far")).toArrow()
    pivots = shared.value.pivots
    reach, counts = np.full((pivots, pivots), np.inf), np.zeros(pivots, np.int64)
    if len(rows):
        cell, to, n, far = (c.to_numpy() for c in rows.columns)
        reach[cell, to], counts[cell] = far, n
    return reach, counts


def _solve(asked, placed, groups, reach, counts, width: int, k: int, most: int, chunk: int) -> DataFrame:
    """Send every vector to the groups that need it and find the best of each part."""
    spark = asked.sparkSession
    number = int(groups.max(initial=-1)) + 1
    need = np.stack([reach[groups == g].min(0) for g in range(number)]) if number else np.zeros((0, reach.shape[1]))
    # What a group may be sent, by the summaries of the cells: it is dealt to chunks, and its queries to slices.
    held = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    sent = [sum(r.n for r in held if r.far * (1 + SLACK) >= need[g, r.cell]) for g in range(number)]
    chunks = [max(1, -(-n // chunk)) for n in sent]
    slices = [max(1, -(-int(counts[groups == g].sum()) // most)) for g in range(number)]
    plan = spark.sparkContext.broadcast((groups, need, reach, chunks, slices))

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, _, _, chunks, slices = plan.value
        for batch in batches:
            group = groups[batch.column(2).to_numpy()]
            part = batch.column(1).to_numpy() % np.array(slices, np.int64)[group]
            for c in range(max(chunks, default=0)):
                at = pa.array(np.flatnonzero(np.array(chunks)[group] > c))
                own = batch.take(at)
                keys = [pa.array(group).take(at), pa.array(part).take(at), pa.array(np.full(len(own), c))]
                yield pa.RecordBatch.from_arrays([*keys, *own.columns], names=["grp", "slice", "chunk", "vec", "query", "cell", "least"])

    def deal_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, need, _, chunks, slices = plan.value
        for batch in batches:
            cell, far = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            name = batch.column(1).flatten().field(2).take(batch.column(1).offsets[:-1]).to_numpy()
            for g in range(len(need)):
                at = np.flatnonzero(far * (1 + SLACK) >= need[g][cell])
                own = batch.take(pa.array(at))
                for s in range(slices[g]):
                    keys = [np.full(len(at), g), np.full(len(at), s), name[at] % chunks[g]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, keys), *own.columns], names=["grp", "slice", "chunk", "vec", "ids", "cell", "far"])

    def search(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        reach = plan.value[2]
        out: list[tuple] = []
        if len(queries) and len(vectors):
            rows = matrix(vectors.column("vec").combine_chunks(), width)
            cell, far, ids = vectors.column("cell").to_numpy(), vectors.column("far").to_numpy(), vectors.column("ids").to_pylist()
            order = sorted(range(len(ids)), key=lambda i: tuple_of(ids[i][0]))
            rows, cell, far, ids = rows[order], cell[order], far[order], [ids[i] for i in order]
            asked, names = matrix(queries.column("vec").combine_chunks(), width), queries.column("query").to_pylist()
            own, least = queries.column("cell").to_numpy(), queries.column("least").to_numpy()
            for c in np.unique(own):
                near = np.flatnonzero(far * (1 + SLACK) >= reach[c][cell])
                mine = np.flatnonzero(own == c)
                for start in range(0, len(mine), 128):
                    block = mine[start : start + 128]
                    for q, scores in zip(block.tolist(), products(asked[block], rows[near]), strict=True):
                        out += ((names[q], *r) for r in best_rows(scores, near, ids, least[q], k + 1))
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({n.split()[0]: pa.array(c, t) for n, c, t in zip(FOUND.split(", "), columns, kinds, strict=True)})

    keys = ("grp", "slice", "chunk")
    dealt = "grp long, slice long, chunk long, vec array<int>, "
    left = asked.mapInArrow(deal_queries, dealt + "query long, cell long, least double").groupBy(*keys)
    right = placed.mapInArrow(deal_vectors, dealt + f"ids {IDS}, cell long, far double").groupBy(*keys)
    return left.cogroup(right).applyInArrow(search, FOUND)


def tuple_of(name: dict) -> tuple[bool, int, int]:
    return name["none"], name["vec_id"] or 0, name["row"]


def best_rows(scores: np.ndarray, at: np.ndarray, ids: list[list[dict]], least: float, most: int) -> list[tuple]:
    """The ``most`` best rows ``score, none, vec_id, row`` of the vectors at ``at``, which are in the order of their first ids."""
    good = np.flatnonzero(scores >= least)
    if len(good) > most:
        own = scores[good]
        bar = np.partition(own, len(own) - most)[len(own) - most]
        above = good[own > bar]
        good = np.concatenate([above, good[own == bar][: most - len(above)]])
    rows = [(-int(scores[i]), *tuple_of(name), name["vec_id"]) for i in good.tolist() for name in ids[at[i]]]
    return [(-score, none, vec_id, row) for score, none, _, row, vec_id in sorted(rows, key=lambda r: r[:4])[:most]]
