"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is grown on a bounded sample; every vector is put in one of its leaves. A query walks the tree with a priority
queue of branches, nearest centre first, and visits leaves until as many are seen as a calibration asks for:
the fewest that find the wanted share of true neighbours for a set of trial queries, whose neighbours are known
from a comparison with all vectors. Distances within leaves are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import ROW, keyed, saved, small_batches


@dataclass
class Tree:
    """Nodes by number: their children's centres and numbers; a number below zero is leaf ``-1 - number``."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    @classmethod
    def grow(cls, rows: np.ndarray, leaf: int, branches: int = 8, rounds: int = 8) -> Tree:
        tree, rnd = cls(), np.random.default_rng(7)

        def split(own: np.ndarray) -> int:
            if len(own) <= leaf or (group := k_means(own, min(branches, len(own)), rounds, rnd)) is None:
                tree.leaves += 1
                return -tree.leaves
            number = len(tree.centres)
            tree.centres.append(np.stack([own[group == g].mean(0) for g in range(group.max() + 1)]))
            tree.children.append([])
            tree.children[number] = [split(own[group == g]) for g in range(group.max() + 1)]
            return number

        if split(rows) < 0:  # too few rows for a branch: one leaf
            tree.centres, tree.children = [rows[:1] if len(rows) else np.zeros((1, 0))], [[-1]]
        return tree

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: always the nearest centre."""
        out = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            nearest = distances(rows[own], self.centres[node]).argmin(1) if len(self.children[node]) > 1 else np.zeros(len(own), int)
            for k, child in enumerate(self.children[node]):
                part = own[nearest == k]
                if len(part) and child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out

    def bins(self, query: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            while node >= 0:
                near = distances(query[None], self.centres[node])[0] if len(self.children[node]) > 1 else np.zeros(1)
                best = int(near.argmin())
                for k, child in enumerate(self.children[node]):
                    if k != best:
                        heapq.heappush(heap, (float(near[k]), child))
                node = self.children[node][best]
            yield -1 - node


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by products: good enough to choose branches."""
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b`` from the differences, some rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 20) // max(1, b.size))
    for i in range(0, len(a), step):
        differ = a[i : i + step, None, :] - b[None]
        out[i : i + step] = np.sqrt((differ * differ).sum(2))
    return out


def k_means(rows: np.ndarray, k: int, rounds: int, rnd: np.random.Generator) -> np.ndarray | None:
    """Group numbers without gaps, or None if the rows do not come apart."""
    centres = rows[rnd.choice(len(rows), k, replace=False)]
    group = np.zeros(len(rows), int)
    for _ in range(rounds):
        group = distances(rows, centres).argmin(1)
        used = np.unique(group)
        centres = np.stack([rows[group == g].mean(0) for g in used])
    group = np.unique(distances(rows, centres).argmin(1), return_inverse=True)[1]
    return group if group.max() > 0 else None


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest scores, ties to smaller ids, then to earlier rows."""
    near = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1]) if len(scores) > k else np.arange(len(scores))
    return near[np.lexsort((rows[near], ids[near], scores[near]))][:k]


def top(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


FOUND = "query long, query_id long, row long, vec_id long, score double"


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.97, sample: int = 20_000, trials: int = 128, leaf: int = 256, block: int = 4096
) -> DataFrame:
    """The ``k`` nearest other vectors of each query by Euclidean distance: ``query_id, rank, vec_id, score``.

    ``vectors`` has ``vec_id, embedding``. Null ids, and vectors that are null, zero, of another length than most, or
    hold a null or non-finite number, take no part. Ties go to smaller ids, then to earlier rows. Fewer than ``k`` others: all of
    them. Rows that repeat an id are vectors of their own, as queries too. Of equal vectors only the ``k + 1`` smallest ids can be
    among the nearest, so the index keeps these; a vector that fills a third of the table costs no more than any other.

    The tree grows on about ``sample`` vectors, chosen by hash, down to leaves of some ``leaf`` vectors of the table,
    or a few of the sample where that is larger. ``trials`` vectors, chosen by hash, are compared with all vectors
    to set the number of leaves to visit. Neighbouring leaves of up to ``block`` vectors are searched in one task, larger
    ones are split.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = keyed(vectors, vec_id=F.col("vec_id").cast("long"), vector=F.col("embedding").cast("array<double>"), asks=is_query)
    rows = rows.withColumnRenamed(ROW, "row").where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = saved(rows.where(F.size("vector") == lengths.n), "vectors")
    within = Window.partitionBy("vector").orderBy("vec_id", "row")
    kept = rows.withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= k + 1).select("row", "vec_id", "vector")
    kept = saved(kept, "index")
    total = kept.count()
    by_hash = F.pmod(F.xxhash64("vec_id", "row", F.lit("tree")), F.lit(1 << 30))
    share = min(1.0, sample / total)
    picked = np.array([r.vector for r in kept.where(by_hash < int(share * (1 << 30)) + 1).select("vector").collect()], float).reshape(-1, lengths.n)
    tree = Tree.grow(picked, max(4, int(leaf * share)))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = pa.array(shared.value.place(matrix(batch.column(2))))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaves], names=["row", "vec_id", "vector", "leaf"])

    index = saved(kept.mapInArrow(place, "row long, vec_id long, vector array<double>, leaf long"), "leaves")
    sizes = {r.leaf: r.rows for r in index.groupBy("leaf").agg(F.count("*").alias("rows")).collect()}  # as many as leaves

    trial_share = min(1.0, trials / total)
    trial = F.pmod(F.xxhash64("vec_id", "row", F.lit("trial")), F.lit(1 << 30)) < int(trial_share * (1 << 30)) + 1
    tried = kept.where(trial).collect()
    visits = _calibrate(index, tree, [r.row for r in tried], np.array([r.vector for r in tried], float), k, recall) if tried else tree.leaves
    # Neighbouring leaves are searched together, up to about ``block`` vectors; a larger leaf is split in parts.
    shards, parts, filled = {}, {}, block
    for n in range(tree.leaves):
        if filled + sizes.get(n, 0) > block:
            parts[len(parts)], filled = 1, 0
        shards[n], filled = len(parts) - 1, filled + sizes.get(n, 0)
        parts[shards[n]] = max(1, -(-sizes.get(n, 0) // block))
    queries = rows.where("asks").select("row", "vec_id", "vector")
    crowd = max(1, -(-queries.count() * min(visits, len(parts)) // (len(parts) * block)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            vectors = matrix(batch.column(2))
            for i, query in enumerate(batch.column(0).to_pylist()):
                seen, rows_seen, leaves = 0, 0, {}
                for n in shared.value.bins(vectors[i]):
                    leaves.setdefault(shards[n], []).append(n)
                    seen, rows_seen = seen + 1, rows_seen + sizes.get(n, 0)
                    if seen >= visits and rows_seen > k:
                        break
                for shard, own in leaves.items():
                    for part in range(parts[shard]):
                        for column, value in zip(out, (shard, part, query, own, i), strict=True):
                            column.append(value)
            at = pa.array(out.pop(), pa.int64())
            own = pa.array(out.pop(), pa.list_(pa.int64()))
            mixed = np.array(out[2], np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            groups = pa.array((mixed % np.uint64(crowd)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out), groups, own, batch.column(1).take(at), batch.column(2).take(at)],
                names=["shard", "part", "query", "crowd", "leaves", "query_id", "vector"],
            )

    asked = queries.mapInArrow(visit, "shard long, part long, query long, crowd long, leaves array<long>, query_id long, vector array<double>")
    # A row for each leaf of the tree.
    where = spark.createDataFrame([(n, s, parts[s]) for n, s in shards.items()], "leaf long, shard long, parts long")
    held = index.join(F.broadcast(where), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id", "row"), F.col("parts")))
    held = held.withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(crowd - 1).cast("long"))))

    def search(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if len(rows) and len(queries):
            rows = rows.sort_by("leaf")
            numbers, ids = rows.column("row").to_numpy(), rows.column("vec_id").to_numpy()
            vectors = matrix(rows.column("vector").combine_chunks())
            leaves, starts = np.unique(rows.column("leaf").to_numpy(), return_index=True)
            spans = dict(zip(leaves.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True), strict=True))
            asking, names = queries.column("query").to_numpy(), queries.column("query_id").to_numpy()
            asked = matrix(queries.column("vector").combine_chunks())
            for q, name, vector, own in zip(asking, names, asked, queries.column("leaves").to_pylist(), strict=True):
                at = np.concatenate([np.arange(*spans[n]) for n in own if n in spans] or [np.zeros(0, int)])
                at = at[numbers[at] != q]
                scores = exact(vector[None], vectors[at])[0]
                near = best(ids[at], numbers[at], scores, k)
                found = (np.full(len(near), q), np.full(len(near), name), numbers[at[near]], ids[at[near]], scores[near])
                for column, value in zip(out, found, strict=True):
                    column.append(value)
        kinds = (np.int64, np.int64, np.int64, np.int64, float)
        return pa.table({n.split()[0]: np.concatenate([np.zeros(0, t), *c]) for n, t, c in zip(FOUND.split(", "), kinds, out, strict=True)})

    keys = ("shard", "part", "crowd")
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(search, FOUND)
    return top(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _calibrate(index: DataFrame, tree: Tree, names: list[int], queries: np.ndarray, k: int, recall: float) -> int:
    """The fewest leaves whose visit finds the share ``recall`` of the trial queries' true neighbours."""
    shared = index.sparkSession.sparkContext.broadcast((np.array(names), queries))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, queries = shared.value
        for batch in batches:
            rows, ids, leaves = (batch.column(i).to_numpy() for i in (0, 1, 3))
            scores = exact(queries, matrix(batch.column(2)))
            for q, own in zip(asking.tolist(), scores, strict=True):
                others = np.flatnonzero(rows != q)
                at = others[best(ids[others], rows[others], own[others], k)]
                data = [np.full(len(at), q), np.zeros(len(at), np.int64), rows[at], ids[at], own[at], leaves[at]]
                yield pa.RecordBatch.from_arrays([pa.array(d) for d in data], names=["query", "query_id", "row", "vec_id", "score", "leaf"])

    truth = top(index.select("row", "vec_id", "vector", "leaf").mapInArrow(compare, FOUND + ", leaf long"), k).collect()
    if not truth:
        return tree.leaves
    order = {q: {n: i for i, n in enumerate(tree.bins(v))} for q, v in zip(names, queries, strict=True)}
    needed = np.sort([order[r.query][r.leaf] + 1 for r in truth])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
