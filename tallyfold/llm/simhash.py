"""Near-duplicates by SimHash: exact pairs within a Hamming distance from a forest of vantage-point trees.

Distances between unrelated 64-bit fingerprints crowd around 32, where a triangle bound of 4 prunes little. So
each tree measures the Hamming distance within one block of bits only, which is a metric too. Two fingerprints
that differ in at most ``within`` bits differ in at most ``within // blocks`` bits of at least one block;
that is the radius of the trees. A tree cuts the fingerprints at a distance from a vantage point. Every fingerprint
lives in one shard of each tree, and also visits the shards across each boundary that its radius overlaps. Pairs
are compared exactly, over all bits, within shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import ROW, checkpointed, keyed, saved, small_batches, texts_of
from tallyfold.llm.graph import components
from tallyfold.operators.skew import splittable_join

FULL = (1 << 64) - 1


def simhash(text: str, width: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's word shingles; 0 without words.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; a text with fewer than ``width``
    words is one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(width, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    hashed = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 15):
        s, e = starts[i : min(n, i + (1 << 15))].tolist(), ends[k - 1 :][i : i + (1 << 15)].tolist()
        codes = np.array([hashed(joined[a:b], seed) for a, b in zip(s, e, strict=False)], "<u8")
        total += _bit_sums(codes)
    return _majority(total, n)


def simhash_of(codes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; 0 without any."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(codes), 1 << 15):
        total += _bit_sums(codes[i : i + (1 << 15)].astype("<u8"))
    return _majority(total, len(codes))


def _bit_sums(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(total: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fp`` and the row key, with the fingerprint as a signed long; a null text is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([simhash(t, width) for t in texts_of(batch.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes)], names=[ROW, "doc_id", "fp"])

    small_batches(docs.sparkSession)
    rows = keyed(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text"))
    return rows.mapInArrow(work, f"{ROW} long, doc_id long, fp long")


def block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - (1 << a)) & FULL for a, b in zip(edges, edges[1:], strict=False)]


def grow(sample: np.ndarray, mask: int, leaf: int) -> list[tuple[int, int, int, int]]:
    """A vantage-point tree over a sample: nodes ``(vantage, cut, near, far)``; a child below zero is leaf ``-1 - child``.

    Of a few candidates, the vantage point and cut that halve the sample best are taken.
    """
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0
    root: list[int] = [0]
    todo = [(sample & np.uint64(mask), root, 0)]
    slots: list[list[int]] = []
    while todo:
        rows, slot, side = todo.pop()
        best = None
        if len(rows) > leaf:
            for v in np.unique(np.concatenate((rows[:: max(1, len(rows) // 6)][:6], ~rows[:2] & np.uint64(mask)))):
                d = np.bitwise_count(rows ^ v)
                sums = np.cumsum(np.bincount(d, minlength=65))
                cut = int(np.argmin(np.abs(2 * sums - len(rows))))
                gap = abs(2 * int(sums[cut]) - len(rows))
                if 0 < sums[cut] < len(rows) and (best is None or gap < best[0]):
                    best = (gap, int(v), cut, d)
        if best is None:
            slot[side] = -1 - leaves
            leaves += 1
            continue
        _, v, cut, d = best
        own = [0, 0]
        slot[side] = len(nodes)
        nodes.append((v, cut, 0, 0))
        slots.append(own)
        todo += [(rows[d <= cut], own, 0), (rows[d > cut], own, 1)]
    return [(-1 if not nodes else 0, 0, root[0], root[0])] + [
        (v, cut, *own) for (v, cut, _, _), own in zip(nodes, slots, strict=True)
    ]


def route(codes: np.ndarray, tree: list, mask: int, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf reached: its number, the positions of ``codes`` there, and whether they live or only visit there.

    A pair within the radius that a boundary parts has its near end within ``radius`` of the cut: that end visits
    the far side. Visitors go on wherever the triangle bound leaves a partner possible.
    """
    every = np.arange(len(codes))
    todo = [(tree[0][2], every, np.ones(len(codes), bool))]
    while todo:
        child, rows, home = todo.pop()
        if not len(rows):
            continue
        if child < 0:
            yield -1 - child, rows, home
            continue
        v, cut, near, far = tree[1 + child]
        d = np.bitwise_count((codes[rows] ^ np.uint64(v)) & np.uint64(mask)).astype(np.int64)
        stays = np.where(home, d <= cut, d <= cut + radius)
        todo.append((near, rows[stays], home[stays]))
        goes = np.where(home & (d > cut), True, d > cut - radius)
        todo.append((far, rows[goes], (home & (d > cut))[goes]))


def shard_links(codes: np.ndarray, group: np.ndarray, home: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that close pairs of a shard connect, at most one for each fingerprint but the first.

    Compared are those that live here with each other and with visitors; if ``group`` has two values, only pairs
    with both.
    """
    parent = list(range(len(codes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links_a, links_b = [], []
    homes = np.flatnonzero(home)
    two = len(np.unique(group)) > 1
    step = max(1, (1 << 21) // max(1, len(codes)))
    for i in range(0, len(homes), step):
        own = homes[i : i + step]
        close = np.bitwise_count(codes[own][:, None] ^ codes[None, :]) <= within
        close &= (np.arange(len(codes))[None, :] > own[:, None]) | ~home[None, :]
        if two:
            close &= group[own][:, None] != group[None, :]
        x, y = np.nonzero(close)
        if len(x):
            roots = np.array([find(k) for k in range(len(codes))])
            x = own[x]
            apart = roots[x] != roots[y]
            for a, b in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[ra] = rb
                    links_a.append(a)
                    links_b.append(b)
    return codes[np.array(links_a, int)], codes[np.array(links_b, int)]


def close_links(codes: DataFrame, within: int = 4, blocks: int = 3, leaf: int = 8, crowd: int = 8192) -> DataFrame:
    """Links ``a, b`` among distinct fingerprints ``fp`` that connect exactly what pairs within ``within`` bits connect.

    The trees grow on one fingerprint in 64, by hash, at most about 65,536, so they stay small enough to send to every
    task, and a shard holds some hundreds of fingerprints. Shards that still hold more than ``crowd`` (their
    number is bounded by the trees' leaves) are compared in parts, each pair of parts in a task of its own.
    """
    spark = codes.sparkSession
    total = codes.count()
    share = min(1 / 64, 65536 / max(total, 1))
    chosen = F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))
    sample = np.array([r.fp for r in codes.where(chosen).collect()], np.int64).view(np.uint64)
    masks, radius = block_masks(blocks), within // blocks
    trees = spark.sparkContext.broadcast([grow(np.sort(sample), m, leaf) for m in masks])

    def shards(parts: dict[tuple[int, int], int]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = batch.column("fp").to_numpy()
                own = fps.view(np.uint64)
                for t, (tree, mask) in enumerate(zip(trees.value, masks, strict=True)):
                    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
                    for shard, rows, home in route(own, tree, mask, radius):
                        k = parts.get((t, shard), 1)
                        part = ((fps[rows] * np.int64(0x9E3779B97F4A7C1 | 1)) >> 20) % k if k > 1 else np.zeros(len(rows), np.int64)
                        for other in range(k):
                            for column, value in zip(
                                out,
                                (np.full(len(rows), shard), np.minimum(part, other), np.maximum(part, other), part, fps[rows], home),
                                strict=True,
                            ):
                                column.append(value)
                    if out[0]:
                        merged = [pa.array(np.concatenate(c)) for c in out]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(merged[0]), t)), *merged], names=["tree", "shard", "p", "q", "part", "fp", "home"]
                        )

        return work

    schema = "tree long, shard long, p long, q long, part long, fp long, home boolean"
    placed = codes.select("fp").mapInArrow(shards({}), schema)
    crowded = placed.groupBy("tree", "shard").agg(F.count("*").alias("rows")).where(F.col("rows") > crowd)
    parts = {(r.tree, r.shard): -(-r.rows // crowd) for r in crowded.collect()}
    if parts:
        placed = codes.select("fp").mapInArrow(shards(parts), schema)

    def links(rows: pa.Table) -> pa.Table:
        fp, part, home = (rows.column(c).to_numpy() for c in ("fp", "part", "home"))
        if rows.column("p")[0].as_py() == rows.column("q")[0].as_py():
            part = np.zeros(len(fp), np.int64)
        a, b = shard_links(fp.view(np.uint64), part, home, within)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return placed.groupBy("tree", "shard", "p", "q").applyInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, within: int = 4, width: int = 4, blocks: int = 3) -> DataFrame:
    """Every row with its group: ``doc_id, fp, component_id`` and the row key, and that of the row that stands for the group.

    ``component_id`` is the smallest id among the documents that links reach; ``keeper`` is the key of one row with it.
    Texts without words have fingerprint 0 and link like others; a null text is empty. Null ids come after all
    others, so a group has a null ``component_id`` only if no row of it has an id. Repeated rows are rows of their
    own. An empty table gives no rows; other columns are not used. Copies are joined by their fingerprint and
    never paired with each other.
    """
    rows = saved(fingerprints(docs, width), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    codes = checkpointed(rows.groupBy("fp").agg(F.min(order).alias("low")))
    roots = components(close_links(codes, within, blocks))
    grouped = codes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "fp"))
    lows = grouped.groupBy("root").agg(F.min("low").alias("first"))
    classes = splittable_join(grouped.select("fp", "root"), lows, "root", "inner")
    found = splittable_join(rows, classes.select("fp", "first").distinct(), "fp", "inner")
    return found.select(ROW, "doc_id", "fp", F.col("first.doc_id").alias("component_id"), F.col(f"first.{ROW}").alias("keeper"))


def one_of_each_group(docs: DataFrame, within: int = 4, width: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest id; columns as they were."""
    groups = near_duplicates(docs, within, width)
    keepers = groups.where(F.col("keeper") == F.col(ROW)).select(ROW)
    names = docs.columns
    return keyed(docs, doc=F.struct(*(F.col(f"`{c}`") for c in names))).join(keepers, ROW, "left_semi").select("doc.*")
