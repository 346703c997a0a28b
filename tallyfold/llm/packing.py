"""Best-fit packing of token sequences, planned on the histogram of lengths.

The plan sees only how many pieces there are of each length, at most ``size`` numbers. Best-fit decreasing runs
on these counts: whenever the longest length left is placed with what fits best beside it, that pattern is
applied as many times as the counts allow. A plan is a bounded list of intervals: ranks ``a`` to ``b`` of
one length go to sequences ``s``, ``s + 1``, ... at one offset. Pieces find their place by their rank within
their length. Ranks come from counts per task and length and are never worked out by one task for a whole length.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.common import runs, saved, small_batches, task_index, texts_of
from tallyfold.llm.tokens import encoder

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary())]
    + [("task", pa.int32()), ("nth", pa.int64())]
)
INTERVALS = "length int, low long, high long, sequence long, offset long"


def plan_best_fit(counts: Mapping[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals ``(length, low, high, sequence, offset)`` that place ``counts[n]`` pieces of each length ``n``.

    The piece of rank ``r`` with ``low <= r < high`` goes to sequence ``sequence + r - low`` at ``offset``. Best
    fit: open a sequence with the longest length left, then take the longest that still fits, until none does.
    """
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    used = np.zeros(size + 1, np.int64)
    below = np.zeros(size + 2, np.int64)  # the longest length up to n of which something is left
    plan, sequence = [], 0

    def refresh(n: int) -> None:
        below[n:] = 0
        below[1:-1] = np.maximum.accumulate(np.where(left[1:] > 0, np.arange(1, size + 1), 0))

    refresh(0)
    while below[size]:
        room, pattern, taken = size, [], {}
        while room and (n := int(below[room])):
            while n and left[n] <= taken.get(n, 0):  # all of this length are in the pattern already
                n = int(below[n - 1])
            if not n:
                break
            most = min(room // n, int(left[n]) - taken.get(n, 0))
            pattern += [n] * most
            taken[n] = taken.get(n, 0) + most
            room -= n * most
        times = min(int(left[n]) // k for n, k in taken.items())
        offset = 0
        for n in pattern:
            plan.append((n, int(used[n]), int(used[n]) + times, sequence, offset))
            used[n] += times
            left[n] -= times
            offset += n
        sequence += times
        if any(left[n] == 0 for n in taken):
            refresh(0)
    return plan


def cut_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, store: int = 600_000) -> DataFrame:
    """The token pieces of every document; ``nth`` numbers those of one length within each task.

    A document has its ids and ``end_id``. Only one longer than ``size`` is cut: its first piece takes the
    remainder, all others are full. A null text is empty.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer, most=store).encode, task_index()
        seen = np.zeros(size + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, keys = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for a, b in runs(texts, 1 << 21):
                rows: list[list] = [[], [], [], [], [], []]
                for key, ids in zip(keys[a:b], encode(texts[a:b]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    edges = list(range(n % size or min(n, size), n + 1, size))
                    for k, (start, stop) in enumerate(zip([0, *edges], edges, strict=False)):
                        row = (key, k, start, stop - start, ids[4 * start : 4 * stop], int(seen[stop - start]))
                        seen[stop - start] += 1
                        for column, value in zip(rows, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip([*rows[:5], [task] * len(rows[0]), rows[5]], PIECES.types, strict=True)],
                    schema=PIECES,
                )

    small_batches(docs.sparkSession)
    kinds = "doc_id long, piece int, start long, length int, ids binary, task int, nth long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, kinds)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, store: int = 600_000) -> DataFrame:
    """Every piece of every document with its place: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit; ``start`` counts the document's ids before the piece. Places in a
    sequence leave no gap. Null ids and repeated rows are documents of their own; an empty text is one end id; an
    empty table gives no rows. Other columns of ``docs`` are not used. A worker keeps the ids of ``store`` pieces of text, some 250 bytes
    each; it takes longer with fewer.

    The pieces are written once, since their ranks and their contents must come from one run. The driver sees one
    count per length and gets the plan; both are bounded by ``size``, not by the data.
    """
    spark = docs.sparkSession
    pieces = saved(cut_pieces(docs, tokenizer, size, end_id, store), "pieces")
    per_task = saved(pieces.groupBy("length", "task").agg(F.count("*").alias("rows")), "piece-counts")
    counts = {r.length: r.rows for r in per_task.groupBy("length").agg(F.sum("rows").alias("rows")).collect()}
    plan = plan_best_fit({n: c for n, c in counts.items() if n < size}, size)
    first_full = max((s + high - low for _, low, high, s, _ in plan), default=0)
    plan.append((size, 0, counts.get(size, 0), first_full, 0))

    # A row per task and length, with the ranks that precede it: bounded by tasks times lengths, shuffled by length.
    before = F.expr("sum(rows) OVER (PARTITION BY length ORDER BY task) - rows")
    bases = per_task.withColumn("base", before).select("length", "task", "base")
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    intervals = sorted(plan)
    table: dict[int, list] = {}
    for n, low, high, s, offset in intervals:
        table.setdefault(n, []).append((low, high, s, offset))
    starts = {n: np.array([r[0] for r in rows]) for n, rows in table.items()}
    values = {n: np.array([(r[0], r[2], r[3]) for r in rows]) for n, rows in table.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                low, s, at = values[n][np.searchsorted(starts[n], ranks[own], "right") - 1].T
                sequence[own], offset[own] = s + ranks[own] - low, at
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*out.fieldNames()])

    out = T.StructType.fromDDL(
        "doc_id long, piece int, start long, length int, ids binary, sequence_id long, offset long"
    )
    small_batches(spark)
    return ranked.mapInArrow(place, out)
