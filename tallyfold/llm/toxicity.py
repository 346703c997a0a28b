"""Toxicity by two Kneser-Ney models of letter sequences: one of toxic text, one of ordinary text.

Each class predicts a letter from the three before it by its own discounted counts. What the discount takes away
goes to lower-order continuation counts (how many different letters stand before a trigram) that both classes
share. So contexts that are rare in either class, or alike in both, say nothing, and unseen inflections of an
expression are still recognised by their stem. A text is judged by the difference of its log-likelihoods, divided
by the square root of its length: sums over unrelated letters grow with that root, so texts of all lengths compare.

All labelled rows are counted, every sequence by itself: tasks add up their own, a shuffle the rest. The model grows with the
number of different sequences, some 60 bytes each on the driver and in every task, and with nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import broadcast_within, remainder, runs, small_batches, texts_of

SPACE = 32
RUN = 1 << 16  # characters worked on at a time, but for longer texts


@cache
def _inside() -> np.ndarray:
    return np.fromiter((c == 39 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _four(context: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """One 64-bit key of four letters, which have 84 bits: two of a million sequences agree with a chance of 3e-8."""
    return context * np.uint64(0xD6E8FEB86659FD93) ^ letter


def _three(context: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return (context << np.uint64(21) | letter) & np.uint64((1 << 63) - 1)


class Index:
    """Places of different keys, found by open addressing in a table that is at most a quarter full."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(10, int(4 * len(keys) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32 if len(keys) < 1 << 31 else np.int64)
        rows, at = np.arange(len(keys)), self._start(keys)
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]
            lost = self.slots[at] != rows
            rows, at = rows[lost], self._next(at[lost])

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        at = self._start(keys)
        out = self.slots[at]
        if not len(self.keys):
            return out
        rows = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[rows]
        while len(rows):
            at = self._next(at)
            out[rows] = self.slots[at]
            more = (out[rows] >= 0) & (self.keys[out[rows]] != keys[rows])
            rows, at = rows[more], at[more]
        return out


@dataclass
class Letters:
    """Some texts as letter sequences, one entry for every letter and every space behind one."""

    letter: np.ndarray
    context: np.ndarray  # the three letters before it
    edges: np.ndarray  # where each text starts, and the end

    @classmethod
    def of(cls, texts: list[str]) -> Letters:
        """Letters and digits in lower case; a run of anything else is one space; three spaces before each text."""
        lowered = [f"   {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(_inside()[codes], codes, SPACE).astype(np.uint64)
        sizes = np.array([len(t) for t in lowered], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        keep = codes != SPACE
        keep[1:] |= keep[:-1]  # the first space of a run
        padding = (starts[:-1, None] + np.arange(3)).ravel()
        keep[padding] = True
        kept = np.concatenate(([0], np.cumsum(keep)))[starts]
        codes = codes[keep]
        two = np.zeros_like(codes)
        two[1:] = codes[:-1] << np.uint64(21) | codes[1:]
        three = np.zeros_like(codes)
        three[1:] = (two[:-1] << np.uint64(21) | codes[1:]) & np.uint64((1 << 63) - 1)
        real = np.ones(len(codes), bool)
        real[(kept[:-1, None] + np.arange(3)).ravel()] = False
        at = np.flatnonzero(real)
        edges = kept - 3 * np.arange(len(kept))
        return cls(codes[at], three[at - 1], edges)


def count_sequences(rows: DataFrame) -> DataFrame:
    """``context, letter, ordinary, toxic``: how often each letter stands after three others, from ``text`` and ``label`` (0 or 1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = texts_of(batch.column(0)), batch.column(1).to_numpy()
            for a, b in runs(texts, RUN):
                seen = Letters.of(texts[a:b])
                toxic = np.repeat(labels[a:b], np.diff(seen.edges)) == 1
                _, first, number = np.unique(_four(seen.context, seen.letter), return_index=True, return_inverse=True)
                data = [seen.context[first].view(np.int64), seen.letter[first].view(np.int64)]
                data += [np.bincount(number[chosen], minlength=len(first)) for chosen in (~toxic, toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(d) for d in data], names=["context", "letter", "ordinary", "toxic"])

    small_batches(rows.sparkSession)
    counted = rows.select("text", F.col("label").cast("int")).mapInArrow(count, "context long, letter long, ordinary long, toxic long")
    return counted.groupBy("context", "letter").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


@dataclass
class KneserNey:
    """What scoring needs; arrays by place in an index, with what holds for unknown sequences at the end."""

    fours: Index
    contexts: Index
    threes: Index
    shorts: Index
    own: list[np.ndarray]  # by class: probability of a letter after three, after the discount
    left: list[np.ndarray]  # by class: what three letters leave to the shared model
    shared: np.ndarray  # shared probability of a letter after two, after its discount
    rest: np.ndarray  # what two letters leave to all letters alike
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, counted: pa.Table, discount: float = 1.0, shared_discount: float = 0.5, letters: int = 40) -> KneserNey | None:
        """From the rows of ``count_sequences``; None if a class has no text."""
        context, letter, *classes = (counted.column(c).to_numpy() for c in ("context", "letter", "ordinary", "toxic"))
        if not all(counts.any() for counts in classes):
            return None
        order = np.lexsort((letter, context))
        context, letter = context[order].view(np.uint64), letter[order].view(np.uint64)
        threes, three = np.unique(_three(context, letter), return_inverse=True)
        shorts, short = np.unique(threes >> np.uint64(21), return_inverse=True)
        kinds = np.bincount(three).astype(np.float64)  # each sequence of four has another letter before these three
        shared = np.maximum(kinds - shared_discount, 0) / np.bincount(short, kinds)[short]
        rest = np.clip(1 - np.bincount(short, shared), 1e-6, 1) / letters
        contexts, after = np.unique(context, return_inverse=True)
        own, left = [], []
        for counts in classes:
            counts = counts[order]
            total = np.bincount(after, counts)
            share = np.maximum(counts - discount, 0) / np.maximum(total[after], 1)
            own.append(np.append(share, 0).astype(np.float32))
            rests = np.where(total > 0, np.clip(1 - np.bincount(after, share), 1e-6, 1), 1.0)
            left.append(np.append(rests, 1).astype(np.float32))
        found = (Index(k) for k in (_four(context, letter), contexts, threes, shorts))
        return cls(*found, own, left, np.append(shared, 0).astype(np.float32), np.append(rest, 1 / letters).astype(np.float32))

    def compare(self, texts: list[str]) -> np.ndarray:
        """Per text: (log P(text | toxic) - log P(text | ordinary)) / sqrt(letters); 0 without letters."""
        out = np.zeros(len(texts))
        for a, b in runs(texts, RUN):
            seen = Letters.of(texts[a:b])
            three = _three(seen.context, seen.letter)
            back = self.shared[self.threes.find(three)] + self.rest[self.shorts.find(three >> np.uint64(21))]
            four, context = self.fours.find(_four(seen.context, seen.letter)), self.contexts.find(seen.context)
            toxic = self.own[1][four] + self.left[1][context] * back
            ratio = np.log(toxic / (self.own[0][four] + self.left[0][context] * back))
            sums = np.concatenate(([0.0], np.cumsum(ratio, dtype=np.float64)))[seen.edges]
            out[a:b] = np.diff(sums) / np.sqrt(np.maximum(np.diff(seen.edges), 1))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.compare(texts) + self.shift, -500, 500)))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of ``y`` on ``x`` by Newton's method, slightly held back; slope at least zero, and shift."""
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    hold = np.diag([1e-2, 1e-6])
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        curve = design.T @ (design * (p * (1 - p))[:, None]) + hold
        beta += np.clip(np.linalg.solve(curve, design.T @ (y - p) - hold @ beta), -2, 2)
    return max(float(beta[0]) / scale, 0.0), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 20_000, near: int = 2_000_000) -> KneserNey | None:
    """Learn from the labelled rows whose fold (crc32 of the id modulo 5) is not 0.

    Folds 2 to 4 give the counts, all their rows. Fold 1 gives the line between the classes: a logistic regression
    on the scores of at most about ``rows`` of its rows, chosen by hash. Labels go to the tasks if they have at most
    ``near`` rows, else the join shuffles. Several labels of one id: the largest. None if a class is not there.
    """
    spark = docs.sparkSession
    fold = remainder(F.col("doc_id"), 5)
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(fold != 0)
    ones = known.where(fold == 1).count()
    joined = docs.select("doc_id", "text").where(fold != 0).join(broadcast_within(known, near), "doc_id")
    model = KneserNey.fit(count_sequences(joined.where(fold != 1)).toArrow())
    if model is None:
        return None
    share = int(min(1.0, rows / max(1, ones)) * (1 << 20))
    chosen = (fold == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(shared.value.compare(texts_of(batch.column(0))))
            yield pa.RecordBatch.from_arrays([found, batch.column(1)], names=["x", "y"])

    seen = joined.where(chosen).select("text", "label").mapInArrow(judge, "x double, y int").toPandas()
    shared.destroy()
    if seen.y.nunique() == 2:
        model.slope, model.shift = calibrate(seen.x.to_numpy(float), seen.y.to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, model: KneserNey | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; held out are ids of fold 0.

    An empty or null text has the score of no evidence. Null ids are not held out. Without a model (no labels
    of both classes) every score is 0. Repeated rows are scored alike; other columns are not used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            found = shared.value.score(texts) if shared.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: KneserNey | None, most: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``most`` or more; columns as they were. Without a model, all stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value:
                batch = batch.filter(pa.array(shared.value.score(texts_of(batch.column(at))) < most))
            yield batch

    small_batches(docs.sparkSession)
    return docs.mapInArrow(work, docs.schema)
