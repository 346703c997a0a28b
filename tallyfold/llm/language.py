"""Language identification by a Bloom filter whose slots are bit masks of languages.

The filter is bit-sliced: one look-up per hash returns, for an n-gram, all languages that may contain it at once,
as the bits common to its slots. A text's bits are counted per language, the share that the filter's false positives
explain is taken off, and the language with the largest rest is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import remainder, runs, small_batches, texts_of

GRAMS = 20  # bits of an n-gram's number
SLOTS = 21  # bits: slots of the filter
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
UNKNOWN = "und"
RUN = 1 << 16  # characters worked on at a time, but for longer texts
MOST = 1024  # languages


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all letter trigrams of some texts, the texts' edges among them, and which have a letter.

    Letters are in lower case, all else counts as a space; a trigram has a letter in its middle.
    """
    lowered = [f" {t} ".lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = np.where(_letters()[codes], codes, 32)
    edges = np.concatenate(([0], np.cumsum([len(t) for t in lowered])))
    valid = np.zeros(len(codes), bool)
    valid[1:-1] = codes[1:-1] != 32
    at = np.flatnonzero(valid)
    mixed = (codes[at - 1].astype(np.uint64) << np.uint64(42)) | (codes[at].astype(np.uint64) << np.uint64(21)) | codes[at + 1].astype(np.uint64)
    found = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - GRAMS)).astype(np.int64)
    places = np.concatenate(([0], np.cumsum(valid)))[edges]
    return found, places, np.diff(places) > 0


def _slots(numbers: np.ndarray) -> list[np.ndarray]:
    return [(((numbers + 1).astype(np.uint64) * np.uint64(h)) >> np.uint64(64 - SLOTS)).astype(np.int64) for h in HASHES]


@dataclass
class Filter:
    """The slots, 64 languages to a column, the languages' names, and each one's rate of false positives."""

    names: list[str]
    slots: np.ndarray
    wrong: np.ndarray

    @classmethod
    def build(cls, names: list[str], grams: np.ndarray, members: np.ndarray) -> Filter:
        """``members[i]`` has the mask words of the n-gram ``grams[i]``."""
        slots = np.zeros((1 << SLOTS, members.shape[1]), np.uint64)
        for at in _slots(grams):
            np.bitwise_or.at(slots, at, members)
        full = [np.count_nonzero(slots[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) / len(slots) for k in range(len(names))]
        return cls(names, slots, np.array(full) ** len(HASHES))

    def languages(self, numbers: np.ndarray) -> np.ndarray:
        """The masks of all languages that contain each n-gram."""
        first, *rest = (self.slots[at] for at in _slots(numbers))
        for other in rest:
            first = first & other
        return first

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Name and score of the language of each text; ties go to the first name."""
        numbers, edges, lettered = grams(texts)
        masks = self.languages(numbers)
        sizes = np.maximum(np.diff(edges), 1)
        rates = np.zeros((len(self.names), len(texts)))
        for k in range(len(self.names)):
            bits = np.cumsum(masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1))
            hits = np.concatenate(([0], bits)).astype(np.int64)[edges]
            rates[k] = (np.diff(hits) / sizes - self.wrong[k]) / max(1 - self.wrong[k], 1e-9)
        rates = np.clip(rates, 0, 1)
        best = rates.argmax(0)
        names = [self.names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, np.where(lettered, rates[best, np.arange(len(texts))], 0.0)


def train(docs: DataFrame, held_out: int = 1, least: int = 2, part: float = 0.25) -> Filter | None:
    """Learn which n-grams each value of ``lang`` contains, from rows whose crc32 of the id modulo 3 is not ``held_out``.

    An n-gram is in a language if it occurs ``least`` times there, and as a share of all its n-grams at least
    ``part`` times as often as in the language where it is commonest: in a large corpus every n-gram strays into every
    language. All such rows are counted. Rows without an id, text or lang teach nothing. None without any.
    The counts are bounded by the number of languages (at most ``MOST``, else an error) times 2**GRAMS.
    """
    rows = docs.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.where(remainder(docs["doc_id"], 3) != held_out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                at = np.flatnonzero(counts)
                data = [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])]
                yield pa.RecordBatch.from_arrays(data, names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            texts, langs = texts_of(batch.column(0)), batch.column(1).to_pylist()
            for a, b in runs(texts, RUN):
                numbers, edges, _ = grams(texts[a:b])
                order = np.repeat(np.arange(b - a), np.diff(edges))
                own = np.array(langs[a:b])
                for name in sorted(set(langs[a:b])):
                    if name not in held:
                        held[name] = np.zeros(1 << GRAMS, np.int64)
                    np.add.at(held[name], numbers[(own == name)[order]], 1)
                    if len(held) > 16:
                        yield from flush()
        yield from flush()

    small_batches(docs.sparkSession)
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all")).limit(MOST + 1).collect()
    if len(totals) > MOST:
        raise ValueError(f"more than {MOST} languages")
    if not totals:
        return None
    names = sorted(r["lang"] for r in totals)
    shares = counts.join(F.broadcast(docs.sparkSession.createDataFrame(totals, "lang string, all long")), "lang")
    shares = shares.withColumn("share", F.col("n") / F.col("all"))
    best = F.max("share").over(Window.partitionBy("gram"))
    kept = shares.withColumn("best", best).where((F.col("n") >= least) & (F.col("share") >= part * F.col("best")))
    number = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("lang")) - 1
    masks = kept.select("gram", number.alias("number")).groupBy("gram").agg(F.collect_set("number").alias("numbers"))
    found = masks.toPandas()
    members = np.zeros((len(found), -(-len(names) // 64)), np.uint64)
    for i, numbers in enumerate(found.numbers):
        for k in numbers:
            members[i, k // 64] |= np.uint64(1 << (k % 64))
    return Filter.build(names, found.gram.to_numpy(np.int64), members)


def predict_language(docs: DataFrame, model: Filter | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; held out are ids with crc32 modulo 3 of 1.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Null ids are not held out.
    Repeated rows are judged alike; other columns are not used; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = judge(shared.value, texts_of(batch.column(1)))
            data = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(data, names=["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def judge(model: Filter | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    names: list[str] = []
    scores = np.zeros(len(texts))
    if model is None:
        return [UNKNOWN] * len(texts), scores
    for a, b in runs(texts, RUN):
        found, scores[a:b] = model.decide(texts[a:b])
        names += found
    return names, scores


def with_language(docs: DataFrame, model: Filter | None, least: float = 0.2) -> DataFrame:
    """``docs`` without rows in no learned language: those judged ``und`` or scored below ``least``; columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = judge(shared.value, texts_of(batch.column(at)))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores.tolist(), strict=True)], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(work, docs.schema)
