"""Document quality by Bradley-Terry ranking.

Of two documents, the one with the larger score is preferred with the probability sigmoid(difference). Scores are
linear in features of the text, so preference pairs teach by logistic loss on differences of features. The line between good
and bad is a quantile of the training scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import broadcast_within, remainder, small_batches, texts_of

BAR = 0.3  # the score at the line
FEATURES = (
    "characters words word_length distinct_words distinct_pairs top_word capitals digits white other_ascii spread_signs "
    "wide lines distinct_lines line_words signed_words capital_words short_words"
).split()
_CLASS = np.zeros(256, np.int64)  # of a byte: 0 small letter, 1 capital, 2 digit, 3 white space, 4 other ASCII, 5 beyond
_CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]] = 1, 2, 3
_CLASS[[b for b in range(128) if not (chr(b).isalnum() or chr(b).isspace())]] = 4
_CLASS[128:] = 5
_SENTENCE = frozenset(b".,;:'\"-()?")  # signs of ordinary prose


def features(text: str) -> list[float]:
    """The numbers named in ``FEATURES``; an empty text has no words and no shares."""
    raw = text.encode("utf-8", "surrogatepass")
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by = np.bincount(_CLASS, bytes_, minlength=6)
    odd = sum(int(bytes_[b]) for b in range(33, 127) if _CLASS[b] == 4 and b not in _SENTENCE)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, size, m = max(1, len(words)), max(1, len(raw)), max(1, len(lines))
    top = max(Counter(words).values(), default=0)
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / n if words else 0.0,
        len(set(words)) / n,
        len(set(zip(words, words[1:], strict=False))) / n,
        top / n,
        by[1] / size,
        by[2] / size,
        by[3] / size,
        by[4] / size,
        odd / size,
        by[5] / size,
        np.log1p(len(lines)),
        len(set(lines)) / m,
        np.log1p(len(words) / m),
        sum(not w[-1].isalnum() for w in words) / n,
        sum(w[0].isupper() for w in words) / n,
        sum(len(w) < 4 for w in words) / n,
    ]


@dataclass
class Ranking:
    """A score linear in scaled features, their squares and roots, and the line at which it is cut."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    line: float = 0.0
    slope: float = 1.0

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.concatenate((z, z * z / 4, np.sqrt(np.abs(z))), 1)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``BAR`` at the line."""
        z = self.slope * (self.rank(x) - self.line) + np.log(BAR / (1 - BAR))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, pairs: int = 200_000, hold: float = 1e-3) -> Ranking | None:
        """Learn from rows ``x`` and which of them are good; None without both kinds.

        ``pairs`` preferences are drawn, each a good row over a bad one, all rows of the rarer kind equally often. The
        line is the quantile of the scores that tells the two kinds apart with the least error, each kind
        weighing the same.
        """
        over, under = np.flatnonzero(good), np.flatnonzero(~good)
        if not len(over) or not len(under):
            return None
        scale = x.std(0)
        model = cls(x.mean(0), np.where(scale > 1e-9, scale, 1.0), np.zeros(3 * x.shape[1]))
        rnd = np.random.default_rng(11)
        basis = model.basis(x)
        differ = basis[rnd.permutation(np.resize(over, pairs))] - basis[rnd.permutation(np.resize(under, pairs))]
        for _ in range(30):
            p = 1 / (1 + np.exp(np.clip(differ @ model.weights, -30, 30)))  # how wrong each preference is
            curve = differ.T @ (differ * (p * (1 - p))[:, None]) / pairs + hold * np.eye(differ.shape[1])
            step = np.linalg.solve(curve, differ.T @ p / pairs - hold * model.weights)
            model.weights = model.weights + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-4:
                break
        ranks = basis @ model.weights
        cuts = np.quantile(ranks, np.linspace(0, 1, 1001))
        wrong = [(ranks[good] < c).mean() + (ranks[~good] >= c).mean() for c in cuts]
        least = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-12)
        model.line = float(cuts[least[len(least) // 2]])
        return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 20_000, near: int = 2_000_000) -> Ranking | None:
    """Learn from labelled rows whose crc32 of the id modulo 5 is not 0: at most about ``rows`` of them, chosen by hash.

    Several labels of one id: the largest. Labels go to the tasks if they have at most ``near`` rows after that choice,
    else the join shuffles. None if a kind is not there.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(remainder(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = int(min(1.0, rows / max(1, known.count())) * (1 << 20))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < share)
    joined = docs.select("doc_id", "text").join(broadcast_within(known, near), "doc_id").select("text", "label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t) for t in texts_of(batch.column(0))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([found, batch.column(1)], names=["x", "label"])

    small_batches(docs.sparkSession)
    seen = joined.mapInArrow(measure, "x array<double>, label int").orderBy("label", F.xxhash64("x")).toPandas()
    x = np.array(seen.x.tolist(), float).reshape(-1, len(FEATURES))
    return Ranking.fit(x, seen.label.to_numpy() == 1)


def score_quality(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; held out are ids whose crc32 modulo 5 is 0.

    Null texts are empty and scored like any; null ids are not held out. Without a model every score is ``BAR``. Repeated
    rows are scored alike; other columns are not used; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
            found = shared.value.score(x) if shared.value else np.full(len(texts), BAR)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= BAR).cast("int").alias("predicted"))
