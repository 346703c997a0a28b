"""Document fingerprints by locally consistent parsing.

A text is cut into phrases, these into longer phrases, and so on. Where to cut is decided by deterministic coin
tossing: each symbol is labelled by the lowest bit in which it differs from the one before, four times over, which
leaves labels below six; local maxima start phrases. A cut thus depends on a few symbols around it and on nothing else,
so equal passages get equal phrases inside, wherever they stand. The names of the phrases from the second level on
are sampled into a fingerprint of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import ROW, keyed, small_batches, texts_of

BINS = 64
LEVELS = 5  # at most; the first gives no names
CHUNK = 1 << 18  # characters parsed at a time


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _merge_repeats(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol become one symbol; ``starts`` has a mark where a text begins."""
    fresh = starts.copy()
    fresh[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(fresh)
    if len(at) == len(symbols):
        return symbols, starts
    runs = np.diff(np.append(at, len(symbols))).astype(np.uint64)
    kept = symbols[at]
    return np.where(runs > 1, _mix(kept + runs * np.uint64(0xA24BAED4963EE407)), kept), starts[at]


def _labels(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels below six, different for neighbours within a text."""
    x = symbols
    for _ in range(4):
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[starts] = x[starts] ^ np.uint64(1)
        differ = x ^ before
        low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        x = low << np.uint64(1) | (x >> np.minimum(low, np.uint64(63))) & np.uint64(1)
    return x


def parse(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names of the phrases, and which of them begin a text."""
    symbols, starts = _merge_repeats(symbols, starts)
    x = _labels(symbols, starts).astype(np.int16)
    left, right = np.full(len(x), -1, np.int16), np.full(len(x), -1, np.int16)
    left[1:] = np.where(starts[1:], -1, x[:-1])
    right[:-1] = np.where(starts[1:], -1, x[1:])
    cuts = ((x > left) & (x > right)) | starts
    at = np.flatnonzero(cuts)
    places = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    terms = _mix(symbols + (places + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return _mix(np.add.reduceat(terms, at)), starts[at]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of ``BINS`` 16-bit numbers per text: of the phrase names that fall into a bin, the smallest hash; 0 if none."""
    out = np.zeros((len(texts), BINS), np.uint16)
    filled = [i for i, t in enumerate(texts) if t]
    if not filled:
        return out
    joined = "".join(texts[i] for i in filled).encode("utf-32-le", "surrogatepass")
    symbols = np.frombuffer(joined, "<u4").astype(np.uint64)
    starts = np.zeros(len(symbols), bool)
    starts[np.cumsum([0, *(len(texts[i]) for i in filled[:-1])])] = True
    keys = []
    sizes = np.full(len(filled), 2)
    for level in range(1, LEVELS + 1):
        before = sizes
        symbols, starts = parse(symbols, starts)
        owner = np.cumsum(starts) - 1
        sizes = np.bincount(owner)
        if level > 1:
            # a text that is one phrase already gives no more names, whatever the texts beside it do
            go_on = np.ones(len(owner), bool) if level == 2 else before[owner] > 1
            hashed = _mix(symbols[go_on] + np.uint64(level))
            own = owner[go_on].astype(np.uint64)
            keys.append(own << np.uint64(38) | (hashed >> np.uint64(58)) << np.uint64(32) | hashed & np.uint64(0xFFFFFFFF))
    names = np.sort(np.concatenate(keys))
    first = np.concatenate(([True], np.diff(names >> np.uint64(32)) > 0))
    chosen = names[first]
    rows, bins = (chosen >> np.uint64(38)).astype(np.int64), (chosen >> np.uint64(32)).astype(np.int64) % BINS
    out[np.array(filled)[rows], bins] = 1 + (chosen & np.uint64(0xFFFFFFFF)) % np.uint64(65535)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of phrase names in common: equal bins over bins filled on either side; 1 if both are empty."""
    either = ((a > 0) | (b > 0)).sum(1)
    return np.where(either == 0, 1.0, ((a == b) & (a > 0)).sum(1) / np.maximum(either, 1))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` and the text that follows, dealt out in ranges of ids and sorted there.

    Gives rows ``bucket, guest, none, doc_id, row key, text``: within a bucket each row's text is followed by that of the
    next one. The first row of each range is a guest at the end of the range before, the very first at the
    very end. Only range bounds and first rows' keys, as many as there are shuffle partitions, pass the driver. Null
    ids come last.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text"))
    bounds = rows.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    bounds = np.unique(np.array(bounds, float)).astype(np.int64)

    def bucket_of(column: pa.Array) -> np.ndarray:
        ids = column.fill_null(0).to_numpy()
        return np.where(column.is_null().to_numpy(zero_copy_only=False), len(bounds), np.searchsorted(bounds, ids, "right"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket_of(batch.column(1)))], names=[ROW, "doc_id", "bucket"])

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    placed = rows.select(ROW, "doc_id").mapInArrow(place, f"{ROW} long, doc_id long, bucket long")
    firsts = sorted((r.bucket, r.low[ROW]) for r in placed.groupBy("bucket").agg(F.min(order).alias("low")).collect())
    host = {row: firsts[i - 1][0] for i, (_, row) in enumerate(firsts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "guest", "none", "doc_id", ROW, "text"]
        for batch in batches:
            keys, ids, texts = batch.columns
            none = ids.is_null()
            own = [pa.array(bucket_of(ids)), pa.array(np.zeros(batch.num_rows, bool)), none, ids, keys, texts]
            yield pa.RecordBatch.from_arrays(own, names=names)
            for i, key in enumerate(keys.to_pylist()):
                if key in host:
                    guest = [pa.array([host[key]]), pa.array([True]), *(c.slice(i, 1) for c in (none, ids, keys, texts))]
                    yield pa.RecordBatch.from_arrays(guest, names=names)

    schema = f"bucket long, guest boolean, none boolean, doc_id long, {ROW} long, text string"
    dealt = rows.mapInArrow(deal, schema).repartition(parts, "bucket")
    return dealt.sortWithinPartitions("bucket", "guest", "none", "doc_id", ROW)


RESULT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, with that of its edited text and how near it is to this and to the next document.

    Returns ``doc_id, n_chars, edited`` (the edited text)``, fingerprint, edited_fingerprint, near_edited, near_next``;
    fingerprints are hexadecimal. Next is by ascending id, null ids last, rows of one id in the table's order; the first
    follows the last, and an only document itself. A null text is empty; the empty fingerprint is like itself (1) and unlike all others (0).
    Other columns are not used; an empty table gives no rows.
    """

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        """Rows with the one that follows the last of them."""
        texts = [t or "" for *_, t in rows]
        after = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own, changed = fingerprints(texts), fingerprints(after)
        data = [
            [r[2] for r in rows[:-1]],
            [len(t) for t in texts[:-1]],
            after,
            [x.tobytes().hex() for x in own[:-1]],
            [x.tobytes().hex() for x in changed],
            likeness(own[:-1], changed),
            likeness(own[:-1], own[1:]),
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3)] + [texts_of(batch.column(5))]
            for row in zip(*columns, strict=True):
                if held and held[-1][1] and row[0] != held[-1][0]:
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                if len(held) > 1 and (row[1] or size > CHUNK):
                    yield compare(held)
                    held, size = [row], len(row[3])

    return with_following(docs).mapInArrow(work, RESULT)
