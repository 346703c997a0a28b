"""Byte-level BPE of whole texts: leaves encoded in parallel, joined by tree concatenation.

A long text is halved down to leaves that tasks encode on their own. Joining two neighbours re-encodes a window around
the cut, and widens it until what it gives agrees with the left side where it begins and with the right side where it
ends. Agreement is exact at both levels at which the tokenizer works: the scanner that splits text keeps no
memory past a split, and a sequence of ids is the encoding of its bytes if every two neighbours are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import ROW, keyed, runs, small_batches, texts_of
from tallyfold.llm.tokens import Encoder, encoder

REACH = 3  # characters that the scanner may look ahead of a split: the longest contraction
STORE = 200_000  # pieces that a worker keeps, which also holds whole texts as splits
SHORT = 48  # characters of a split that the encoder's store keeps
Split = tuple[int, list[int]]  # characters and ids of what the scanner splits off


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id: the vocabulary writes each byte as one printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    tokenizer = encoder(path, most=STORE).tokenizer
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = token.encode() if token in special else bytes(shown[c] for c in token)
    return out


class Tree:
    """Tree concatenation with one tokenizer."""

    def __init__(self, path: str, leaf: int = 1024):
        self.encoder: Encoder = encoder(path, most=STORE)
        self.tokenizer, self.bytes, self.leaf = self.encoder.tokenizer, token_bytes(path), leaf

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def scan(self, text: str) -> list[str]:
        """What the scanner splits a text without special tokens into."""
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def unsplit(self, text: str) -> list[int]:
        """The ids of one piece that the scanner does not split, however long."""
        if len(text) <= self.leaf:
            return self._ids(text)
        middle = len(text) // 2
        return self.meet(self.unsplit(text[:middle]), self.unsplit(text[middle:]))

    def meet(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring parts of an unsplit piece: windows of ids around the cut, doubled until they agree.

        The window starts and ends with an id that the side has there too, or takes in the whole side.
        """
        width = 4
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            raw = b"".join(map(self.bytes.__getitem__, [*left[a:], *right[:b]]))
            try:
                inner = self._ids(raw.decode("utf-8"))
            except UnicodeDecodeError:  # the window's edge is within a character
                width += 1
                if a == 0 and b == len(right):
                    raise
                continue
            if (a == 0 or inner[0] == left[a]) and (b == len(right) or inner[-1] == right[b - 1]):
                return [*left[:a], *inner, *right[b:]]
            width *= 2

    def leaf_splits(self, text: str) -> list[Split]:
        """What the scanner splits a leaf into; short splits are looked up together."""
        splits = self.scan(text)
        short = [x for x in splits if len(x) <= SHORT]
        ids, sizes = self.encoder.lookup([self.encoder.key(x) for x in short])
        ends = np.cumsum(sizes).tolist()
        ids, looked = ids.tolist(), iter(zip([0, *ends], ends, strict=False))
        return [(len(x), ids[slice(*next(looked))] if len(x) <= SHORT else self.unsplit(x)) for x in splits]

    def join(self, left: list[Split], right: list[Split], text: str, start: int, cut: int) -> list[Split]:
        """The splits of two neighbouring parts of ``text``: the left from ``start``, the right from ``cut``.

        The window begins at a split of the left side out of reach of the cut. It grows on the right until the scanner
        splits inside it where the right side is split too.
        """
        keep, back = len(left), 0
        while keep and back < REACH:
            keep -= 1
            back += left[keep][0]
        ends = np.cumsum([n for n, _ in right])
        width = 4
        while True:
            k = min(width, len(right))
            stop = cut + int(ends[k - 1]) if k else cut
            pieces = self.scan(text[cut - back : stop])
            at, seen, splits = cut - back, [], {cut: 0, **{cut + int(e): i + 1 for i, e in enumerate(ends[:k])}}
            for piece in pieces:
                if at >= cut and at in splits and seen and (k == len(right) or at <= stop - REACH):
                    break
                seen.append((at, piece))
                at += len(piece)
            if at in splits and (k == len(right) or at <= stop - REACH):
                middle = [self._across(x, piece, left, right, cut) for x, piece in seen]
                return [*left[:keep], *middle, *right[splits[at] :]]
            width *= 2

    def _across(self, at: int, piece: str, left: list[Split], right: list[Split], cut: int) -> Split:
        if left and right and at == cut - left[-1][0] and at + len(piece) == cut + right[0][0]:
            return len(piece), self.meet(left[-1][1], right[0][1])
        return len(piece), self.unsplit(piece)

    def fold(self, parts: list[list[Split]], text: str) -> list[int]:
        """The ids of a whole text from the splits of its parts, joined pairwise, level by level."""
        spans, at = [], 0
        for splits in parts:
            spans.append((at, splits))
            at += sum(n for n, _ in splits)
        while len(spans) > 1:
            joined = [(a, self.join(x, y, text, a, b)) for (a, x), (b, y) in zip(spans[::2], spans[1::2], strict=False)]
            spans = joined + spans[2 * len(joined) :]
        return [i for _, ids in spans[0][1] for i in ids] if spans else []


def halves(text: str, most: int) -> list[str]:
    """The text halved until no part has over ``most`` characters; parts on one level differ by one at most."""
    parts = [text]
    while max(map(len, parts)) > most:
        parts = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :])]
    return parts


def split_leaves(tree: Tree, batch: pa.RecordBatch, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """The leaves of a batch with their splits, some ``most`` characters at a time: a split takes far more memory than its text."""
    parts, texts = batch.column("part").to_pylist(), batch.column("text").to_pylist()
    for a, b in runs(texts, most):
        splits = [[(len(x), tree._ids(x))] if p % 2 else tree.leaf_splits(x) for p, x in zip(parts[a:b], texts[a:b], strict=True)]
        sizes = pa.array([[n for n, _ in s] for s in splits], pa.list_(pa.int32()))
        counts = pa.array([[len(i) for _, i in s] for s in splits], pa.list_(pa.int32()))
        ids = pa.array([np.array([i for _, x in s for i in x], "<u4").tobytes() for s in splits], pa.binary())
        own = batch.slice(a, b - a)
        yield pa.RecordBatch.from_arrays([*own.columns, sizes, counts, ids], names=[*batch.schema.names, "sizes", "counts", "ids"])


def encode(docs: DataFrame, tokenizer: str, long: int = 32_768) -> DataFrame:
    """``doc_id, ids`` of every text as the library encodes it; ids are little-endian unsigned 32-bit.

    Special tokens that stand in a text are ids of their own, as the library has it, and end a part. Texts of more than ``long``
    characters are cut into leaves, which are shuffled and encoded one by one and then joined per text; all others
    are encoded where they are read. A null text is empty and has no ids; null ids and repeated rows are
    documents of their own; other columns are not used; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs, doc_id=F.col("doc_id").cast("long"), text=F.coalesce("text", F.lit("")))
    size = F.length("text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, most=STORE)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in runs(texts, 1 << 20):
                ids = pa.array(own.encode(texts[a:b]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = "|".join(map(re.escape, sorted(encoder(tokenizer, most=STORE).marks, key=len, reverse=True))) or "(?!)"
        for batch in batches:
            for row, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # even places: text, cut into leaves; odd places: special tokens
                pieces = [(k, j, x) for k, p in enumerate(re.split(f"({marks})", text)) if p for j, x in enumerate([p] if k % 2 else halves(p, long // 2))]
                for number, (part, leaf, x) in enumerate(pieces):
                    columns = [[row], [key], [number], [part], [leaf], [x]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CUTS.types, strict=True)], schema=CUTS)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(tokenizer)
        for batch in batches:
            yield from split_leaves(tree, batch)

    def joined(rows: pa.Table) -> pa.Table:
        """One text: its leaves in order, folded part by part."""
        tree, out = Tree(tokenizer), []
        rows = rows.sort_by("number").to_pylist()
        for part in sorted({r["part"] for r in rows}):
            own = [r for r in rows if r["part"] == part]
            parts = []
            for r in own:
                ids = np.frombuffer(r["ids"], "<u4").tolist()
                edges = np.concatenate(([0], np.cumsum(r["counts"]))).astype(int).tolist()
                parts.append([(n, ids[a:b]) for n, a, b in zip(r["sizes"], edges, edges[1:], strict=False)])
            out += parts[0][0][1] if part % 2 else tree.fold(parts, "".join(r["text"] for r in own))
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "ids": pa.array([np.array(out, "<u4").tobytes()], pa.binary())})

    near = rows.where(size <= long).select("doc_id", "text").mapInArrow(short, "doc_id long, ids binary")
    schema = f"{ROW} long, doc_id long, number int, part int, leaf int, text string"
    # A number of its own keeps the leaves apart: they are few bytes, but each costs time.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = rows.where(size > long).mapInArrow(cut, schema).repartition(tasks, ROW, "number")
    far = far.mapInArrow(leaves, schema + ", sizes array<int>, counts array<int>, ids binary")
    return near.unionByName(far.groupBy(ROW).applyInArrow(joined, "doc_id long, ids binary"))


CUTS = pa.schema([(ROW, pa.int64()), ("doc_id", pa.int64()), ("number", pa.int32()), ("part", pa.int32()), ("leaf", pa.int32()), ("text", pa.string())])


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids, text``: the text that the library decodes the ids to, special tokens included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(tokenizer).__getitem__
        for batch in batches:
            texts = [b"".join(map(known, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    small_batches(tokens.sparkSession)
    return tokens.mapInArrow(work, "doc_id long, ids binary, text string")

