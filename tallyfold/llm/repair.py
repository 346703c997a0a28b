"""Token ids as Re-Pair grammars: files of blocks that give back any document without the rest.

Documents are put in ascending order of ids by a range shuffle, encoded, and gathered in blocks. In each block
frequent pairs of neighbouring ids become nonterminals, round by round; all pairs of a round are replaced
together, left to right. No pair crosses the end of a document. A block stores its rules, the number of ids each
rule stands for, the final sequence, and every document's place in it, so a document is decoded alone.

A block is the bytes ``RPB1``, six 32-bit numbers (bytes per symbol, first nonterminal, rules, symbols, documents,
0), then the rules' left and right symbols and expansion lengths, the documents' numbers of symbols and of ids (32 bits
each), and the sequence; all little-endian and unsigned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import runs, saved, small_batches, task_index, texts_of
from tallyfold.llm.tokens import encoder, spans

MAGIC = b"RPB1"
HASH_BITS = 18


@dataclass
class Block:
    first: int  # the first nonterminal: rule k is symbol first + k
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray  # ids that each rule stands for
    sequence: np.ndarray
    symbols: np.ndarray  # of each document
    tokens: np.ndarray  # ids of each document

    def to_bytes(self) -> bytes:
        width = 2 if self.first + len(self.left) <= 1 << 16 else 4
        head = np.array([width, self.first, len(self.left), len(self.sequence), len(self.tokens), 0], "<u4")
        tables = (self.left, self.right, self.lengths, self.symbols, self.tokens)
        return b"".join([MAGIC, head.tobytes(), *(t.astype("<u4").tobytes() for t in tables), self.sequence.astype(f"<u{width}").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Block:
        if raw[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        width, first, rules, size, docs, _ = np.frombuffer(raw, "<u4", 6, 4).tolist()
        at, parts = 28, []
        for n in (rules, rules, rules, docs, docs):
            parts.append(np.frombuffer(raw, "<u4", n, at))
            at += 4 * n
        left, right, lengths, symbols, tokens = parts
        return cls(first, left, right, lengths, np.frombuffer(raw, f"<u{width}", size, at), symbols, tokens)

    def expand(self, sequence: np.ndarray) -> np.ndarray:
        """The ids that a sequence of symbols stands for."""
        x = sequence.astype(np.int64)
        while len(x) and (deep := x >= self.first).any():
            places = np.cumsum(1 + deep) - 1 - deep
            out = np.empty(len(x) + np.count_nonzero(deep), np.int64)
            out[places] = np.where(deep, self.left[np.where(deep, x - self.first, 0)] if len(self.left) else 0, x)
            out[places[deep] + 1] = self.right[x[deep] - self.first]
            x = out
        return x.astype("<u4")

    def all_expanded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What every symbol stands for, one after the other; where that of each symbol starts; how many ids it has.

        A rule occurs several times in its block, so all of this is no longer than a few blocks' ids.
        """
        rules = np.arange(self.first, self.first + len(self.left))
        sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])
        return np.concatenate([np.arange(self.first, dtype="<u4"), self.expand(rules)]), np.cumsum(sizes) - sizes, sizes

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i`` alone."""
        start = int(self.symbols[:i].sum(dtype=np.int64))
        return self.expand(self.sequence[start : start + int(self.symbols[i])])

    def span(self, start: int, stop: int) -> np.ndarray:
        """The block's ids from ``start`` to ``stop``: only the symbols that reach into that range are expanded."""
        sizes = np.ones(len(self.sequence), np.int64)
        deep = self.sequence >= self.first
        sizes[deep] = self.lengths[self.sequence[deep].astype(np.int64) - self.first]
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.sequence[a:b])[start - before : stop - before]


def compress(ids: np.ndarray, tokens: np.ndarray, rounds: int = 10, per_round: int = 4096, least: int = 8) -> Block:
    """Re-Pair over one block: ``tokens`` are the documents' numbers of ids, all at least 1.

    Each round replaces the up to ``per_round`` most frequent pairs that occur at least ``least`` times; rounds end
    when a round saves under a hundredth. Every pair is found again in the exact counts of its hash's candidates.
    """
    x = ids.astype(np.uint64)
    first = int(x.max()) + 1 if len(x) else 0
    last = np.zeros(len(x), bool)
    last[np.cumsum(tokens) - 1] = True
    lefts, rights, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], np.zeros(0, np.int64)
    for _ in range(rounds):
        if len(x) < 2:
            break
        pairs = x[:-1] << np.uint64(32) | x[1:]
        slots = ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        slots[last[:-1]] = 1 << HASH_BITS
        counts = np.bincount(slots, minlength=(1 << HASH_BITS) + 1)[:-1]
        bar = max(least, int(np.partition(counts, -per_round)[-per_round]))
        often = np.append(counts >= bar, False)
        at = np.flatnonzero(often[slots])
        coded = pa.array(pairs[at]).dictionary_encode()
        found, back = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        times = np.bincount(back, minlength=len(found))
        chosen = np.flatnonzero(times >= least)
        chosen = chosen[np.lexsort((found[chosen], -times[chosen]))][:per_round]
        if not len(chosen):
            break
        rule = np.full(len(found), -1, np.int64)
        rule[chosen] = np.arange(len(chosen))
        hit = rule[back] >= 0
        at, own = at[hit], rule[back][hit]
        # of neighbouring matches, every second one from the left
        fresh = np.concatenate(([True], np.diff(at) > 1))
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0
        at, own = at[take], own[take]
        base = first + len(lengths)
        new = found[chosen]
        left, right = new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)
        sizes = [np.where(s < first, 1, lengths[np.maximum(s.astype(np.int64) - first, 0)] if len(lengths) else 1) for s in (left, right)]
        lefts.append(left)
        rights.append(right)
        lengths = np.concatenate((lengths, sizes[0] + sizes[1]))
        x[at] = (base + own).astype(np.uint64)
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        last[at] = last[at + 1]
        saved_now = len(at) / len(x)
        x, last = x[keep], last[keep]
        if saved_now < 0.01:
            break
    ends = np.flatnonzero(last) + 1
    symbols = np.diff(np.concatenate(([0], ends)))
    return Block(first, np.concatenate(lefts), np.concatenate(rights), lengths, x, symbols, np.asarray(tokens))


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int = 1, words: bool = True, size: int = 1 << 20) -> DataFrame:
    """Write every document's ids, each with ``end_id`` behind, in ascending ``doc_id`` order; return the table of files.

    Its rows are blocks: ``part`` and ``block`` give the order, ``before`` the ids of earlier blocks of the part,
    ``doc_ids`` the documents and ``data`` the block. A block closes at ``size`` ids; a longer document is a block of
    its own. Null ids come first; documents of one id follow each other in the order of their texts' hashes. A salt
    lets rows that share an id fall into several parts. A null text is empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, words, 600_000).encode, task_index()
        end = np.array([end_id], "<u4").tobytes()
        keys: list = []
        held: list[bytes] = []
        gathered = before = number = 0

        def close() -> pa.RecordBatch:
            tokens = np.array([len(x) // 4 for x in held], np.int64)
            data = compress(np.frombuffer(b"".join(held), "<u4"), tokens).to_bytes()
            columns = [[part], [number], [before], [gathered], [list(keys)], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FILES.types, strict=True)], schema=FILES)

        for batch in batches:
            texts, ids = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for a, b in runs(texts, 1 << 21):
                for key, x in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    if held and gathered + len(x) // 4 >= size:
                        yield close()
                        before, number, gathered = before + gathered, number + 1, 0
                        keys.clear()
                        held.clear()
                    keys.append(key)
                    held.append(x + end)
                    gathered += len(x) // 4 + 1
        if held:
            yield close()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("_nth"))
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_salt", F.pmod("_nth", F.lit(1024)))
    order = ["doc_id", "_hash", "_salt"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return saved(rows.mapInArrow(write, "part int, block int, before long, tokens long, doc_ids array<long>, data binary"), "token-blocks")


FILES = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("tokens", pa.int64())]
    + [("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())]
)


def read_documents(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ``start`` counts the ids of all documents before."""
    spark = files.sparkSession
    sums = files.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").collect()  # a row for each writing task
    base = dict(zip([r.part for r in sums], np.cumsum([0, *(r.tokens for r in sums)]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast(base)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, keys, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block.from_bytes(data)
                start = shared.value[part] + before
                tokens = block.tokens.astype(np.int64)
                starts = start + np.cumsum(tokens) - tokens
                edges = np.concatenate(([0], np.cumsum(block.symbols.astype(np.int64))))
                expanded, places, sizes = block.all_expanded()
                # some documents at a time
                cut = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(tokens) >> 17)) + 1, [len(tokens)]))
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    symbols = block.sequence[edges[a] : edges[b]]
                    raw = expanded[spans(places[symbols], sizes[symbols])].tobytes()
                    ends = 4 * np.cumsum(tokens[a:b])
                    ids = [raw[i:j] for i, j in zip((ends - 4 * tokens[a:b]).tolist(), ends.tolist(), strict=True)]
                    columns = [pa.array(keys[a:b], pa.int64()), pa.array(starts[a:b]), pa.array(tokens[a:b]), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    small_batches(spark)
    return files.select("part", "before", "doc_ids", "data").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
