"""Phrases of two and three words by stripes: every prefix keys a counter of the words that follow it.

Tasks count stripes of the texts they read and send one row for each: the prefix, the words that follow it, their counts.
Equal stripes are merged element by element. A merged stripe gives the phrases that extend its prefix, its total
the count of the prefix itself (what follows may be the end of the piece), and its largest element tells whether a
longer phrase takes the prefix over.

Three rounds over the texts. The first adds up how often the words of each of 2**20 hash slots occur. The second makes the
stripes of single words; words of slots with too few occurrences are too rare for any phrase, so their own stripes are left
out, and in others they count for the total only. The third makes the stripes of pairs, of frequent pairs followed by frequent
pairs only: a bitmap over a hash of the frequent pairs, of at most 32 MB, lets each of them pass (and a few others,
which the counts drop). Stripes of common words are cut, by a hash of what follows, into segments of a bounded number of
occurrences each; their slot's count says how many. An element lies in one segment; totals add up over segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import saved, small_batches
from tallyfold.operators.skew import splittable_join

SLOT_BITS = 20
END, NOTHING = 0, 1
BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
STRIPE = "lang string, prefix string, segment int, words string, counts array<int>"
UNKNOWN = "und"
MOST_BITS = 28


class Words:
    """Token numbers of the texts of one language: 0 ends a piece, other numbers are words in order of appearance."""

    def __init__(self, lang: str) -> None:
        self.ids: dict[bytes, int] = {b"\n": END, b"": NOTHING}
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 5) & 0x7FFFFFFF
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[str]) -> None:
        """A to Z in lower case; pieces end at ``.,;:!?``, at line breaks and with the text."""
        whole = b"\n".join([b"", *(t.encode("utf-8") for t in texts), b""]).lower().translate(BREAKS)
        # Arrow cuts it and finds the different words; only these become objects.
        cut = pc.split_pattern(pa.array([whole.replace(b"\n", b" \n ")], pa.large_binary()), " ").flatten().dictionary_encode()
        different = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.ids.get, different, repeat(-1)), np.int32, len(different))
        fresh = np.flatnonzero(numbers < 0)
        numbers[fresh] = np.arange(len(self.ids), len(self.ids) + len(fresh))
        self.ids.update((different[i], int(numbers[i])) for i in fresh.tolist())
        found = numbers[cut.indices.to_numpy()]
        found = found[found != NOTHING]
        self.held.append(found)
        self.size += len(found)

    def tokens(self) -> np.ndarray:
        return np.concatenate([*self.held, np.zeros(2, np.int32)])

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in self.ids), np.uint64, len(self.ids))

    def text(self) -> pa.Array:
        return pa.array(list(self.ids), pa.binary()).cast(pa.string())


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) ^ (second >> np.uint64(29)) ^ second * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)


def by_language(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[str, Words]]:
    """The words of the texts that came in, whenever there are ``held`` of them, and at the end.

    Nothing here refers to what was given out: the caller is to let go of it too before it takes the next.
    """
    found: dict[str, Words] = {}
    size = 0
    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            words = found.setdefault(lang, Words(lang))
            size -= words.size
            words.add(own)
            size += words.size
        texts = words = own = None
        if size >= held:
            while found:
                yield found.popitem()
            size = 0
    while found:
        yield found.popitem()


def occurrences(docs: DataFrame, held: int) -> np.ndarray:
    """How often the words of each slot occur: 2**20 numbers, whatever the size of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << SLOT_BITS, np.int64)
        for _, words in by_language(batches, held):
            n = np.bincount(words.tokens(), minlength=2)
            n[:2] = 0
            np.add.at(sums, slots(words.hashes()), n)
            del words, n
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["slot", "n"])

    rows = docs.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(1 << SLOT_BITS, np.int64)
    sums[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return sums


def _rows(lang: str, prefix: pa.Array, cut: np.ndarray, follower: np.ndarray, hashes: np.ndarray, text: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripes from elements in order of prefix: equal prefixes have equal numbers in ``cut[:, 0]``, ``cut[:, 1]`` is their number of segments."""
    segment = np.where(cut[:, 1] > 1, hashes[follower] % np.maximum(cut[:, 1], 1).astype(np.uint64), 0).astype(np.int32)
    order = np.lexsort((segment, cut[:, 0]))
    own, segment, follower, counts = cut[order, 0], segment[order], follower[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (segment[1:] != segment[:-1])])) if len(own) else np.zeros(0, int)
    step = 20_000
    for i in range(0, len(starts), step):
        at = starts[i : i + step]
        stop = starts[i + step] if i + step < len(starts) else len(own)
        offsets = pa.array(np.concatenate([at, [stop]]).astype(np.int32) - at[0])
        words = pa.ListArray.from_arrays(offsets, text.take(pa.array(follower[at[0] : stop])))
        numbers = pa.ListArray.from_arrays(offsets, pa.array(counts[at[0] : stop].astype(np.int32)))
        columns = [pa.array([lang] * len(at)), prefix.take(pa.array(own[at])), pa.array(segment[at]), pc.binary_join(words, " "), numbers]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STRIPE.split(", ")])


def word_stripes(docs: DataFrame, sums: np.ndarray, least: int, unit: int, held: int) -> DataFrame:
    """What follows single words; the empty word stands for the end and for rare words, the prefix null for all words."""
    shared = docs.sparkSession.sparkContext.broadcast(sums)

    def stripes(lang: str, words: Words) -> Iterator[pa.RecordBatch]:
        tokens, hashes, text = words.tokens(), words.hashes(), _with_end(words.text())
        n = shared.value[slots(hashes)]
        frequent = n >= least
        frequent[:2] = False
        first, second = tokens[:-1], tokens[1:]
        keep = frequent[first]
        keys, counts = np.unique(first[keep].astype(np.int64) << 31 | np.where(frequent[second[keep]], second[keep], END), return_counts=True)
        first, second = keys >> 31, keys & (1 << 31) - 1
        yield from _rows(lang, text, np.stack([first, -(-n[first] // unit)], 1), second, hashes, text, counts)
        everything = pa.array([[int((tokens != END).sum())]], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([""]), everything],
            names=[c.split()[0] for c in STRIPE.split(", ")],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in by_language(batches, held):
            yield from stripes(lang, words)
            del words

    return docs.mapInArrow(gather, STRIPE)


def _with_end(text: pa.Array) -> pa.Array:
    """The end's line break as an empty word."""
    return pa.concat_arrays([pa.array(["", ""]), text.slice(2)])


def pair_stripes(docs: DataFrame, sums: np.ndarray, bits: np.ndarray, unit: int, held: int) -> DataFrame:
    """What follows pairs, of pairs and followers that ``bits`` lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast((sums, bits))

    def stripes(lang: str, words: Words) -> Iterator[pa.RecordBatch]:
        sums, bits = shared.value
        tokens, hashes, text = words.tokens(), words.hashes(), words.text()
        n = sums[slots(hashes)]
        first, second = tokens[:-1], tokens[1:]
        at = np.flatnonzero((first != END) & (second != END))
        passes = np.zeros(len(first), bool)
        for i in range(0, len(at), 1 << 17):
            part = at[i : i + (1 << 17)]
            passes[part] = _holds(bits, pair_hash(hashes[first[part]], hashes[second[part]]))
        at = np.flatnonzero(passes[:-1] & passes[1:])
        pairs, own = np.unique(tokens[at].astype(np.int64) << 31 | tokens[at + 1], return_inverse=True)
        keys, counts = np.unique(own.astype(np.int64) << 31 | tokens[at + 2], return_counts=True)
        own, third = keys >> 31, keys & (1 << 31) - 1
        heads = pairs >> 31
        prefix = pc.binary_join_element_wise(text.take(pa.array(heads)), text.take(pa.array(pairs & (1 << 31) - 1)), " ")
        yield from _rows(lang, prefix, np.stack([own, -(-n[heads[own]] // unit)], 1), third, hashes, text, counts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in by_language(batches, held):
            yield from stripes(lang, words)
            del words

    return docs.mapInArrow(gather, STRIPE)


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - (len(bits) * 8 - 1).bit_length())
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def frequent_bits(pairs: DataFrame) -> np.ndarray:
    """A bitmap over a hash of ``lang, prefix, word``, some 16 bits a pair and 32 MB at most, put together from blocks."""
    size = min(MOST_BITS, max(16, (16 * pairs.count()).bit_length()))
    block = 1 << 13

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << size - 3, np.uint8)
        seeds: dict[str, int] = {}
        for batch in batches:
            langs, firsts, seconds = (c.to_pylist() for c in batch.columns)
            own = [seeds.get(x) or seeds.setdefault(x, Words(x).seed) for x in langs]
            first, second = (np.array([xxhash.xxh64_intdigest(w.encode(), s) for w, s in zip(ws, own, strict=True)], np.uint64) for ws in (firsts, seconds))
            at = pair_hash(first, second) >> np.uint64(64 - size)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield from rows((i // block, bits[i : i + block].tobytes()) for i in range(0, len(bits), block) if bits[i : i + block].any())

    def rows(blocks: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        found = list(blocks)
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, np.uint8)
                own[n] = own[n] | part if n in own else part
        yield from rows((n, b.tobytes()) for n, b in own.items())

    kinds = "block long, bits binary"
    out = np.zeros(1 << size - 3, np.uint8)
    for row in pairs.mapInArrow(mark, kinds).repartition("block").mapInArrow(merge, kinds).collect():
        part = np.frombuffer(row.bits, np.uint8)
        out[row.block * block : row.block * block + len(part)] = part
    return out


def merged(stripes: DataFrame, least: int, tasks: int = 0) -> DataFrame:
    """Equal stripes added up element by element: ``lang, prefix, segment, total`` and the ``elements`` of ``least`` or more.

    All of it happens where the stripes were sent to; an element never meets more than the rows of its own. ``tasks``: deal
    them out to so many, if the session would take fewer.
    """
    key = ("lang", "prefix", "segment")
    few = tasks <= int(stripes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stripes.repartition(*key) if few else stripes.repartition(tasks, *key)
    elements = dealt.select("lang", "prefix", "segment", "counts", F.posexplode(F.split("words", " ")).alias("i", "word"))
    sums = elements.groupBy("lang", "prefix", "segment", "word").agg(F.sum(F.get("counts", F.col("i"))).alias("n"))
    kept = F.collect_list(F.when((F.col("n") >= least) & (F.col("word") != ""), F.struct("word", "n")))
    return sums.groupBy("lang", "prefix", "segment").agg(F.sum("n").alias("total"), kept.alias("elements"))


def phrases(docs: DataFrame, least: int = 10, share: int = 50, unit: int = 1 << 20, held: int = 1 << 21, each: int = 1 << 20) -> DataFrame:
    """Scored phrases of every language: ``lang, phrase, a, l, r, n, score``.

    ``a`` is the phrase's count (``least`` or more), ``l`` and ``r`` those of the two sides of its lowest-scoring cut (of equal
    ones the shortest left side), ``n`` all words of the language, ``score`` is ``1000000 a a / (l r)`` rounded down, in
    decimals wide enough for counts up to 10**14. Pairs that are part of a triple with ``share`` percent of their count
    or more are left out. A null text is empty, a null language ``und``; a table without words gives no rows. Repeated rows count
    each; other columns are not looked at. ``unit`` bounds the occurrences in a segment, ``held`` the words that a
    counting task holds (within one batch of texts), ``each`` those whose stripes a merging task gets on average, at most. Makes Arrow batches of the session small unless it has set their size.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    sums = occurrences(texts, held)
    tasks = -(-int(sums.sum()) // each)
    ones = saved(merged(word_stripes(texts, sums, least, unit, held), least, tasks), "word-stripes")
    twos = ones.where("prefix IS NOT NULL").select("lang", F.col("prefix").alias("first"), F.inline("elements").alias("second", "f"))
    bits = frequent_bits(twos.select("lang", "first", "second"))
    longer = saved(merged(pair_stripes(texts, sums, bits, unit, held), least, tasks).where(F.size("elements") > 0), "pair-stripes")

    sizes = ones.where("prefix IS NULL").select("lang", F.col("total").alias("n"))
    common = ones.where("prefix IS NOT NULL").groupBy("lang", F.col("prefix").alias("word")).agg(F.sum("total").alias("f")).where(F.col("f") >= least)
    parts = [F.substring_index("prefix", " ", i).alias(n) for i, n in ((1, "first"), (-1, "second"))]
    triples = longer.select("lang", *parts, F.inline("elements").alias("third", "a"))

    # The largest extension of a pair to the right is in its own stripe, to the left an element of another's.
    largest = longer.select("lang", *parts, F.array_max(F.transform("elements", lambda e: e["n"])).alias("most"))
    before = triples.select("lang", F.col("second").alias("first"), F.col("third").alias("second"), F.col("a").alias("most"))
    over = largest.unionByName(before).groupBy("lang", "first", "second").agg(F.max("most").alias("most"))
    free = twos.withColumnRenamed("f", "a").join(over, ["lang", "first", "second"], "left")
    free = free.where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")

    def with_count(rows: DataFrame, of: DataFrame, to: str, *own: str) -> DataFrame:
        names = [c for c in of.columns if c not in ("lang", "f")]
        right = of.select("lang", *(F.col(n).alias(p) for n, p in zip(names, own, strict=True)), F.col("f").alias(to))
        return splittable_join(rows, right, ["lang", *own], "inner")

    two = with_count(with_count(free, common, "l", "first"), common, "r", "second")
    two = two.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", "l", "r", _score("l", "r").alias("score"))
    three = with_count(with_count(triples, common, "l1", "first"), twos, "r1", "second", "third")
    three = with_count(with_count(three, twos, "l2", "first", "second"), common, "r2", "third")
    cuts = (F.struct(_score(f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2))
    three = three.withColumn("cut", F.least(*cuts))
    three = three.select("lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    return splittable_join(two.unionByName(three), sizes, "lang", "inner").select("lang", "phrase", "a", "l", "r", "n", "score")


def _score(left: str, right: str) -> Column:
    wide = "cast({} as decimal(14,0))".format
    return F.expr(f"({wide('a')} * {wide('a')} * 1000000BD) div ({wide(left)} * {wide(right)})")


def best_phrases(docs: DataFrame, most: int = 2000, **settings: int) -> DataFrame:
    """The ``most`` phrases of each language in order of score, count and text, with their ``rank``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases(docs, **settings).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
