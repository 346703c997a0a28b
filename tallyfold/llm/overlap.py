"""Near-duplicates by the overlap of word shingles: candidates from SimHash's vantage-point forest, then an exact Jaccard check.

Every different set of shingles has a SimHash fingerprint of its hashes. The forest of ``simhash.py`` links the fingerprints within a
few bits; every link is checked on the whole sets, and what passes makes components. At a similarity of 0.8 two fingerprints
differ in some ten bits of 64, which no index by distance tells from a crowd. So a second search follows for what the
forest leaves apart. Of two texts with Jaccard similarity ``s``, a band of five minima is equal with probability ``s ** 5``, one of 20
bands with ``1 - (1 - s ** 5) ** 20``: 0.9996 at 0.8. Only buckets that hold several components are looked at: all pairs of a small one
are checked, but for those of one component. The texts of a large one (with a shared template,
say) are searched without chance by prefix filtering: with its shingles in order of how many of
these texts hold them, rarest first, a text shares one of its first ``n - ceil(0.8 n) + 1`` with any text of similarity
0.8. So only pairs with a common rare shingle are checked, and only if they are not connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import ROW, checkpointed, keyed, saved, small_batches, texts_of
from tallyfold.llm.graph import components
from tallyfold.llm.simhash import close_links, simhash_of
from tallyfold.operators.skew import splittable_join

BANDS, DEEP = 20, 5
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * DEEP, np.uint64) << np.uint64(1) | np.uint64(1)
NONE = np.uint64((1 << 64) - 1)


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the different runs of ``width`` words; words as for SimHash, a shorter text is one run."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    k = min(width, len(words))
    hashed = {xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)} if words else ()
    return np.sort(np.fromiter(hashed, np.uint64, len(hashed)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One code for the minima of each band."""
    least = np.full(len(FACTORS), NONE)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * FACTORS[None, :]).min(0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), 42) for b in least.reshape(BANDS, DEEP)], np.uint64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, code, fp, bands`` and the row key; equal ``code`` means equal shingles. A null text is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, width) for t in texts_of(batch.column(2))]
            codes = pa.array([xxhash.xxh128_digest(h.tobytes()) for h in found], pa.binary())
            fps = pa.array(np.array([simhash_of(h) for h in found], np.uint64).view(np.int64))
            flat = np.concatenate([bands(h) for h in found]).view(np.int64) if found else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, fps, lists], names=[ROW, "doc_id", "code", "fp", "bands"])

    small_batches(docs.sparkSession)
    rows = keyed(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text"))
    return rows.mapInArrow(work, f"{ROW} long, doc_id long, code binary, fp long, bands array<long>")


def forest_pairs(codes: DataFrame, within: int, blocks: int) -> DataFrame:
    """Pairs ``a < b`` of codes to check first: those of one fingerprint with its least code, and the forest's links between these."""
    least = codes.groupBy("fp").agg(F.min("code").alias("least"), F.count("*").alias("n"))
    least = checkpointed(least)
    same = splittable_join(codes.select("fp", F.col("code").alias("x")), least.where("n > 1"), "fp", "inner")
    links = close_links(least.select("fp"), within, blocks)
    for end, name in (("a", "x"), ("b", "y")):
        links = splittable_join(links, least.select(F.col("fp").alias(end), F.col("least").alias(name)), end, "inner")
    return _ordered(same.select("x", F.col("least").alias("y")).union(links.select("x", "y")).where("x <> y"))


def buckets(codes: DataFrame) -> DataFrame:
    """``code, band, value`` for every band that two codes or more share."""
    placed = codes.select("code", F.posexplode("bands").alias("band", "value"))
    shared = placed.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return splittable_join(placed, shared, ["band", "value"], "left_semi")


def apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """``code, root`` and the bucket of the codes in buckets that the links so far leave in several components, with the buckets' size."""
    rooted = met.join(roots.select(F.col("node").alias("code"), "root"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    kinds = rooted.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
    split = kinds.where("low <> high").select("band", "value", "size")
    return splittable_join(rooted, split, ["band", "value"], "inner")


def small_pairs(split: DataFrame) -> DataFrame:
    """All pairs of different roots within each of the buckets, which are small."""
    cells = split.groupBy("band", "value").agg(F.array_sort(F.collect_list(F.struct("code", "root"))).alias("all"))
    pairs = cells.select("all", F.posexplode("all").alias("i", "one"))
    pairs = pairs.select("one", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("other"))
    return _ordered(pairs.where("one.root <> other.root").select(F.col("one.code").alias("x"), F.col("other.code").alias("y")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _words_of(sets: DataFrame, texts: DataFrame) -> DataFrame:
    return sets.join(texts, "code").select("code", "root", F.size("words").alias("n"), F.explode("words").alias("word"))


def _needed(least: float) -> Column:
    """How many of its ``n`` shingles a text has in common with any text of similarity ``least``."""
    # A little less than the product, which may come out above the whole number that it is.
    return F.ceil(F.col("n") * least - 1e-9)


def with_partners(crowd: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``crowd`` without the texts that no other can be similar to: too many of their shingles are in no other text of ``crowd``.

    The shingles of one text are counted by their own groups, so that those of texts that go meet in no join.
    """
    words = _words_of(sets, crowd).groupBy("word").agg(F.count("*").alias("texts"), F.min(F.struct("code", "n")).alias("text"))
    alone = words.where("texts = 1").groupBy("text.code", "text.n").agg(F.count("*").alias("own"))
    gone = alone.where(F.col("n") - F.col("own") < _needed(least)).select("code")
    return checkpointed(crowd.join(gone, "code", "left_anti"))


def rare_pairs(crowd: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs of ``crowd``, of different roots, that share a shingle of their prefixes: all with ``least`` are among them.

    Their number is that of texts which share a shingle that is rare among them, by the lengths that ``least`` allows.
    """
    words = _words_of(sets, with_partners(crowd, sets, least))
    # Shingles of one component pair nothing: their number is what the others leave of a set.
    held = words.groupBy("word").agg(F.count("*").alias("texts"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    order = F.array_sort(F.collect_list(F.struct("texts", "word"))).alias("words")
    length = (F.size("words") - _needed(least) + 1).cast("int")
    sorted_words = splittable_join(words, held.select("word", "texts"), "word", "inner").groupBy("code", "root", "n").agg(order).where(length > 0)
    first = sorted_words.select("code", "root", "n", F.size("words").alias("held"), F.posexplode(F.slice("words", F.lit(1), length)).alias("i", "w"))
    # How many may be shared if this is the first that is.
    first = first.select("code", "root", "n", F.col("w.word").alias("word"), (F.col("held") - F.col("i")).alias("left"))
    mixed = first.groupBy("word").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    first = checkpointed(splittable_join(first, mixed, "word", "left_semi"))
    other = first.select(F.col("code").alias("y"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("left").alias("rest"), "word")
    # Two sets of n and m have (n + m) * least / (1 + least) in common at a similarity of ``least``.
    near = F.least("left", "rest") >= (F.col("n") + F.col("m")) * (least / (1 + least)) - 1e-9
    return _ordered(first.withColumnRenamed("code", "x").join(other, "word").where(near & (F.col("root") < F.col("other"))))


def shingle_sets(docs: DataFrame, ends: DataFrame, codes: DataFrame, width: int) -> DataFrame:
    """``code, words``: the whole sets of the codes in ``ends``."""
    wanted = codes.join(ends, "code", "left_semi").select("code", F.col(f"low.{ROW}").alias(ROW))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(texts_of(batch.column(1))):
                found = pa.array([shingles(text, width).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), found], names=["code", "words"])

    texts = keyed(docs, text=F.col("text")).join(wanted, ROW).select("code", "text")
    return saved(texts.mapInArrow(work, "code binary, words array<long>"), "shingles")


def overlapping(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` whose shingles have a Jaccard similarity of ``least`` or more."""
    both = pairs
    for end, words in (("a", "x"), ("b", "y")):
        both = splittable_join(both, sets.select(F.col("code").alias(end), F.col("words").alias(words)), end, "inner")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared / (F.size("x") + F.size("y") - shared) >= least).select("a", "b")


def linked(docs: DataFrame, codes: DataFrame, width: int, least: float, within: int = 7, blocks: int = 4, small: int = 16) -> DataFrame:
    """``node, root`` of the codes that pairs of ``least`` or more connect with another."""
    pairs = checkpointed(forest_pairs(codes, within, blocks))
    met = checkpointed(buckets(codes))
    ends = pairs.select(F.col("a").alias("code")).union(pairs.select("b")).union(met.select("code")).distinct()
    sets = shingle_sets(docs, ends, codes, width)
    roots = components(overlapping(pairs, sets, least))
    rest = checkpointed(apart(met, roots))
    crowd = checkpointed(rest.where(F.col("size") > small).select("code", "root").distinct())
    more = small_pairs(rest.where(F.col("size") <= small))
    if not crowd.isEmpty():
        more = more.union(rare_pairs(crowd, sets, least)).distinct()
    links = checkpointed(overlapping(more, sets, least))
    if links.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def one_of_each_overlap(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row, that with the smallest id, of each group that pairs of ``least`` or more connect; columns as they were.

    Texts without words are alike. Null ids come after all others; repeated rows are rows of their own. Of pairs at
    just ``least`` four in ten thousand share no band and are missed if the forest does not link them, the fewer the more alike; a pair
    that does share one is found, however many texts share it. Makes Arrow batches of the session small unless it has set their size.
    """
    rows = saved(signatures(docs, width), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    codes = checkpointed(rows.groupBy("code").agg(F.min(order).alias("low"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    roots = linked(docs, codes, width, least)
    grouped = codes.select("code", "low").join(roots.withColumnRenamed("node", "code"), "code", "left")
    keepers = grouped.groupBy(F.coalesce("root", "code")).agg(F.min("low").alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    names = docs.columns
    return keyed(docs, doc=F.struct(*(F.col(f"`{c}`") for c in names))).join(keepers, ROW, "left_semi").select("doc.*")
