"""From raw documents to packed token sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import language, toxicity
from tallyfold.llm.common import saved
from tallyfold.llm.lines import without_repeated_runs
from tallyfold.llm.overlap import one_of_each_overlap
from tallyfold.llm.packing import pack
from tallyfold.llm.queries import BYTES, vocabulary
from tallyfold.plans.registry import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models score below one half; learned from ``labels`` of these documents."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that ``lang`` of these documents teaches; texts without a letter go."""
    return language.with_language(docs, language.train(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines in repeated runs of 50 words; ``n_chars`` follows the text."""
    kept = without_repeated_runs(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates (five-word Jaccard 0.8)."""
    return one_of_each_overlap(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences of 2048; ids as their checksum.

    The store of pieces is small, as the workers hold the models of the stages before as well.
    """
    return pack(docs, vocabulary(BYTES), store=150_000).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_copies),
    ("packing", pack_sequences),
]

#: SQL can express neither the models nor the tokenizer; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
