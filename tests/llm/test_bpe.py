"""Tree concatenation gives the library's ids and texts, for cuts anywhere."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as driver
from tallyfold.llm import bpe, queries
from tallyfold.plans.registry import table

PATH = queries.vocabulary(queries.BYTES)
PARTS = ["a", "the", " the", "ing", "'s", "'", "''", "re", "'re", "l", " ", "  ", "\n", "1", "12", "é", "中文", "!", "…", "́", "​", "\x1c", "\U0001f600", "S", "ß", " \t"]


def library(text):
    return bpe.encoder(PATH).tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_any_cut_joins_to_the_library_result(seed):
    rnd = random.Random(seed)
    alphabet = rnd.sample(PARTS, rnd.randint(1, 8))
    tree = bpe.Tree(PATH, leaf=rnd.choice([1, 2, 5, 50]))
    for _ in range(12):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 120)))
        cuts = sorted({0, len(text), *(rnd.randrange(len(text) + 1) for _ in range(rnd.randint(0, 5)))})
        leaves = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        assert tree.fold([tree.leaf_splits(x) for x in leaves], text) == library(text), (text, leaves)


@pytest.mark.parametrize("unit", ["a", "ab", "thequick", "=", "-=", " ", "1", "é", "中", "́", "abcdefghijklmnopqrstuvwxyz"])
def test_long_unsplit_pieces(unit):
    text = unit * (5000 // len(unit))
    assert bpe.Tree(PATH, leaf=64).unsplit(text) == library(text)


def test_documents(documents):
    rnd = random.Random(9)
    pairs = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 900)))) for i in range(60)]
    pairs += [(100, None), (101, ""), (102, "x" * 9000), (103, " " * 3000), (104, "a<|endoftext|>b" * 90), (105, "<|endoftext|>" * 50)]
    pairs += [(106, ("It's they're " + "q" * 700) * 9)]
    rows = bpe.decode(bpe.encode(documents(pairs), PATH, long=200), PATH).collect()
    assert sorted((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.text) for r in rows) == sorted((i, library(t or ""), t or "") for i, t in pairs)


def test_nulls_repeats_and_clashing_columns(written):
    rows = [(None, "a" * 300), (3, "b c"), (3, "b c"), (None, None)]
    docs = written(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS part", "3 AS number")
    found = bpe.encode(docs, PATH, long=100).collect()
    assert sorted((r.doc_id or -1, len(r.ids)) for r in found) == sorted((i or -1, 4 * len(library(t or ""))) for i, t in rows)


def test_empty_table(documents):
    assert bpe.decode(bpe.encode(documents([]), PATH), PATH).collect() == []


def test_query_on_the_small_tables(spark):
    tokenizer = bpe.encoder(PATH).tokenizer
    wanted = []
    for i, t in table(spark, driver.SMOKE, "documents").select("doc_id", "text").collect():
        ids = library(t or "")
        raw, text = np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)
        wanted.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    rows = driver.queries()["op7_tree_concatenation"](spark, driver.SMOKE)
    assert sorted(map(tuple, rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(wanted)


def test_leaves_are_split_a_few_at_a_time():
    text = "some words of a leaf " * 700
    rows = [{bpe.ROW: i, "doc_id": i, "number": i, "part": 0, "leaf": i, "text": text} for i in range(40)]
    batches = list(bpe.split_leaves(bpe.Tree(PATH), pa.RecordBatch.from_pylist(rows, schema=bpe.CUTS)))
    assert len(batches) > 3 and [i for b in batches for i in b.column("number").to_pylist()] == list(range(40))
    assert all(sum(map(len, b.column("text").to_pylist())) <= 1 << 17 for b in batches)
