"""Locally consistent parsing: shared phrases whatever the offset, and the order of documents."""

from __future__ import annotations

import hashlib
import random

import numpy as np

import __spark_entry__ as driver
from tallyfold.llm import parsing
from tallyfold.plans.registry import table

LETTERS = "abcdefgh ijklm"


def plain(pairs):
    """(doc_id, n_chars, edited text, fingerprints, likenesses), document by document."""
    pairs, out = sorted(pairs), []
    for i, (key, text) in enumerate(pairs):
        text, following = text or "", pairs[(i + 1) % len(pairs)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = (parsing.fingerprints([t]) for t in (text, changed, following))
        near = [float(parsing.likeness(a, x)[0]) for x in (b, c)]
        out.append((key, len(text), changed, a.tobytes().hex(), b.tobytes().hex(), *near))
    return out


def test_labels_differ_and_phrases_are_short():
    rnd = random.Random(2)
    symbols = np.array([rnd.getrandbits(64) for _ in range(5000)], np.uint64)
    starts = np.zeros(5000, bool)
    starts[[0, 1200]] = True
    labels = parsing._labels(symbols, starts)
    assert labels.max() < 6 and (labels[1:] != labels[:-1])[~starts[1:]].all()
    names, _ = parsing.parse(symbols, starts)
    assert 5000 / 12 < len(names) < 5000 / 2


def test_a_passage_has_the_same_phrases_at_any_offset():
    rnd = random.Random(3)
    passage = "".join(rnd.choice(LETTERS) for _ in range(6000))
    for offset in (1, 2, 3, 57):
        other = "".join(rnd.choice(LETTERS) for _ in range(offset)) + passage
        assert parsing.likeness(*map(parsing.fingerprints, ([passage], [other])))[0] > 0.95
    other = "".join(rnd.choice(LETTERS) for _ in range(6000))
    assert parsing.likeness(*map(parsing.fingerprints, ([passage], [other])))[0] < 0.05


def test_texts_do_not_depend_on_their_neighbours():
    texts = ["", "a", "aa", "aaaa" * 500, "some words here", "", "é" * 3, "x" * 40 + "y", "some words here"]
    together = parsing.fingerprints(texts)
    assert all((together[i] == parsing.fingerprints([t])[0]).all() for i, t in enumerate(texts))
    assert all(parsing.likeness(together[i : i + 1], together[i : i + 1])[0] == 1 for i in range(len(texts)))


def test_documents(documents):
    rnd = random.Random(6)
    pairs = [(rnd.randint(-50, 10**9), "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 400)))) for _ in range(120)]
    pairs += [(-100, None), (10**10, ""), (5, "long " * 60_000), (6, "\U0001f600́" * 9)]
    found = sorted(tuple(r) for r in parsing.fingerprint_documents(documents(pairs)).collect())
    assert found == plain(pairs)


def test_nulls_repeats_and_clashing_columns(written):
    rows = [(None, "last of all"), (3, "same"), (3, "same"), (1, None)]
    docs = written(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS guest", "3 AS fingerprint")
    found = sorted((r.doc_id or 99, r.edited, r.near_next) for r in parsing.fingerprint_documents(docs).collect())
    assert found == [(1, "", 0.0), (3, "sala", 0.0), (3, "sasa", 1.0), (99, "last o", 0.0)]


def test_one_document_and_none(documents):
    (row,) = parsing.fingerprint_documents(documents([(4, "abcd")])).collect()
    assert (row.edited, row.near_next) == ("abab", 1.0)
    assert parsing.fingerprint_documents(documents([])).collect() == []


def test_query_on_the_small_tables(spark):
    docs = [tuple(r) for r in table(spark, driver.SMOKE, "documents").select("doc_id", "text").collect()]
    wanted = [(i, n, hashlib.sha256(e.encode()).hexdigest(), *rest) for i, n, e, *rest in plain(docs)]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, driver.queries()["op9_consistent_parsing"](spark, driver.SMOKE).select(*names).collect())) == wanted
