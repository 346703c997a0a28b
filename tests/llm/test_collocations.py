"""Phrases by stripes against counts of every run of words."""

from __future__ import annotations

import random
import re
import weakref
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import __spark_entry__ as driver
from oracle import duck, rows_of, rows_of_sql
from tallyfold.llm import collocations

TEXTS = "text string, lang string"


def plain(docs, least=10, share=50, most=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        wide = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in wide.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in wide.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("unit", [3, 1 << 18])
@pytest.mark.parametrize("held", [7, 1 << 18])
def test_counts_of_every_run(written, unit, held):
    rnd = random.Random(unit + held)
    words = ["a", "b", "c", "The", "the", "über", "Ü", "日本", "x'y", " ", "z z"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "?!", " - "]
    docs = [("".join(rnd.choice(words) + rnd.choice(marks[: rnd.randint(1, len(marks))]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "de", None, "und", ""])) for _ in range(80)]
    docs += [(None, "en"), ("", None), ("...", "de")] + [("the a b", "en")] * 30
    table = written(docs, TEXTS).selectExpr("*", "1 AS first", "2 AS n", "3 AS `a.b`", "4 AS phrase", "5 AS segment")
    for least, share in ((2, 50), (10, 50), (3, 101)):
        found = collocations.best_phrases(table, least=least, share=share, unit=unit, held=held)
        assert sorted(map(tuple, found.collect())) == plain(docs, least, share)


def test_limit_and_ties(written):
    docs = [(f"{x} {y}. {x} {y}", "en") for x in "abcdefgh" for y in "stuv"]
    for most in (1, 5, 40):
        assert sorted(map(tuple, collocations.best_phrases(written(docs, TEXTS), most, least=2).collect())) == plain(docs, 2, most=most)


def test_long_text_and_one_very_common_pair(written):
    docs = [("new york " * 100_000, "en"), ("new york. " * 1000, "en")]
    assert sorted(map(tuple, collocations.best_phrases(written(docs, TEXTS), unit=1000).collect())) == plain(docs)


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3 * 10**12, 10**13, 10**12 * 9)], "a long, l long, r long")
    assert rows.select(collocations._score("l", "r")).first()[0] == 10**6 * 9 * 10**24 // (9 * 10**25)


def test_empty_table(written):
    assert collocations.best_phrases(written([], TEXTS)).collect() == []


def test_slots_hold_all_occurrences(written):
    docs = written([("a b a c " * 50, "en"), (None, None)], TEXTS)
    sums = collocations.occurrences(docs.selectExpr("coalesce(lang, 'und') AS lang", "text"), 1 << 18)
    words = collocations.Words("en")
    words.add(["a b a c"])
    assert len(sums) == 1 << collocations.SLOT_BITS and sums.sum() == 200
    assert [sums[s] for s in collocations.slots(words.hashes())[2:]] == [100, 50, 50]


def test_a_full_bitmap_changes_nothing(written, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 16)
    monkeypatch.setattr(collocations, "_holds", lambda bits, hashes: hashes >= 0)
    docs = [("a b c d a b c. d a", "en")] * 7 + [("b c d", "fr")] * 11
    assert sorted(map(tuple, collocations.best_phrases(written(docs, TEXTS)).collect())) == plain(docs)


def test_query_against_sql(spark):
    found = rows_of(driver.queries()["op12_phrase_stripes"](spark, driver.SMOKE))
    assert found == rows_of_sql(duck(driver.SMOKE), driver.oracle_sql()["op12_phrase_stripes"]) and sum(found[1].values()) > 100


def test_words_that_were_given_out_are_let_go():
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array(["a b c", "d e"])], names=["lang", "text"])
    given, alive = [], []
    for _, words in collocations.by_language(iter([batch] * 4), 5):
        alive.append(sum(w() is not None for w in given))
        given.append(weakref.ref(words))
        del words
    assert len(given) == 8 and alive == [0] * 8


def test_merging_tasks_get_a_bounded_share(written, spark):
    docs = [(f"a{i % 50} b{i % 70} c{i % 30}. " * 5, "en") for i in range(200)]
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.createDataFrame([("en", f"w{i}", 0, "x y", [6, 4]) for i in range(500)], collocations.STRIPE)
    found = collocations.merged(rows, 5, tasks)
    assert f", {tasks})" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.total, len(r.elements)) for r in found.collect()} == {(10, 1)}
    assert sorted(map(tuple, collocations.best_phrases(written(docs, TEXTS), each=100).collect())) == plain(docs)
