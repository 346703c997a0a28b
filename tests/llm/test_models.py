"""Quality, toxicity and language: held-out accuracy, folds, and rows with nothing to judge."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

import __spark_entry__ as driver
from tallyfold.llm import language, quality, toxicity
from tallyfold.plans.registry import table

FOLDER = "/root/testdata/sf0.01"


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@pytest.mark.parametrize(("name", "label", "least"), [("op1_bradley_terry", "quality", 0.95), ("op6_class_kneser_ney", "toxic", 0.85)])
def test_labels_of_held_out_rows(spark, name, label, least):
    rows = {r.doc_id: r for r in driver.queries()[name](spark, FOLDER).collect()}
    assert len(rows) == table(spark, FOLDER, "documents").count()
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    bar = quality.BAR if label == "quality" else 0.5
    assert all(r.predicted == int(r.score >= bar) for r in rows.values())
    held = [(rows[r.doc_id].predicted, r[label]) for r in table(spark, FOLDER, "labels").collect() if rows[r.doc_id].held_out]
    assert sum(p == y for p, y in held) >= least * len(held)


def test_languages_of_held_out_rows(spark):
    docs = {r.doc_id: r for r in table(spark, FOLDER, "documents").collect()}
    rows = driver.queries()["op8_language_bitmasks"](spark, FOLDER).collect()
    assert len(rows) == len(docs) and all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.99 * len(held)


@pytest.fixture
def mixed(written):
    rnd = random.Random(1)
    good, bad = "the quiet river runs below old trees and stones".split(), "vexit zulmo graak".split()
    rows = []
    for i in range(400):
        words = [rnd.choice(good) for _ in range(40)]
        if i % 4 == 0:
            words[5:30:5] = [rnd.choice(bad) + rnd.choice(["", "en", "os"]) for _ in range(5)]
        rows.append((i, " ".join(words), "xx" if i % 2 else "yy"))
    labels = [(i, int(i % 4 > 0), int(i % 4 == 0)) for i in range(400)] + [(0, None, None), (None, 1, 1)]
    rows += [(None, "river vexit", None), (None, None, "xx"), (900, "", "xx"), (901, "12 !", None), (1, rows[1][1], "xx"), (902, "graaken " * 30_000, "xx")]
    docs = written(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS label", "2 AS score", "3 AS words", "4 AS held_out")
    return docs, written(labels, "doc_id long, quality int, toxic int")


def test_toxic_stems(mixed):
    docs, labels = mixed
    model = toxicity.train(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == 406
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert next(r for r in rows if r.doc_id == 902).predicted == 1
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.score < 0.5)


def test_quality_of_odd_rows(mixed):
    docs, labels = mixed
    rows = quality.score_quality(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 406 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(mixed):
    docs, _ = mixed
    model = language.train(docs)
    rows = language.predict_language(docs, model).collect()
    assert len(rows) == 406
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (900, 901)} == {900: "und", 901: "und"}
    assert {r.lang_pred for r in rows} == {"xx", "yy", "und"}
    kept = language.with_language(docs, model, least=0.0)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)


def test_many_languages_need_several_words_of_mask(documents, written):
    rnd = random.Random(3)
    names = [f"l{i:03}" for i in range(70)]
    syllables = {n: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(20)] for n in names}
    rows = [(i, " ".join(rnd.choice(syllables[names[i % 70]]) for _ in range(60)), names[i % 70]) for i in range(700)]
    docs = written(rows, "doc_id long, text string, lang string")
    found = language.predict_language(docs, language.train(docs)).collect()
    assert sum(r.lang_pred == names[r.doc_id % 70] for r in found) >= 0.97 * 700


def test_nothing_to_learn_from(written):
    docs = written([(1, "a b", None)], "doc_id long, text string, lang string")
    labels = written([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.train(docs, labels)).first().score == 0
    assert quality.score_quality(docs, quality.train(docs, labels)).first().score == quality.BAR
    assert language.predict_language(docs, language.train(docs)).first().lang_pred == "und"
    empty = docs.where("false")
    assert toxicity.score_toxicity(empty, None).collect() == quality.score_quality(empty, None).collect() == []
    assert language.predict_language(empty, language.train(empty)).collect() == []


def test_sequences_of_many_letters_are_told_apart(written):
    rnd = random.Random(7)
    rows = [("".join(chr(0x4E00 + rnd.randrange(400)) for _ in range(2000)), i % 2) for i in range(60)]
    model = toxicity.KneserNey.fit(toxicity.count_sequences(written(rows, "text string, label int")).toArrow())
    fours = [Counter(), Counter()]
    for text, label in rows:
        padded = f"   {text} "
        fours[label].update(padded[i - 3 : i + 1] for i in range(3, len(padded)))
    kinds, after = Counter(f[1:] for f in fours[0].keys() | fours[1].keys()), Counter()
    for three, n in kinds.items():
        after[three[:2]] += n
    follow = [Counter(), Counter()]
    different = [Counter(), Counter()]
    for c in (0, 1):
        for four, n in fours[c].items():
            follow[c][four[:3]] += n
            different[c][four[:3]] += 1
    pairs = Counter(three[:2] for three in kinds)

    def plain(text):
        padded, total = f"   {text} ", 0.0
        for i in range(3, len(padded)):
            four = padded[i - 3 : i + 1]
            short = four[1:3]
            back = max(kinds[four[1:]] - 0.5, 0) / max(after[short], 1) + (0.5 * pairs[short] / after[short] if after[short] else 1) / 40
            p = []
            for c in (0, 1):
                n = follow[c][four[:3]]
                p.append(max(fours[c][four] - 1, 0) / max(n, 1) + (max(different[c][four[:3]] / n, 1e-6) if n else 1) * back)
            total += math.log(p[1] / p[0])
        return total / math.sqrt(len(padded) - 3)

    texts = [text[k : k + 500] for (text, _), k in zip(rows, range(0, 1500, 25))]
    assert model.compare(texts) == pytest.approx([plain(t) for t in texts], rel=1e-3, abs=1e-3)
