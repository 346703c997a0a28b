"""The five stages, each on what the one before kept."""

from __future__ import annotations

from collections import defaultdict

import __spark_entry__ as driver
import corpus_pipeline
from tallyfold.llm import language, toxicity
from tallyfold.plans.registry import table
from test_lines import plain
from test_overlap import plain_kept
from test_packing import PATH, packing

FOLDER = driver.SMOKE


def test_each_stage_against_a_plain_version(spark):
    docs = table(spark, FOLDER, "documents")
    columns, (tox, lang, line, near, pack) = docs.columns, [f for _, f in corpus_pipeline.STAGES]
    kept = tox(spark, docs, FOLDER).cache()
    model = toxicity.train(docs, table(spark, FOLDER, "labels"))
    rows = docs.collect()
    assert kept.columns == columns
    assert sorted(r.doc_id for r in kept.collect()) == [r.doc_id for r in rows if not model or model.score([r.text])[0] < 0.5]

    known = lang(spark, kept, FOLDER).cache()
    judge = language.train(kept)
    wanted = [r.doc_id for r in kept.collect() if (f := judge.decide([r.text]))[0][0] != "und" and f[1][0] >= 0.2]
    assert known.columns == columns and sorted(r.doc_id for r in known.collect()) == sorted(wanted)

    cut = line(spark, known, FOLDER).cache()
    assert cut.columns == columns
    short = [(r.doc_id, r.text) for r in known.collect() if r.text.count("\n") < 60]
    found = {r.doc_id: r.text for r in line(spark, known.where("length(text) - length(replace(text, '\\n', '')) < 60"), FOLDER).collect()}
    assert sorted(found.items()) == plain(short, 50)
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    single = near(spark, cut, FOLDER).cache()
    pairs = sorted((r.doc_id, r.text) for r in cut.collect())
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == plain_kept(pairs)

    pieces = pack(spark, single, FOLDER).collect()
    encode = packing.encoder(PATH).tokenizer.encode
    sizes = defaultdict(int)
    for r in pieces:
        sizes[r.doc_id] += r.length
    assert sizes == {r.doc_id: len(encode(r.text, add_special_tokens=False).ids) + 1 for r in single.collect()}


def test_run_is_the_stages_in_a_row(spark):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    rows = driver.queries()["pipeline"](spark, FOLDER)
    assert sorted(map(tuple, rows.select(*names).collect())) == sorted(map(tuple, docs.select(*names).collect()))
