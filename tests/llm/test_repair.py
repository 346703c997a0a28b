"""Re-Pair files: exact round trips, random access, global starts."""

from __future__ import annotations

import random

import numpy as np
import pytest

import __spark_entry__ as driver
from tallyfold.llm import queries, repair
from tallyfold.plans.registry import table

PATH = queries.vocabulary(queries.WORDS)


def wanted(pairs):
    """(doc_id, start, ids) by the library itself."""
    tokenizer = repair.encoder(PATH, True).tokenizer
    out, start = [], 0
    for i, t in sorted(pairs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, tuple(ids)))
        start += len(ids)
    return out


def found(frame):
    return sorted((r.doc_id, r.start, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in frame.collect())


@pytest.mark.parametrize("seed", range(25))
def test_blocks_round_trip(seed):
    rnd = random.Random(seed)
    words = [[rnd.randint(0, 9) for _ in range(rnd.randint(1, 6))] for _ in range(8)]
    docs = [[7] * rnd.randint(1, 60) if rnd.random() < 0.2 else sum((rnd.choice(words) for _ in range(rnd.randint(0, 80))), []) + [1] for _ in range(30)]
    ids, tokens = np.array(sum(docs, []), np.uint32), np.array([len(d) for d in docs])
    block = repair.compress(ids, tokens, least=2)
    assert len(block.sequence) < len(ids)
    block = repair.Block.from_bytes(block.to_bytes())
    assert [block.document(i).tolist() for i in range(30)] == docs
    for _ in range(20):
        a, b = sorted(rnd.sample(range(len(ids) + 1), 2))
        assert block.span(a, b).tolist() == ids[a:b].tolist()
    assert all(block.lengths[k] == len(block.expand(np.array([block.first + k]))) for k in range(len(block.left)))


def test_no_rules_and_wide_symbols():
    block = repair.Block.from_bytes(repair.compress(np.array([1]), np.array([1])).to_bytes())
    assert block.document(0).tolist() == [1]
    ids = np.array([70_000, 2, 70_000, 2, 1] * 20)
    block = repair.Block.from_bytes(repair.compress(ids, np.array([100])).to_bytes())
    assert block.document(0).tolist() == ids.tolist()


def test_files(documents):
    rnd = random.Random(4)
    pairs = [(i * 3, " ".join(rnd.choice(["One", "two's", "Été", "4 5", "!?", "\n"]) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    pairs += [(1, None), (2, ""), (4, "long words " * 4000), (5, "z" * 20000), (7, "a <|endoftext|> b\x1cc")]
    files = repair.write_blocks(documents(pairs), PATH, size=500)
    assert found(repair.read_documents(files)) == wanted(pairs)
    assert files.count() > 3


def test_nulls_repeats_and_clashing_columns(written):
    rows = [(None, "x y"), (4, "x"), (4, "x"), (None, None), (2, "q")]
    docs = written(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS ids", "3 AS _salt")
    read = repair.read_documents(repair.write_blocks(docs, PATH)).collect()
    assert sorted(r.doc_id or -1 for r in read) == [-1, -1, 2, 4, 4]
    spans = sorted((r.start, r.n_tokens) for r in read)
    assert [s for s, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(5)]
    assert max(r.start for r in read if r.doc_id is None) < min(r.start for r in read if r.doc_id)


def test_empty_table(documents):
    assert repair.read_documents(repair.write_blocks(documents([]), PATH)).collect() == []


def test_query_on_the_small_tables(spark):
    import zlib

    docs = [tuple(r) for r in table(spark, driver.SMOKE, "documents").select("doc_id", "text").collect()]
    rows = driver.queries()["op2_repair_grammar"](spark, driver.SMOKE).collect()
    expected = [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in wanted(docs)]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == expected


def test_all_symbols_expanded_at_once():
    rnd = random.Random(3)
    ids = np.array([rnd.choice([5, 6, 7, 7, 9]) for _ in range(5000)], "<u4")
    for tokens in ([5000], [2000, 1, 2999]):
        block = repair.Block.from_bytes(repair.compress(ids, np.array(tokens)).to_bytes())
        expanded, places, sizes = block.all_expanded()
        assert len(block.left) > 5 and sizes[block.sequence].sum() == 5000
        assert [expanded[places[s] : places[s] + sizes[s]].tolist() for s in block.sequence] == [block.expand(np.array([s])).tolist() for s in block.sequence]
    empty = repair.Block.from_bytes(repair.compress(ids[:0], np.array([], np.int64)).to_bytes())
    assert [len(x) for x in empty.all_expanded()] == [0, 0, 0]
