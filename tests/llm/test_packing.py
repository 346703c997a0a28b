"""Best-fit packing: plans on counts, places without gaps, ids as the library gives them."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as driver
from tallyfold.llm import packing, queries

PATH = queries.vocabulary(queries.BYTES)


def greedy(lengths, size):
    """Best-fit decreasing one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_rank_once(seed):
    rnd = random.Random(seed)
    size = rnd.choice([8, 64, 256])
    counts = {rnd.randint(1, size - 1): rnd.randint(1, 60) for _ in range(rnd.randint(1, 40))}
    plan = packing.plan_best_fit(counts, size)
    ranks, places = defaultdict(list), defaultdict(list)
    for n, low, high, s, offset in plan:
        ranks[n] += range(low, high)
        for k in range(high - low):
            places[s + k].append((offset, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for rows in places.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:i]) for i in range(len(rows))]
        assert sum(n for _, n in rows) <= size
    lengths = [n for n, c in counts.items() for _ in range(c)]
    assert len(places) <= greedy(lengths, size) * 1.03 + 1


def check(rows, pairs, size):
    tokenizer = packing.encoder(PATH).tokenizer
    wanted = sorted(
        (i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in pairs
    )
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= size
        whole[r.doc_id].append((r.piece, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= size
    if len({i for i, _ in pairs}) == len(pairs):
        found = []
        for i, pieces in whole.items():
            pieces.sort()
            assert [p for p, _, _ in pieces] == list(range(len(pieces)))
            ids = [x for _, _, part in pieces for x in part]
            assert all(start == sum(len(q) for _, _, q in pieces[:p]) for p, start, _ in pieces)
            assert all(len(part) == size for _, _, part in pieces[1:])
            found.append((i, tuple(ids)))
        assert sorted(found) == wanted
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in wanted)


def test_pieces_and_places(documents):
    rnd = random.Random(3)
    pairs = [(i, " ".join(rnd.choice(["a", "there", "Wörter,", "x1", "\n"]) for _ in range(rnd.randint(0, 90)))) for i in range(200)]
    pairs += [(900, None), (901, ""), (902, "word " * 3000), (903, "a" * 5000)]
    check(packing.pack(documents(pairs), PATH, size=64).collect(), pairs, 64)


def test_repeated_rows_null_ids_and_clashing_columns(spark, written):
    rows = [(1, "a b c", 5), (1, "a b c", 5), (None, "q", 6), (None, None, 7)] * 3
    docs = written(rows, "doc_id long, text string, rank int").selectExpr("*", "1 AS task", "2 AS length", "3 AS nth")
    packed = packing.pack(docs, PATH, size=16).collect()
    assert len(packed) == 12
    places = [(r.sequence_id, r.offset) for r in packed]
    assert len(set(places)) == 12


def test_empty_table(documents):
    assert packing.pack(documents([]), PATH).collect() == []


def test_query_on_the_small_tables(spark):
    rows = driver.queries()["op4_best_fit_packing"](spark, driver.SMOKE).collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.02 * total / 2048 + 1
