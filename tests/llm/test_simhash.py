"""SimHash near-duplicates against a plain version: every pair compared, every bit counted."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

import __spark_entry__ as driver
from tallyfold.llm import simhash as sh
from tallyfold.plans.registry import table


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes, within=4):
    """The smallest reachable position for every fingerprint."""
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(codes)), 2):
        if (codes[i] ^ codes[j]).bit_count() <= within:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def expected(pairs):
    pairs = sorted(pairs)
    codes = [plain_fingerprint(t) for _, t in pairs]
    return sorted((i, f"{c:016x}", pairs[g][0]) for (i, _), c, g in zip(pairs, codes, plain_groups(codes), strict=True))


def test_query_equals_brute_force(spark):
    docs = table(spark, driver.SMOKE, "documents").select("doc_id", "text").collect()
    found = driver.queries()["op10_simhash_near_dedup"](spark, driver.SMOKE).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected([tuple(d) for d in docs])


def test_texts_of_all_kinds(documents):
    words = "Alpha beta GAMMA delta épsilon zeta eta theta".split()
    rnd = random.Random(5)
    base = [rnd.choice(words) for _ in range(300)]
    pairs = [(i, " ".join([*base[:i], "x", *base[i:]])) for i in range(40)]
    pairs += [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "ONE\x0btwo"), (105, "É a b"), (106, "w " * 40000)]
    pairs += [(200 + i, " ".join(base)) for i in range(30)]
    found = sh.near_duplicates(documents(pairs))
    rows = [(r.doc_id, f"{r.fp & sh.FULL:016x}", r.component_id) for r in found.collect()]
    assert sorted(rows) == expected(pairs)


@pytest.mark.parametrize(("blocks", "crowd"), [(3, 8192), (5, 8192), (2, 8192), (3, 60)])
def test_links_connect_what_all_pairs_connect(spark, blocks, crowd):
    rnd = random.Random(blocks + crowd)
    codes = {rnd.getrandbits(64) for _ in range(900)}
    for c in list(codes)[:300]:
        for _ in range(rnd.randint(1, 3)):
            for bit in rnd.sample(range(64), rnd.randint(1, 6)):
                c ^= 1 << bit
            codes.add(c)
    codes = sorted(codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(c,) for c in signed], "fp long").repartition(4)
    links = sh.close_links(frame, blocks=blocks, crowd=crowd, leaf=2).collect()
    assert all(((r.a ^ r.b) & sh.FULL).bit_count() <= 4 for r in links)
    place = {c: i for i, c in enumerate(signed)}
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = find(place[r.a]), find(place[r.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(codes))] == plain_groups(codes)


def test_nulls_repeats_and_clashing_columns(written):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "q r s t u v"), (None, "only null ids here now")]
    docs = written(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS keeper", "3 AS low", "4 AS component_id")
    found = sorted((r.doc_id is None, r.doc_id or 0, r.component_id or -1) for r in sh.near_duplicates(docs).collect())
    assert found == [(False, 3, 3), (False, 7, 7), (False, 7, 7), (True, 0, -1), (True, 0, 7)]
    kept = sh.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7]


def test_empty_table(documents):
    assert sh.near_duplicates(documents([])).collect() == []
    assert sh.one_of_each_group(documents([])).collect() == []
