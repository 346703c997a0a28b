"""Overlap of shingles against every pair compared."""

from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F
from tallyfold.llm import overlap
from tallyfold.plans.registry import table


def plain_kept(pairs, width=5, least=0.8):
    pairs = sorted(pairs)
    sets = []
    for _, text in pairs:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(pairs)), 2):
        shared = len(sets[i] & sets[j])
        if sets[i] == sets[j] or shared / (len(sets[i]) + len(sets[j]) - shared) >= least:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [pairs[i][0] for i in range(len(pairs)) if find(i) == i]


def test_stage_equals_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    wanted = plain_kept([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == wanted


def test_a_large_group_and_texts_of_all_kinds(documents):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    pairs = [(i, " ".join([*base[: i + 1], f"x{i}", *base[i + 1 :]])) for i in range(300)]
    for i in range(300, 340):  # overlaps of 0.6 to 0.95
        other = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        pairs += [(2 * i, " ".join(other)), (2 * i + 1, " ".join([*other[: 200 - (i - 299)], *(f"y{k}" for k in range(i - 299))]))]
    pairs += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE\x0btwo"), (905, "w " * 40000)]
    kept = overlap.one_of_each_overlap(documents(pairs))
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(pairs)


def test_pairs_within_a_shared_template(documents):
    """Two hundred texts with one template: those of a pair have more in common than the template, all others less."""
    template = [f"t{i}" for i in range(400)]
    pairs = []
    for i in range(100):
        shared = [f"p{i}x{k}" for k in range(8)]
        for j in range(2):
            own = [f"o{i}y{j}z{k}" for k in range(44)]
            pairs.append((len(pairs), " ".join([*template, *shared, *own])))
    kept = sorted(r.doc_id for r in overlap.one_of_each_overlap(documents(pairs)).collect())
    assert kept == plain_kept(pairs) and len(kept) < 150


def test_the_forest_links_near_copies_by_itself(documents, monkeypatch):
    rnd = random.Random(5)
    pairs = []
    for i in range(30):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(600)]
        pairs += [(4 * i + j, " ".join([*base[:300], *(f"x{j}" for _ in range(j)), *base[300:]])) for j in range(4)]
    met = []
    monkeypatch.setattr(overlap, "buckets", lambda codes: met.append(1) or codes.select("code", F.lit(0).alias("band"), F.lit(0).alias("value")).limit(0))
    kept = overlap.one_of_each_overlap(documents(pairs))
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(pairs) == [4 * i for i in range(30)] and met


def test_texts_that_can_have_no_partner_meet_in_no_join(documents, monkeypatch):
    """A third of every text's shingles are its own but for two pairs: only these texts' shingles are joined."""
    template = [f"t{i}" for i in range(300)]
    pairs = [(i, " ".join([*template, *(f"o{i}x{k}" for k in range(150))])) for i in range(60)]
    pairs += [(60 + i, " ".join([*template, *(f"p{i // 2}x{k}" for k in range(100)), *(f"q{i}x{k}" for k in range(40))])) for i in range(4)]
    met, join = [], overlap.splittable_join
    monkeypatch.setattr(overlap, "forest_pairs", lambda codes, *_: codes.select(F.col("code").alias("a"), F.col("code").alias("b")).limit(0))

    def counted(left, right, keys, how):
        joined = join(left, right, keys, how)
        met.extend([joined.count()] if (keys, how) == ("word", "inner") else [])
        return joined

    monkeypatch.setattr(overlap, "splittable_join", counted)
    kept = sorted(r.doc_id for r in overlap.one_of_each_overlap(documents(pairs)).collect())
    assert kept == plain_kept(pairs) == [*range(61), 62] and len(met) == 1 and 0 < met[0] <= 4 * 436


def test_empty_table_and_null_ids(written, documents):
    assert overlap.one_of_each_overlap(documents([])).collect() == []
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "q r s t u v"), (None, "only null ids here now")]
    kept = overlap.one_of_each_overlap(written(rows, "doc_id long, text string").selectExpr("*", "1 AS code", "2 AS bands"))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7]
