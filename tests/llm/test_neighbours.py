"""Nearest neighbours against brute force: exact scores, recall, and vectors that take no part."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tallyfold.llm import neighbours
from tallyfold.plans.registry import table


def truth(ids, vectors, q, k=10):
    d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
    return [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if ids[i] != q][:k]


def grouped(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in out.items()}


def test_query_recall_and_scores(spark):
    rows = table(spark, driver.SMOKE, "embeddings").toPandas()
    ids, vectors = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
    found = grouped(driver.queries()["op5_k_means_tree"](spark, driver.SMOKE))
    assert sorted(found) == sorted(i for i in ids if i % 100 == 0)
    hits = 0
    for q, rows in found.items():
        assert [r for r, _, _ in rows] == list(range(1, 11))
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        for _, v, s in rows:
            assert s == pytest.approx(np.sqrt(((vectors[ids == v][0] - vectors[ids == q][0]) ** 2).sum()), abs=1e-12)
        hits += len({v for _, v, _ in rows} & {v for v, _ in truth(ids, vectors, q)})
    assert hits >= 0.9 * 10 * len(found)


def test_copies_ties_and_rows_that_take_no_part(written):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 300)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(400)]
    bad = [(5000, None), (5100, [0.0] * 4), (5200, [1.0, None, 0.0, 0.0]), (5300, [math.nan] * 4), (5400, [math.inf, 0.0, 0.0, 0.0]), (5500, [1.0]), (None, [1.0] * 4)]
    vectors = written(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 AS leaf", "2 AS score", "3 AS part")
    found = grouped(neighbours.nearest(vectors, F.col("vec_id") % 100 == 0, leaf=16, block=64, recall=1.0))
    assert sorted(found) == [100, 200, 1000, 1100, 1200, 1300]
    assert [v for _, v, _ in found[1000]] == list(range(1001, 1011))
    assert [(v, s) for _, v, s in found[1200]] == [(v, 0.0) for v in range(1000, 1010)]
    ids, values = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    assert [v for _, v, _ in found[100]] == [v for v, _ in truth(ids, values, 100)]


def test_few_and_no_vectors(written):
    schema = "vec_id long, embedding array<float>"
    few = grouped(neighbours.nearest(written([(100, [1.0, 2.0]), (3, [1.0, 0.0])], schema), F.col("vec_id") % 100 == 0))
    assert few == {100: [(1, 3, 2.0)]}
    assert neighbours.nearest(written([(100, [1.0, 2.0])], schema), F.col("vec_id") % 100 == 0).collect() == []
    assert neighbours.nearest(written([], schema), F.col("vec_id") % 100 == 0).collect() == []


def test_rows_that_repeat_an_id_are_vectors_of_their_own(written):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=3).tolist()) for i in [100, 100, 7, 7, 200, 200, 200, *range(300, 340)]]
    rows += [(100, rows[0][1])]
    vectors = written(rows, "vec_id long, embedding array<float>", files=1)
    found = neighbours.nearest(vectors, F.col("vec_id") % 100 == 0, k=5, recall=1.0, leaf=8)
    values = np.array([v for _, v in rows], np.float32).astype(float)
    wanted = []
    for i, (q, _) in enumerate(rows):
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((values[i] - values[j]) ** 2).sum())), rows[j][0]) for j in range(len(rows)) if j != i)[:5]
            wanted += [(q, rank, v, pytest.approx(d)) for rank, (d, v) in enumerate(near, 1)]
    got = [tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(wanted)
    left = list(got)
    for row in wanted:
        left.remove(next(r for r in left if r == row))
    assert left == []
