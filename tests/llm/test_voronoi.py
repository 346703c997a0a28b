"""The join by Voronoi cells against the comparison of all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

import __spark_entry__ as driver
from oracle import duck, rows_of, rows_of_sql
from pyspark.sql import functions as F
from tallyfold.llm import voronoi

VECTORS = "vec_id long, embedding array<float>"
MOST = 2**31 - 1


def plain(rows, k, asks):
    whole = []
    for i, (vec_id, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, vec_id, [min(max(math.floor(64 * float(np.float32(x))), -MOST), MOST) for x in v]))
    out = []
    for i, q, v in whole:
        if q is not None and asks(q):
            near = [(-sum(a * b for a, b in zip(v, w)), c is None, c or 0, j, c) for j, c, w in whole if j != i]
            out += [(q, rank, n[4], min(max(-n[0], -(2**63)), 2**63 - 1)) for rank, n in enumerate(sorted(near, key=lambda n: n[:4])[:k], 1)]
    return sorted(out, key=repr)


def found(table, k, asks, **settings):
    rows = voronoi.best_by_product(table, asks, k, **settings).collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("settings", [{}, {"pivots": 5, "references": 40, "group": 6, "chunk": 30}, {"pivots": 64, "references": 8, "group": 3, "chunk": 7}])
def test_all_rows_compared(written, settings):
    rnd = random.Random(len(settings))
    centres = [[rnd.gauss(0, 4) for _ in range(6)] for _ in range(8)]
    rows = [(i, [x + rnd.gauss(0, 0.3) for x in rnd.choice(centres)]) for i in range(300)]
    rows += [(300 + i, rows[i % 7][1]) for i in range(60)]  # copies: ties
    rows += [(500, [0.0] * 6), (505, [0.0] * 6), (510, None), (515, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (520, [math.nan] * 6), (525, [math.inf] * 6), (530, []), (535, [9.0])]
    assert found(written(rows, VECTORS, files=1), 20, F.col("vec_id") % 5 == 0, **settings) == plain(rows, 20, lambda q: q % 5 == 0)


def test_repeated_and_null_ids(written):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 0, 5, 7, 10]), [float(rnd.randint(-3, 3)), 1.0]) for _ in range(120)]
    got = found(written(rows, VECTORS, files=1), 4, F.col("vec_id") % 5 == 0, group=2, chunk=5)
    assert got == plain(rows, 4, lambda q: q % 5 == 0) and len(got) > 100


def test_scores_beyond_floating_point_and_beyond_64_bits(written):
    rnd = random.Random(5)
    for size in (1e5, 1e30):
        rows = [(i, [rnd.uniform(-size, size) for _ in range(3)]) for i in range(80)]
        assert found(written(rows, VECTORS, files=1), 5, F.col("vec_id") % 10 == 0) == plain(rows, 5, lambda q: q % 10 == 0)


def test_few_rows_extra_columns_and_empty_tables(written):
    rows = [(0, [1.0, 2.0]), (20, [3.0, 4.0])]
    table = written(rows, VECTORS).selectExpr("*", "1 AS query", "2 AS vec", "3 AS ids", "4 AS `a.b`", "5 AS _llm_row")
    assert found(table, 20, F.col("vec_id") % 20 == 0) == plain(rows, 20, lambda q: q % 20 == 0)
    assert found(written([(1, [1.0])], VECTORS), 20, F.col("vec_id") % 20 == 0) == []
    assert found(written([(0, [1.0])], VECTORS), 20, F.col("vec_id") % 20 == 0) == []
    assert found(written([], VECTORS), 20, F.col("vec_id") % 20 == 0) == []


def test_clusters_are_not_sent_where_nothing_of_them_is_needed():
    rnd = np.random.default_rng(1)
    centres = rnd.normal(0, 1000, (10, 8))
    rows = np.floor(np.concatenate([c + rnd.normal(0, 5, (100, 8)) for c in centres])).astype(np.int64)
    cells = voronoi.Cells(rows[rnd.permutation(1000)[:400]], 40)
    cell, far = cells.place(rows)
    reach = cells.reach(rows, cells.least(rows, 20))
    needed = far[None, :] >= reach[:, cell]
    assert needed.mean() < 0.5
    scores = rows @ rows.T
    best = np.sort(scores, axis=1)[:, -20][:, None]
    assert needed[scores > best].all() and needed[scores == best].all()


def test_query_against_sql(spark):
    got = rows_of(driver.queries()["op11_voronoi_join"](spark, driver.SMOKE))
    assert got == rows_of_sql(duck(driver.SMOKE), driver.oracle_sql()["op11_voronoi_join"])
