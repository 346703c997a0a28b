"""Repeated runs of lines: against SQL, against a plain version, and rows with nothing to compare."""

from __future__ import annotations

import random
import re

import __spark_entry__ as driver
from oracle import duck, rows_of, rows_of_sql
from tallyfold.llm import lines


def test_query_equals_sql(spark):
    name = "op3_winnowed_lines"
    found = rows_of(driver.queries()[name](spark, driver.SMOKE))
    assert found == rows_of_sql(duck(driver.SMOKE), driver.oracle_sql()[name])


def plain(pairs, words):
    """Every run of enough words against all earlier ones: quadratic, for small tables."""
    texts = [(key, t.split("\n")) for key, t in sorted(pairs)]
    earliest, runs = {}, []
    for doc, (_, own) in enumerate(texts):
        full = [(i, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate(own)]
        full = [x for x in full if x[2]]
        for a in range(len(full)):
            for b in range(a, len(full)):
                if sum(n for *_, n in full[a : b + 1]) >= words:
                    run = tuple(x for _, x, _ in full[a : b + 1])
                    place = (doc, full[a][0], full[b][0])
                    earliest[run] = min(earliest.get(run, place), place)
                    runs.append((run, place))
    gone = set()
    for run, (doc, a, b) in runs:
        first = earliest[run]
        if first[0] != doc or a > first[2]:
            gone |= {(doc, i) for i in range(a, b + 1)}
    return [(key, "\n".join(x for i, x in enumerate(own) if (d, i) not in gone)) for d, (key, own) in enumerate(texts)]


def test_runs_equal_all_runs(documents):
    for seed in range(3):
        rnd = random.Random(seed)
        pool = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) for _ in range(12)] + ["", "  "]
        pairs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for i in range(40)]
        pairs += [(100 + i, "\n".join(pool[:6])) for i in range(3)]
        rows = lines.without_repeated_runs(documents(pairs), words=12).select("doc_id", "text").collect()
        assert sorted(map(tuple, rows)) == plain(pairs, 12)


def test_nulls_repeats_long_texts_and_clashing_columns(written):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(2, passage), (2, passage), (None, f"own\n{passage}"), (1, f"x\n{passage}\ny"), (3, None), (4, ""), (5, "one\ntwo\n" * 3000)]
    docs = written(rows, "doc_id long, text string").selectExpr("*", "1 AS `a.b`", "2 AS line", "3 AS run", "4 AS gone", "5 AS removed")
    found = lines.without_repeated_runs(docs)
    assert found.columns == ["doc_id", "text", "a.b", "line", "run", "gone", "removed"]
    texts = [(r.doc_id, r.text) for r in found.collect() if r.doc_id != 5]
    assert sorted(texts, key=repr) == sorted([(1, f"x\n{passage}\ny"), (2, ""), (2, ""), (None, "own"), (3, None), (4, "")], key=repr)
    (long,) = [r.text for r in found.collect() if r.doc_id == 5]
    assert long.startswith("one\ntwo\n" * 25) and len(long) < 30_000


def test_empty_table(documents):
    assert lines.without_repeated_runs(documents([])).collect() == []


def test_no_python_on_the_way(spark):
    plan = driver.queries()["op3_winnowed_lines"](spark, driver.SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
