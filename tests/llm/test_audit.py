"""The audit of filters against documents sent through every order one by one."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import combinations, permutations
from math import factorial

import __spark_entry__ as driver
from oracle import duck, rows_of, rows_of_sql
from tallyfold.llm import audit
from tallyfold.plans.registry import table

LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """Rows of ``docs`` are (doc_id, text, source)."""
    last = float("inf")
    least = {}
    for i, text, _ in docs:
        least[text or ""] = min(least.get(text or "", last), last if i is None else i)
    parts = defaultdict(list)
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        rules = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": least[t] < (last if i is None else i),
        }
        own = [r for r in labels if i is not None and r[0] == i]
        parts[source or ""].append(({f for f, bad in rules.items() if bad}, any(r[1] == 1 for r in own), any(r[2] == 1 for r in own)))
    out = []
    for part, rows in parts.items():
        share = defaultdict(int)
        steps = []
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                share[f] += len(gone)
                failing = sum(f in r[0] for r in rows)
                only = sum(r[0] == {f} for r in rows)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), only, sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*s[:-1], share[s[-1]]) for s in steps]
    return sorted(out)


def test_coefficients_are_those_of_the_definition():
    for n in (1, 2, 3, 5):
        if n == 1:
            continue
        for i, row in enumerate(audit.shapley_coefficients(n)):
            others = [p for p in range(n) if p != i]
            wanted = [0] * (1 << n)
            for k in range(n):
                for group in combinations(others, k):
                    s = sum(1 << p for p in group)
                    weight = factorial(k) * factorial(n - k - 1)
                    wanted[s | 1 << i] += weight
                    wanted[s] -= weight
            wanted[0] = row[0] = 0  # nothing is removed by no filter
            assert row == wanted


def test_every_order_against_single_documents(spark, written):
    rnd = random.Random(3)
    words = ["alpha", "beta", "Gamma", "DELTA", "épée", "x|y", "50%", " ", "plain"] + [f"w{i}" for i in range(60)]
    texts = ["", None, " \t\n", "A", "#"] + [rnd.choice([" ", "\n", "\t"]).join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(40)]
    docs = [(rnd.choice([None, *range(90)]), rnd.choice(texts), rnd.choice(["a", "b", "", None, "ü"])) for _ in range(250)]
    labels = [(rnd.choice([None, *range(90)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(120)]
    table = written(docs, "doc_id long, text string, source string").selectExpr("*", "'x' AS part", "1 AS mask", "2 AS good", "3 AS key", "4 AS `a.b`")
    found = audit.audit(table, spark.createDataFrame(labels, LABELS).selectExpr("*", "'y' AS text", "'z' AS source"))
    assert sorted(map(tuple, found.collect())) == plain(docs, labels)


def test_long_texts_and_many_copies(spark, written):
    long = " ".join(f"word{i}" for i in range(200_000))
    docs = [(i, long if i % 100 == 0 else "same", "s") for i in range(300)]
    rows = audit.audit(written(docs, "doc_id long, text string, source string"), spark.createDataFrame([], LABELS)).collect()
    first = next(r for r in rows if r.filter_order == "EABCD" and r.step == 1)
    assert (first.kept, first.removed, first.redundant, first.good_lost) == (2, 298, 0, 0)


def test_empty_tables(spark, written):
    assert audit.audit(written([], "doc_id long, text string, source string"), spark.createDataFrame([], LABELS)).collect() == []


def test_query_against_sql(spark):
    run = driver.queries()["op13_filter_audit"]
    found = run(spark, driver.SMOKE)
    assert rows_of(found) == rows_of_sql(duck(driver.SMOKE), driver.oracle_sql()["op13_filter_audit"])
    parts = table(spark, driver.SMOKE, "documents").select("source").distinct().count()
    assert found.count() == 600 * parts
