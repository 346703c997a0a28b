"""How filters interact: what each removes in every order of application, and its Shapley share.

A document comes down to the set of filters it fails, one bit each. Counts by part and set are all that is
needed: the number of documents that a coalition of filters removes is tabulated for all 32 coalitions, a step of an
order is the difference of two coalitions, and the Shapley share is the least-squares fit of a sum of shares to the
32 removals, weighted by the Shapley kernel and constrained to add up to what all filters remove together. The
normal equations are solved in rationals; they do not depend on the data, so their solution is a fixed row of
whole coefficients for each filter, which Spark multiplies with the removals of each part.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import checkpointed
from tallyfold.operators.skew import splittable_join

LETTERS = "ABCDE"
FIVE = len(LETTERS)
ALL = (1 << FIVE) - 1
SPACE = r"[\x20\x09-\x0D]+"


def fails(text: Column) -> Column:
    """The bits of the filters A to D that a text fails; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    rules = [n < 50, 100 * different < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
    bits = [F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules)]
    return sum(bits[1:], bits[0])


def failure_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, docs``: how many documents of a source fail just the filters of ``mask``.

    Texts are equal if their SHA-256 is. A document whose text a smaller ``doc_id`` has, in any part, fails E. A null
    id comes after all others; rows that repeat an id count each, and none of them is the smaller one. A document is good
    (toxic) if any of its label rows says so.
    """
    bits = fails(F.col("text"))
    key = F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), key.alias("key"), bits.alias("mask"))
    rows = rows.groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("docs"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    rows = splittable_join(rows, known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    # The documents with the smallest id of their text, by what else they share: one row for all others.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    shared = ["key", "part", "mask", "good", "toxic"]
    sets = rows.groupBy(*shared, "doc_id").agg(F.sum("docs").alias("docs")).groupBy(*shared)
    sets = checkpointed(sets.agg(F.sum("docs").alias("docs"), F.min(F.struct(order.alias("low"), "docs")).alias("first")))
    lows = sets.groupBy("key").agg(F.min("first.low").alias("least"))
    judged = splittable_join(sets, lows, "key", "inner")
    own = F.when(F.col("first.low") == F.col("least"), F.col("first.docs")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask"), own.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("docs") - own).alias("n"))))
    judged = judged.select("part", "good", "toxic", split.alias("s"))
    return judged.groupBy("part", F.col("s.mask").alias("mask"), "good", "toxic").agg(F.sum("s.n").alias("docs")).where("docs > 0")


def shapley_coefficients(players: int = FIVE) -> list[list[int]]:
    """For each player the whole coefficients of all coalitions' values that give its Shapley value times ``players!``.

    Minimises the kernel-weighted squares of ``v(S) - sum of S's shares`` with all shares adding up to ``v(all)``:
    with ``A = Z'WZ`` the shares are ``A^-1 (Z'Wv - u 1)``, where ``u`` meets the constraint.
    """
    everyone = (1 << players) - 1
    weights = {
        s: Fraction(players - 1, comb(players, k) * k * (players - k)) for s in range(1, everyone) for k in [s.bit_count()]
    }
    has = [[s >> i & 1 for i in range(players)] for s in range(everyone + 1)]
    system = [[sum((w * has[s][i] * has[s][j] for s, w in weights.items()), Fraction()) for j in range(players)] for i in range(players)]
    inverse = _inverse(system)
    totals = [sum(row, Fraction()) for row in inverse]
    out: list[list[int]] = [[] for _ in range(players)]
    for s in range(everyone + 1):
        # The value is linear in v, so the solution for v = 1 at this coalition alone is its coefficient.
        right = [weights.get(s, Fraction()) * has[s][i] for i in range(players)]
        free = [sum((a * b for a, b in zip(row, right, strict=True)), Fraction()) for row in inverse]
        u = (sum(free, Fraction()) - (s == everyone)) / sum(totals, Fraction())
        for i in range(players):
            share = factorial(players) * (free[i] - u * totals[i])
            if share.denominator != 1:
                raise ArithmeticError("a Shapley coefficient times the number of orders is whole")
            out[i].append(int(share))
    return out


def _inverse(matrix: list[list[Fraction]]) -> list[list[Fraction]]:
    n = len(matrix)
    rows = [[*row, *(Fraction(int(i == j)) for j in range(n))] for i, row in enumerate(matrix)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [row[n:] for row in rows]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part's 120 orders of the filters, five steps each; zeros included.

    Columns: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``, numbers
    long, ``shapley`` times 120. A table without rows has no parts. Columns of other names are not looked at. Work after
    ``failure_sets`` is over at most 32 sets times the label values a part, and 600 rows a part come out.
    """

    def tabulated(condition: str, n: str = "docs") -> Column:
        sums = (f"sum(if({condition.format(s)}, {n}, 0L))" for s in range(ALL + 1))
        return F.expr(f"array({', '.join(sums)})")

    removals = failure_sets(docs, labels).groupBy("part").agg(
        F.sum("docs").alias("n"),
        tabulated("mask = {}").alias("only"),
        tabulated("(mask & {}) != 0").alias("all"),
        tabulated("(mask & {}) != 0", "if(good, docs, 0L)").alias("good"),
        tabulated("(mask & {}) != 0", "if(toxic, docs, 0L)").alias("toxic"),
    )
    fit = (" + ".join(f"{c}L * all[{s}]" for s, c in enumerate(row)) for row in shapley_coefficients())
    at = F.explode(F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order string, step int, before int, after int, own int, filter int>>"))
    return removals.select("*", F.expr(f"array({', '.join(fit)})").alias("shares"), at.alias("at")).selectExpr(
        "part",
        "at.filter_order",
        "at.step",
        "n - all[at.after] AS kept",
        "all[at.after] - all[at.before] AS removed",
        "all[at.own] - all[at.after] + all[at.before] AS redundant",
        "only[at.own] AS unique_fails",
        "good[at.after] - good[at.before] AS good_lost",
        "toxic[at.after] - toxic[at.before] AS toxic_lost",
        "shares[at.filter] AS shapley",
    )


def _steps() -> list[dict[str, str | int]]:
    """For every step of every order the coalitions before and after it, its filter's own bit, and the filter."""
    out: list[dict[str, str | int]] = []
    for order in permutations(range(FIVE)):
        before = 0
        for i, f in enumerate(order):
            out.append(
                {"filter_order": "".join(LETTERS[x] for x in order), "step": i + 1, "before": before, "after": before | 1 << f, "own": 1 << f, "filter": f}
            )
            before |= 1 << f
    return out
