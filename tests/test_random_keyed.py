"""Keyed operators against plain dictionaries, on random change logs with one key that holds a third of them."""

from __future__ import annotations

import random

import pytest

from tallyfold.operators import keyed

SCHEMA = "k int, a string, b int, v int"


def change_log(seed, n=300):
    rng = random.Random(seed)
    order = rng.sample(range(n * 2), n)
    return [
        (
            0 if rng.random() < 1 / 3 else rng.randrange(40),
            rng.choice(["x", "y", "", None]),
            rng.choice([None, rng.randrange(9)]),
            v,
        )
        for v in order
    ]


def newest(log):
    out = {}
    for row in sorted(log, key=lambda r: r[3]):
        out[row[0]] = row
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_dictionaries(spark, rows, seed):
    log = change_log(seed)
    df = spark.createDataFrame(log, SCHEMA).repartition(5)

    merged = {}
    for k, a, b, _ in sorted(log, key=lambda r: r[3]):
        old = merged.get(k, (None, None))
        merged[k] = (old[0] if a is None else a, old[1] if b is None else b)
    assert rows(keyed.merge_replace_if_not_null(df, "k", "v")) == sorted(((k, *r) for k, r in merged.items()), key=repr)

    last = newest(log)
    assert rows(keyed.latest_by_key(df, "k", "v")) == sorted(last.values(), key=repr)

    base = [r for r in newest(change_log(seed + 100)).values() if r[0] % 3]
    base_df = spark.createDataFrame(base, SCHEMA)
    held = {r[0]: r for r in base}
    both = newest([*base, *log])
    # A change as old as the row it meets would be a tie, which the operator leaves open.
    if all(last[k][3] != held[k][3] for k in held.keys() & last.keys()):
        assert rows(keyed.upsert(base_df, df, "k", "v")) == sorted(both.values(), key=repr)
    won = {**{k: r[:3] for k, r in held.items()}, **{k: r[:3] for k, r in last.items()}}
    assert rows(keyed.upsert(base_df.drop("v"), df, "k", "v")) == sorted(won.values(), key=repr)

    first = {}
    for row in sorted(log, key=lambda r: r[3]):
        first.setdefault(row[0], row)
    assert rows(keyed.insert_if_absent(base_df, df, "k", "v")) == sorted({**first, **held}.values(), key=repr)
    gone = df.where("b = 1")
    named = {r[0] for r in log if r[2] == 1}
    assert rows(keyed.delete_keys(base_df, gone, "k")) == sorted((r for r in base if r[0] not in named), key=repr)
