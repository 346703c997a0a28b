from __future__ import annotations

import pytest

from tallyfold.operators import match, templates

ROSTER = "cluster string, host string, service string, expected int"


def test_roster(spark, rows):
    ps = spark.createDataFrame(
        [
            ("h1", "ops", "java org.NameNode"),
            ("h1", "ops", "grep -i NameNode"),
            ("h1", "root", "java org.NameNode"),
            ("h2", "ops", "java org.datanode"),
            ("h2", "ops", "java org.DataNode"),
            ("h3", "ops", "nginx: worker process"),
            ("h3", "ops", "nginx: worker process"),
        ],
        "host string, owner string, cmd string",
    )
    seen = match.match_processes(ps, ["NameNode", "DataNode", "worker"], owner="OPS")
    assert rows(seen.groupBy("host", "service").count()) == [
        ("h1", "NameNode", 1), ("h2", "DataNode", 2), ("h3", "worker", 2),
    ]
    wanted = [("c", "h1", "NameNode", 1), ("c", "h2", "DataNode", 1), ("n", "h3", "worker", 2), ("z", "h9", "worker", 1)]
    checks = match.check_roster(spark.createDataFrame(wanted, ROSTER), seen)
    found = [("h1", 1, True), ("h2", 2, False), ("h3", 2, True), ("h9", 0, False)]
    assert rows(checks, "host", "observed", "ok") == found
    assert rows(match.rollup_status(checks)) == [("c", "PARTIAL", 1, 1), ("n", "RUNNING", 1, 0), ("z", "STOP", 0, 1)]
    assert rows(match.failing_checks(checks), "cluster", "host", "service") == [("c", "h2", "DataNode")]


TEXTS = [(1, "x=${a},${b},${c}", "k"), (2, "no marks $ {a}", None), (3, None, "n"), (4, "${a}${a}", "t"), (5, "", "e")]
VALUES = {"a": "1", "b": "${a}$1\\"}
FILLED = [
    (1, "x=1,${a}$1\\,${c}", "k"),
    (2, "no marks $ {a}", None),
    (3, None, "n"),
    (4, "11", "t"),
    (5, "", "e"),
]


@pytest.mark.parametrize("as_table", [False, True])
def test_templates(spark, rows, as_table):
    df = spark.createDataFrame(TEXTS, "id int, text string, note string")
    params = spark.createDataFrame(list(VALUES.items()), "key string, value string") if as_table else VALUES
    assert rows(templates.fill_templates(df, params, keys="id")) == FILLED
    assert rows(templates.marks_of(df)) == [("a", 3), ("b", 1), ("c", 1)]
