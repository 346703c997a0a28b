from __future__ import annotations

from types import SimpleNamespace

import pytest

from tallyfold.session import CHECKPOINT_DIR, scale_settings, shared_folder


def session(master, **conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: conf.get(name, default)),
        sparkContext=SimpleNamespace(master=master),
    )


def test_shared_folder_is_the_one_the_session_names():
    cluster = session("yarn", **{CHECKPOINT_DIR: "hdfs://shared/folder/"})
    first, second = shared_folder(cluster, "x"), shared_folder(cluster, "x")
    assert first.startswith("hdfs://shared/folder/x-") and first != second


def test_only_a_local_master_may_use_a_temporary_folder(spark):
    with pytest.raises(ValueError, match=CHECKPOINT_DIR):
        shared_folder(session("yarn"), "x")
    assert "/x-" in shared_folder(spark, "x")


def test_scale_settings(spark):
    assert scale_settings(0, 8)["spark.sql.shuffle.partitions"] == "16"
    settings = scale_settings(100 * 1024**4, 4000)
    assert settings["spark.sql.shuffle.partitions"] == "819200"
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)
