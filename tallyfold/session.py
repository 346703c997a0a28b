"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(app: str = "tallyfold", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def scale_settings(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Session settings for a job that shuffles about ``shuffle_bytes`` on ``cores`` executor cores.

    Shuffle partitions start at about 128 MB each and at least two per core; adaptive execution then joins
    the small ones and cuts the large ones. Scans read 256 MB splits.
    """
    target = 128 * 1024 * 1024
    return {
        "spark.sql.shuffle.partitions": str(max(2 * cores, -(-shuffle_bytes // target))),
        "spark.sql.files.maxPartitionBytes": str(2 * target),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target),
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    }


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tallyfold-")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder named by ``spark.checkpoint.dir``.

    Only a local master may run without that setting; there a temporary folder takes its place.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder every executor can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
