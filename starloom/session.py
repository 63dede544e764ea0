"""Spark session set-up and the folder for intermediate tables."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

# Adaptive execution splits uneven join partitions and merges small ones at run time. Beyond 2000
# shuffle partitions Spark records average block sizes, in which it cannot see uneven ones,
# unless told to record blocks so much larger than the median exactly.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.shuffle.accurateBlockSkewedFactor": "5",
    "spark.log.level": "WARN",
}


def get_spark(
    app_name: str, conf: Mapping[str, str] | None = None, shuffle_bytes: int | None = None
) -> SparkSession:
    """A session with `DEFAULT_CONF`, then `conf` over it: master, memory, packages and whatever
    else Spark takes as a setting.

    `shuffle_bytes`, the size of the largest shuffle expected, sets how many partitions a shuffle
    starts with; adaptive execution merges those that turn out small.
    """
    settings = dict(DEFAULT_CONF)
    if shuffle_bytes:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions(shuffle_bytes))
    return SparkSession.builder.appName(app_name).config(map=settings | dict(conf or {})).getOrCreate()


def shuffle_partitions(shuffle_bytes: int, partition_bytes: int = 256 << 20) -> int:
    """Partitions of `partition_bytes` each, whatever their number."""
    return max(1, math.ceil(shuffle_bytes / partition_bytes))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the shared folder that the session names in `spark.checkpoint.dir`.

    Only a local session may fall back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="starloom-")
    return f"{base.rstrip('/')}/starloom-{uuid.uuid4().hex}"
