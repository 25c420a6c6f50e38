"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir. Where that is unset, below one of ours if all runs in one process; on a
    cluster that is an error, as executors do not see each other's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named or '/tmp/txloom-checkpoints'}/{name}-{uuid.uuid4().hex}"
