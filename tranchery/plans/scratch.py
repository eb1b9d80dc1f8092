"""Fresh folders for queries that write and read back: in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tranchery.shared.dir", None)
    if not base:  # one machine, as in tests
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.tranchery.shared.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
