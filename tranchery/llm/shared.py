"""Storage helpers: tables that several jobs of one operator read live in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Only a local master, where driver and executors are one process, may go
    without: it gets a fresh temporary folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tranchery.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.tranchery.shared.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows reach Python tasks in Arrow batches of about ``BATCH_BYTES`` (a longer row is a batch of its
    own): texts make a batch of the default number of rows large.  The setting holds for the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def joined_by_weight(rows: DataFrame, keyed: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has each key once with its number of rows (``weight``, left out).

    Keys with over a thousandth of all rows, a thousand at most, are broadcast; the others meet in a shuffle, where no
    key is large.  Every row has its key in ``keyed``; keys are not null."""
    keyed = staged(keyed, "keyed")
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * 1000 > total
    found = [c for c in keyed.columns if c not in (key, weight)]
    some = keyed.where(hot).select(key, F.struct(*found).alias("_found"))
    met = rows.join(F.broadcast(some), key, "left")
    often = met.where("_found is not null").select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in found])
    seldom = met.where("_found is null").select(*rows.columns).join(keyed.where(~hot).drop(weight), key)
    return often.unionByName(seldom)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
