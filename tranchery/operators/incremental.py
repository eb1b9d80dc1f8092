"""Loads that take what has changed since the last one, and results that are kept up from these rows only.

All state is in keyed tables (``streaming.keyed``) with one version per load: the high-water mark of each job, the last
row of each key, and the results per group.  The mark is written last, so a load that fails is run again as the same
version and replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranchery.operators import quality
from tranchery.operators.changelog import latest_per_key
from tranchery.streaming.keyed import KeyedTable

_LAST = "pk long, grp string, amt decimal(14,2), at long"
_RESULT = "grp string, cnt long, total decimal(24,2)"


def marks_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, "job string, mark long", ["job"], lambda rows: rows.groupBy("job").agg(F.max("mark").alias("mark")), buckets=1)


class Upkeep:
    """Rows and sum per group of the last row of each key, kept up load by load.

    Given to ``load``: rows with pk, grp, amt and at (what the mark is taken of, unique and ascending); a null group
    takes the key out.  Older rows than a key's last one change nothing."""

    def __init__(self, spark: SparkSession, path: str, job: str = "upkeep", buckets: int = 16):
        self.spark, self.job = spark, job
        self.marks = marks_table(spark, f"{path}/marks")
        self.rows = KeyedTable(spark, f"{path}/rows", _LAST, ["pk"], lambda rows: latest_per_key(rows, ["pk"], ["at"]), buckets)
        summed = lambda rows: rows.groupBy("grp").agg(F.sum("cnt").alias("cnt"), F.sum("total").cast("decimal(24,2)").alias("total"))
        self.results = KeyedTable(spark, f"{path}/results", _RESULT, ["grp"], summed, buckets=1)

    def load(self, source: DataFrame) -> int:
        """Takes the rows of ``source`` beyond the mark; the number of keys that changed."""
        version = max(self.marks.versions(), default=-1) + 1
        fresh = quality.beyond_watermark(source, "at", self.marks.read(version - 1), self.job).where("pk is not null")
        last = latest_per_key(fresh, ["pk"], ["at"]).select("pk", "grp", "amt", "at")
        self.rows.add(last, version)
        # both images of the changed keys only: as they were, and as they now are
        changed = last.select("pk")
        images = lambda v, sign: self.rows.read(v).join(changed, "pk", "left_semi").select("grp", "amt", F.lit(sign).alias("sign"))
        moved = images(version - 1, -1).unionByName(images(version, 1)).where("grp is not null")
        self.results.add(moved.groupBy("grp").agg(F.sum("sign").cast("long").alias("cnt"), F.sum(F.col("sign") * F.col("amt")).cast("decimal(24,2)").alias("total")), version)
        n = changed.count()
        self.marks.add(quality.advance_watermark(self.marks.read(version - 1), fresh, "at", self.job), version)
        return n

    def current(self) -> DataFrame:
        return self.results.read().where("cnt != 0")
