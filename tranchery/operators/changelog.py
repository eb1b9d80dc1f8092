"""Change logs as tables: signed rows, latest state, versions, differences of two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signed_rows(changes: DataFrame) -> DataFrame:
    """A change as its retraction (-1, before) and its addition (+1, after)."""
    images = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("row")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("row"))))
    return changes.select("pk", "op_ts", images.alias("s")).where("s.row is not null").select("pk", "op_ts", "s.sign", "s.row.*")


def running_totals(signed: DataFrame, key: str = "grp", value: str = "amt") -> DataFrame:
    """Rows and sum of what is current, per key; keys without rows left out."""
    totals = signed.groupBy(key).agg(F.sum("sign").alias("cnt"), F.sum(F.col("sign") * F.col(value)).alias("total"))
    return totals.where("cnt != 0")


def latest_per_key(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key, ties broken by the later order columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def mirror(changes: DataFrame, keys: list[str] = ("pk",), order: list[str] = ("op_ts", "seq")) -> DataFrame:
    """The current state: each key's last image, deleted keys left out."""
    return latest_per_key(changes, list(keys), list(order)).where("op != 'd'")


def as_of(changes: DataFrame, version: int, batch: str = "batch_id") -> DataFrame:
    """The state after the batches up to ``version``."""
    return mirror(changes.where(F.col(batch) <= version))


def diff_versions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The changes (c, u, d) that lead from one version of a table to another, with both images."""
    values = [c for c in new.columns if c not in keys]
    image = lambda: F.struct(*values)
    a = old.select(*[F.col(k).alias(f"{k}_a") for k in keys], image().alias("before"))
    b = new.select(*[F.col(k).alias(f"{k}_b") for k in keys], image().alias("after"))
    on = [F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b")) for k in keys]
    joined = a.join(b, on, "full_outer")
    op = F.when(F.col("before").isNull(), "c").when(F.col("after").isNull(), "d").otherwise("u")
    merged = [F.when(F.col("after").isNotNull(), F.col(f"{k}_b")).otherwise(F.col(f"{k}_a")).alias(k) for k in keys]
    return joined.where(~F.col("before").eqNullSafe(F.col("after"))).select(*merged, op.alias("op"), "before", "after")
