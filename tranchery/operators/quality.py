"""Data-quality checks, table differ, reconciliation, watermark and lineage checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tranchery.functions import loan as L


def conserved_counts(raw: DataFrame, facts: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row with the row counts n_raw, n_facts and n_rejects, each of its own table; they agree when no row is lost."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(raw, "n_raw").crossJoin(one(facts, "n_facts")).crossJoin(one(rejects, "n_rejects"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("cnt")).where("cnt > 1")


def check_row(df: DataFrame, name: str, level: str, table: str, actual: Column, expected: Column | None = None) -> DataFrame:
    """A one-row check result: ``actual`` and ``expected`` are aggregates over ``df`` (expected: 0)."""
    row = df.agg(actual.cast("long").alias("actual"), (expected if expected is not None else F.lit(0)).cast("long").alias("expected"))
    return row.select(F.lit(name).alias("check_name"), F.lit(level).alias("level"), F.lit(table).alias("table_name"), "actual", "expected", (F.col("actual") == F.col("expected")).alias("passed"))


def report(checks: list[DataFrame], batch: str | None = None) -> DataFrame:
    out = reduce(DataFrame.unionByName, checks)
    return out.withColumn("check_time", F.current_timestamp()).withColumn("batch_id", F.lit(batch)) if batch else out


def failed_errors(result: DataFrame) -> int:
    """Number of failed checks of level ERROR; a run with any is to be stopped."""
    return result.where("level = 'ERROR' and not passed").count()


def leaked_columns(df: DataFrame, forbidden: list[str] = L.POST_ORIGINATION) -> DataFrame:
    names = sorted(set(df.columns) & set(forbidden))
    return df.sparkSession.createDataFrame([(n,) for n in names], "column_name string")


def month_gaps(df: DataFrame, column: str) -> DataFrame:
    """Months missing between the first and the last."""
    present = df.where(F.col(column).isNotNull()).select(F.to_date(F.concat(F.col(column), F.lit("-01"))).alias("m")).distinct()
    every = present.agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return every.join(present, "m", "left_anti").select(F.date_format("m", "yyyy-MM").alias(column))


def full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe full outer join on keys; other columns get the suffixes _l and _r, ``side`` says where a key is."""
    l = left.select(*[F.col(k).alias(f"{k}_l") for k in keys], *[F.col(c).alias(f"{c}_l") for c in left.columns if c not in keys], F.lit(1).alias("_l"))
    r = right.select(*[F.col(k).alias(f"{k}_r") for k in keys], *[F.col(c).alias(f"{c}_r") for c in right.columns if c not in keys], F.lit(1).alias("_r"))
    on = reduce(lambda a, b: a & b, [F.col(f"{k}_l").eqNullSafe(F.col(f"{k}_r")) for k in keys])
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    joined = l.join(r, on, "full_outer").withColumn("side", side)
    merged = [F.when(F.col("_l").isNotNull(), F.col(f"{k}_l")).otherwise(F.col(f"{k}_r")).alias(k) for k in keys]
    return joined.select(*merged, *[c for c in joined.columns if c not in {"_l", "_r", *(f"{k}_{s}" for k in keys for s in "lr")}])


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], tolerance: dict[str, float], quantised: bool = False) -> DataFrame:
    """One row per compared column: rows on one side only, greatest difference, rows over tolerance (null against a
    value counts), and with ``quantised`` the rows whose 4-decimal values differ without being a rounding tie."""
    joined = full_outer(left.select(*keys, *tolerance), right.select(*keys, *tolerance), keys)
    aggs = [F.count_if(F.col("side") == s).alias(s) for s in ("left_only", "right_only", "both")]
    for i, (c, tol) in enumerate(tolerance.items()):
        a, b = F.col(f"{c}_l").cast("double"), F.col(f"{c}_r").cast("double")
        gap, both = F.abs(a - b), F.col("side") == "both"
        odd = both & (a.isNull() != b.isNull())
        aggs += [F.max(F.when(both, gap)).alias(f"d{i}"), F.count_if(odd | (both & (gap > tol))).alias(f"o{i}"), F.count_if(both & (F.round(a, 4) != F.round(b, 4)) & ~L.tie_at_4dp(a) & ~L.tie_at_4dp(b)).alias(f"q{i}")]
    one = joined.agg(*aggs)
    per = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("max_diff"), F.col(f"o{i}").alias("over_tolerance"), F.col(f"q{i}").alias("quantised_mismatch")) for i, c in enumerate(tolerance)]))
    out = one.select("left_only", "right_only", per.alias("r")).select("r.column_name", "left_only", "right_only", "r.max_diff", "r.over_tolerance", "r.quantised_mismatch")
    return out if quantised else out.drop("quantised_mismatch")


def compare_metrics(actual: DataFrame, baseline: DataFrame) -> DataFrame:
    """Named numbers (name, value) against a baseline (name, value, tolerance)."""
    both = baseline.withColumnRenamed("value", "base").join(actual, "name", "left")
    ok = F.coalesce(F.abs(F.col("value") - F.col("base")) <= F.col("tolerance"), F.lit(False))
    return both.select("name", "value", "base", "tolerance", ok.alias("passed"))


def reconcile(batch: DataFrame, stream: DataFrame, key: str) -> DataFrame:
    """Counts and sums per key on both sides; a null key is a key of its own.  Inputs: key, cnt, total."""
    j = full_outer(batch, stream, [key])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cnt, total = zero("cnt_r") - zero("cnt_l"), zero("total_r") - zero("total_l")
    status = F.when(F.col("side") == "left_only", "batch_only").when(F.col("side") == "right_only", "stream_only").when((cnt == 0) & (total == 0), "equal").otherwise("different")
    return j.select(key, F.col("cnt_l").alias("batch_cnt"), F.col("cnt_r").alias("stream_cnt"), cnt.alias("cnt_diff"), F.col("total_l").alias("batch_sum"), F.col("total_r").alias("stream_sum"), total.alias("sum_diff"), status.alias("status"))


def beyond_watermark(df: DataFrame, column: str, marks: DataFrame, job: str) -> DataFrame:
    """Rows above a job's high-water mark (all rows when it has none).  ``marks``: job, mark."""
    mark = marks.where(F.col("job") == job).agg(F.max("mark").alias("_mark"))
    return df.crossJoin(F.broadcast(mark)).where(F.col("_mark").isNull() | (F.col(column) > F.col("_mark"))).drop("_mark")


def advance_watermark(marks: DataFrame, df: DataFrame, column: str, job: str) -> DataFrame:
    """Marks with the job's moved to the greatest value seen; it never falls."""
    new = df.agg(F.max(column).alias("mark")).where("mark is not null").select(F.lit(job).alias("job"), "mark")
    return marks.select("job", "mark").unionByName(new).groupBy("job").agg(F.max("mark").alias("mark"))


def lineage_faults(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges (src, dst, declared_by) that name an unknown table or that only one end declares.  ``tables``: name."""
    ends = edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("name"))
    dangling = ends.join(tables, "name", "left_anti").select("src", "dst", F.concat(F.lit("dangling:"), F.col("name")).alias("fault"))
    up, down = edges.where("declared_by = dst").select("src", "dst"), edges.where("declared_by = src").select("src", "dst")
    one = up.join(down, ["src", "dst"], "left_anti").union(down.join(up, ["src", "dst"], "left_anti")).withColumn("fault", F.lit("one_sided"))
    return dangling.unionByName(one).distinct()


def volume_swing(df: DataFrame, batch: str, back: int = 3, limit: float = 0.5) -> DataFrame:
    """Rows per batch against the mean of the ``back`` batches before; a swing over ``limit`` is flagged."""
    counted = df.groupBy(batch).agg(F.count("*").alias("cnt"))
    mean = F.avg("cnt").over(Window.orderBy(batch).rowsBetween(-back, -1))
    return counted.withColumn("trailing", F.round(mean, 4)).withColumn("swing", F.round(F.col("cnt") / F.nullif(F.col("trailing"), F.lit(0.0)) - 1, 4)).withColumn("flagged", F.coalesce(F.abs("swing") > limit, F.lit(False)))


def monitored(df: DataFrame, time: str, value: str, now: str, fresh_hours: float = 48.0, swing: float = 0.5, back: int = 7, spread: float = 3.0) -> DataFrame:
    """(check_name, day, actual, low, high, status): hours from the last row to ``now``; rows per day against the mean of
    the ``back`` days before, give or take ``swing``; the day's mean value against theirs, give or take ``spread``
    standard deviations.  PASS within the bounds, FAIL outside, NEW where there are no bounds yet, NONE without a value.

    The windows run over one row per day."""
    c = F.col
    hours = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(c(time).cast("timestamp")))) / 3600
    fresh = df.agg(hours.cast("double").alias("actual")).select(F.lit("freshness").alias("check_name"), F.lit(now).alias("day"), "actual", F.lit(0.0).alias("low"), F.lit(fresh_hours).alias("high"))
    days = df.groupBy(F.date_format(time, "yyyy-MM-dd").alias("day")).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("v"))
    w = Window.orderBy("day").rowsBetween(-back, -1)
    days = days.select("day", "n", "v", F.avg("n").over(w).alias("an"), F.avg("v").over(w).alias("av"), F.stddev_samp("v").over(w).alias("sv"))
    volume = days.select(F.lit("volume").alias("check_name"), "day", c("n").alias("actual"), (c("an") * (1 - swing)).alias("low"), (c("an") * (1 + swing)).alias("high"))
    range_ = days.select(F.lit("range").alias("check_name"), "day", c("v").alias("actual"), (c("av") - spread * c("sv")).alias("low"), (c("av") + spread * c("sv")).alias("high"))
    status = F.when(c("actual").isNull(), "NONE").when(c("low").isNull(), "NEW").when(c("actual").between(c("low"), c("high")), "PASS").otherwise("FAIL")
    return fresh.unionByName(volume).unionByName(range_).select("check_name", "day", *[F.round(x, 4).alias(x) for x in ("actual", "low", "high")], status.alias("status"))
