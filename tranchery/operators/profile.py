"""Column profiles: distributions, top values, missing and distinct counts, date spans.  One pass over the table each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts and percent of each value, null included."""
    counted = df.groupBy(column).agg(F.count("*").alias("cnt"))
    total = F.broadcast(counted.agg(F.sum("cnt").alias("_total")))
    return counted.crossJoin(total).select(column, "cnt", F.round(F.col("cnt") * F.lit(100.0) / F.col("_total"), 3).alias("pct"))


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k most frequent values of each column (ties by value, null first)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")).select("r.*")
    counted = long.groupBy("column_name", "value").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("column_name").orderBy(F.desc("cnt"), F.asc_nulls_first("value"))
    return counted.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def profile(df: DataFrame, approximate: bool = False, samples: int = 5) -> DataFrame:
    """Per column: type, missing count and rate, distinct count and the least sample values.

    Distinct counts and samples come from one (column, value) aggregation, which combines before its shuffle;
    ``approximate`` counts distinct values by sketch in the first pass instead."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(c).cast("string").alias("value")) for c, t in df.dtypes])).alias("r")).select("r.*")
    rate = lambda n, all_: F.round((n / all_).cast("double"), 4)
    if approximate:
        out = long.groupBy("column_name", "data_type").agg(F.count("*").alias("n"), F.count("value").alias("full"), F.approx_count_distinct("value").alias("distinct_values"))
        return out.select("column_name", "data_type", (F.col("n") - F.col("full")).alias("missing"), rate(F.col("n") - F.col("full"), F.col("n")).alias("missing_rate"), "distinct_values")
    values = long.groupBy("column_name", "data_type", "value").agg(F.count("*").alias("n"))
    # the rank is filtered right away, so each task keeps the least values of a column only
    least = values.where("value is not null").withColumn("_rn", F.row_number().over(Window.partitionBy("column_name").orderBy("value"))).where(F.col("_rn") <= samples)
    least = least.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    out = values.groupBy("column_name", "data_type").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("distinct_values"))
    out = out.join(F.broadcast(least), "column_name", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    return out.select("column_name", "data_type", "missing", rate(F.col("missing"), F.col("n")).alias("missing_rate"), "distinct_values", "samples").orderBy(F.desc("missing_rate"), "column_name")


def date_spans(df: DataFrame, columns: list[str], fmt: str = "MMM-yyyy") -> DataFrame:
    """Per text column: how many values parse as dates or fail, and the first and last date."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])).alias("r")).select("r.*")
    d = F.try_to_date("value", fmt)
    return long.groupBy("column_name").agg(F.count(d).alias("parsed"), (F.count("value") - F.count(d)).alias("failed"), F.min(d).alias("first_date"), F.max(d).alias("last_date"))


def sketches(df: DataFrame, lg_k: int = 12, k: int = 200) -> DataFrame:
    """One row per column, from one scan that shuffles one row per task: rows, non-null rows, a sketch of the distinct
    values and, for numbers, one of the quantiles.

    The error of distinct counts is about 1.04 / 2 ** (lg_k / 2), that of ranks about 2.3 / k ** 0.9, whatever the number
    of rows; sketches of parts (days, months) merge to that of the whole."""
    aggs = [F.count("*").alias("n")]
    for i, (c, t) in enumerate(df.dtypes):
        number = t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")
        quantiles = F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)) if number else F.lit(None).cast("binary")
        aggs.append(F.struct(F.count(c).alias("full_n"), F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias("d"), quantiles.alias("q")).alias(f"s{i}"))
    per = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("s")) for i, c in enumerate(df.columns)]))
    return df.agg(*aggs).select("n", per.alias("r")).select("r.column_name", "n", "r.s.full_n", F.col("r.s.d").alias("distinct_sketch"), F.col("r.s.q").alias("quantile_sketch"))


def merged_sketches(parts: DataFrame) -> DataFrame:
    """The sketches of a whole from those of its parts."""
    return parts.groupBy("column_name").agg(F.sum("n").alias("n"), F.sum("full_n").alias("full_n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.when(F.count("quantile_sketch") > 0, F.kll_merge_agg_double("quantile_sketch")).alias("quantile_sketch"))


def sketched_profile(sketched: DataFrame, shares: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Per column: rows, missing rows, estimated distinct values and quantiles (null for texts)."""
    quantiles = F.array(*[F.when(F.col("full_n") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q))) for q in shares])
    return sketched.select("column_name", "n", (F.col("n") - F.col("full_n")).alias("missing"), F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"), F.when(F.col("quantile_sketch").isNotNull(), quantiles).alias("quantiles"))
