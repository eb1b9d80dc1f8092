"""Risk metrics over facts and snapshots: segments, monthly delinquency, vintages, roll rates, skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tranchery.functions import loan as L


def _segment_aggs() -> list[Column]:
    return [
        F.count("*").alias("loan_cnt"), F.sum("funded_amnt").cast("double").alias("total_amnt"), F.sum("is_bad").alias("bad_cnt"), L.ratio(F.sum("is_bad"), F.count("*")).alias("bad_rate"),
        F.round(L.weighted_avg(F.col("int_rate"), F.col("funded_amnt")), 4).alias("avg_int_rate"),
    ]


def terminal(facts: DataFrame, perf: DataFrame) -> DataFrame:
    """Facts joined to the performance of terminal loans, the only ones in a bad-rate denominator."""
    return facts.join(perf.where("is_terminal = 1").select("loan_id", "is_bad", "is_terminal"), "loan_id")


def risk_segment(terminal_loans: DataFrame, column: str) -> DataFrame:
    return terminal_loans.groupBy(F.lit(column).alias("dim_type"), F.col(column).alias("dim_value")).agg(*_segment_aggs())


def risk_segments(terminal_loans: DataFrame, columns: list[str]) -> DataFrame:
    """All segment types in one scan: each loan is spread over its (type, value) pairs before one aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dim_type"), F.col(c).alias("dim_value")) for c in columns]))
    spread = terminal_loans.select("funded_amnt", "is_bad", "int_rate", pairs.alias("d"))
    return spread.groupBy("d.dim_type", "d.dim_value").agg(*_segment_aggs())


def delinquency(snapshot: DataFrame) -> DataFrame:
    n = F.count("*")
    return snapshot.groupBy("issue_month", "mob").agg(n.alias("loan_cnt"), F.sum("is_bad_month").alias("bad_cnt"), F.sum("is_delinquent").alias("delinq_cnt"), L.ratio(F.sum("is_delinquent"), n).alias("delinq_rate"), L.ratio(F.sum("is_bad_month"), n).alias("bad_rate"), F.sum("out_prncp").cast("double").alias("outstanding_amt"))


def ever_bad(snapshot: DataFrame) -> DataFrame:
    """Whether the loan has been bad in this month or before."""
    w = Window.partitionBy("issue_month", "loan_id").orderBy("mob").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return snapshot.withColumn("ever_bad", F.max("is_bad_month").over(w))


def vintage(snapshot: DataFrame, levels: str = "both", monotone: bool = False, mob_max: int = 24) -> DataFrame:
    """Cumulative bad rate per issue month, grade and month on book: by ``grade``, for ``all`` loans, or ``both`` from one scan.

    ``monotone``: the flag never falls back within a loan (as month_end_snapshot gives it), so it is its own running
    maximum and no window over loans is needed.
    """
    given = snapshot.where(F.col("mob").between(1, mob_max))
    flagged = given.withColumn("ever_bad", F.col("is_bad_month")) if monotone else ever_bad(given)
    flagged = flagged.withColumn("g", F.coalesce("grade", F.lit(L.UNKNOWN)))
    aggs = [L.ratio(F.sum("ever_bad"), F.count("*")).alias("bad_rate"), F.count("*").alias("exposure_cnt")]
    if levels == "grade":
        return flagged.groupBy("issue_month", F.col("g").alias("grade"), "mob").agg(*aggs)
    if levels == "all":
        return flagged.groupBy("issue_month", F.lit("ALL").alias("grade"), "mob").agg(*aggs)
    sets = flagged.groupingSets([["issue_month", "g", "mob"], ["issue_month", "mob"]], "issue_month", "g", "mob").agg(*aggs, F.grouping("g").alias("all_grades"))
    return sets.select("issue_month", F.when(F.col("all_grades") == 1, "ALL").otherwise(F.col("g")).alias("grade"), "mob", "bad_rate", "exposure_cnt")


def recent_months(snapshot: DataFrame, months: int) -> DataFrame:
    """The snapshot's last ``months`` + 1 months, by a filter on both sides of the month (so partitions prune)."""
    last = snapshot.agg(F.max("snapshot_month")).first()[0] or "0000-01"
    y, m = divmod(int(last[:4]) * 12 + int(last[5:7]) - 1 - months, 12)
    return snapshot.where(F.col("snapshot_month").between(f"{y:04d}-{m + 1:02d}", last))


def next_month_pairs(snapshot: DataFrame) -> DataFrame:
    """Each loan's bucket beside that of the next month, by self join."""
    a = snapshot.select("loan_id", F.col("snapshot_month").alias("from_month"), F.col("dpd_bucket").alias("from_bucket"), L.add_months_str(F.col("snapshot_month"), 1).alias("to_month"))
    b = snapshot.select("loan_id", F.col("snapshot_month").alias("to_month"), F.col("dpd_bucket").alias("to_bucket"))
    return a.join(b, ["loan_id", "to_month"])


def next_month_lead(snapshot: DataFrame) -> DataFrame:
    """The same by one window instead of a join, for snapshots whose months follow one another."""
    w = Window.partitionBy("loan_id").orderBy("snapshot_month")
    out = snapshot.select("loan_id", F.col("snapshot_month").alias("from_month"), F.col("dpd_bucket").alias("from_bucket"), F.lead("dpd_bucket").over(w).alias("to_bucket"), F.lead("snapshot_month").over(w).alias("to_month"))
    return out.where(F.col("to_month") == L.add_months_str(F.col("from_month"), 1))


def roll_rates(snapshot: DataFrame, months: int = 12, by_join: bool = False) -> DataFrame:
    """Counts and shares of bucket changes into the next month; loans without a next month are not counted.

    One window per loan serves snapshots that hold a loan once per month; ``by_join`` serves others.  A snapshot
    bucketed by loan (``layers.save_bucketed``) needs no shuffle for the window."""
    recent = recent_months(snapshot, months).where("loan_id is not null")
    pairs = next_month_pairs(recent) if by_join else next_month_lead(recent)
    counted = pairs.groupBy("from_month", "from_bucket", "to_bucket").agg(F.count("*").alias("cnt"))
    return counted.withColumn("rate", L.ratio(F.col("cnt"), F.sum("cnt").over(Window.partitionBy("from_month", "from_bucket"))))


def key_shares(df: DataFrame, key: str) -> DataFrame:
    """Per key: count, share of all rows, and skew ratio (share times number of keys)."""
    counted = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("cnt"))
    totals = counted.agg(F.sum("cnt").alias("total"), F.count("*").alias("keys"))
    share = F.col("cnt").cast("double") / F.col("total").cast("double")
    return counted.crossJoin(F.broadcast(totals)).select("key", "cnt", F.round(share, 6).alias("share"), F.round(L.skew_ratio(share, F.col("keys")), 4).alias("skew_ratio"))


def salted_sums(df: DataFrame, keys: list[str], value: str, buckets: int, salt_by: str) -> DataFrame:
    """Two-stage aggregation: per (key, salt), then per key.  For aggregates that decompose."""
    first = df.groupBy(*keys, L.salt(F.col(salt_by), buckets).alias("_salt")).agg(F.count("*").alias("c"), F.sum(value).alias("s"))
    return first.groupBy(*keys).agg(F.sum("c").alias("cnt"), F.sum("s").cast("double").alias("total"))
