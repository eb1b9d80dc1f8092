"""Layer transforms: landing casts, application-time facts, performance facts, dimensions and the month-end snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tranchery.functions import loan as L
from tranchery.sources.layout import write_bounded

# The columns of the raw loan file that are kept, by kind.
NUMERIC = ["loan_amnt", "funded_amnt", "int_rate", "installment", "annual_inc", "dti", "delinq_2yrs", "fico_range_low", "fico_range_high", "inq_last_6mths", "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc", "mort_acc", "pub_rec_bankruptcies", "total_rec_prncp", "total_rec_int", "recoveries", "out_prncp", "total_pymnt", "last_pymnt_amnt"]
TEXT = ["id", "term", "grade", "sub_grade", "emp_length", "home_ownership", "verification_status", "issue_d", "loan_status", "purpose", "title", "addr_state", "zip_code", "earliest_cr_line", "application_type", "last_pymnt_d"]
MOB_MAX = 24
#: loans that one task of a snapshot's write expands, and months whose files it holds open at once
LOANS_PER_TASK, OPEN_FILES = 250_000, 64


def landing_cast(raw: DataFrame, load_time: bool = True) -> DataFrame:
    """Numbers where they parse (else null), trimmed texts (blank is null), and the load time."""
    out = raw.select(*[F.col(c).cast("string").try_cast("double").alias(c) if c in NUMERIC else F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) if c in TEXT else F.col(c) for c in raw.columns])
    return out.withColumn("etl_load_time", F.current_timestamp()) if load_time else out


def bad_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is not all digits (null included)."""
    return df.where(~F.coalesce(F.col(column).rlike("^[0-9]+$"), F.lit(False)))


def guard_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """The same rows; evaluating one whose id is not all digits fails the job."""
    return df.withColumn(column, F.when(F.coalesce(F.col(column).rlike("^[0-9]+$"), F.lit(False)), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("not a loan id: "), F.coalesce(F.col(column), F.lit("null"))))))


def application_facts(raw: DataFrame, lt1_as_zero: bool = False) -> DataFrame:
    """Standardised application-time columns and ``dq_level``: REJECT without key, positive amount or date; WARN also
    for a rate outside 0..40 or an unknown grade; nulls count as flagged."""
    c = F.col
    issue = L.parse_month(c("issue_d"))
    month = F.date_format(issue, "yyyy-MM")
    out = raw.select(
        c("id").cast("string").alias("loan_id"),
        c("loan_amnt").cast("string").try_cast("decimal(14,2)").alias("loan_amnt"),
        c("funded_amnt").cast("string").try_cast("decimal(14,2)").alias("funded_amnt"),
        L.parse_term(c("term")).alias("term_months"),
        L.parse_rate(c("int_rate")).alias("int_rate"),
        c("installment").cast("string").try_cast("decimal(14,2)").alias("installment"),
        F.trim("grade").alias("grade"),
        F.trim("sub_grade").alias("sub_grade"),
        L.parse_emp_length(c("emp_length"), lt1_as_zero).alias("emp_length_years"),
        L.upper_trim(c("home_ownership")).alias("home_ownership"),
        c("annual_inc").cast("string").try_cast("decimal(16,2)").alias("annual_inc"),
        F.trim("verification_status").alias("verification_status"),
        L.norm_purpose(c("purpose")).alias("purpose"),
        L.upper_trim(c("addr_state")).alias("addr_state"),
        c("dti").cast("string").try_cast("decimal(10,4)").alias("dti"),
        c("fico_range_low").cast("string").try_cast("decimal(8,2)").alias("fico_low"),
        c("fico_range_high").cast("string").try_cast("decimal(8,2)").alias("fico_high"),
        issue.alias("issue_date"), month.alias("issue_month"), month.alias("vintage"),
    )
    sure = lambda x: F.coalesce(x, F.lit(False))
    key = c("loan_id").isNotNull() & sure(c("loan_amnt") > 0) & c("issue_date").isNotNull()
    fine = sure(c("int_rate").between(0, 40)) & sure(c("grade").isin(L.GRADES))
    return out.withColumn("dq_level", F.when(~key, "REJECT").when(~fine, "WARN").otherwise("PASS"))


def split_rejects(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return facts.where("dq_level != 'REJECT'"), facts.where("dq_level = 'REJECT'")


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def performance_facts(raw: DataFrame, snapshot_month: str) -> DataFrame:
    """Post-origination columns: status classes, rounded money, last payment date, months on book at the end."""
    c = F.col
    status = F.trim("loan_status")
    last, issue = L.parse_month(c("last_pymnt_d")), L.parse_month(c("issue_d"))
    end = F.lit(snapshot_month).cast("date")
    reference = F.coalesce(F.when(L.is_terminal(status), last), end)
    money = ["total_rec_prncp", "total_rec_int", "recoveries", "out_prncp", "total_pymnt", "last_pymnt_amnt"]
    return raw.select(
        c("id").cast("string").alias("loan_id"), status.alias("loan_status"), L.is_terminal(status).cast("int").alias("is_terminal"), L.is_bad(status).cast("int").alias("is_bad"), L.dpd_bucket(status).alias("dpd_bucket"),
        *[F.round(c(m).cast("string").try_cast("decimal(14,2)"), 2).alias(m) for m in money], last.alias("last_pymnt_d"), L.month_diff(reference, issue).alias("mob_final"),
    )


def applicants(raw: DataFrame) -> DataFrame:
    """One row per loan: applicant columns with income and score bands.  Of rows with one id the greatest stays,
    compared column by column (nulls are least)."""
    c = F.col
    out = raw.select(
        c("id").cast("string").alias("loan_id"), c("annual_inc").cast("string").try_cast("decimal(16,2)").alias("annual_inc"), L.upper_trim(c("home_ownership")).alias("home_ownership"), L.first_number(c("emp_length")).alias("emp_length_years"),
        L.upper_trim(c("addr_state")).alias("addr_state"), c("fico_range_low").cast("string").try_cast("decimal(8,2)").alias("fico_low"), c("dti").cast("string").try_cast("decimal(10,4)").alias("dti"),
    )
    banded = out.withColumn("income_band", L.income_band(c("annual_inc"))).withColumn("fico_band", L.fico_band(c("fico_low")))
    rest = F.struct(*[x for x in banded.columns if x != "loan_id"])
    return banded.where("loan_id is not null").groupBy("loan_id").agg(F.max(rest).alias("r")).select("loan_id", "r.*")


def products(raw: DataFrame) -> DataFrame:
    """Mean rate per term and grade, with code and band."""
    c = F.col
    parsed = raw.select(L.parse_term(c("term")).alias("term_months"), F.trim("grade").alias("grade"), L.parse_rate(c("int_rate")).cast("double").alias("r"))
    mean = parsed.where("term_months is not null and grade is not null").groupBy("term_months", "grade").agg(F.round(F.avg("r"), 4).alias("avg_int_rate"))
    return mean.select(L.product_code(c("term_months"), c("grade")).alias("product_code"), "term_months", "grade", "avg_int_rate", L.rate_band(c("avg_int_rate")).alias("rate_band"))


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day; weekday counts from Monday = 0."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))
    return days.select(
        F.date_format("d", "yyyyMMdd").cast("int").alias("date_key"), F.col("d").alias("full_date"), F.year("d").alias("year_num"), F.quarter("d").alias("quarter_num"), F.month("d").alias("month_num"), F.date_format("d", "MMM").alias("month_name"),
        F.date_format("d", "yyyy-MM").alias("year_month"), F.weekofyear("d").alias("week_of_year"), F.weekday("d").alias("day_of_week"), (F.weekday("d") >= 5).cast("int").alias("is_weekend"),
    )


def month_end_snapshot(raw: DataFrame, end: str, mob_max: int = MOB_MAX, never_paid_from_issue: bool = False, stop_at_payoff: bool = False) -> DataFrame:
    """Each loan with an issue month, once per month from the next one to ``mob_max`` months later or the end.

    Defaults: a loan without payment stays CURRENT until its charge-off; balances are the final ones in every month; a
    paid loan goes on.  ``never_paid_from_issue`` counts its gap from the issue month instead, ``stop_at_payoff``
    ends a fully paid loan's delinquency at its last payment.
    """
    return expand_months(snapshot_loans(raw), end, mob_max, never_paid_from_issue, stop_at_payoff)


def snapshot_loans(raw: DataFrame) -> DataFrame:
    """What the snapshot takes of each loan with an issue month: one narrow row, moved in place of its months."""
    c = F.col
    issue, last = L.parse_month(c("issue_d")), L.parse_month(c("last_pymnt_d"))
    status = F.trim("loan_status")
    return raw.select(
        c("id").cast("string").alias("loan_id"), issue.alias("issue_date"), L.month_index(issue).alias("i"), L.month_index(last).alias("p"), L.is_bad(status).alias("bad"), F.coalesce(L.dpd_bucket(status) == "PAID", F.lit(False)).alias("paid"),
        F.coalesce("out_prncp", F.lit(0).cast("decimal(14,2)")).alias("out_prncp"), F.coalesce("total_rec_prncp", F.lit(0).cast("decimal(14,2)")).alias("total_rec_prncp"), "loan_amnt", F.trim("grade").alias("grade"),
    ).where("issue_date is not null")


def expand_months(loans: DataFrame, end: str, mob_max: int = MOB_MAX, never_paid_from_issue: bool = False, stop_at_payoff: bool = False) -> DataFrame:
    """``snapshot_loans`` as months, each loan's where the loan is; rules as in ``month_end_snapshot``."""
    c = F.col
    off = F.when(c("bad"), F.coalesce(c("p"), c("i") + 12) + 6)
    last_mob = F.least(F.lit(mob_max), L.month_index(F.lit(end).cast("date")) - c("i"))
    rows = loans.withColumn("off", off).withColumn("mob", F.explode(F.sequence(F.lit(1), F.lit(mob_max)))).where(c("mob") <= last_mob)
    rows = rows.withColumn("m", c("i") + c("mob"))
    since = c("i") if never_paid_from_issue else F.lit(None).cast("int")
    gap = F.coalesce(c("m") - F.coalesce(c("p"), since), F.lit(-1))
    if stop_at_payoff:
        gap = F.when(c("paid") & (c("m") >= c("p")), F.lit(-1)).otherwise(gap)
    rows = rows.withColumn("gap", gap)
    bucket = F.when(c("off") <= c("m"), "CHARGED_OFF").when(c("gap") >= 4, "DPD_120_PLUS").when(c("gap") >= 2, "DPD_31_120").when(c("gap") >= 1, "DPD_1_30").otherwise("CURRENT")
    rows = rows.withColumn("dpd_bucket", bucket)
    first = L.month_of_index(c("m"))
    return rows.select(
        "loan_id", F.date_format(first, "yyyy-MM").alias("snapshot_month"), F.last_day(first).alias("snapshot_date"), F.date_format("issue_date", "yyyy-MM").alias("issue_month"), "mob",
        F.greatest("gap", F.lit(0)).alias("months_since_last_pymnt"), "dpd_bucket", (~c("dpd_bucket").isin("CURRENT", "PAID")).cast("int").alias("is_delinquent"), (c("dpd_bucket") == "CHARGED_OFF").cast("int").alias("is_bad_month"),
        "out_prncp", "total_rec_prncp", "loan_amnt", "grade",
    )


def expected_snapshot_rows(raw: DataFrame, end: str, mob_max: int = MOB_MAX) -> DataFrame:
    """The closed form of the snapshot's row count."""
    i = L.month_index(L.parse_month(F.col("issue_d")))
    months = F.greatest(F.lit(0), F.least(F.lit(mob_max), L.month_index(F.lit(end).cast("date")) - i))
    return raw.where(i.isNotNull()).agg(F.coalesce(F.sum(months), F.lit(0)).cast("long").alias("expected_rows"))


def write_snapshot(snapshot: DataFrame, path: str, fmt: str = "parquet", rows_per_file: int = 1_000_000) -> None:
    """One directory per month, replaced where the snapshot has the month; a large month has several files."""
    write_bounded(snapshot, path, "snapshot_month", rows_per_file, "overwrite", fmt)


def deal_by_issue(loans: DataFrame, per_task: int) -> DataFrame:
    """``snapshot_loans`` dealt out over tasks of about ``per_task`` rows, each of neighbouring issue months: a loan's
    place is drawn by hash within its month's share of all loans, so large months get several tasks and small ones share
    one."""
    sizes = loans.groupBy(F.col("i").alias("_i")).agg(F.count("*").alias("_n"))
    known, rows, before = sorted(sizes.collect()), [], 0  # one row per issue month
    for i, n in known:
        rows.append((i, n, before))
        before += n
    plan = loans.sparkSession.createDataFrame(rows, "_i int, _n long, _before long")
    place = F.col("_before") + F.expr("(_u * _n) div 1048576")
    met = loans.join(F.broadcast(plan), F.col("i") == F.col("_i")).withColumn("_u", F.pmod(F.xxhash64(*loans.columns), F.lit(1 << 20)))
    tasks = max(-(-before // per_task), 1)
    return met.withColumn("_task", (place / F.lit(per_task)).cast("int")).repartitionById(tasks, F.col("_task")).select(*loans.columns)


def build_snapshot(raw: DataFrame, end: str, path: str, fmt: str = "parquet", rows_per_file: int = 1_000_000, loans_per_task: int | None = None, **rules) -> None:
    """``month_end_snapshot`` written as by ``write_snapshot``, but loans move instead of their months: dealt out by issue
    month, they are expanded in the task that writes them, with a file per month open (beyond ``OPEN_FILES`` months the
    rest is sorted).  A task has 250,000 loans at most, whatever the input; small inputs are spread over the cores."""
    spark, loans = raw.sparkSession, snapshot_loans(raw)
    if not loans_per_task:
        loans_per_task = min(rows_per_file, LOANS_PER_TASK, max(LOANS_PER_TASK // 10, -(-loans.count() // spark.sparkContext.defaultParallelism)))
    rows = expand_months(deal_by_issue(loans, loans_per_task), end, **rules)
    key = "spark.sql.maxConcurrentOutputFileWriters"
    had = spark.conf.get(key)
    spark.conf.set(key, OPEN_FILES)
    try:
        rows.write.format(fmt).mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_month").save(path)
    finally:
        spark.conf.set(key, had)


def save_snapshot_bucketed(raw: DataFrame, end: str, name: str, path: str, rows_per_bucket: int = 1_000_000, least: int = 16) -> DataFrame:
    """The snapshot bucketed by loan, with as many buckets as its rows call for: their number comes from the closed form,
    and loans are put into their bucket before they are expanded there."""
    rows = expected_snapshot_rows(raw, end).first()[0]
    buckets, by = max(least, -(-rows // rows_per_bucket)), ["loan_id", "snapshot_month"]
    placed = expand_months(snapshot_loans(raw).repartition(buckets, "loan_id"), end)
    placed.sortWithinPartitions(*by).write.mode("overwrite").bucketBy(buckets, "loan_id").sortBy(*by).option("path", path).format("parquet").saveAsTable(name)
    return raw.sparkSession.table(name)


def save_bucketed(df: DataFrame, name: str, path: str, key: str = "loan_id", buckets: int = 16, order: str | None = "snapshot_month") -> DataFrame:
    """A table bucketed by ``key``, one file per bucket: joins and windows by that key read it without a shuffle."""
    by = [key, order] if order else [key]
    df.repartition(buckets, key).sortWithinPartitions(*by).write.mode("overwrite").bucketBy(buckets, key).sortBy(*by).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)
