"""The loan tables that the queries use, mapped from the given orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranchery.sources.tables import read_table

SNAPSHOT_END = "2001-12-01"
#: the columns of loan_raw
LOAN_NUMBERS = ["loan_amnt", "funded_amnt", "installment", "annual_inc", "dti", "fico_range_low", "fico_range_high", "out_prncp", "total_rec_prncp", "total_rec_int", "recoveries", "total_pymnt", "last_pymnt_amnt"]
LOAN_TEXTS = ["id", "term", "int_rate", "grade", "sub_grade", "emp_length", "home_ownership", "verification_status", "purpose", "addr_state", "issue_d", "loan_status", "last_pymnt_d"]


def loan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    digit = lambda n: (k % n).cast("string")
    money = lambda n: (k % n).cast("decimal(14,2)")
    grade = F.when(k % 211 != 0, F.substring(F.lit("ABCDEFG"), (1 + k % 7).cast("int"), F.lit(1)))
    choose = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (1 + k % n).cast("int"))
    closed = F.when(k % 5 == 0, "Charged Off").when(k % 97 == 0, "Default").when(k % 89 == 0, "Does not meet the credit policy. Status:Fully Paid").otherwise("Fully Paid")
    pending = choose(4, ["In Grace Period", "Late (16-30 days)", "Late (31-120 days)", "Does not meet the credit policy. Status:Charged Off"])
    years = k % 12
    fico = F.when(c % 101 != 0, (630 + 10 * (c % 18)).cast("decimal(8,2)"))
    joined = orders.join(customer, F.col("o_custkey") == c)
    return joined.select(
        k.cast("string").alias("id"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("loan_amnt"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("funded_amnt"),
        F.when(k % 3 == 0, " 60 months").otherwise(" 36 months").alias("term"),
        F.concat((5 + k % 25).cast("string"), F.lit("."), F.lpad(digit(100), 2, "0"), F.lit("%")).alias("int_rate"),
        F.lit(None).cast("decimal(14,2)").alias("installment"),
        grade.alias("grade"),
        F.when(k % 211 != 0, F.concat(grade, (1 + k % 5).cast("string"))).alias("sub_grade"),
        F.when(years == 0, "< 1 year").when(years == 10, "10+ years").when(years == 11, "n/a").otherwise(F.concat(years.cast("string"), F.lit(" years"))).alias("emp_length"),
        choose(3, [" rent", "Mortgage", "OWN "]).alias("home_ownership"),
        ((F.col("c_acctbal") + 1000) * 20).cast("decimal(16,2)").alias("annual_inc"),
        choose(3, ["Verified", "Source Verified", "Not Verified"]).alias("verification_status"),
        choose(4, ["debt_consolidation", "credit_card", "home_improvement", "other"]).alias("purpose"),
        F.concat(F.lit("n"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("addr_state"),
        (k % 40).cast("decimal(10,4)").alias("dti"),
        fico.alias("fico_range_low"),
        (fico + 4).cast("decimal(8,2)").alias("fico_range_high"),
        F.date_format("o_orderdate", "MMM-yyyy").alias("issue_d"),
        F.when(F.col("o_orderstatus") == "F", closed).when(F.col("o_orderstatus") == "O", " Current ").when(F.col("o_orderstatus") == "P", pending).alias("loan_status"),
        F.when(k % 67 != 0, F.date_format(F.add_months(F.col("o_orderdate").cast("date"), (k % 30).cast("int")), "MMM-yyyy")).alias("last_pymnt_d"),
        money(1000).alias("out_prncp"), money(5000).alias("total_rec_prncp"), money(700).alias("total_rec_int"), money(90).alias("recoveries"), money(6000).alias("total_pymnt"), money(400).alias("last_pymnt_amnt"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``loan_raw`` as comma lines with a header, footers at fixed places, a blank line, and a late-filled column."""
    loans = loan_raw(spark, sf_dir)
    key = F.col("id").cast("long")
    late = F.when(key >= 1000, F.lit("x")).otherwise("")
    text = F.concat_ws(",", "id", F.col("loan_amnt").cast("string"), "term", "int_rate", F.coalesce("grade", F.lit("")), "issue_d", "loan_status", late)
    data = loans.select(key.alias("at"), text.alias("value"))
    footer = loans.where(key % 500 == 250).select(key.alias("at"), F.concat(F.lit("Total amount funded in policy code "), (key % 3).cast("string"), F.lit(": 1000")).alias("value"))
    title = loans.where(key % 1000 == 700).select(key.alias("at"), F.lit("Loans that do not meet the credit policy").alias("value"))
    other = spark.createDataFrame([(-1, ",".join(RAW_COLUMNS)), (9, "")], "at long, value string")
    return data.unionByName(footer).unionByName(title).unionByName(other)


RAW_COLUMNS = ["id", "loan_amnt", "term", "int_rate", "grade", "issue_d", "loan_status", "note"]


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log that ``events`` gives: seq, pk, op_ts, op (c, u, d), before and after (grp, amt)."""
    from pyspark.sql import Window

    events = read_table(spark, sf_dir, "events")
    image = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("grp"), F.col("value").cast("decimal(14,2)").alias("amt"))
    after = F.when(F.col("event_type") != "error", image)
    e = events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("pk"), F.col("ts").alias("op_ts"), after.alias("after"))
    e = e.withColumn("before", F.lag("after").over(Window.partitionBy("pk").orderBy("seq")))
    op = F.when(F.col("after").isNull(), "d").when(F.col("before").isNull(), "c").otherwise("u")
    return e.where("before is not null or after is not null").select("seq", "pk", "op_ts", op.alias("op"), "before", "after")
