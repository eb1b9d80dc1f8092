"""Queries over single column functions, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranchery.functions import loan as L
from tranchery.operators import layers, metrics, quality
from tranchery.plans import check_sql as S
from tranchery.plans.catalog import query
from tranchery.sources.fixtures import SNAPSHOT_END, loan_raw
from tranchery.sources.tables import read_table

C = F.col


def _column(name: str, make, sql: str):
    """A query of one function over every loan: id and the function's value."""

    @query(name, S.with_parts(f"select id, {sql} as value from loan_raw", "loan_raw"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return loan_raw(spark, sf_dir).select("id", make().alias("value"))

    run.__name__ = name


_column("parse_term", lambda: L.parse_term(C("term")), S.TERM)
_column("parse_rate", lambda: L.parse_rate(C("int_rate")).cast("double"), f"cast({S.RATE_OF} as double)")
_column("parse_month", lambda: L.parse_month(C("issue_d")), S.ISSUE)
_column("parse_emp_length", lambda: L.parse_emp_length(C("emp_length")), S.EMP)
_column("norm_upper_trim", lambda: L.upper_trim(C("home_ownership")), "upper(trim(home_ownership))")
_column("norm_purpose", lambda: L.norm_purpose(C("purpose")), "trim(replace(purpose, '_', ' '))")
_column("income_band", lambda: L.income_band(C("annual_inc")), S.bands("annual_inc", L.INCOME_BANDS))
_column("fico_band", lambda: L.fico_band(C("fico_range_low")), S.bands("fico_range_low", L.FICO_BANDS))
_column("rate_band", lambda: L.rate_band(L.parse_rate(C("int_rate"))), S.bands(S.RATE_OF, L.RATE_BANDS))
_column("product_code", lambda: L.product_code(L.parse_term(C("term")), C("grade")), f"concat_ws('_', cast({S.TERM} as varchar), grade)")
_column("is_bad", lambda: L.is_bad(C("loan_status")), S.BAD)
_column("is_terminal", lambda: L.is_terminal(C("loan_status")), S.TERMINAL)
_column("dpd_bucket", lambda: L.dpd_bucket(C("loan_status")), S.BUCKET)
_column("month_index", lambda: L.month_index(L.parse_month(C("issue_d"))), S.mi(S.ISSUE))
_column("month_str", lambda: L.month_str(L.month_index(L.parse_month(C("issue_d"))) + 5), f"strftime({S.month_of(S.mi(S.ISSUE) + ' + 5')}, '%Y-%m')")
_column("month_end", lambda: F.last_day(L.parse_month(C("issue_d"))), f"last_day({S.ISSUE})")
_column("month_diff", lambda: L.month_diff(L.parse_month(C("last_pymnt_d")), L.parse_month(C("issue_d"))), f"case when {S.LAST} is null then 0 else greatest({S.mi(S.LAST)} - {S.mi(S.ISSUE)}, 0) end")
_column("add_month_str", lambda: L.add_months_str(F.date_format(L.parse_month(C("issue_d")), "yyyy-MM"), -13), f"strftime({S.ISSUE} - to_months(13), '%Y-%m')")
_column("round_n", lambda: F.round(C("annual_inc").cast("decimal(18,4)") / 7, 4).cast("double"), "cast(round(cast(annual_inc as double) / 7, 4) as double)")
_column("safe_div", lambda: C("total_pymnt").cast("double") / F.nullif(C("recoveries").cast("double"), F.lit(0.0)), "cast(total_pymnt as double) / nullif(cast(recoveries as double), 0)")
_column("coalesce_unknown", lambda: F.coalesce("grade", F.lit(L.UNKNOWN)), "coalesce(grade, 'UNKNOWN')")
_column("null_sentinel", lambda: L.null_key(F.when(C("dti") == 3, " nan ").when(C("dti") == 4, "  ").otherwise(C("grade"))), "case when dti = 3 or dti = 4 or grade is null then '__NULL__' else grade end")
_column("tie_at_4dp", lambda: L.tie_at_4dp(C("total_pymnt").cast("double") / 80000 + 0.00005), "abs((cast(total_pymnt as double) / 80000 + 0.00005) * 1e4 - floor((cast(total_pymnt as double) / 80000 + 0.00005) * 1e4) - 0.5) < 1e-6")


@query("skew_ratio", "with c as (select l_returnflag k, count(*) n from lineitem group by 1) select k, round(cast(n as double) / (select sum(n) from c) * (select count(*) from c), 4) skew_ratio from c")
def skew_ratio(spark, sf_dir):
    return metrics.key_shares(read_table(spark, sf_dir, "lineitem"), "l_returnflag").select(C("key").alias("k"), "skew_ratio")


@query("case_flag_sum", S.with_parts("select count(*) filter (grade is null) null_grade, count(*) filter (fico_range_low is null) null_fico, count(*) filter (last_pymnt_d is null) null_last from loan_raw", "loan_raw"))
def case_flag_sum(spark, sf_dir):
    null = lambda c: F.count_if(C(c).isNull())
    return loan_raw(spark, sf_dir).agg(null("grade").alias("null_grade"), null("fico_range_low").alias("null_fico"), null("last_pymnt_d").alias("null_last"))


@query("len_max", S.with_parts("select max(length(id)) len_max from loan_raw", "loan_raw"))
def len_max(spark, sf_dir):
    return loan_raw(spark, sf_dir).agg(F.max(F.length("id")).alias("len_max"))


@query("ts_diff_ms", "select event_id, cast(date_diff('microsecond', date_trunc('hour', ts), ts) as double) / 1000 ms from events")
def ts_diff_ms(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", L.ts_diff_ms(C("ts").cast("timestamp"), F.date_trunc("hour", C("ts").cast("timestamp"))).alias("ms"))


@query("salt")
def salt(spark, sf_dir):
    return loan_raw(spark, sf_dir).groupBy(L.salt(C("id"), 10).alias("salt")).agg(F.count("*").alias("cnt"))


_DATES = "select cast(unnest(generate_series(date '1995-01-01', date '2001-12-31', interval 1 day)) as date) d"
_DAY = "cast(strftime(d, '%Y%m%d') as integer) date_key, d full_date, year(d) year_num, quarter(d) quarter_num, month(d) month_num, strftime(d, '%b') month_name, strftime(d, '%Y-%m') year_month, weekofyear(d) week_of_year, isodow(d) - 1 day_of_week, cast(isodow(d) >= 6 as integer) is_weekend"


@query("dim_date", f"select {_DAY} from ({_DATES}) where d between (select cast(date_trunc('year', min(o_orderdate)) as date) from orders) and (select last_day(cast(max(o_orderdate) as date)) from orders)")
def dim_date(spark, sf_dir):
    first, last = read_table(spark, sf_dir, "orders").agg(F.date_trunc("year", F.min("o_orderdate")).cast("date"), F.last_day(F.max("o_orderdate"))).first()
    return layers.calendar(spark, str(first), str(last))


@query("date_parts", f"select o_orderkey, week_of_year, day_of_week, is_weekend from (select {_DAY}, o_orderkey from (select cast(o_orderdate as date) d, o_orderkey from orders))")
def date_parts(spark, sf_dir):
    d = C("o_orderdate")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.weekofyear(d).alias("week_of_year"), F.weekday(d).alias("day_of_week"), (F.weekday(d) >= 5).cast("int").alias("is_weekend"))


# filters


@query("terminal_filter", S.with_parts("select loan_id, loan_status from perf where is_terminal = 1", "perf"))
def terminal_filter(spark, sf_dir):
    return layers.performance_facts(loan_raw(spark, sf_dir), SNAPSHOT_END).where("is_terminal = 1").select("loan_id", "loan_status")


@query("mob_between", S.with_parts("select mob, count(*) cnt from snap where mob between 6 and 12 group by mob", "snap"))
def mob_between(spark, sf_dir):
    return layers.month_end_snapshot(loan_raw(spark, sf_dir), SNAPSHOT_END).where(C("mob").between(6, 12)).groupBy("mob").agg(F.count("*").alias("cnt"))


@query("month_range_filter", S.with_parts("select issue_month, count(*) cnt from facts where issue_month between '1997-01' and '1997-12' group by 1", "facts"))
def month_range_filter(spark, sf_dir):
    return _facts(spark, sf_dir).where(C("issue_month").between("1997-01", "1997-12")).groupBy("issue_month").agg(F.count("*").alias("cnt"))


@query("mod_sample", S.with_parts("select loan_id, grade from facts where cast(loan_id as bigint) % 4 = 0", "facts"))
def mod_sample(spark, sf_dir):
    return _facts(spark, sf_dir).where(F.pmod(C("loan_id").cast("long"), F.lit(4)) == 0).select("loan_id", "grade")


@query("id_guard", "select count(*) bad_ids from (select cast(c_custkey as varchar) id from customer union all select c_name from customer where c_custkey % 100 = 0) where not regexp_matches(id, '^[0-9]+$')")
def id_guard(spark, sf_dir):
    customer = read_table(spark, sf_dir, "customer")
    ids = customer.select(C("c_custkey").cast("string").alias("id")).union(customer.where("c_custkey % 100 = 0").select("c_name"))
    return layers.bad_ids(ids).agg(F.count("*").alias("bad_ids"))


@query("leak_guard_project", "select unnest(['last_pymnt_amnt','last_pymnt_d','loan_status','out_prncp','recoveries','total_pymnt','total_rec_int','total_rec_prncp']) column_name")
def leak_guard_project(spark, sf_dir):
    return quality.leaked_columns(loan_raw(spark, sf_dir))


@query("quantile_outliers", S.with_parts("select count(*) filter (annual_inc <= 0) nonpositive, min(cast(annual_inc as double)) lo, max(cast(annual_inc as double)) hi, quantile_cont(cast(annual_inc as double), 0.5) q50, quantile_cont(cast(annual_inc as double), 0.9) q90, quantile_cont(cast(annual_inc as double), 0.99) q99, quantile_cont(cast(dti as double), 0.9) dti_q90 from loan_raw", "loan_raw"))
def quantile_outliers(spark, sf_dir):
    inc = C("annual_inc").cast("double")
    q = lambda c, p: F.percentile(c, p)
    return loan_raw(spark, sf_dir).agg(F.count_if(inc <= 0).alias("nonpositive"), F.min(inc).alias("lo"), F.max(inc).alias("hi"), q(inc, 0.5).alias("q50"), q(inc, 0.9).alias("q90"), q(inc, 0.99).alias("q99"), q(C("dti").cast("double"), 0.9).alias("dti_q90"))


# sorts, limits, sets


@query("order_by_key", S.with_parts("select grade, count(*) cnt from facts group by grade order by grade", "facts"))
def order_by_key(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("cnt")).orderBy("grade")


@query("order_desc", S.with_parts("select loan_status, count(*) cnt from perf group by 1 order by cnt desc, loan_status", "perf"))
def order_desc(spark, sf_dir):
    return layers.performance_facts(loan_raw(spark, sf_dir), SNAPSHOT_END).groupBy("loan_status").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "loan_status")


@query("limit_n", S.with_parts("select loan_id, cast(funded_amnt as double) funded from facts order by funded_amnt desc, loan_id limit 20", "facts"))
def limit_n(spark, sf_dir):
    return _facts(spark, sf_dir).orderBy(F.desc("funded_amnt"), "loan_id").limit(20).select("loan_id", C("funded_amnt").cast("double").alias("funded"))


@query("topk_per_group", S.with_parts("select grade, loan_id, cast(funded_amnt as double) funded from (select *, row_number() over (partition by grade order by funded_amnt desc, loan_id) rn from facts) where rn <= 5", "facts"))
def topk_per_group(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("grade").orderBy(F.desc("funded_amnt"), "loan_id")
    return _facts(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("grade", "loan_id", C("funded_amnt").cast("double").alias("funded"))


@query("union_all", "select 'orders' t, count(*) cnt from orders union all select 'customer', count(*) from customer")
def union_all(spark, sf_dir):
    count = lambda n: read_table(spark, sf_dir, n).agg(F.lit(n).alias("t"), F.count("*").alias("cnt"))
    return count("orders").unionByName(count("customer"))


@query("distinct_values", S.with_parts("select distinct loan_status from perf", "perf"))
def distinct_values(spark, sf_dir):
    return layers.performance_facts(loan_raw(spark, sf_dir), SNAPSHOT_END).select("loan_status").distinct()


@query("except_keys", "select c_custkey k from customer except select o_custkey from orders")
def except_keys(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select(C("c_custkey").alias("k")).subtract(read_table(spark, sf_dir, "orders").select("o_custkey"))


@query("intersect_keys", "select c_custkey k from customer where c_nationkey < 5 intersect select o_custkey from orders where o_orderstatus = 'F'")
def intersect_keys(spark, sf_dir):
    left = read_table(spark, sf_dir, "customer").where("c_nationkey < 5").select(C("c_custkey").alias("k"))
    return left.intersect(read_table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("weighted_avg", S.with_parts("select home_ownership, round(cast(sum(funded_amnt * int_rate) as double) / cast(sum(funded_amnt) as double), 4) avg_rate from facts where int_rate is not null and funded_amnt is not null group by 1", "facts"))
def weighted_avg(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("home_ownership").agg(F.round(L.weighted_avg(C("int_rate"), C("funded_amnt")), 4).alias("avg_rate"))


@query("terminal_bad_rate", S.with_parts("select round(cast(sum(is_bad) filter (is_terminal = 1) as double) / count(*) filter (is_terminal = 1), 6) bad_rate, round(cast(sum(is_bad) as double) / count(*), 6) wrong_rate from perf", "perf"))
def terminal_bad_rate(spark, sf_dir):
    perf = layers.performance_facts(loan_raw(spark, sf_dir), SNAPSHOT_END)
    ended = C("is_terminal") == 1
    return perf.agg(L.ratio(F.sum(F.when(ended, C("is_bad"))), F.count_if(ended)).alias("bad_rate"), L.ratio(F.sum("is_bad"), F.count("*")).alias("wrong_rate"))


def _facts(spark, sf_dir):
    return layers.split_rejects(layers.application_facts(loan_raw(spark, sf_dir)))[0]
