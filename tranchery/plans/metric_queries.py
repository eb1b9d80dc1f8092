"""Queries over risk metrics, profiles, windows and skew."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tranchery.operators import layers, metrics, profile, skew
from tranchery.plans import check_sql as S
from tranchery.plans.catalog import query
from tranchery.plans.layer_queries import _facts, _perf, _snapshot, terminal_loans
from tranchery.plans.scratch import scratch
from tranchery.sources.fixtures import LOAN_NUMBERS, LOAN_TEXTS, SNAPSHOT_END, loan_raw
from tranchery.sources.tables import read_table

C = F.col
_AGG = "count(*) loan_cnt, cast(sum(funded_amnt) as double) total_amnt, cast(sum(is_bad) as bigint) bad_cnt, round(cast(sum(is_bad) as double) / count(*), 6) bad_rate, round(cast(sum(funded_amnt * int_rate) as double) / cast(sum(funded_amnt) as double), 4) avg_int_rate"


def _segment_sql(column):
    return f"select '{column}' dim_type, {column} dim_value, {_AGG} from term group by {column}"


def _segment(name, column):
    @query(name, S.with_parts(_segment_sql(column), "term"))
    def run(spark, sf_dir):
        loans = metrics.terminal(_facts(spark, sf_dir), _perf(spark, sf_dir)) if column == "grade" else terminal_loans(spark, sf_dir)
        return metrics.risk_segment(loans, column)

    run.__name__ = name


_segment("risk_segment_grade", "grade")
_segment("risk_segment_income", "income_band")
_segment("risk_segment_fico", "fico_band")


@query("risk_segment", S.with_parts(" union all ".join(_segment_sql(c) for c in ("grade", "income_band", "fico_band")), "term"))
def risk_segment(spark, sf_dir):
    return metrics.risk_segments(terminal_loans(spark, sf_dir), ["grade", "income_band", "fico_band"])


@query("delinq_monthly", S.with_parts("select issue_month, mob, count(*) loan_cnt, cast(sum(is_bad_month) as bigint) bad_cnt, cast(sum(is_delinquent) as bigint) delinq_cnt, round(cast(sum(is_delinquent) as double) / count(*), 6) delinq_rate, round(cast(sum(is_bad_month) as double) / count(*), 6) bad_rate, cast(sum(out_prncp) as double) outstanding_amt from snap group by 1, 2", "snap"))
def delinq_monthly(spark, sf_dir):
    return metrics.delinquency(_snapshot(spark, sf_dir))


@query("vintage_grade", S.with_parts("select * from vintage where grade <> 'ALL'", "vintage"))
def vintage_grade(spark, sf_dir):
    return metrics.vintage(_snapshot(spark, sf_dir), "grade")


@query("vintage_all", S.with_parts("select * from vintage where grade = 'ALL'", "vintage"))
def vintage_all(spark, sf_dir):
    return metrics.vintage(_snapshot(spark, sf_dir), "all")


@query("vintage", S.with_parts("select * from vintage", "vintage"))
def vintage(spark, sf_dir):
    return metrics.vintage(_snapshot(spark, sf_dir))


@query("vintage_monotone_form", S.with_parts("select * from vintage", "vintage"))
def vintage_monotone_form(spark, sf_dir):
    return metrics.vintage(_snapshot(spark, sf_dir), monotone=True)


@query("roll_rate", S.with_parts("select * from roll", "roll"))
def roll_rate(spark, sf_dir):
    return metrics.roll_rates(_snapshot(spark, sf_dir))


@query("roll_rate_bucketed", S.with_parts("select * from roll", "roll"))
def roll_rate_bucketed(spark, sf_dir):
    """The same from a snapshot that is kept bucketed by loan."""
    return metrics.roll_rates(layers.save_snapshot_bucketed(loan_raw(spark, sf_dir), SNAPSHOT_END, f"tranchery_snapshot_{uuid.uuid4().hex}", scratch(spark, "bucketed")))


@query("ever_bad_flag", S.with_parts("select issue_month, mob, cast(sum(ever_bad) as bigint) ever_bad from flagged group by 1, 2", "flagged"))
def ever_bad_flag(spark, sf_dir):
    return metrics.ever_bad(_snapshot(spark, sf_dir).where(C("mob").between(1, 24))).groupBy("issue_month", "mob").agg(F.sum("ever_bad").alias("ever_bad"))


@query("share_of_group", S.with_parts("select from_month, from_bucket, to_bucket, rate from roll", "roll"))
def share_of_group(spark, sf_dir):
    return metrics.roll_rates(_snapshot(spark, sf_dir)).drop("cnt")


@query("share_of_total", "select l_linestatus, l_returnflag, round(cast(count(*) as double) / (select count(*) from lineitem), 6) share from lineitem group by 1, 2")
def share_of_total(spark, sf_dir):
    counted = read_table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("cnt"))
    total = F.broadcast(counted.agg(F.sum("cnt").alias("total")))
    return counted.crossJoin(total).select("l_linestatus", "l_returnflag", F.round(C("cnt").cast("double") / C("total"), 6).alias("share"))


@query("status_distribution", S.with_parts("select trim(loan_status) loan_status, count(*) cnt, round(count(*) * 100.0::double / (select count(*) from loan_raw), 3) pct from loan_raw group by 1", "loan_raw"))
def status_distribution(spark, sf_dir):
    return profile.distribution(loan_raw(spark, sf_dir).select(F.trim("loan_status").alias("loan_status")), "loan_status")


_ENUMS = ["grade", "term", "home_ownership", "purpose", "verification_status"]


@query("enum_topk_counts", S.with_parts("select column_name, value, cnt from (select *, row_number() over (partition by column_name order by cnt desc, value nulls first) rn from (" + " union all ".join(f"select '{c}' column_name, {c} as value, count(*) cnt from loan_raw group by {c}" for c in _ENUMS) + ")) where rn <= 15", "loan_raw"))
def enum_topk_counts(spark, sf_dir):
    return profile.top_values(loan_raw(spark, sf_dir), _ENUMS, 15)


@query("column_profile", S.with_parts(" union all ".join(f"select '{c}' column_name, count(*) - count({c}) missing, round(cast(count(*) - count({c}) as double) / count(*), 4) missing_rate, count(distinct {c}) distinct_values, min(cast({c} as varchar)) least from loan_raw" for c in LOAN_TEXTS + LOAN_NUMBERS), "loan_raw"))
def column_profile(spark, sf_dir):
    return profile.profile(loan_raw(spark, sf_dir)).select("column_name", "missing", "missing_rate", "distinct_values", F.get("samples", F.lit(0)).alias("least"))


@query("time_span_parse", S.with_parts(" union all ".join(f"select '{c}' column_name, count(try_strptime({c}, '%b-%Y')) parsed, count({c}) - count(try_strptime({c}, '%b-%Y')) failed, cast(min(try_strptime({c}, '%b-%Y')) as date) first_date, cast(max(try_strptime({c}, '%b-%Y')) as date) last_date from loan_raw" for c in ("issue_d", "last_pymnt_d")), "loan_raw"))
def time_span_parse(spark, sf_dir):
    return profile.date_spans(loan_raw(spark, sf_dir), ["issue_d", "last_pymnt_d"])


_FACTS = ["loan_id", "loan_amnt", "funded_amnt", "term_months", "int_rate", "grade", "sub_grade", "home_ownership", "annual_inc", "dti", "fico_low", "issue_month", "addr_state"]
_NUMBERS = ["loan_amnt", "funded_amnt", "term_months", "int_rate", "annual_inc", "dti", "fico_low"]


@query("column_sketches", S.with_parts(" union all ".join(f"select '{c}' column_name, count(*) n, count(*) - count({c}) missing, true distinct_close, true quantiles_close from facts" for c in _FACTS), "facts"))
def column_sketches(spark, sf_dir):
    """Sketches of each year, merged, against exact figures: distinct values within 5 %, ranks of quantiles within 3 %."""
    facts = _facts(spark, sf_dir).select(*_FACTS)
    path, year = scratch(spark, "sketches"), F.substring("issue_month", 1, 4)
    for (y,) in facts.select(year).distinct().collect():
        profile.sketches(facts.where(year == y)).write.mode("append").parquet(path)
    got = profile.sketched_profile(profile.merged_sketches(spark.read.parquet(path)), _SHARES)
    exact = facts.agg(*[F.count_distinct(c).alias(f"d_{c}") for c in _FACTS])
    exact = exact.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), C(f"d_{c}").alias("exact")) for c in _FACTS])).alias("r")).select("r.*")
    found = got.join(exact, "column_name").select("column_name", "n", "missing", (F.abs(C("distinct_values") / C("exact") - 1) <= 0.05).alias("distinct_close"), "quantiles").collect()
    close = facts.agg(*[_ranks_close(r["column_name"], r["quantiles"]).alias(r["column_name"]) for r in found if r["quantiles"]]).first()
    rows = [(r["column_name"], r["n"], r["missing"], r["distinct_close"], r["column_name"] not in close or close[r["column_name"]]) for r in found]
    return spark.createDataFrame(rows, "column_name string, n long, missing long, distinct_close boolean, quantiles_close boolean")


_SHARES = (0.05, 0.5, 0.95)


def _ranks_close(column, quantiles):
    """Whether each value has its share of the rows below or at it, give or take 3 %."""
    x, ok = C(column).cast("double"), F.lit(True)
    for share, q in zip(_SHARES, quantiles, strict=True):
        below, at = F.count_if(x < q) / F.count(x), F.count_if(x <= q) / F.count(x)
        ok = ok & (below <= share + 0.03) & (at >= share - 0.03)
    return ok


@query("missing_cross", S.with_parts("select count(*) filter (issue_d is null) no_issue, count(*) filter (loan_status is null) no_status, count(issue_d) expected_rows from loan_raw", "loan_raw"))
def missing_cross(spark, sf_dir):
    return loan_raw(spark, sf_dir).agg(F.count_if(C("issue_d").isNull()).alias("no_issue"), F.count_if(C("loan_status").isNull()).alias("no_status"), F.count("issue_d").alias("expected_rows"))


@query("distinct_counts", S.with_parts("select count(distinct issue_month) n_months, count(distinct grade) grades, count(distinct loan_id) loans from facts", "facts"))
def distinct_counts(spark, sf_dir):
    return _facts(spark, sf_dir).agg(F.count_distinct("issue_month").alias("n_months"), F.count_distinct("grade").alias("grades"), F.count_distinct("loan_id").alias("loans"))


@query("having_dups", "select l_orderkey, l_linenumber, count(*) cnt from lineitem group by 1, 2 having count(*) > 1")
def having_dups(spark, sf_dir):
    from tranchery.operators.quality import duplicates

    return duplicates(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("key_distribution", S.with_parts("select loan_status \"key\", count(*) cnt, round(cast(count(*) as double) / (select count(*) from perf), 6) share, round(cast(count(*) as double) / (select count(*) from perf) * (select count(distinct loan_status) from perf), 4) skew_ratio from perf group by 1", "perf"))
def key_distribution(spark, sf_dir):
    return metrics.key_shares(_perf(spark, sf_dir), "loan_status")


@query("hash_partition_distribution")
def hash_partition_distribution(spark, sf_dir):
    return _perf(spark, sf_dir).groupBy(F.pmod(F.hash("loan_id"), F.lit(20)).alias("part")).agg(F.count("*").alias("cnt"))


@query("granularity_skew", " union all ".join(f"select '{n}' granularity, count(*) n_keys, round(cast(max(c) as double) / sum(c), 6) max_share from (select count(*) c from lineitem group by {g})" for n, g in (("flag", "l_returnflag"), ("flag_status", "l_returnflag, l_linestatus"), ("order", "l_orderkey"))))
def granularity_skew(spark, sf_dir):
    items, out = read_table(spark, sf_dir, "lineitem"), None
    for name, keys in (("flag", ["l_returnflag"]), ("flag_status", ["l_returnflag", "l_linestatus"]), ("order", ["l_orderkey"])):
        part = items.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.lit(name).alias("granularity"), F.count("*").alias("n_keys"), F.round(F.max("c").cast("double") / F.sum("c"), 6).alias("max_share"))
        out = part if out is None else out.unionByName(part)
    return out


_SUMS = S.with_parts("select loan_status, grade, count(*) cnt, cast(sum(funded_amnt) as double) total from facts join perf using (loan_id) group by 1, 2", "facts", "perf")


@query("salted_agg", _SUMS)
def salted_agg(spark, sf_dir):
    return skew.salted_sums(_facts(spark, sf_dir).join(_perf(spark, sf_dir), "loan_id"), ["loan_status", "grade"], "funded_amnt", "loan_id", 10)


@query("heavy_hitters", S.with_parts("select loan_status, grade, count(*) cnt from facts join perf using (loan_id) group by 1, 2 having count(*) >= 0.04 * (select count(*) from facts join perf using (loan_id))", "facts", "perf"))
def heavy_hitters(spark, sf_dir):
    return skew.heavy_hitters(_facts(spark, sf_dir).join(_perf(spark, sf_dir), "loan_id"), ["loan_status", "grade"], 0.04)


@query("salted_distinct", "select l_returnflag, l_linestatus, count(distinct l_orderkey) distinct_values from lineitem group by 1, 2")
def salted_distinct(spark, sf_dir):
    return skew.salted_distinct(read_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey")


@query("skewed_groupby", _SUMS)
def skewed_groupby(spark, sf_dir):
    return _facts(spark, sf_dir).join(_perf(spark, sf_dir), "loan_id").groupBy("loan_status", "grade").agg(F.count("*").alias("cnt"), F.sum("funded_amnt").cast("double").alias("total"))


@query("wide_agg", S.with_parts("select cast(sum(loan_amnt) as double) s1, cast(sum(funded_amnt) as double) s2, cast(max(annual_inc) as double) m1, cast(max(dti) as double) m2, max(length(loan_id)) l1, max(purpose) p1, cast(sum(fico_low) as double) s3, max(issue_month) m3, max(addr_state) m4, cast(sum(term_months) as bigint) s4 from facts", "facts"))
def wide_agg(spark, sf_dir):
    d = lambda f, c, n: f(c).cast("double").alias(n)
    return _facts(spark, sf_dir).agg(d(F.sum, "loan_amnt", "s1"), d(F.sum, "funded_amnt", "s2"), d(F.max, "annual_inc", "m1"), d(F.max, "dti", "m2"), F.max(F.length("loan_id")).alias("l1"), F.max("purpose").alias("p1"), d(F.sum, "fico_low", "s3"), F.max("issue_month").alias("m3"), F.max("addr_state").alias("m4"), F.sum("term_months").alias("s4"))


@query("narrow_agg", S.with_parts("select grade, count(*) cnt from facts group by 1", "facts"))
def narrow_agg(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("cnt"))


@query("issue_trend", S.with_parts("select issue_month, count(*) cnt, round(cast(sum(funded_amnt) as double) / 1e8, 4) amount from facts group by 1", "facts"))
def issue_trend(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("issue_month").agg(F.count("*").alias("cnt"), F.round(F.sum("funded_amnt").cast("double") / 1e8, 4).alias("amount")).orderBy("issue_month")


_BUCKETS = ["CHARGED_OFF", "CURRENT", "DPD_120_PLUS", "DPD_1_30", "DPD_31_120"]


@query("roll_matrix", S.with_parts("select from_bucket, " + ", ".join(f"round(coalesce(sum(cnt) filter (to_bucket = '{b}'), 0) * 100.0::double / sum(cnt), 4) as \"{b}\"" for b in _BUCKETS) + " from roll where from_month = (select max(from_month) from roll) group by 1", "roll"))
def roll_matrix(spark, sf_dir):
    rates = metrics.roll_rates(_snapshot(spark, sf_dir))
    last = rates.join(F.broadcast(rates.agg(F.max("from_month").alias("last"))), C("from_month") == C("last"))
    return metrics_matrix(last)


def metrics_matrix(rates):
    wide = rates.groupBy("from_bucket").pivot("to_bucket", _BUCKETS).agg(F.sum("cnt")).na.fill(0)
    total = sum((C(b) for b in _BUCKETS), F.lit(0))
    return wide.select("from_bucket", *[F.round(C(b) * 100.0 / total, 4).alias(b) for b in _BUCKETS])


@query("vintage_matrix", S.with_parts("select issue_month, " + ", ".join(f"max(bad_rate) filter (mob = {m}) as \"{m}\"" for m in range(1, 25)) + " from vintage where grade = 'ALL' group by 1", "vintage"))
def vintage_matrix(spark, sf_dir):
    months = list(range(1, 25))
    wide = metrics.vintage(_snapshot(spark, sf_dir), "all").groupBy("issue_month").pivot("mob", months).agg(F.first("bad_rate"))
    return wide.na.drop("all", subset=[str(m) for m in months])


@query("row_counts_all", " union all ".join(f"select '{t}' table_name, count(*) cnt from {t}" for t in ("region", "nation", "customer", "orders", "lineitem", "events")))
def row_counts_all(spark, sf_dir):
    out = None
    for t in ("region", "nation", "customer", "orders", "lineitem", "events"):
        part = read_table(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("cnt"))
        out = part if out is None else out.unionByName(part)
    return out


@query("vintage_monotonic", S.with_parts("select count(*) violations from (select bad_rate, lag(bad_rate) over (partition by issue_month, grade order by mob) prev from vintage) where bad_rate < prev", "vintage"))
def vintage_monotonic(spark, sf_dir):
    w = Window.partitionBy("issue_month", "grade").orderBy("mob")
    return metrics.vintage(_snapshot(spark, sf_dir)).withColumn("prev", F.lag("bad_rate").over(w)).where("bad_rate < prev").agg(F.count("*").alias("violations"))


@query("size_ladder", " union all ".join("select %d step, * from (%s)" % (n, S.with_parts(f"select grade, count(*) loan_cnt, cast(sum(is_bad) as bigint) bad_cnt from term where cast(loan_id as bigint) % {n} = 0 group by grade", "term")) for n in (10, 4, 1)))
def size_ladder(spark, sf_dir):
    loans, out = metrics.terminal(_facts(spark, sf_dir), _perf(spark, sf_dir)), None
    for n in (10, 4, 1):
        part = loans.where(F.pmod(C("loan_id").cast("long"), F.lit(n)) == 0).groupBy("grade").agg(F.count("*").alias("loan_cnt"), F.sum("is_bad").alias("bad_cnt")).withColumn("step", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


