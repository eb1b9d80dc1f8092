"""Queries over data-quality checks, differs, reconciliation, watermarks and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tranchery.operators import incremental, layers, metrics, quality
from tranchery.operators.loan_run import LoanRun
from tranchery.plans import check_sql as S
from tranchery.plans.catalog import query
from tranchery.plans.layer_queries import _facts, _perf, _snapshot, terminal_loans
from tranchery.plans.scratch import scratch
from tranchery.sources.fixtures import SNAPSHOT_END, loan_raw
from tranchery.sources.tables import read_table

C = F.col
_ROW = "'{}' check_name, '{}' as level, '{}' table_name"


def _check_sql(name, level, table, actual, expected="0"):
    return f"select {_ROW.format(name, level, table)}, cast(({actual}) as bigint) actual, cast(({expected}) as bigint) expected, ({actual}) = ({expected}) passed"


_CHECKS = {
    "dq_row_conservation": ("ERROR", "facts", "(select count(*) from facts) + (select count(*) from facts_all where dq_level = 'REJECT')", "select count(*) from loan_raw"),
    "dq_pk_unique": ("ERROR", "facts", "select count(*) from (select loan_id from facts group by 1 having count(*) > 1)", "0"),
    "dq_agg_consistency": ("ERROR", "segments", "select sum(is_bad) from term", "select sum(is_bad) from perf where is_terminal = 1"),
    "dq_amount_non_negative": ("ERROR", "facts", "select count(*) from facts where loan_amnt <= 0 or funded_amnt < 0", "0"),
    "dq_enum_valid": ("ERROR", "perf", "select count(*) from (select distinct loan_status, dpd_bucket from perf) where loan_status is not null and dpd_bucket = 'UNKNOWN'", "0"),
    "dq_date_valid": ("WARN", "facts", "select count(*) from facts where issue_date > date '2001-07-01'", "0"),
    "dq_month_gaps": ("WARN", "facts", "select count(*) from (select unnest(generate_series(min(issue_date), max(issue_date), interval 1 month)) m from facts) where strftime(m, '%Y-%m') not in (select issue_month from facts)", "0"),
    "dq_no_leakage": ("ERROR", "facts", "0", "0"),
}
_PARTS = {"dq_row_conservation": ["facts"], "dq_agg_consistency": ["term"], "dq_enum_valid": ["perf"]}


def _build(name, spark, sf_dir):
    facts, level, table = _facts(spark, sf_dir), *_CHECKS[name][:2]
    row = lambda df, actual, expected=None: quality.check_row(df, name, level, table, actual, expected)
    if name == "dq_row_conservation":
        raw = loan_raw(spark, sf_dir)
        rejects = layers.split_rejects(layers.application_facts(raw))[1]
        return row(quality.conserved_counts(raw, facts, rejects), F.first("n_facts") + F.first("n_rejects"), F.first("n_raw"))
    if name == "dq_pk_unique":
        return row(quality.duplicates(facts, ["loan_id"]), F.count("*"))
    if name == "dq_agg_consistency":
        total = metrics.risk_segment(terminal_loans(spark, sf_dir), "grade").agg(F.sum("bad_cnt").alias("a"))
        detail = _perf(spark, sf_dir).where("is_terminal = 1").agg(F.sum("is_bad").alias("b"))
        return row(total.crossJoin(detail), F.first("a"), F.first("b"))
    if name == "dq_amount_non_negative":
        return row(facts, F.count_if((C("loan_amnt") <= 0) | (C("funded_amnt") < 0)))
    if name == "dq_enum_valid":
        known = C("loan_status").isNotNull() & (C("dpd_bucket") == "UNKNOWN")
        return row(_perf(spark, sf_dir).select("loan_status", "dpd_bucket").distinct(), F.count_if(known))
    if name == "dq_date_valid":
        return row(facts, F.count_if(C("issue_date") > F.lit("2001-07-01").cast("date")))
    if name == "dq_month_gaps":
        return row(quality.month_gaps(facts, "issue_month"), F.count("*"))
    return row(quality.leaked_columns(facts), F.count("*"))


def _register(name):
    level, table, actual, expected = _CHECKS[name]

    @query(name, S.with_parts(_check_sql(name, level, table, actual, expected), *_PARTS.get(name, ["facts"])))
    def run(spark, sf_dir):
        return _build(name, spark, sf_dir)

    run.__name__ = name


for _name in _CHECKS:
    _register(_name)


@query("dq_report", S.with_parts(" union all ".join(_check_sql(n, *v) for n, v in _CHECKS.items()), "facts", "perf", "term"))
def dq_report(spark, sf_dir):
    return quality.report([_build(n, spark, sf_dir) for n in _CHECKS])


@query("month_gap_join", S.with_parts("select strftime(m, '%Y-%m') issue_month from (select unnest(generate_series((select min(issue_date) from facts), (select max(issue_date) from facts), interval 1 month)) m) where month(m) % 5 = 0 and strftime(m, '%Y-%m') in (select issue_month from facts) and strftime(m, '%Y-%m') not in (select min(issue_month) from facts) and strftime(m, '%Y-%m') not in (select max(issue_month) from facts) or strftime(m, '%Y-%m') not in (select issue_month from facts)", "facts"))
def month_gap_join(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    ends = F.broadcast(facts.agg(F.min("issue_month").alias("a"), F.max("issue_month").alias("b")))
    holed = facts.crossJoin(ends).where((F.month("issue_date") % 5 != 0) | C("issue_month").isin("") | (C("issue_month") == C("a")) | (C("issue_month") == C("b")))
    return quality.month_gaps(holed, "issue_month")


def _two_versions(spark, sf_dir):
    """Segment table by grade and a changed copy: one grade missing, one new, one value off, one null."""
    left = metrics.risk_segment(terminal_loans(spark, sf_dir), "grade").select(C("dim_value").alias("grade"), "loan_cnt", "bad_rate")
    right = left.where("grade is null or grade != 'A'").withColumn("bad_rate", F.when(C("grade") == "B", C("bad_rate") + 0.01).when(C("grade") == "C", F.lit(None)).otherwise(C("bad_rate")))
    right = right.withColumn("grade", F.when(C("grade") == "G", "H").otherwise(C("grade")))
    return left, right


_TWO = S.with_parts("""select coalesce(l.grade, r.grade) grade, l.loan_cnt loan_cnt_l, r.loan_cnt loan_cnt_r, l.bad_rate bad_rate_l, r.bad_rate bad_rate_r, case when r.here is null then 'left_only' when l.here is null then 'right_only' else 'both' end side
  from (select grade, count(*) loan_cnt, round(cast(sum(is_bad) as double) / count(*), 6) bad_rate, 1 here from term group by grade) l
  full outer join (select case when grade = 'G' then 'H' else grade end grade, count(*) loan_cnt, case when grade = 'B' then round(cast(sum(is_bad) as double) / count(*), 6) + 0.01 when grade = 'C' then null else round(cast(sum(is_bad) as double) / count(*), 6) end bad_rate, 1 here from term where grade is null or grade <> 'A' group by term.grade) r
  on l.grade is not distinct from r.grade""", "term")


@query("full_outer_nullsafe", _TWO)
def full_outer_nullsafe(spark, sf_dir):
    return quality.full_outer(*_two_versions(spark, sf_dir), ["grade"])


@query("table_diff", f"""with j as ({_TWO}) select 'bad_rate' column_name, count(*) filter (side = 'left_only') left_only, count(*) filter (side = 'right_only') right_only, round(max(abs(bad_rate_l - bad_rate_r)) filter (side = 'both'), 9) max_diff,
  count(*) filter (side = 'both' and ((bad_rate_l is null) <> (bad_rate_r is null) or abs(bad_rate_l - bad_rate_r) > 1e-6)) over_tolerance from j
  union all select 'loan_cnt', count(*) filter (side = 'left_only'), count(*) filter (side = 'right_only'), max(abs(loan_cnt_l - loan_cnt_r)) filter (side = 'both'), count(*) filter (side = 'both' and loan_cnt_l <> loan_cnt_r) from j""")
def table_diff(spark, sf_dir):
    return quality.table_diff(*_two_versions(spark, sf_dir), ["grade"], {"bad_rate": 1e-6, "loan_cnt": 0}).withColumn("max_diff", F.round("max_diff", 9))


@query("derived_join_check", S.with_parts("select a.issue_month, a.mob, a.exposure_cnt, cast(sum(g.exposure_cnt) as bigint) grades from vintage a join vintage g on a.issue_month = g.issue_month and a.mob = g.mob and g.grade <> 'ALL' where a.grade = 'ALL' group by 1, 2, 3", "vintage"))
def derived_join_check(spark, sf_dir):
    return _all_against_grades(spark, sf_dir)


def _all_against_grades(spark, sf_dir):
    v = metrics.vintage(_snapshot(spark, sf_dir))
    grades = v.where("grade != 'ALL'").groupBy("issue_month", "mob").agg(F.sum("exposure_cnt").alias("grades"))
    return v.where("grade = 'ALL'").select("issue_month", "mob", "exposure_cnt").join(grades, ["issue_month", "mob"])


@query("check_all_row", S.with_parts("select 'vintage_all_row' chk, count(*) bad_rows from (select issue_month, mob, sum(exposure_cnt) filter (grade <> 'ALL') parts, sum(exposure_cnt) filter (grade = 'ALL') whole from vintage group by 1, 2) where parts is distinct from whole", "vintage"))
def check_all_row(spark, sf_dir):
    return _all_against_grades(spark, sf_dir).where("exposure_cnt != grades").agg(F.lit("vintage_all_row").alias("chk"), F.count("*").alias("bad_rows"))


@query("check_roll_normalised", S.with_parts("select 'roll_normalised' chk, count(*) bad_rows from (select sum(rate) s from roll group by from_month, from_bucket) where abs(s - 1) > 0.001", "roll"))
def check_roll_normalised(spark, sf_dir):
    sums = metrics.roll_rates(_snapshot(spark, sf_dir)).groupBy("from_month", "from_bucket").agg(F.sum("rate").alias("s"))
    return sums.where(F.abs(C("s") - 1) > 0.001).agg(F.lit("roll_normalised").alias("chk"), F.count("*").alias("bad_rows"))


@query("check_segment_total", S.with_parts("select abs((select sum(is_bad) from term) - (select sum(is_bad) from perf where is_terminal = 1))::bigint diff", "term"))
def check_segment_total(spark, sf_dir):
    segments = metrics.risk_segments(terminal_loans(spark, sf_dir), ["grade"]).agg(F.sum("bad_cnt").alias("a"))
    return segments.crossJoin(_perf(spark, sf_dir).where("is_terminal = 1").agg(F.sum("is_bad").alias("b"))).select(F.abs(C("a") - C("b")).alias("diff"))


_METRICS = [
    ("loans", "select cast(count(*) as double) from facts", 0.0),
    ("funded", "select cast(sum(funded_amnt) as double) from facts", 0.01),
    ("terminal", "select cast(count(*) as double) from perf where is_terminal = 1", 0.0),
    ("bad", "select cast(sum(is_bad) as double) from perf where is_terminal = 1", 0.0),
    ("months", "select cast(count(distinct issue_month) as double) from facts", 0.0),
]


@query("metric_compare", S.with_parts(" union all ".join(f"select '{n}' name, ({q}) as value, ({q}) + {1 if n == 'bad' else 0} base, {t!r}::double tolerance, {'false' if n == 'bad' else 'true'} passed" for n, q, t in _METRICS), "facts", "perf"))
def metric_compare(spark, sf_dir):
    facts, perf = _facts(spark, sf_dir), _perf(spark, sf_dir).where("is_terminal = 1")
    one = lambda df, n, x: df.agg(F.lit(n).alias("name"), x.cast("double").alias("value"))
    actual = one(facts, "loans", F.count("*")).unionByName(one(facts, "funded", F.sum("funded_amnt"))).unionByName(one(perf, "terminal", F.count("*"))).unionByName(one(perf, "bad", F.sum("is_bad"))).unionByName(one(facts, "months", F.count_distinct("issue_month")))
    tolerance = F.when(C("name") == "funded", 0.01).otherwise(0.0)
    base = actual.withColumn("value", C("value") + F.when(C("name") == "bad", 1.0).otherwise(0.0)).withColumn("tolerance", tolerance)
    return quality.compare_metrics(actual, base)


_PLAIN = "select loan_status, grade, count(*) cnt, sum(funded_amnt) total from facts join perf using (loan_id) group by loan_status, grade"
_SALTED = "select loan_status, grade, sum(c) cnt, sum(s) total from (select loan_status, grade, hash(loan_id) % 10 salt, count(*) c, sum(funded_amnt) s from facts join perf using (loan_id) group by loan_status, grade, salt) group by loan_status, grade"


@query("salted_equivalence", S.with_parts(f"select count(*) filter (p.cnt is distinct from q.cnt or abs(p.total - q.total) > 0.01) different, count(*) > 0 non_empty from ({_PLAIN}) p full join ({_SALTED}) q on p.loan_status is not distinct from q.loan_status and p.grade is not distinct from q.grade", "facts", "perf"))
def salted_equivalence(spark, sf_dir):
    loans = _facts(spark, sf_dir).join(_perf(spark, sf_dir), "loan_id")
    plain = loans.groupBy("loan_status", "grade").agg(F.count("*").alias("cnt"), F.sum("funded_amnt").cast("double").alias("total"))
    j = quality.full_outer(plain, metrics.salted_sums(loans, ["loan_status", "grade"], "funded_amnt", 10, "loan_id"), ["loan_status", "grade"])
    differs = (C("side") != "both") | (C("cnt_l") != C("cnt_r")) | (F.abs(C("total_l") - C("total_r")) > 0.01)
    return j.agg(F.count_if(differs).alias("different"), (F.count("*") > 0).alias("non_empty"))


@query("load_verify", S.with_parts("select count(*) n_rows, count(distinct loan_id) keys, count(*) filter (grade is null) null_grades, count(distinct issue_month) partitions from facts", "facts"))
def load_verify(spark, sf_dir):
    return _facts(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count_distinct("loan_id").alias("keys"), F.count_if(C("grade").isNull()).alias("null_grades"), F.count_distinct("issue_month").alias("partitions"))


@query("pk_checks", "select count(distinct l_orderkey) distinct_keys, count(*) n_rows, count(*) - count(distinct l_orderkey) dup_rows, count(*) filter (l_orderkey is null) null_keys from lineitem")
def pk_checks(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_orderkey").alias("distinct_keys"), F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("l_orderkey")).alias("dup_rows"), F.count_if(C("l_orderkey").isNull()).alias("null_keys"))


@query("incremental_watermark", "select 'first' load, count(*) n_rows, max(event_id) mark from events where event_type = 'click' or event_id <= (select max(event_id) // 2 from events) union all select 'second', count(*), (select max(event_id) from events) from events where event_id > (select max(event_id) from events where event_type = 'click' or event_id <= (select max(event_id) // 2 from events))")
def incremental_watermark(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    half = F.broadcast(events.agg(F.expr("max(event_id) div 2").alias("half")))
    first = events.crossJoin(half).where((C("event_type") == "click") | (C("event_id") <= C("half"))).drop("half")
    none = spark.createDataFrame([], "job string, mark long")
    one = quality.beyond_watermark(first, "event_id", none, "load")
    marks = quality.advance_watermark(none, one, "event_id", "load")
    two = quality.beyond_watermark(events, "event_id", marks, "load")
    after = quality.advance_watermark(marks, two, "event_id", "load")
    count = lambda n, df, m: df.agg(F.lit(n).alias("load"), F.count("*").alias("n_rows")).crossJoin(m.select("mark"))
    return count("first", one, marks).unionByName(count("second", two, after))


@query("incremental_upkeep", """with r as (select user_id pk, case when event_type <> 'error' then strftime(ts, '%Y-%m-%d') end grp, cast(value as decimal(14,2)) amt, event_id from events),
l as (select * from (select *, row_number() over (partition by pk order by event_id desc) rn from r) where rn = 1)
select grp, count(*) cnt, cast(sum(amt) as double) total, (select count(distinct pk) from r where event_id > (select max(event_id) // 2 from events)) changed from l where grp is not null group by grp""")
def incremental_upkeep(spark, sf_dir):
    """Current rows per day after two loads, the second of which touches the keys that changed; loading once more
    finds nothing beyond the mark."""
    events = read_table(spark, sf_dir, "events")
    rows = events.select(C("user_id").alias("pk"), F.when(C("event_type") != "error", F.date_format("ts", "yyyy-MM-dd")).alias("grp"), C("value").cast("decimal(14,2)").alias("amt"), C("event_id").alias("at"))
    half = events.agg(F.expr("max(event_id) div 2")).first()[0] or 0
    kept = incremental.Upkeep(spark, scratch(spark, "upkeep"))
    kept.load(rows.where(C("at") <= half))
    changed = kept.load(rows)
    again = kept.load(rows)
    return kept.current().select("grp", "cnt", C("total").cast("double").alias("total"), F.lit(changed + again).cast("long").alias("changed"))


@query("lineage_check", """select s.src, s.dst, s.fault from (select 'nation ' || n.n_name src, 'region ' || r.r_name dst, 'one_sided' fault from nation n join region r on n.n_regionkey = r.r_regionkey where n.n_nationkey % 3 = 0
  union all select 'nation ' || n.n_name, 'region ' || r.r_name, 'dangling:region ' || r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey where r.r_regionkey = 4) s""")
def lineage_check(spark, sf_dir):
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    src, dst = F.concat(F.lit("nation "), "n_name"), F.concat(F.lit("region "), "r_name")
    pairs = nation.join(region, C("n_regionkey") == C("r_regionkey")).select("n_nationkey", src.alias("src"), dst.alias("dst"))
    edges = pairs.select("src", "dst", C("src").alias("declared_by")).unionByName(pairs.where("n_nationkey % 3 != 0").select("src", "dst", C("dst").alias("declared_by")))
    names = nation.select(src.alias("name")).union(region.where("r_regionkey != 4").select(dst))
    return quality.lineage_faults(edges, names)


@query("freshness_volume", "select day, cnt, round(t, 4) as \"trailing\", round(cnt / nullif(round(t, 4), 0) - 1, 4) swing, coalesce(abs(round(cnt / nullif(round(t, 4), 0) - 1, 4)) > 0.5, false) flagged from (select *, avg(cnt) over (order by day rows between 3 preceding and 1 preceding) t from (select strftime(ts, '%Y-%m-%d') as day, count(*) cnt from events group by 1))")
def freshness_volume(spark, sf_dir):
    return quality.volume_swing(read_table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day")


_DAYS = "d as (select strftime(ts, '%Y-%m-%d') as day, count(*) n, avg(value) v from events group by 1), t as (select *, avg(n) over w an, avg(v) over w av, stddev_samp(v) over w sv from d window w as (order by day rows between 7 preceding and 1 preceding))"
_STATUS = "case when actual is null then 'NONE' when low is null then 'NEW' when actual between low and high then 'PASS' else 'FAIL' end status"


@query("freshness_range", f"with {_DAYS} select check_name, day, round(actual, 4) actual, round(low, 4) low, round(high, 4) high, {_STATUS} from (select 'freshness' check_name, '2024-02-01' as day, (epoch(timestamp '2024-02-01') - floor(epoch(max(ts)))) / 3600 actual, 0.0::double low, 48.0::double high from events union all select 'volume', day, n::double, an * 0.5, an * 1.5 from t union all select 'range', day, v, av - 3 * sv, av + 3 * sv from t)")
def freshness_range(spark, sf_dir):
    """Hours since the last event, rows of each day and mean value of each day, against what may be expected."""
    return quality.monitored(read_table(spark, sf_dir, "events"), "ts", "value", "2024-02-01")


_LAYERS = {
    "facts": "facts", "rejects": "(select 1 from facts_all where dq_level = 'REJECT')", "performance": "perf", "applicants": "(select distinct loan_id from applicant where loan_id is not null)",
    "products": "(select distinct term_months, grade from facts_all where term_months is not null and grade is not null)", "calendar": "(select unnest(generate_series(min(issue_date), max(issue_date), interval 1 day)) from facts)",
    "snapshot": "snap", "segments": "(select 1 from term group by grade union all select 1 from term group by income_band union all select 1 from term group by fico_band)", "delinquency": "(select 1 from snap group by issue_month, mob)", "vintages": "vintage", "roll_rates": "roll",
}


@query("loan_run", S.with_parts(" union all ".join(f"select '{k}' layer, count(*) n_rows, 9::bigint checks, 0::bigint failed_errors from {v}" for k, v in _LAYERS.items()), "facts", "perf", "term", "vintage", "roll"))
def loan_run(spark, sf_dir):
    """All layers written by one run, with its checks."""
    done = LoanRun(loan_raw(spark, sf_dir), scratch(spark, "loan-run"), SNAPSHOT_END)
    counts = [t.agg(F.lit(n).alias("layer"), F.count("*").alias("n_rows")) for n, t in done.all().items()]
    checks = done.report().agg(F.count("*").alias("checks"), F.count_if(F.expr("level = 'ERROR' and not passed")).alias("failed_errors"))
    return reduce(lambda a, b: a.unionByName(b), counts).crossJoin(F.broadcast(checks))
