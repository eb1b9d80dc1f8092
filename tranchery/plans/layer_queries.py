"""Queries over sources, layers, dimensions and the month-end snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from tranchery.functions import loan as L
from tranchery.operators import joins, layers, metrics
from tranchery.plans import check_sql as S
from tranchery.plans.catalog import query
from tranchery.plans.scratch import scratch
from tranchery.sources import tables as T
from tranchery.sources.fixtures import LOAN_NUMBERS, LOAN_TEXTS, RAW_COLUMNS, SNAPSHOT_END, loan_raw, raw_lines

C = F.col
MONEY = ["loan_amnt", "funded_amnt", "installment", "annual_inc", "dti", "int_rate", "fico_low", "fico_high"]


def doubles(df, columns):
    """Decimal columns as doubles (the check engines name decimals differently)."""
    return df.withColumns({c: C(c).cast("double") for c in columns if c in df.columns})


def _sql_doubles(columns):
    return "* replace (" + ", ".join(f"cast({c} as double) as {c}" for c in columns) + ")"


@query("raw_split", S.with_parts("select value, kind from kinds", "kinds"))
def raw_split(spark, sf_dir):
    path = scratch(spark, "raw-lines")
    raw_lines(spark, sf_dir).orderBy("at").select("value").write.option("compression", "gzip").text(path)
    data, junk = T.split_raw(spark, path)
    return data.withColumn("kind", F.lit("data")).unionByName(junk.withColumn("kind", F.lit("junk")))


@query("raw_csv_read", S.with_parts("select split_part(value, ',', 1) id, split_part(value, ',', 6) issue_d, split_part(value, ',', 7) loan_status from kinds where kind = 'data'", "kinds"))
def raw_csv_read(spark, sf_dir):
    data = T.with_line_kind(raw_lines(spark, sf_dir)).where("kind = 'data'")
    return T.parse_raw(data, RAW_COLUMNS, ["id", "issue_d", "loan_status"])


@query("schema_detect", S.with_parts(" union all ".join(f"select '{c}' column_name, count({c}) non_null, count(nullif(trim(cast({c} as varchar)), '')) non_blank, {kind} kept_type from loan_raw" for c, kind in [*((c, "'string'") for c in LOAN_TEXTS), *((c, "null" if c == "installment" else "'double'") for c in LOAN_NUMBERS)]), "loan_raw"))
def schema_detect(spark, sf_dir):
    return T.column_kinds(loan_raw(spark, sf_dir), keys=["id"])


@query("sample_head", S.with_parts("select id, grade from loan_raw order by cast(id as bigint) limit 500", "loan_raw"))
def sample_head(spark, sf_dir):
    return T.head(loan_raw(spark, sf_dir).withColumn("k", C("id").cast("long")), "k", 500).select("id", "grade")


@query("parquet_project", "select o_orderkey, o_orderstatus from orders")
def parquet_project(spark, sf_dir):
    return T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")


@query("parquet_sink", S.with_parts("select count(*) cnt, sum(cast(id as bigint))::bigint ids from loan_raw", "loan_raw"))
def parquet_sink(spark, sf_dir):
    path = scratch(spark, "sink")
    T.write_parquet(loan_raw(spark, sf_dir), path)
    return spark.read.parquet(path).agg(F.count("*").alias("cnt"), F.sum(C("id").cast("long")).alias("ids"))


_TSV = ["id", "grade", "term", "last_pymnt_d", "loan_status"]


@query("tsv_scan", S.with_parts("select " + ", ".join(_TSV) + " from loan_raw", "loan_raw"))
def tsv_scan(spark, sf_dir):
    path, given = scratch(spark, "tsv"), loan_raw(spark, sf_dir).select(*_TSV)
    T.write_tsv(given, path)
    return T.read_tsv(spark, path, given.schema)


@query("tsv_export", S.with_parts("select count(*) rows_given, count(*) rows_read, count(grade) grades from loan_raw", "loan_raw"))
def tsv_export(spark, sf_dir):
    path, given = scratch(spark, "tsv"), loan_raw(spark, sf_dir).select(*_TSV)
    T.write_tsv(given, path)
    back = T.read_tsv(spark, path, given.schema).agg(F.count("*").alias("rows_read"), F.count("grade").alias("grades"))
    return given.agg(F.count("*").alias("rows_given")).crossJoin(back)


@query("orc_table", S.with_parts("select grade, count(*) cnt from facts group by grade", "facts"))
def orc_table(spark, sf_dir):
    path = scratch(spark, "orc")
    _facts(spark, sf_dir).write.format("orc").option("compression", "snappy").save(path)
    return spark.read.orc(path).groupBy("grade").agg(F.count("*").alias("cnt"))


@query("dyn_partition_overwrite", S.with_parts("select issue_month, case when issue_month >= '2001-01' then 'second' else 'first' end load, count(*) cnt from facts group by 1, 2", "facts"))
def dyn_partition_overwrite(spark, sf_dir):
    path, facts = scratch(spark, "partitions"), _facts(spark, sf_dir).select("loan_id", "issue_month")
    T.overwrite_partitions(facts.withColumn("load", F.lit("first")), path, "issue_month")
    T.overwrite_partitions(facts.where("issue_month >= '2001-01'").withColumn("load", F.lit("second")), path, "issue_month")
    return spark.read.schema("loan_id string, load string, issue_month string").parquet(path).groupBy("issue_month", "load").agg(F.count("*").alias("cnt"))


_CONVERTED = ["id", "loan_amnt", "term", "int_rate", "grade", "emp_length", "annual_inc", "purpose", "issue_d", "loan_status"]


@query("format_convert", S.with_parts("select f.format, count(*) cnt, " + ", ".join(f"cast(sum({c if c in LOAN_NUMBERS else f'length({c})'}) as double) {c}" for c in _CONVERTED) + " from loan_raw, (select unnest(['csv','orc','parquet']) format) f group by 1", "loan_raw"))
def format_convert(spark, sf_dir):
    """Ten columns through three formats: what is read back, by sums of numbers and lengths of texts (blanks count)."""
    given, out = loan_raw(spark, sf_dir).select(*_CONVERTED), None
    size = lambda c: F.sum(C(c) if c in LOAN_NUMBERS else F.length(c)).cast("double").alias(c)
    for fmt in ("csv", "orc", "parquet"):
        path, as_is = scratch(spark, f"as-{fmt}"), T.AS_IS if fmt == "csv" else {}
        given.write.format(fmt).options(**as_is).save(path)
        part = spark.read.schema(given.schema).format(fmt).options(**as_is).load(path).agg(F.lit(fmt).alias("format"), F.count("*").alias("cnt"), *[size(c) for c in _CONVERTED])
        out = part if out is None else out.unionByName(part)
    return out


@query("csv_export", S.with_parts("select grade, count(*) cnt from facts group by grade", "facts"))
def csv_export(spark, sf_dir):
    path = scratch(spark, "csv")
    T.write_csv_single(_facts(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("cnt")), path)
    return spark.read.schema("grade string, cnt long").option("header", True).csv(path)


@query("ctas_saveastable", S.with_parts("select grade, count(*) cnt from facts group by grade", "facts"))
def ctas_saveastable(spark, sf_dir):
    counted = _facts(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("cnt"))
    counted.write.mode("overwrite").format("orc").option("path", scratch(spark, "table")).saveAsTable("tranchery_grade_counts")
    return spark.table("tranchery_grade_counts")


@query("idempotent_reload", S.with_parts("select count(*) first_load, count(*) second_load from loan_raw", "loan_raw"))
def idempotent_reload(spark, sf_dir):
    path, given = scratch(spark, "reload"), loan_raw(spark, sf_dir).select("id", "grade")
    first, second = T.reload_checked(given, path), T.reload_checked(given, path)
    return given.agg(F.lit(first).cast("long").alias("first_load"), F.lit(second).cast("long").alias("second_load"))


@query("ingest_summary", S.with_parts("select count(*) physical, count(*) filter (value like 'id,%') header, count(*) filter (kind = 'junk' and value not like 'id,%') junk, count(*) filter (kind = 'data') data_rows from kinds", "kinds"))
def ingest_summary(spark, sf_dir):
    lines = T.with_line_kind(raw_lines(spark, sf_dir))
    head = C("value").startswith("id,")
    return lines.agg(F.count("*").alias("physical"), F.count_if(head).alias("header"), F.count_if((C("kind") == "junk") & ~head).alias("junk"), F.count_if(C("kind") == "data").alias("data_rows"))


_ODS = ["loan_amnt", "annual_inc", "dti", "out_prncp"]


@query("ods_cast", S.with_parts("select id, " + ", ".join(f"cast({c} as double) {c}" for c in _ODS) + ", nullif(trim(term), '') term, nullif(trim(loan_status), '') loan_status, try_cast(int_rate as double) int_rate from loan_raw", "loan_raw"))
def ods_cast(spark, sf_dir):
    return layers.landing_cast(loan_raw(spark, sf_dir).select("id", *_ODS, "term", "loan_status", "int_rate"), load_time=False)


@query("dwd_clean", S.with_parts(f"select {_sql_doubles(MONEY)} from facts_all", "facts_all"))
def dwd_clean(spark, sf_dir):
    return doubles(layers.application_facts(loan_raw(spark, sf_dir)), MONEY)


@query("dq_grade_rows", S.with_parts("select dq_level, count(*) cnt from facts_all group by 1", "facts_all"))
def dq_grade_rows(spark, sf_dir):
    return layers.application_facts(loan_raw(spark, sf_dir)).groupBy("dq_level").agg(F.count("*").alias("cnt"))


@query("reject_split", S.with_parts("""select count(*) filter (dq = 'REJECT') rejected, count(*) filter (dq <> 'REJECT') kept from (select case when id is null or not coalesce(amt > 0, false) or d is null then 'REJECT' else 'OK' end dq
  from (select id, case when cast(id as bigint) % 50 = 0 then -loan_amnt else loan_amnt end amt, case when cast(id as bigint) % 70 = 0 then null else issue_d end d from loan_raw))""", "loan_raw"))
def reject_split(spark, sf_dir):
    k = C("id").cast("long")
    dirty = loan_raw(spark, sf_dir).withColumn("loan_amnt", F.when(k % 50 == 0, -C("loan_amnt")).otherwise(C("loan_amnt"))).withColumn("issue_d", F.when(k % 70 != 0, C("issue_d")))
    kept, rejected = layers.split_rejects(layers.application_facts(dirty))
    return rejected.agg(F.count("*").alias("rejected")).crossJoin(kept.agg(F.count("*").alias("kept")))


_PERF = ["total_rec_prncp", "total_rec_int", "recoveries", "out_prncp", "total_pymnt", "last_pymnt_amnt"]


@query("perf_derive", S.with_parts(f"select {_sql_doubles(_PERF)} from perf", "perf"))
def perf_derive(spark, sf_dir):
    return doubles(layers.performance_facts(loan_raw(spark, sf_dir), SNAPSHOT_END), _PERF)


@query("dim_applicant", S.with_parts(f"select {_sql_doubles(['annual_inc', 'fico_low', 'dti'])} from applicant", "applicant"))
def dim_applicant(spark, sf_dir):
    return doubles(layers.applicants(loan_raw(spark, sf_dir)), ["annual_inc", "fico_low", "dti"])


@query("dim_product", S.with_parts(f"""select concat_ws('_', cast(t as varchar), g) product_code, t term_months, g grade, r avg_int_rate, {S.bands("r", L.RATE_BANDS)} rate_band
  from (select {S.TERM} t, trim(grade) g, round(avg(cast({S.RATE_OF} as double)), 4) r from loan_raw where grade is not null group by 1, 2)""", "loan_raw"))
def dim_product(spark, sf_dir):
    return layers.products(loan_raw(spark, sf_dir))


@query("dedup_first", "select l_orderkey, l_linenumber, cast(sum(l_partkey) as bigint) parts from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) rn from lineitem) where rn = 1 group by 1, 2")
def dedup_first(spark, sf_dir):
    first = layers.first_per_key(T.read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return first.select("l_orderkey", "l_linenumber", C("l_partkey").alias("parts"))


_SNAP = ["out_prncp", "total_rec_prncp", "loan_amnt"]


@query("loan_snapshot", S.with_parts(f"select {_sql_doubles(_SNAP)} from snap", "snap"))
def loan_snapshot(spark, sf_dir):
    return doubles(_snapshot(spark, sf_dir), _SNAP)


@query("charge_off_month", S.with_parts("select id loan_id, case when b then coalesce(p, i + 12) + 6 end charge_off from (select id, " + f"{S.BAD} b, {S.mi(S.ISSUE)} i, {S.mi(S.LAST)} p from loan_raw)", "loan_raw"))
def charge_off_month(spark, sf_dir):
    issue, last = (L.month_index(L.parse_month(C(c))) for c in ("issue_d", "last_pymnt_d"))
    return loan_raw(spark, sf_dir).select(C("id").alias("loan_id"), F.when(L.is_bad(C("loan_status")), F.coalesce(last, issue + 12) + 6).alias("charge_off"))


@query("dpd_rule", S.with_parts("select dpd_bucket, is_delinquent, is_bad_month, count(*) cnt from snap group by 1, 2, 3", "snap"))
def dpd_rule(spark, sf_dir):
    return _snapshot(spark, sf_dir).groupBy("dpd_bucket", "is_delinquent", "is_bad_month").agg(F.count("*").alias("cnt"))


@query("snapshot_rowcount", S.with_parts("select count(*) expected_rows, count(*) actual_rows from snap", "snap"))
def snapshot_rowcount(spark, sf_dir):
    raw = loan_raw(spark, sf_dir)
    return layers.expected_snapshot_rows(raw, SNAPSHOT_END).crossJoin(_snapshot(spark, sf_dir).agg(F.count("*").alias("actual_rows")))


@query("snapshot_partitioned_write", S.with_parts("select snapshot_month, count(*) cnt from snap group by 1", "snap"))
def snapshot_partitioned_write(spark, sf_dir):
    path = scratch(spark, "snapshot")
    layers.build_snapshot(loan_raw(spark, sf_dir), SNAPSHOT_END, path)
    return spark.read.schema(_snapshot(spark, sf_dir).schema).parquet(path).groupBy("snapshot_month").agg(F.count("*").alias("cnt"))


# joins


@query("join_fact_perf", S.with_parts("select loan_id, grade, is_bad from facts join perf using (loan_id)", "facts", "perf"))
def join_fact_perf(spark, sf_dir):
    return _facts(spark, sf_dir).join(_perf(spark, sf_dir), "loan_id").select("loan_id", "grade", "is_bad")


@query("join_three_way", S.with_parts("select loan_id, grade, is_bad, income_band, fico_band from term", "term"))
def join_three_way(spark, sf_dir):
    return terminal_loans(spark, sf_dir).select("loan_id", "grade", "is_bad", "income_band", "fico_band")


@query("self_join_next_month", S.with_parts("select loan_id, snapshot_month from_month, dpd_bucket from_bucket, next_bucket to_bucket from (select *, lead(dpd_bucket) over w next_bucket, lead(mob) over w next_mob from snap where loan_id is not null window w as (partition by loan_id order by mob)) where next_mob = mob + 1", "snap"))
def self_join_next_month(spark, sf_dir):
    return metrics.next_month_pairs(_snapshot(spark, sf_dir)).select("loan_id", "from_month", "from_bucket", "to_bucket")


@query("cross_join_totals", "select o_orderstatus, count(*) cnt, (select count(*) from orders) total from orders group by 1")
def cross_join_totals(spark, sf_dir):
    orders = T.read_table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("cnt")).crossJoin(F.broadcast(orders.agg(F.count("*").alias("total"))))


@query("scalar_subquery_join", S.with_parts("select count(*) cnt from snap where snapshot_month = (select max(snapshot_month) from snap)", "snap"))
def scalar_subquery_join(spark, sf_dir):
    snap = _snapshot(spark, sf_dir)
    return snap.join(F.broadcast(snap.agg(F.max("snapshot_month").alias("last"))), C("snapshot_month") == C("last")).agg(F.count("*").alias("cnt"))


@query("join_strategy_hint", S.with_parts("select 'merge' strategy, count(*) cnt, sum(is_bad)::bigint bad from facts join perf using (loan_id) union all select 'broadcast', count(*), sum(is_bad)::bigint from facts join perf using (loan_id)", "facts", "perf"))
def join_strategy_hint(spark, sf_dir):
    out, facts, perf = None, _facts(spark, sf_dir), _perf(spark, sf_dir).select("loan_id", "is_bad")
    for name, side in (("merge", perf.hint("merge")), ("broadcast", joins.small_side(perf))):
        part = facts.join(side, "loan_id").agg(F.lit(name).alias("strategy"), F.count("*").alias("cnt"), F.sum("is_bad").alias("bad"))
        out = part if out is None else out.unionByName(part)
    return out


@query("only_in_either", "select c_custkey k, 'no_orders' side from customer where c_custkey not in (select o_custkey from orders) union all select distinct o_custkey, 'no_customer' from orders where o_custkey not in (select c_custkey from customer)")
def only_in_either(spark, sf_dir):
    c = T.read_table(spark, sf_dir, "customer").select(C("c_custkey").alias("k"))
    o = T.read_table(spark, sf_dir, "orders").select(C("o_custkey").alias("k")).distinct()
    return c.join(o, "k", "left_anti").withColumn("side", F.lit("no_orders")).unionByName(o.join(c, "k", "left_anti").withColumn("side", F.lit("no_customer")))


def _facts(spark, sf_dir):
    return layers.split_rejects(layers.application_facts(loan_raw(spark, sf_dir)))[0]


def _perf(spark, sf_dir):
    return layers.performance_facts(loan_raw(spark, sf_dir), SNAPSHOT_END)


def _snapshot(spark, sf_dir):
    return layers.month_end_snapshot(loan_raw(spark, sf_dir), SNAPSHOT_END)


def terminal_loans(spark, sf_dir):
    applicants = layers.applicants(loan_raw(spark, sf_dir)).select("loan_id", "income_band", "fico_band")
    return metrics.terminal(_facts(spark, sf_dir), _perf(spark, sf_dir)).join(applicants, "loan_id")
