"""Queries over table layout: partition pruning, compaction, formats, file statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tranchery.plans import check_sql as S
from tranchery.plans.catalog import query
from tranchery.plans.layer_queries import _facts
from tranchery.plans.scratch import scratch
from tranchery.sources import layout
from tranchery.sources import tables as T

C = F.col


def _partitioned(spark, sf_dir):
    """Facts partitioned by issue month, and the same without partitions."""
    one, two = scratch(spark, "by-month"), scratch(spark, "flat")
    facts = _facts(spark, sf_dir).select("loan_id", "grade", "funded_amnt", "issue_month")
    facts.repartition("issue_month").write.partitionBy("issue_month").parquet(one)
    facts.write.parquet(two)
    return spark.read.schema(facts.schema).parquet(one), spark.read.parquet(two)


_PRUNE = "select count(*) cnt, cast(sum(funded_amnt) as double) funded from facts where issue_month = '1998-06'"


@query("partition_filter", S.with_parts(_PRUNE, "facts"))
def partition_filter(spark, sf_dir):
    return _partitioned(spark, sf_dir)[0].where("issue_month = '1998-06'").agg(F.count("*").alias("cnt"), F.sum("funded_amnt").cast("double").alias("funded"))


@query("partition_prune_compare", S.with_parts(" union all ".join(f"select '{n}' layout, * from ({_PRUNE})" for n in ("partitioned", "flat")), "facts"))
def partition_prune_compare(spark, sf_dir):
    out = None
    for name, df in zip(("partitioned", "flat"), _partitioned(spark, sf_dir), strict=True):
        part = df.where("issue_month = '1998-06'").agg(F.lit(name).alias("layout"), F.count("*").alias("cnt"), F.sum("funded_amnt").cast("double").alias("funded"))
        out = part if out is None else out.unionByName(part)
    return out


def _many_and_compact(spark, sf_dir):
    many, few = scratch(spark, "many"), scratch(spark, "few")
    _facts(spark, sf_dir).select("loan_id", "grade", "funded_amnt", F.substring("issue_month", 1, 4).alias("year")).repartition(40).write.partitionBy("year").parquet(many)
    T.compact(spark, many, few, "year")
    return many, few


_BY_GRADE = "select grade, count(*) cnt, cast(sum(funded_amnt) as double) funded from facts group by grade"


@query("compaction_compare", S.with_parts(" union all ".join(f"select '{n}' layout, * from ({_BY_GRADE})" for n in ("many", "compact")), "facts"))
def compaction_compare(spark, sf_dir):
    out = None
    for name, path in zip(("many", "compact"), _many_and_compact(spark, sf_dir), strict=True):
        part = spark.read.parquet(path).groupBy("grade").agg(F.count("*").alias("cnt"), F.sum("funded_amnt").cast("double").alias("funded")).withColumn("layout", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("small_files_compact", S.with_parts("select substr(issue_month, 1, 4) as year, 1::bigint files from facts group by 1", "facts"))
def small_files_compact(spark, sf_dir):
    few = _many_and_compact(spark, sf_dir)[1]
    return T.file_stats(spark, few, "year").select(C("year").cast("string").alias("year"), "files")


@query("repartition_write", S.with_parts("select grade, 1::bigint files from facts where grade is not null group by grade", "facts"))
def repartition_write(spark, sf_dir):
    path = scratch(spark, "by-grade")
    _facts(spark, sf_dir).select("loan_id", "grade").where("grade is not null").repartition(20, "grade").write.partitionBy("grade").parquet(path)
    return T.file_stats(spark, path, "grade").select("grade", "files")


@query("file_stats", "select o_orderstatus, case when count(*) <= 1000000 then 1 else (count(*) * 11 + 9999999) // 10000000 end files from orders group by 1")
def file_stats(spark, sf_dir):
    """One file per status, and beyond a million rows a tenth more than would just hold them."""
    path = scratch(spark, "by-status")
    T.overwrite_partitions(T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return T.file_stats(spark, path, "o_orderstatus").select("o_orderstatus", "files")


#: nine tenths of the loans are put into one month
_SKEWED = "case when cast(loan_id as bigint) % 10 <> 0 then '1998-06' else issue_month end"
_PER_FILE = 2000


def _skewed(spark, sf_dir):
    facts = _facts(spark, sf_dir).select("loan_id", "grade", "funded_amnt", "purpose", "issue_month")
    return facts.withColumn("issue_month", F.when(C("loan_id").cast("long") % 10 != 0, "1998-06").otherwise(C("issue_month")))


@query("bounded_write", S.with_parts(f"select month, n n_rows, case when n <= {_PER_FILE} then 1 else cast(ceil(n * 1.1 / {_PER_FILE}) as bigint) end files, true bounded from (select {_SKEWED} as month, count(*) n from facts group by 1)", "facts"))
def bounded_write(spark, sf_dir):
    """A month of nine tenths of all rows is written by many tasks, the others by one each."""
    path = scratch(spark, "bounded")
    layout.write_bounded(_skewed(spark, sf_dir), path, "issue_month", _PER_FILE)
    rows = spark.read.parquet(path).groupBy(C("issue_month").cast("string").alias("month"), "_metadata.file_path").agg(F.count("*").alias("n"))
    return rows.groupBy("month").agg(F.sum("n").alias("n_rows"), F.count("*").alias("files"), (F.max("n") <= _PER_FILE).alias("bounded"))


@query("bounded_compaction", S.with_parts(f"select {_SKEWED} as month, count(*) n_rows, cast(sum(funded_amnt) as double) funded, 0::bigint too_large, true packed from facts group by 1", "facts"))
def bounded_compaction(spark, sf_dir):
    """Many small files packed to at most a tenth of the table each: none is larger, and a month has no more of them than
    half-filled ones would be, by the bytes that it had."""
    many, few = scratch(spark, "many"), scratch(spark, "few")
    _skewed(spark, sf_dir).repartition(40).write.partitionBy("issue_month").parquet(many)
    target = int(layout.file_stats(spark, many).first()["bytes"]) // 10
    layout.compact(spark, many, few, "issue_month", target)
    month = C("issue_month").alias("month")
    had = layout.file_stats(spark, many, "issue_month").select(month, C("bytes").alias("had"))
    files = layout.listed_files(spark, few, "issue_month").groupBy(month).agg(F.count("*").alias("files"), F.count_if(C("bytes") > target).alias("too_large"))
    sizes = files.join(had, "month").select("month", "too_large", (C("files") <= F.floor(2 * C("had") / target) + 2).alias("packed"))
    rows = spark.read.parquet(few).groupBy(C("issue_month").cast("string").alias("month")).agg(F.count("*").alias("n_rows"), F.sum("funded_amnt").cast("double").alias("funded"))
    return rows.join(sizes, "month")


@query("partition_files_read", S.with_parts("select 'month' as read, 1::bigint files, count(*) filter (issue_month = '1998-06') n_rows from facts union all select 'all', count(distinct issue_month), count(*) from facts", "facts"))
def partition_files_read(spark, sf_dir):
    """Files and rows that scans of a partitioned table take, by the scans' own counters."""
    path = scratch(spark, "by-month")
    layout.write_bounded(_facts(spark, sf_dir).select("loan_id", "funded_amnt", "issue_month"), path, "issue_month")
    table = spark.read.schema("loan_id string, funded_amnt decimal(14,2), issue_month string").parquet(path)
    total = lambda d: layout.scanned(d.agg(F.sum("funded_amnt")))
    took = {"month": total(table.where("issue_month = '1998-06'")), "all": total(table)}
    return spark.createDataFrame([(k, v["files"], v["rows"]) for k, v in took.items()], "read string, files long, n_rows long")


_COUNT = "select grade, count(*) cnt, cast(sum(funded_amnt) as double) funded from facts group by grade"


@query("format_compare", S.with_parts(" union all ".join(f"select '{f}' format, * from ({_COUNT})" for f in ("csv", "parquet", "orc")), "facts"))
def format_compare(spark, sf_dir):
    given, out = _facts(spark, sf_dir).select("loan_id", "grade", "funded_amnt", "purpose"), None
    for fmt in ("csv", "parquet", "orc"):
        path = scratch(spark, f"cmp-{fmt}")
        given.write.format(fmt).save(path)
        part = spark.read.schema(given.schema).format(fmt).load(path).groupBy("grade").agg(F.count("*").alias("cnt"), F.sum("funded_amnt").cast("double").alias("funded")).withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


_TEN = ["loan_id", "grade", "funded_amnt", "purpose", "annual_inc", "dti", "issue_month", "addr_state", "term_months", "home_ownership"]
_WIDE = "count(*) cnt, cast(sum(funded_amnt) as double) s1, cast(max(annual_inc) as double) m1, cast(max(dti) as double) m2, max(length(loan_id)) l1, max(purpose) p1, max(issue_month) m3, max(addr_state) m4, cast(sum(term_months) as bigint) s4, max(home_ownership) h1, max(grade) g1"


@query("format_compare_wide", S.with_parts(" union all ".join(f"select '{f}' format, {_WIDE} from facts" for f in ("csv", "parquet", "orc")), "facts"))
def format_compare_wide(spark, sf_dir):
    """One aggregate over all ten columns, from each format."""
    given, out = _facts(spark, sf_dir).select(*_TEN), None
    d = lambda f, c, n: f(c).cast("double").alias(n)
    for fmt in ("csv", "parquet", "orc"):
        path, as_is = scratch(spark, f"wide-{fmt}"), T.AS_IS if fmt == "csv" else {}
        given.write.format(fmt).options(**as_is).save(path)
        read = spark.read.schema(given.schema).format(fmt).options(**as_is).load(path)
        aggs = [F.count("*").alias("cnt"), d(F.sum, "funded_amnt", "s1"), d(F.max, "annual_inc", "m1"), d(F.max, "dti", "m2"), F.max(F.length("loan_id")).alias("l1"), F.max("purpose").alias("p1"), F.max("issue_month").alias("m3"), F.max("addr_state").alias("m4"), F.sum("term_months").alias("s4"), F.max("home_ownership").alias("h1"), F.max("grade").alias("g1")]
        part = read.agg(F.lit(fmt).alias("format"), *aggs)
        out = part if out is None else out.unionByName(part)
    return out
