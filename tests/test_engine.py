"""Layers, metrics, quality and streams: invariants and small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from tranchery.operators import changelog, layers, metrics, profile, quality
from tranchery.plans import quality_queries
from tranchery.plans.check_sql import END
from tranchery.plans.scratch import scratch
from tranchery.sources import fixtures, tables
from tranchery.streaming import changes as st

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def snapshot(spark):
    return layers.month_end_snapshot(fixtures.loan_raw(spark, SF), END).persist()


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_snapshot_has_the_closed_form_count(spark, snapshot):
    assert layers.expected_snapshot_rows(fixtures.loan_raw(spark, SF), END).first()[0] == snapshot.count()


def test_vintage_without_window_agrees(snapshot):
    assert same(metrics.vintage(snapshot), metrics.vintage(snapshot, monotone=True))


def test_roll_rates_sum_to_one(snapshot):
    rates = metrics.roll_rates(snapshot).groupBy("from_month", "from_bucket").agg(F.sum("rate").alias("s"))
    assert rates.where(F.abs(F.col("s") - 1) > 0.001).count() == 0


def test_next_month_by_join_and_by_window_agree(snapshot):
    assert same(metrics.next_month_pairs(snapshot).select("loan_id", "from_month", "from_bucket", "to_bucket"), metrics.next_month_lead(snapshot).select("loan_id", "from_month", "from_bucket", "to_bucket"))


def test_snapshot_options(spark):
    raw = spark.createDataFrame([("1", "Jan-2001", None, "Current"), ("2", "Jan-2001", "Mar-2001", "Fully Paid")], "id string, issue_d string, last_pymnt_d string, loan_status string")
    raw = raw.withColumns({"out_prncp": F.lit(1).cast("decimal(14,2)"), "total_rec_prncp": F.lit(1).cast("decimal(14,2)"), "loan_amnt": F.lit(1).cast("decimal(14,2)"), "grade": F.lit("A")})
    last = lambda **o: {r["loan_id"]: r["dpd_bucket"] for r in layers.month_end_snapshot(raw, END, **o).where("snapshot_month = '2001-12'").collect()}
    assert last() == {"1": "CURRENT", "2": "DPD_120_PLUS"}
    assert last(never_paid_from_issue=True)["1"] == "DPD_120_PLUS"
    assert last(stop_at_payoff=True)["2"] == "CURRENT"


def test_applicants_keep_the_greatest_row_of_an_id(spark):
    rows = [("1", 10.0, None), ("1", 20.0, 1.0), ("1", 20.0, None), ("1", None, 9.0), (None, 5.0, 1.0)]
    raw = spark.createDataFrame(rows, "id string, annual_inc double, dti double").withColumns({c: F.lit(None).cast("string") for c in ("home_ownership", "emp_length", "addr_state", "fico_range_low")})
    for order in ("annual_inc", "dti"):
        got = layers.applicants(raw.orderBy(order)).collect()
        assert [(r["loan_id"], float(r["annual_inc"]), float(r["dti"])) for r in got] == [("1", 20.0, 1.0)]


def test_guard_ids_fails_on_a_bad_id(spark):
    with pytest.raises(Exception, match="not a loan id"):
        layers.guard_ids(spark.createDataFrame([("x1",)], "id string")).collect()


def test_empty_table_gives_an_empty_report(spark):
    assert quality.month_gaps(spark.createDataFrame([], "m string"), "m").count() == 0
    assert profile.distribution(spark.createDataFrame([], "g string"), "g").count() == 0


def test_partition_pruning_reaches_the_scan(spark, snapshot):
    path = scratch(spark, "prune")
    layers.write_snapshot(snapshot, path)
    read = spark.read.parquet(path).where("snapshot_month = '2001-06'")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_month" in plan
    assert len(read.inputFiles()) == len(spark.read.parquet(path).inputFiles())  # listing is by table; pruning is at run time
    assert read.count() == snapshot.where("snapshot_month = '2001-06'").count()


def test_table_diff_counts_null_against_value(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), (None, 3.0), ("w", 1.0)], "k string, v double")
    b = spark.createDataFrame([("x", None), ("y", 2.00005), (None, 3.0), ("z", 1.0)], "k string, v double")
    r = quality.table_diff(a, b, ["k"], {"v": 1e-6}, quantised=True).first()
    assert (r["left_only"], r["right_only"], r["over_tolerance"], r["quantised_mismatch"]) == (1, 1, 2, 0)


def test_lineage_faults(spark):
    edges = spark.createDataFrame([("a", "b", "a"), ("a", "b", "b"), ("b", "c", "b"), ("b", "gone", "b")], "src string, dst string, declared_by string")
    got = quality.lineage_faults(edges, spark.createDataFrame([("a",), ("b",), ("c",)], "name string"))
    assert {tuple(r) for r in got.collect()} == {("b", "c", "one_sided"), ("b", "gone", "one_sided"), ("b", "gone", "dangling:gone")}


def test_failed_errors(spark):
    ok = quality.check_row(spark.range(3), "n", "ERROR", "t", F.count("*"), F.lit(3))
    bad = quality.check_row(spark.range(3), "m", "ERROR", "t", F.count("*"))
    assert quality.failed_errors(quality.report([ok, bad], "b1")) == 1


def test_raw_lines_split_and_kinds(spark):
    df = spark.createDataFrame([("1,a",), ("1.5,b",), ("Total amount: 3",), ("",), ("id,x",), (".5,c",), ("1.2.3,x",)], "value string")
    assert tables.with_line_kind(df).where("kind = 'data'").count() == 3


def test_late_filled_column_is_kept(spark):
    df = spark.createDataFrame([(i, None if i < 50 else "x", None) for i in range(100)], "id int, late string, none string")
    kept = {r["column_name"]: r["kept_type"] for r in tables.column_kinds(df).collect()}
    assert kept == {"id": "double", "late": "string", "none": None}
    assert {r["column_name"]: r["kept_type"] for r in tables.column_kinds(df, sample_rows=10).collect()}["late"] is None


def test_signed_totals_equal_the_mirror(spark):
    log = fixtures.changes(spark, SF)
    totals = changelog.running_totals(changelog.signed_rows(log)).select("grp", "cnt", F.col("total").cast("decimal(24,2)"))
    now = changelog.mirror(log).groupBy("after.grp").agg(F.count("*").alias("cnt"), F.sum("after.amt").cast("decimal(24,2)").alias("total"))
    assert same(totals, now)


def _change(seq, pk, ts, op, after):
    return (seq, pk, ts, op, None, after)


def test_watermark_drops_only_what_is_two_batches_late(spark):
    source, out, checkpoint = scratch(spark, "late"), scratch(spark, "windows"), scratch(spark, "cp")
    at = lambda m, s=0: datetime.datetime(2024, 1, 1, 0, m, s)
    files = [[(1, at(0)), (2, at(10))], [(3, at(0, 30))], [(4, at(0, 40)), (5, at(20))], [(6, at(30))]]
    for i, rows in enumerate(files):
        df = spark.createDataFrame([_change(s, s, t, "c", ("g", None)) for s, t in rows], st.CHANGE)
        df.coalesce(1).write.mode("append").json(source)
        query = st.tumble(st.file_source(spark, source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        query.trigger(availableNow=True).start().awaitTermination()
        assert i < len(files)
    first = spark.read.parquet(out).where(F.col("window_start") == F.lit(at(0))).first()
    assert first["cnt"] == 1  # both late rows came after the window had been closed


def test_row_conservation_sees_lost_facts(spark, monkeypatch):
    whole = quality_queries._facts
    row = lambda: quality_queries._build("dq_row_conservation", spark, SF).first()
    assert row()["passed"]
    monkeypatch.setattr(quality_queries, "_facts", lambda *x: whole(*x).where(F.crc32("loan_id") % 5 != 0))
    lost = row()
    assert not lost["passed"] and lost["actual"] < lost["expected"] == fixtures.loan_raw(spark, SF).count()


def test_two_runs_append_versions(spark):
    out = scratch(spark, "versions")
    write = st.merge_totals(out)
    one = spark.createDataFrame([_change(1, 1, datetime.datetime(2024, 1, 1), "c", ("g", None))], st.CHANGE)
    write(one, 0)
    write(one, 1)
    write(one, 1)  # the same batch again overwrites its own version
    assert st.read_version(spark, out, st.TOTALS).first()["cnt"] == 2
    assert st.read_version(spark, out, st.TOTALS, 0).first()["cnt"] == 1


def test_jdbc_read_ranges(spark):
    from tranchery.sources import tables as T

    url = "jdbc:derby:memory:ranges;create=true"
    T.jdbc_write(spark.range(100).withColumnRenamed("id", "k"), url, "t", mode="overwrite")
    T.jdbc_write(spark.range(100, 120).withColumnRenamed("id", "k"), url, "t")
    back = T.jdbc_read_ranges(spark, url, "t", "k", 3)
    assert back.rdd.getNumPartitions() == 3 and sorted(r[0] for r in back.collect()) == list(range(120))
    T.jdbc_write(spark.range(0).withColumnRenamed("id", "k"), url, "t", mode="overwrite")
    assert T.jdbc_read_ranges(spark, url, "t", "k", 3).count() == 0
