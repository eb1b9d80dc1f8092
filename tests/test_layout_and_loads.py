"""File layout, skewed keys, sketches, incremental upkeep, and the loan run that stops."""

import collections
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tranchery.operators import incremental, joins, layers, metrics, observe, profile, quality, skew
from tranchery.operators.loan_run import LoanRun, StoppedByChecks
from tranchery.plans.check_sql import END
from tranchery.plans.scratch import scratch
from tranchery.sources import fixtures, layout

SF = "/root/testdata/sf0.001"


def on_disk(path):
    path = path.removeprefix("file:")
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def skewed(spark, n=20000):
    return spark.range(n).select("id", F.when(F.col("id") % 10 != 0, "hot").when(F.col("id") % 20 == 0, F.concat(F.lit("m "), F.col("id") % 7)).alias("m"), F.sha2(F.col("id").cast("string"), 256).alias("v"))


def test_listing_equals_the_disk(spark):
    path = scratch(spark, "listed")
    skewed(spark, 500).repartition(5).write.partitionBy("m").parquet(path)
    got = {re.sub("^file:/+", "/", r["file"]).replace("%20", " "): (r["bytes"], r["m"]) for r in layout.listed_files(spark, path, "m").collect()}
    want = on_disk(path)
    assert {k.replace("%20", " "): v for k, v in want.items()} == {k: b for k, (b, _) in got.items()}
    assert {m for _, m in got.values()} == {"hot", None, *(f"m {i}" for i in range(7))}
    assert layout.file_stats(spark, path).first()["bytes"] == sum(want.values())


def test_bounded_write_of_a_skewed_column(spark):
    path, df = scratch(spark, "bounded"), skewed(spark)
    layout.write_bounded(df, path, "m", 1000)
    per_file = spark.read.parquet(path).groupBy(F.col("_metadata.file_path"), "m").agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in per_file) <= 1000 and collections.Counter(r["m"] for r in per_file)["hot"] == 20
    assert all(n == 1 for m, n in collections.Counter(r["m"] for r in per_file).items() if m not in ("hot", None))
    assert spark.read.parquet(path).select("id", "m", "v").exceptAll(df).count() == 0 and spark.read.parquet(path).count() == df.count()
    layout.write_bounded(df.where("m = 'm 3'").limit(1), path, "m", 1000)  # replaces that partition only
    left = {r["m"]: r["count"] for r in spark.read.parquet(path).groupBy("m").count().collect()}
    assert left["m 3"] == 1 and left["hot"] == 18000
    layout.write_bounded(df.limit(0), scratch(spark, "nothing"), "m")


def test_compaction_by_bytes(spark):
    many, few, df = scratch(spark, "many"), scratch(spark, "few"), skewed(spark)
    df.repartition(30).write.partitionBy("m").parquet(many)
    target = 200_000
    layout.compact(spark, many, few, "m", target)
    sizes = on_disk(few)
    assert max(sizes.values()) <= target and len(sizes) < len(on_disk(many)) / 5
    assert sum(v < target / 3 for k, v in sizes.items() if "m=hot" in k) <= 1
    assert spark.read.parquet(few).select("id", "m", "v").exceptAll(df).count() == 0 and spark.read.parquet(few).count() == df.count()
    flat, out = scratch(spark, "flat"), scratch(spark, "out")
    df.coalesce(1).write.parquet(flat)
    layout.compact(spark, flat, out, None, target)  # one file beyond the target is dealt out
    assert len(on_disk(out)) == -(-sum(on_disk(flat).values()) // target) and spark.read.parquet(out).count() == df.count()


def test_scan_counters(spark):
    path = scratch(spark, "scan")
    layout.write_bounded(skewed(spark, 1000), path, "m")
    table = spark.read.schema("id long, v string, m string").parquet(path)
    one, all_ = layout.scanned(table.where("m = 'm 3'").agg(F.count("*"))), layout.scanned(table.agg(F.count("*")))
    assert one["files"] == 1 and all_["files"] == 9 and all_["rows"] == 1000 and one["bytes"] < all_["bytes"]
    assert all_["bytes"] == sum(on_disk(path).values())


def test_only_heavy_keys_are_salted(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.4 else None if r.random() < 0.2 else f"k{r.randrange(3000)}", i % 11, i) for i in range(20000)]
    df = spark.createDataFrame(rows, "k string, v int, i long").repartition(6)
    salts = {x["k"]: x["n"] for x in df.groupBy("k").agg(F.count_distinct(skew.hot_salt(df, ["k"], "i", 8, 0.05)).alias("n")).collect()}
    assert salts.pop("hot") == 8 and salts.pop(None) == 8 and set(salts.values()) == {1}
    count = collections.Counter(k for k, _, _ in rows)
    assert {x["k"]: x["cnt"] for x in skew.heavy_hitters(df, ["k"], 0.05).collect()} == {k: n for k, n in count.items() if n >= 1000}
    assert {(x["k"], x["cnt"]) for x in skew.salted_sums(df, ["k"], "v", "i", 8, 0.05).collect()} == set(count.items())
    values = collections.defaultdict(set)
    for k, v, _ in rows:
        values[k].add(v)
    assert {x["k"]: x["distinct_values"] for x in skew.salted_distinct(df, ["k"], "v", 8, 0.05).collect()} == {k: len(v) for k, v in values.items()}
    assert skew.heavy_hitters(df.limit(0), ["k"]).count() == 0 and skew.salted_distinct(df.limit(0), ["k"], "v").count() == 0


def test_sketches_merge_to_the_whole(spark):
    df = spark.range(30000).select("id", (F.col("id") % 100).cast("decimal(10,2)").alias("d"), F.when(F.col("id") % 3 == 0, F.lit("x")).alias("t"), F.lit(None).cast("double").alias("none"))
    parts = profile.sketches(df.where("id < 9000")).union(profile.sketches(df.where("id >= 9000"))).union(profile.sketches(df.limit(0)))
    got = {r["column_name"]: r for r in profile.sketched_profile(profile.merged_sketches(parts)).collect()}
    assert {c: (r["n"], r["missing"]) for c, r in got.items()} == {"id": (30000, 0), "d": (30000, 0), "t": (30000, 20000), "none": (30000, 30000)}
    assert abs(got["id"]["distinct_values"] / 30000 - 1) < 0.05 and got["t"]["distinct_values"] == 1 and got["none"]["distinct_values"] == 0
    assert all(abs(q / 30000 - s) < 0.03 for q, s in zip(got["id"]["quantiles"], (0.05, 0.5, 0.95), strict=True)) and got["t"]["quantiles"] is None


def test_upkeep_equals_a_model(spark):
    r, rows, at = random.Random(6), [], 0
    kept = incremental.Upkeep(spark, scratch(spark, "upkeep"), buckets=4)
    for step in range(4):
        fresh = r.choice([0, 5, 25]) if step else 30
        for _ in range(fresh):
            at += 1
            rows.append((r.randrange(12), r.choice(["a", "b", None]), r.randint(1, 9), at))
        source = spark.createDataFrame(rows, "pk long, grp string, amt int, at long").withColumn("amt", F.col("amt").cast("decimal(14,2)"))
        assert kept.load(source) == len({x[0] for x in rows[len(rows) - fresh :]})
        last = {pk: (g, a) for pk, g, a, _ in rows}
        want = collections.Counter(g for g, _ in last.values() if g)
        assert {x["grp"]: x["cnt"] for x in kept.current().collect()} == want
        assert sum(x["total"] for x in kept.current().collect()) == sum(a for g, a in last.values() if g)
    assert kept.marks.read().first()["mark"] == at


def test_a_failed_load_is_run_again(spark, monkeypatch):
    kept = incremental.Upkeep(spark, scratch(spark, "upkeep"))
    rows = lambda *x: spark.createDataFrame(list(x), "pk long, grp string, amt int, at long").withColumn("amt", F.col("amt").cast("decimal(14,2)"))
    kept.load(rows((1, "a", 1, 1)))
    monkeypatch.setattr(kept.marks, "add", lambda *x: (_ for _ in ()).throw(RuntimeError("stopped before the mark")))
    with pytest.raises(RuntimeError, match="before the mark"):
        kept.load(rows((1, "b", 1, 2)))
    monkeypatch.undo()
    kept.load(rows((1, "b", 1, 2), (2, "b", 4, 3)))
    assert {x["grp"]: (x["cnt"], float(x["total"])) for x in kept.current().collect()} == {"b": (2, 5.0)}


def test_bucketed_snapshot_needs_no_shuffle_by_loan(spark):
    snapshot = layers.month_end_snapshot(fixtures.loan_raw(spark, SF), END)
    table = layers.save_bucketed(snapshot, "tranchery_test_bucketed", scratch(spark, "bucketed"), buckets=4)
    plan = metrics.next_month_lead(table)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    same = lambda d: sorted(map(str, d.collect()))
    assert same(metrics.roll_rates(table)) == same(metrics.roll_rates(snapshot, by_join=True))
    spark.sql("drop table tranchery_test_bucketed")


def test_join_strategies(spark):
    a, b = spark.range(100), spark.range(50).withColumn("x", F.lit(1))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(a.join(b.hint("merge"), "id")) and "BroadcastHashJoin" in plan(a.join(joins.small_side(b), "id"))
    given = joins.small_side(b, most_rows=10)
    assert "Broadcast" not in given._jdf.queryExecution().analyzed().toString() and "ResolvedHint" not in given._jdf.queryExecution().analyzed().toString()


def test_plan_nodes_of_any_depth(spark):
    node = {"nodeName": "Scan", "metrics": [{"name": "rows", "accumulatorId": 1}], "children": []}
    for i in range(40):
        node = {"nodeName": f"Project {i}", "metrics": [], "children": [node]}
    start = json.dumps({"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 3, "sparkPlanInfo": node})
    task = json.dumps({"Event": "SparkListenerTaskEnd", "Task Info": {"Accumulables": [{"ID": 1, "Update": "5"}]}})
    log = spark.createDataFrame([(json.loads(x)["Event"], x) for x in (start, task, task)], "event string, value string")
    assert [tuple(x) for x in observe.plan_metrics(log).collect()] == [(3, "Scan", "rows", 10)]


def test_loan_run_stops_on_a_failed_check(spark):
    raw = fixtures.loan_raw(spark, SF)
    doubled = raw.union(raw.where("id = '7'"))
    run = LoanRun(doubled, scratch(spark, "run"), END)
    with pytest.raises(StoppedByChecks) as e:
        run.all()
    assert e.value.failed == ["pk_unique"] and set(e.value.tables) == {"facts", "rejects", "performance"}
    assert run.report().count() == 6
    done = LoanRun(raw, scratch(spark, "run"), END)
    tables = done.all()
    assert len(tables) == 11 and quality.failed_errors(done.report()) == 0 and tables["vintages"].count() > 0


def test_monitoring_statuses(spark):
    rows = [(f"2024-01-{d:02d} 10:00:00", 1.0 + d % 2, d) for d in range(1, 10) for _ in range(10)] + [("2024-01-10 09:00:00", 50.0, 10)]
    df = spark.createDataFrame(rows, "t string, v double, d int").withColumn("t", F.to_timestamp("t"))
    got = {(r["check_name"], r["day"]): r["status"] for r in quality.monitored(df, "t", "v", "2024-01-20").collect()}
    assert got["freshness", "2024-01-20"] == "FAIL" and got["volume", "2024-01-01"] == "NEW" and got["volume", "2024-01-05"] == "PASS"
    assert got["volume", "2024-01-10"] == "FAIL" and got["range", "2024-01-10"] == "FAIL" and got["range", "2024-01-09"] == "PASS"
    assert [r["status"] for r in quality.monitored(df.limit(0), "t", "v", "2024-01-20").collect()] == ["NONE"]


def test_bounded_write_has_the_files_that_its_rule_gives(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 3900, "hot").otherwise("cold").alias("m"))
    for per_file in (130, 390, 1300):  # at 130 by a plain hash some of 33 files would hold more
        path = scratch(spark, "by-rule")
        layout.write_bounded(df, path, "m", per_file)
        files = {}
        for r in spark.read.parquet(path).groupBy("m", F.col("_metadata.file_path").alias("f")).count().collect():
            files.setdefault(r["m"], []).append(r["count"])
        for m, n in {"hot": 3900, "cold": 100}.items():
            want = 1 if n <= per_file else -(-n * 11 // (per_file * 10))
            assert max(files[m]) <= per_file and len(files[m]) == want, (m, per_file)
        assert spark.read.parquet(path).select("id", "m").exceptAll(df).count() == 0 and spark.read.parquet(path).count() == 4000
    path, exact = scratch(spark, "exact"), spark.range(20000).select("id", F.lit("hot").alias("m"))
    layout.write_bounded(exact, path, "m", 2000)  # 1.1 * 20000 / 2000 is 11, in doubles a little more
    assert len(on_disk(path)) == 11


def test_file_stats_sql_counts_files_beyond_a_million_rows():
    import duckdb

    from tranchery.plans.registry import SQL

    con = duckdb.connect()
    con.execute("create table orders as select case when i < 2000000 then 'F' when i < 3000000 then 'O' end o_orderstatus from range(3000007) t(i)")
    assert dict(con.execute(SQL["file_stats"]).fetchall()) == {"F": 3, "O": 1, None: 1}


def test_snapshot_is_written_by_loans(spark):
    raw, path = fixtures.loan_raw(spark, SF), scratch(spark, "by-loans")
    want = layers.month_end_snapshot(raw, END)
    loans = layers.snapshot_loans(raw)
    dealt = layers.deal_by_issue(loans, 100)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert dealt.rdd.getNumPartitions() == 15 and max(sizes) < 160 and sum(sizes) == loans.count()
    layers.build_snapshot(raw, END, path, rows_per_file=40, loans_per_task=100)
    got = spark.read.schema(want.schema).parquet(path)
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).count() == 0
    assert max(r["count"] for r in got.groupBy(F.col("_metadata.file_path")).count().collect()) <= 40


def test_buckets_of_the_snapshot_follow_its_rows(spark):
    raw = fixtures.loan_raw(spark, SF)
    want, path = layers.month_end_snapshot(raw, END), scratch(spark, "bucketed")
    table = layers.save_snapshot_bucketed(raw, END, "tranchery_test_by_rows", path, rows_per_bucket=1000)
    assert len(on_disk(path)) == -(-want.count() // 1000) > 16
    assert table.count() == want.count() and table.select(want.columns).exceptAll(want).count() == 0


def test_loan_run_reads_what_raw_is_made_of_once(spark):
    run = LoanRun(fixtures.loan_raw(spark, SF), scratch(spark, "run"), END)
    run.land()
    assert run.raw.inputFiles() and all(run.path.split("/")[-1] + "/landed/" in f for f in run.raw.inputFiles())
