"""Streams with state: keyed tables of delta files, windows of current rows, late rows under a watermark."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from tranchery.plans.scratch import scratch
from tranchery.streaming import changes as st
from tranchery.streaming.keyed import KeyedTable

START = datetime.datetime(2024, 1, 1)


def totals(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def table(spark, **options):
    return KeyedTable(spark, scratch(spark, "keyed"), "k long, n long", ["k"], totals, **options)


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "k long, n long")


def size(t, version):
    return {b: [f["path"] for f in files] for b, files in t.files(version).items()}


def test_versions_equal_a_model(spark):
    r, t, model, want = random.Random(4), table(spark, buckets=4, max_deltas=2), collections.Counter(), {}
    for v in range(7):
        pairs = [(r.randrange(30), r.randint(1, 5)) for _ in range(r.choice([0, 1, 20]))]
        t.add(rows_of(spark, pairs), v)
        for k, n in pairs:
            model[k] += n
        want[v] = dict(model)
        assert all(len(files) <= 2 for files in t.files(v).values())
    for v in want:
        assert {x["k"]: x["n"] for x in t.read(v).collect()} == want[v]
    assert t.versions() == list(range(7)) and t.read().count() == len(model)
    assert t.prune(2) > 0 and t.versions() == [5, 6]
    assert {x["k"]: x["n"] for x in t.read(5).collect()} == want[5] and t.read(4).count() == 0


def test_a_batch_writes_what_it_holds(spark):
    t = table(spark, buckets=8)
    t.add(rows_of(spark, [(k, 1) for k in range(20000)]), 0)
    before = size(t, 0)
    t.add(rows_of(spark, [(5, 1), (5, 2)]), 1)
    after = t.files(1)
    touched = [b for b in after if len(after[b]) == 2]
    assert len(touched) == 1 and all(before[b][0] == after[b][0]["path"] for b in before)
    assert 20 * after[touched[0]][1]["bytes"] < sum(f["bytes"] for files in after.values() for f in files)
    assert t.read().where("k = 5").first()["n"] == 4


def test_only_crowded_buckets_are_merged(spark):
    t = table(spark, buckets=4, max_deltas=3)
    t.add(rows_of(spark, [(k, 1) for k in range(100)]), 0)
    for v in range(1, 4):
        t.add(rows_of(spark, [(5, 1)]), v)
    first, last = size(t, 0), size(t, 3)
    merged = [b for b in first if last[b] != first[b]]
    assert len(merged) == 1 and len(last[merged[0]]) == 1
    assert t.read().where("k = 5").first()["n"] == 4 and t.read(2).where("k = 5").first()["n"] == 3


def test_running_a_batch_again_replaces_its_version(spark):
    t = table(spark)
    t.add(rows_of(spark, [(1, 1)]), 0)
    t.add(rows_of(spark, [(1, 10), (2, 1)]), 1)
    t.add(rows_of(spark, [(1, 10)]), 1)
    assert [tuple(x) for x in t.read().collect()] == [(1, 11)]
    t.add(rows_of(spark, []), 2)
    assert [tuple(x) for x in t.read().collect()] == [(1, 11)] and table(spark).read().count() == 0


def test_a_failed_write_leaves_the_last_version(spark):
    t = table(spark)
    t.add(rows_of(spark, [(1, 1)]), 0)
    with pytest.raises(Exception, match="stop"):
        t.add(rows_of(spark, [(2, 1)]).select("k", F.raise_error(F.lit("stop")).cast("long").alias("n")), 1)
    assert t.versions() == [0] and t.read(1).count() == 1


@pytest.mark.parametrize("seed", range(2))
def test_current_windows_for_any_split(spark, seed):
    r, log, now = random.Random(seed), [], {}
    for seq in range(120):
        pk, at = r.randrange(8), START + datetime.timedelta(seconds=r.randrange(1800))
        op = r.choice("ccud")
        log.append((seq, pk, at, op, None, None if op == "d" else ("g", r.randint(1, 9))))
    for x in log:
        now[x[1]] = max(now.get(x[1], x), x, key=lambda y: (y[2], y[0]))
    want = collections.Counter()
    for x in now.values():
        if x[5]:
            want[x[2].replace(second=0)] += 1
    r.shuffle(log)  # changes come in any order and any files
    source, out, checkpoint, left = scratch(spark, "source"), scratch(spark, "out"), scratch(spark, "cp"), list(log)
    while left:
        n = r.choice([1, 10, 50])
        part, left = left[:n], left[n:]
        spark.createDataFrame([(*x[:5], x[5] and (x[5][0], __import__("decimal").Decimal(x[5][1]))) for x in part], st.CHANGE).write.mode("append").json(source)
        st.run_available(st.current_windows(st.file_source(spark, source, None)), st.merge_windows(out), checkpoint)
    got = st.read_version(spark, out, st.WINDOWS).where("cnt != 0").collect()
    assert {x["window_start"]: x["cnt"] for x in got} == dict(want)
    assert sum(x["total"] for x in got) == sum(x[5][1] for x in now.values() if x[5])


def test_dropped_windows_are_counted(spark):
    source, out, checkpoint = scratch(spark, "late"), scratch(spark, "windows"), scratch(spark, "cp")
    at = lambda m, s=0: START + datetime.timedelta(minutes=m, seconds=s)
    slots = [[at(0), at(10)], [at(0, 30), at(0, 40), at(1), at(9, 58), at(20)], [at(30)]]
    dropped = []
    for rows in slots:
        df = spark.createDataFrame([(i, i, t, "c", None, ("g", None)) for i, t in enumerate(rows)], st.CHANGE)
        df.write.mode("append").json(source)
        progress = st.append_available(st.tumble(st.file_source(spark, source, None)), out, checkpoint)
        dropped.append(st.dropped_groups(progress))
    # windows 0 and 1 had been closed when three rows came for them; 9:58 is late by the clock only
    assert dropped == [0, 2, 0]
    got = {x["window_start"]: x["cnt"] for x in spark.read.parquet(out).collect()}
    assert got == {at(0): 1, at(9): 1, at(10): 1, at(20): 1}


@pytest.mark.parametrize("seed", range(1))
def test_current_windows_by_mirror_for_any_split(spark, seed):
    r, log, now = random.Random(seed + 7), [], {}
    for seq in range(120):
        pk, at = r.randrange(8), START + datetime.timedelta(seconds=r.randrange(1800))
        op = r.choice("ccud")
        log.append((seq, pk, at, op, None, None if op == "d" else ("g", r.randint(1, 9))))
    for x in log:
        now[x[1]] = max(now.get(x[1], x), x, key=lambda y: (y[2], y[0]))
    want = collections.Counter()
    for x in now.values():
        if x[5]:
            want[x[2].replace(second=0)] += 1
    r.shuffle(log)  # changes come in any order and any files
    source, out, checkpoint, left = scratch(spark, "source"), scratch(spark, "out"), scratch(spark, "cp"), list(log)
    writer = st.merge_current_windows(scratch(spark, "state"), out)
    while left:
        n = r.choice([1, 10, 50])
        part, left = left[:n], left[n:]
        spark.createDataFrame([(*x[:5], x[5] and (x[5][0], __import__("decimal").Decimal(x[5][1]))) for x in part], st.CHANGE).write.mode("append").json(source)
        st.run_available(st.file_source(spark, source, None), writer, checkpoint)
    last = spark.createDataFrame([(*x[:5], x[5] and (x[5][0], __import__("decimal").Decimal(x[5][1]))) for x in part], st.CHANGE)
    writer(last, len(st.windows_table(spark, out).versions()) - 1)  # the last batch is run again
    got = st.read_version(spark, out, st.WINDOWS).where("cnt != 0").collect()
    assert {x["window_start"]: x["cnt"] for x in got} == dict(want)
    assert sum(x["total"] for x in got) == sum(x[5][1] for x in now.values() if x[5])
