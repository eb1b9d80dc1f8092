"""Streaming queries: the change log of ``events`` is written as files, streamed to the end, and the tables read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from tranchery.functions import loan as L
from tranchery.operators import changelog, observe, quality
from tranchery.plans import check_sql as S
from tranchery.plans.catalog import query
from tranchery.plans.scratch import scratch
from tranchery.sources import tables as T
from tranchery.sources.fixtures import changes
from tranchery.streaming import changes as st

C = F.col
SLOTS = 3
#: changes of these sequence numbers come one slot, or two, after those around them
_LATE = ((17, 3, 1), (23, 5, 2))
#: the slot of each change in SQL (named ``arrived``): thirds of the sequence numbers, then the late ones
_EDGE = "(select min(event_id) + (max(event_id) + 1 - min(event_id)) * {i} // {n} from events)"
_SLOT = "(" + " + ".join(f"(seq >= {_EDGE.format(i=i, n=SLOTS)})::int" for i in range(1, SLOTS)) + ")"
_ARRIVED = f"arrived as (select *, least({SLOTS - 1}, {_SLOT} + case " + " ".join(f"when seq % {m} = {r} then {d}" for m, r, d in _LATE) + f" else 0 end) slot, least({SLOTS - 1}, {_SLOT}) own from log)"


def _slots(spark, sf_dir, late=False):
    """The change log with the slot in which each change comes, staged by slot: a range of sequence numbers, and with
    ``late`` the changes that were held up."""
    log = changes(spark, sf_dir)
    edges = T.read_table(spark, sf_dir, "events").agg(F.min("event_id"), F.max("event_id")).first()
    low, high = edges[0] or 0, (edges[1] or 0) + 1
    own = sum((C("seq") >= low + (high - low) * i // SLOTS).cast("int") for i in range(1, SLOTS))
    slot = own
    if late:
        held = None
        for m, r, d in _LATE:
            held = (held.when if held is not None else F.when)(C("seq") % m == r, d)
        slot = F.least(F.lit(SLOTS - 1), slot + held.otherwise(0))
    path = scratch(spark, "slots")
    log.withColumns({"slot": slot.cast("int"), "own": own.cast("int")}).write.partitionBy("slot").parquet(path)
    staged = spark.read.schema(f"{st.CHANGE}, own int, slot int").parquet(path)
    return [staged.where(f"slot = {i}") for i in range(SLOTS)]


def _fed(spark, sf_dir, run, late=False):
    """Writes the files of one slot after the other into a stream's source, and lets ``run(stream, checkpoint)`` take
    what has come each time; what the runs return."""
    source, checkpoint, out = scratch(spark, "changes"), scratch(spark, "checkpoint"), []
    for part in _slots(spark, sf_dir, late):
        part.drop("slot", "own").write.mode("append").json(source)
        out.append(run(st.file_source(spark, source, files_per_batch=None), checkpoint))
    return out


def _streamed(spark, sf_dir, writer_of, late=False):
    out = scratch(spark, "streamed")
    _fed(spark, sf_dir, lambda stream, checkpoint: st.run_available(stream, writer_of(out), checkpoint), late)
    return out


@query("changelog_source", S.with_parts("select op, count(*) cnt from log group by op", "log"))
def changelog_source(spark, sf_dir):
    out = _streamed(spark, sf_dir, st.append_batch)
    return spark.read.parquet(out).groupBy("op").agg(F.count("*").alias("cnt"))


_IMAGE = """'{"grp":"' || g%d || '","amt":' || cast(a%d as varchar) || '}'"""
_ENVELOPE = f"""'{{"seq":' || seq || ',"pk":' || pk || ',"op_ts":"' || strftime(op_ts, '%Y-%m-%dT%H:%M:%S.%g') || '","op":"' || op || '"' || coalesce(',"before":' || {_IMAGE % (0, 0)}, '') || coalesce(',"after":' || {_IMAGE % (1, 1)}, '') || '}}'"""


@query("changelog_sink", S.with_parts(f"select cast(pk as varchar) as key, {_ENVELOPE} as value from log", "log"))
def changelog_sink(spark, sf_dir):
    return st.to_envelopes(changes(spark, sf_dir))


@query("debezium_unpack", S.with_parts("select seq, op, g0 before_grp, cast(a1 as double) after_amt from log", "log"))
def debezium_unpack(spark, sf_dir):
    text = changes(spark, sf_dir).select("seq", F.to_json(F.struct("op", "before", "after")).alias("value"))
    e = text.select("seq", L.unpack_envelope(C("value"), "grp string, amt decimal(14,2)").alias("e"))
    return e.select("seq", "e.op", C("e.before.grp").alias("before_grp"), C("e.after.amt").cast("double").alias("after_amt"))


_MIRROR = "select pk, g1 grp, cast(a1 as double) amt from latest"
_TOTALS = "select grp, cast(sum(sign) as bigint) cnt, cast(sum(sign * amt) as double) total from signed group by grp having sum(sign) <> 0"


@query("latest_per_key", S.with_parts(_MIRROR, "latest"))
def latest_per_key(spark, sf_dir):
    return changelog.mirror(changes(spark, sf_dir)).select("pk", "after.grp", C("after.amt").cast("double").alias("amt"))


@query("mirror_latest", S.with_parts(_MIRROR, "latest"))
def mirror_latest(spark, sf_dir):
    out = _streamed(spark, sf_dir, st.merge_latest)
    return st.read_version(spark, out, st.STATE).where("op != 'd'").select("pk", "grp", C("amt").cast("double").alias("amt"))


@query("month_agg_upsert", S.with_parts(_TOTALS, "signed"))
def month_agg_upsert(spark, sf_dir):
    out = _streamed(spark, sf_dir, st.merge_totals)
    return st.read_version(spark, out, st.TOTALS).where("cnt != 0").select("grp", "cnt", C("total").cast("double").alias("total"))


@query("multi_sink", S.with_parts("select (select count(*) from latest) mirror_rows, (select count(*) from log) change_rows, (select cast(sum(sign) as bigint) from signed) total_rows", "latest", "signed"))
def multi_sink(spark, sf_dir):
    mirror, totals, log = (scratch(spark, n) for n in ("mirror", "totals", "log"))
    writer = st.multi_sink(st.merge_latest(mirror), st.merge_totals(totals), st.append_batch(log))
    _fed(spark, sf_dir, lambda stream, checkpoint: st.run_available(stream, writer, checkpoint))
    a = st.read_version(spark, mirror, st.STATE).where("op != 'd'").agg(F.count("*").alias("mirror_rows"))
    b = spark.read.parquet(log).agg(F.count("*").alias("change_rows"))
    c = st.read_version(spark, totals, st.TOTALS).agg(F.sum("cnt").alias("total_rows"))
    return a.crossJoin(b).crossJoin(c)


def _windows(df):
    return df.select("window_start", "cnt", C("total").cast("double").alias("total"))


def _closed(spark, sf_dir, late, *window):
    """(closed windows, progress of the runs) of the insert-only windows over the slots."""
    out = scratch(spark, "windows")
    progress = _fed(spark, sf_dir, lambda stream, checkpoint: st.append_available(st.tumble(stream, *window), out, checkpoint), late)
    return spark.read.schema(st.CLOSED).parquet(out), [p for run in progress for p in run]


@query("tumble_1min", S.with_parts("select date_trunc('minute', op_ts) window_start, count(*) cnt, cast(sum(a1) as double) total from log where g1 is not null group by 1 having date_trunc('minute', op_ts) + interval 1 minute <= (select max(op_ts) from log where g1 is not null) - interval 5 second", "log"))
def tumble_1min(spark, sf_dir):
    return _windows(_closed(spark, sf_dir, False)[0])


#: insert-only windows of a day under a watermark a day behind: a change is late where the watermark of the slots before
#: its own has passed the end of its window; a window is closed once the last watermark has passed it
_LATENESS = f"""{_ARRIVED},
added as (select *, cast(date_trunc('day', op_ts) as timestamp) w from arrived where g1 is not null),
marked as (select *, w + interval 1 day <= (select date_trunc('milliseconds', max(op_ts)) - interval 1 day from added e where e.slot < added.slot) late from added),
closed as (select w window_start, count(*) cnt, cast(sum(a1) as double) total from marked where late is not true and w + interval 1 day <= (select date_trunc('milliseconds', max(op_ts)) - interval 1 day from added) group by 1)"""


def _late_sql(body):
    return S.with_parts("", "latest").rstrip() + ",\n" + _LATENESS + "\n" + body


@query("stream_watermark", _late_sql("select * from closed"))
def stream_watermark(spark, sf_dir):
    return _windows(_closed(spark, sf_dir, True, "1 day", "1 day")[0])


@query("late_data", _late_sql("select (select count(*) from latest) mirror_rows, (select count(*) from arrived where slot > own) late_rows, (select count(*) from closed) closed_windows, (select cast(sum(cnt) as bigint) from closed) window_rows, (select count(*) from (select distinct slot, w from marked where late)) dropped_windows"))
def late_data(spark, sf_dir):
    """The same late log by record and by window: the mirror takes every change, closed windows take none."""
    mirror = _streamed(spark, sf_dir, st.merge_latest, late=True)
    now = st.read_version(spark, mirror, st.STATE).where("op != 'd'").agg(F.count("*").alias("mirror_rows"))
    late = [p.agg(F.count_if(C("own") < C("slot")).alias("n")) for p in _slots(spark, sf_dir, late=True)]
    late = reduce(lambda a, b: a.unionByName(b), late)
    closed, progress = _closed(spark, sf_dir, True, "1 day", "1 day")
    windows = closed.agg(F.count("*").alias("closed_windows"), F.sum("cnt").alias("window_rows"))
    return now.crossJoin(late.agg(F.sum("n").alias("late_rows"))).crossJoin(windows).withColumn("dropped_windows", F.lit(st.dropped_groups(progress)).cast("long"))


@query("tumble_changelog", S.with_parts("select date_trunc('minute', op_ts) window_start, count(*) cnt, cast(sum(a1) as double) total from latest group by 1", "latest"))
def tumble_changelog(spark, sf_dir):
    """Windows of current rows over the late log, by the last change of each key."""
    out, state = scratch(spark, "current-windows"), scratch(spark, "current-keys")
    _fed(spark, sf_dir, lambda stream, checkpoint: st.run_available(stream, st.merge_current_windows(state, out), checkpoint), late=True)
    return _windows(st.read_version(spark, out, st.WINDOWS).where("cnt != 0"))


@query("exactly_once_restart", S.with_parts(_TOTALS, "signed"))
def exactly_once_restart(spark, sf_dir):
    """The second batch fails after its sink wrote and before it was committed, and is run again."""
    out = scratch(spark, "restart")

    def failing(batch, batch_id):
        st.merge_totals(out)(batch, batch_id)
        if batch_id == 1:
            raise RuntimeError("stopped after the sink wrote, before the batch was committed")

    def run(stream, checkpoint):
        try:
            st.run_available(stream, failing, checkpoint)
        except Exception as e:  # the stream reports the stop as its own error
            if "stopped after the sink wrote" not in str(e):
                raise
            st.run_available(stream, st.merge_totals(out), checkpoint)

    _fed(spark, sf_dir, run)
    return st.read_version(spark, out, st.TOTALS).where("cnt != 0").select("grp", "cnt", C("total").cast("double").alias("total"))


@query("as_of_version", S.with_parts("""select v.version, count(*) n_rows, cast(sum(a1) as double) total from (select unnest([0, 1, 2]) as version) v, lateral (select * from (select *, row_number() over (partition by pk order by op_ts desc, seq desc) rn from log
  where seq < (select min(event_id) + (max(event_id) + 1 - min(event_id)) * (v.version + 1) // 3 from events)) where rn = 1 and op <> 'd') l group by 1""", "log"))
def as_of_version(spark, sf_dir):
    """Every version of the mirror, read back from its manifest."""
    out, all_ = _streamed(spark, sf_dir, st.merge_latest), None
    for v in range(SLOTS):
        part = st.read_version(spark, out, st.STATE, v).where("op != 'd'").agg(F.lit(v).alias("version"), F.count("*").alias("n_rows"), F.sum("amt").cast("double").alias("total"))
        all_ = part if all_ is None else all_.unionByName(part)
    return all_


@query("stream_read_summary", S.with_parts("select count(*) groups, cast(sum(cnt) as bigint) n_rows, round(sum(total), 2) total from (" + _TOTALS + ")", "signed"))
def stream_read_summary(spark, sf_dir):
    out = _streamed(spark, sf_dir, st.merge_totals)
    return st.read_version(spark, out, st.TOTALS).where("cnt != 0").agg(F.count("*").alias("groups"), F.sum("cnt").alias("n_rows"), F.round(F.sum("total").cast("double"), 2).alias("total"))


@query("stream_table_export", S.with_parts("select grp, cast(sum(sign) as bigint) cnt, cast(cast(sum(sign * amt) as decimal(24,2)) as varchar) total from signed group by grp having sum(sign) <> 0", "signed"))
def stream_table_export(spark, sf_dir):
    out, path = _streamed(spark, sf_dir, st.merge_totals), scratch(spark, "export")
    T.write_csv_single(st.read_version(spark, out, st.TOTALS).where("cnt != 0").select("grp", "cnt", C("total").cast("string").alias("total")), path)
    return spark.read.schema("grp string, cnt long, total string").option("header", True).csv(path)


@query("snapshot_to_changes", S.with_parts("""select coalesce(a.pk, b.pk) pk, case when a.pk is null then 'c' when b.pk is null then 'd' else 'u' end op from (select * from (select *, row_number() over (partition by pk order by op_ts desc, seq desc) rn from log where seq < (select max(event_id) // 2 from events)) where rn = 1 and op <> 'd') a
  full outer join latest b on a.pk = b.pk where (a.g1, a.a1) is distinct from (b.g1, b.a1) or a.pk is null or b.pk is null""", "latest"))
def snapshot_to_changes(spark, sf_dir):
    log = changes(spark, sf_dir)
    half = T.read_table(spark, sf_dir, "events").agg(F.expr("max(event_id) div 2")).first()[0] or 0
    rows = lambda d: changelog.mirror(d).select("pk", "after.grp", "after.amt")
    return changelog.diff_versions(rows(log.where(C("seq") < half)), rows(log), ["pk"]).select("pk", "op")


def _latency(spark, sf_dir):
    shipped = T.read_table(spark, sf_dir, "events").withColumn("sink", C("ts") + F.make_interval(secs=(C("event_id") % 7).cast("decimal(18,6)")))
    return shipped.agg(F.count("*").alias("cnt"), F.min(L.ts_diff_ms(C("sink").cast("timestamp"), C("ts").cast("timestamp"))).alias("min_ms"), F.round(F.avg(L.ts_diff_ms(C("sink").cast("timestamp"), C("ts").cast("timestamp"))), 4).alias("avg_ms"), F.max(L.ts_diff_ms(C("sink").cast("timestamp"), C("ts").cast("timestamp"))).alias("max_ms"))


@query("latency_stats", "select count(*) cnt, min(event_id % 7) * 1000.0::double min_ms, round(avg(event_id % 7) * 1000, 4) avg_ms, max(event_id % 7) * 1000.0::double max_ms from events")
def latency_stats(spark, sf_dir):
    return _latency(spark, sf_dir)


@query("end_to_end_latency", S.with_parts("", "log").rstrip() + ",\n" + _ARRIVED + """,
last as (select *, row_number() over (partition by pk order by op_ts desc, seq desc) rn from (select *, max(op_ts) over (partition by own) sink_ts from arrived))
select count(*) cnt, min(d) min_ms, round(avg(d), 4) avg_ms, max(d) max_ms from (select (epoch_us(sink_ts) // 1000 - epoch_us(op_ts) // 1000)::double d from last where rn = 1)""")
def end_to_end_latency(spark, sf_dir):
    """From each key's last change to the time its batch was written, on the clock of the log."""
    out = _streamed(spark, sf_dir, lambda path: st.merge_latest(path, event_clock=True))
    took = L.ts_diff_ms(C("sink_ts"), C("op_ts"))
    return st.read_version(spark, out, st.STATE).agg(F.count("*").alias("cnt"), F.min(took).alias("min_ms"), F.round(F.avg(took), 4).alias("avg_ms"), F.max(took).alias("max_ms"))


@query("batch_stream_reconcile", S.with_parts("select grp, cast(sum(sign) as bigint) batch_cnt, cast(sum(sign) as bigint) stream_cnt, 0::bigint cnt_diff, cast(sum(sign * amt) as double) batch_sum, cast(sum(sign * amt) as double) stream_sum, 0.0::double sum_diff, 'equal' status from signed group by grp having sum(sign) <> 0", "signed"))
def batch_stream_reconcile(spark, sf_dir):
    batch = changelog.mirror(changes(spark, sf_dir)).groupBy("after.grp").agg(F.count("*").alias("cnt"), F.sum("after.amt").cast("decimal(24,2)").alias("total"))
    stream = st.read_version(spark, _streamed(spark, sf_dir, st.merge_totals), st.TOTALS).where("cnt != 0")
    done = quality.reconcile(batch, stream, "grp")
    return done.withColumns({c: C(c).cast("double") for c in ("batch_sum", "stream_sum", "sum_diff")})


def _event_log(spark, sf_dir):
    """An engine event log of tasks, one per order, staged by status, written as gzip text and read as such."""
    orders = T.read_table(spark, sf_dir, "orders")
    stage = F.ascii("o_orderstatus")
    line = F.to_json(F.struct(F.lit("SparkListenerTaskEnd").alias("Event"), stage.alias("Stage ID"), F.struct(F.lit(0).cast("long").alias("Launch Time"), (C("o_orderkey") % 1000).cast("long").alias("Finish Time"), F.array(F.struct((C("o_orderkey") % 3).cast("long").alias("ID"), F.lit("2").alias("Update"))).alias("Accumulables")).alias("Task Info")))
    plan = '{"Event":"org.apache.spark.sql.execution.ui.SparkListenerSQL%s","executionId":7,"sparkPlanInfo":{"nodeName":"%s","metrics":[{"name":"rows","accumulatorId":1}],"children":[{"nodeName":"Scan","metrics":[{"name":"files","accumulatorId":2}],"children":[]}]}}'
    plans = spark.createDataFrame([(plan % ("ExecutionStart", "First"),), (plan % ("AdaptiveExecutionUpdate", "Final"),)], "value string")
    path = scratch(spark, "events")
    orders.select(line.alias("value")).union(plans).write.option("compression", "gzip").text(path)
    return T.read_event_log(spark, path)


@query("eventlog_scan", "select 'SparkListenerTaskEnd' event, count(*) cnt from orders union all select 'org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart', 1 union all select 'org.apache.spark.sql.execution.ui.SparkListenerSQLAdaptiveExecutionUpdate', 1")
def eventlog_scan(spark, sf_dir):
    return _event_log(spark, sf_dir).groupBy("event").agg(F.count("*").alias("cnt"))


@query("task_skew_stats", "select ascii(o_orderstatus) stage_id, count(*) tasks, min(o_orderkey % 1000) min_ms, median(o_orderkey % 1000) median_ms, max(o_orderkey % 1000) max_ms, cast(sum(o_orderkey % 1000) as bigint) total_ms, round(max(o_orderkey % 1000) / median(o_orderkey % 1000), 2) skew from orders group by 1 having count(*) > 1")
def task_skew_stats(spark, sf_dir):
    return observe.task_skew(_event_log(spark, sf_dir))


@query("scan_metrics", "select 7::bigint execution_id, 'Final' node, 'rows' metric, cast(2 * count(*) filter (o_orderkey % 3 = 1) as bigint) as value from orders union all select 7, 'Scan', 'files', cast(2 * count(*) filter (o_orderkey % 3 = 2) as bigint) from orders")
def scan_metrics(spark, sf_dir):
    return observe.plan_metrics(_event_log(spark, sf_dir))


@query("jdbc_rw", "select c_custkey, c_name, c_nationkey, c_acctbal from customer")
def jdbc_rw(spark, sf_dir):
    """Replaces a table of a relational store by one half of the customers, appends the other, reads by key range."""
    url, given = _relational(spark), T.read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    T.jdbc_write(given.where("c_custkey % 2 = 0"), url, "customer", mode="overwrite")
    T.jdbc_write(given.where("c_custkey % 2 = 1"), url, "customer")
    back = T.jdbc_read_ranges(spark, url, "customer", "c_custkey", 4)
    return back.toDF(*[c.lower() for c in back.columns])


def _relational(spark):
    """The store that the session names; a local master may use the engine's own one in memory."""
    url = spark.conf.get("spark.tranchery.jdbc.url", None)
    if not url and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.tranchery.jdbc.url to a store that the driver and all executors reach")
    return url or f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
