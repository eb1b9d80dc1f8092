"""Structured Streaming over change envelopes: windows, running totals, mirror and several sinks from one read.

Streams read JSON files or a message topic with one envelope (op, before, after, with key and time) per line.  Sinks
of ``foreachBatch`` add to keyed tables (``streaming.keyed``), whose versions are the batch ids: a batch that is run
again replaces its own version, and readers always see a complete one.

Two kinds of windows: insert-only ones under a watermark (``tumble``), final once it has passed them, late rows left
out; and windows of current rows (``current_windows``), where an update takes its row out of its former window.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranchery.operators.changelog import latest_per_key, signed_rows
from tranchery.streaming.keyed import KeyedTable

CHANGE = "seq long, pk long, op_ts timestamp, op string, before struct<grp:string,amt:decimal(14,2)>, after struct<grp:string,amt:decimal(14,2)>"


def file_source(spark: SparkSession, path: str, files_per_batch: int | None = 1, schema: str = CHANGE) -> DataFrame:
    """Files in the order in which they came; None takes all that have come as one batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def kafka_source(spark: SparkSession, servers: str, topic: str, schema: str = CHANGE) -> DataFrame:
    """The same from a topic, from its first offset on (needs Spark's Kafka package on the cluster)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("c")).select("c.*")


def to_envelopes(changes: DataFrame) -> DataFrame:
    """(key, value) for a file or topic sink."""
    return changes.select(F.col("pk").cast("string").alias("key"), F.to_json(F.struct(*changes.columns)).alias("value"))


def tumble(changes: DataFrame, late: str = "5 seconds", width: str = "1 minute") -> DataFrame:
    """Insert-only windows: additions and their sum per window, final once the watermark has passed it."""
    added = changes.where("after is not null").withWatermark("op_ts", late)
    return added.groupBy(F.window("op_ts", width).alias("w")).agg(F.count("*").alias("cnt"), F.sum("after.amt").alias("total")).select(F.col("w.start").alias("window_start"), "cnt", "total")


def tumble_current(changes: DataFrame, width: str = "1 minute") -> DataFrame:
    """Windows of current rows: an update takes its row out of the window of the before image's change and into its
    own.  ``changes`` carry the time of the before image as ``before_ts``."""
    rows = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before_ts").alias("ts"), F.col("before.amt").alias("amt")), F.struct(F.lit(1).alias("sign"), F.col("op_ts").alias("ts"), F.col("after.amt").alias("amt"))))
    signed = changes.select(rows.alias("r")).select("r.*").where("ts is not null and amt is not null")
    return signed.groupBy(F.window("ts", width).alias("w")).agg(F.sum("sign").alias("cnt"), F.sum(F.col("sign") * F.col("amt")).alias("total")).select(F.col("w.start").alias("window_start"), "cnt", "total")


def group_totals(changes: DataFrame) -> DataFrame:
    """Running rows and sum per group, with retraction (update or complete mode)."""
    return signed_rows(changes).groupBy("grp").agg(F.sum("sign").alias("cnt"), F.sum(F.col("sign") * F.col("amt")).alias("total"))


_MOVES = "pk long, sign int, ts timestamp, amt decimal(14,2)"


def current_windows(changes: DataFrame) -> DataFrame:
    """What a stream of changes does to windows of current rows: (pk, sign, ts, amt), a row's former place taken back
    (-1) and its new one added (+1).

    The state of a key is its last change: time, sequence number, and the amount where the row is alive.  A change that
    is older than that moves nothing, so the sums do not depend on how the log is cut into batches.  Within a batch a
    key moves once, from where it was to where its last change leaves it.
    """
    kept = "ts timestamp, seq long, amt decimal(14,2), alive boolean"

    def move(key, batches, state):
        import pandas as pd

        was = state.get if state.exists else (pd.Timestamp.min, -1, None, False)
        now = (pd.Timestamp(was[0]), *was[1:])
        for rows in batches:
            last = rows.sort_values(["op_ts", "seq"]).iloc[-1]
            if (last["op_ts"], last["seq"]) > now[:2]:
                now = (last["op_ts"], int(last["seq"]), last["amt"], bool(last["alive"]))
        if now[:2] == (pd.Timestamp(was[0]), was[1]):
            return
        state.update((now[0].to_pydatetime(), *now[1:]))
        moves = [(key[0], sign, x[0], x[2]) for sign, x in ((-1, was), (1, now)) if x[3]]
        if moves:
            yield pd.DataFrame(moves, columns=["pk", "sign", "ts", "amt"])

    last = changes.select("pk", "op_ts", "seq", F.col("after.amt").alias("amt"), F.col("after").isNotNull().alias("alive")).where("pk is not null")
    return last.groupBy("pk").applyInPandasWithState(move, _MOVES, kept, "append", "NoTimeout")


STATE = "seq long, pk long, op_ts timestamp, op string, grp string, amt decimal(14,2), sink_ts timestamp"
CLOSED = "window_start timestamp, cnt long, total decimal(24,2)"
TOTALS = "grp string, cnt long, total decimal(24,2)"
WINDOWS = "window_start timestamp, cnt long, total decimal(24,2)"


def _summed(key: str):
    return lambda rows: rows.groupBy(key).agg(F.sum("cnt").alias("cnt"), F.sum("total").cast("decimal(24,2)").alias("total"))


def mirror_table(spark: SparkSession, path: str, **options) -> KeyedTable:
    """Each key's last change; deletes stay as tombstones, so that a late older change stays out."""
    return KeyedTable(spark, path, STATE, ["pk"], lambda rows: latest_per_key(rows, ["pk"], ["op_ts", "seq"]), **options)


def totals_table(spark: SparkSession, path: str, **options) -> KeyedTable:
    return KeyedTable(spark, path, TOTALS, ["grp"], _summed("grp"), **{"buckets": 4} | options)


def windows_table(spark: SparkSession, path: str, **options) -> KeyedTable:
    return KeyedTable(spark, path, WINDOWS, ["window_start"], _summed("window_start"), **options)


_TABLES = {STATE: mirror_table, TOTALS: totals_table, WINDOWS: windows_table}


def read_version(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The last complete version of a table of that schema (or the last up to ``version``); empty when there is none."""
    return _TABLES[schema](spark, path).read(version)


def merge_latest(path: str, event_clock: bool = False, **options):
    """A batch writer that keeps each key's last change with the time it was written; ``event_clock`` takes the last
    time of the batch's changes for that, the time as of which the log had come."""

    def write(batch: DataFrame, batch_id: int) -> None:
        clock = F.lit(batch.agg(F.max("op_ts")).first()[0]).cast("timestamp") if event_clock else F.current_timestamp()
        new = batch.select("seq", "pk", "op_ts", "op", "after.grp", "after.amt", clock.alias("sink_ts"))
        mirror_table(batch.sparkSession, path, **options).add(new, batch_id)

    return write


def merge_totals(path: str, **options):
    def write(batch: DataFrame, batch_id: int) -> None:
        new = group_totals(batch).select("grp", F.col("cnt").cast("long"), F.col("total").cast("decimal(24,2)"))
        totals_table(batch.sparkSession, path, **options).add(new, batch_id)

    return write


def merge_windows(path: str, width: str = "1 minute", **options):
    """A batch writer for ``current_windows``: rows and sum of each window of current rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        moved = batch.groupBy(F.window("ts", width).alias("w")).agg(F.sum("sign").cast("long").alias("cnt"), F.sum(F.col("sign") * F.col("amt")).cast("decimal(24,2)").alias("total"))
        windows_table(batch.sparkSession, path, **options).add(moved.select(F.col("w.start").alias("window_start"), "cnt", "total"), batch_id)

    return write


def merge_current_windows(state: str, windows: str, width: str = "1 minute", **options):
    """The same as ``current_windows`` with ``merge_windows``, as a batch writer on the changes themselves: each key's
    last change is kept in a mirror table (``state``), and a batch's last changes are joined with the version before it.
    A batch that is run again finds that version as it was."""

    def write(batch: DataFrame, batch_id: int) -> None:
        c, spark = F.col, batch.sparkSession
        kept = mirror_table(spark, state, **options)
        alive = F.when(c("after").isNull(), "d").otherwise("u")
        given = batch.where("pk is not null and op_ts is not null").select("seq", "pk", "op_ts", alive.alias("op"), "after.grp", "after.amt", F.lit(None).cast("timestamp").alias("sink_ts"))
        last = kept.merge(given).persist()
        try:
            was = kept.read(batch_id - 1).select("pk", *[c(x).alias(f"was_{x}") for x in ("op_ts", "seq", "op", "amt")])
            newer = c("was_op_ts").isNull() | (c("op_ts") > c("was_op_ts")) | ((c("op_ts") == c("was_op_ts")) & (c("seq") > c("was_seq")))
            row = lambda sign, x: F.struct(F.lit(sign).alias("sign"), c(f"{x}op_ts").alias("ts"), c(f"{x}amt").alias("amt"), c(f"{x}op").alias("op"))
            moves = last.join(was, "pk", "left").where(newer).select(F.inline(F.array(row(-1, "was_"), row(1, "")))).where("op != 'd'")
            merge_windows(windows, width, **options)(moves, batch_id)
            kept.add(last, batch_id)
        finally:
            last.unpersist()

    return write


def append_batch(path: str):
    """A batch writer that keeps every change with its batch id (the versions of ``as_of``)."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def multi_sink(*writers):
    """One read, several sinks: the batch is held while all write it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for w in writers:
                w(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def run_available(stream: DataFrame, writer, checkpoint: str) -> list[str]:
    """Process what is there and stop; a later call goes on from the checkpoint.  The progress of the batches."""
    query = stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [p.json for p in query.recentProgress]


def append_available(stream: DataFrame, path: str, checkpoint: str) -> list[str]:
    """The same with what is final appended to a Parquet table."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return [p.json for p in query.recentProgress]


def dropped_groups(progress: list[str]) -> int:
    """Late groups that the watermark kept out of the state: a window counts once per batch in which rows come for it
    after it has been closed."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in json.loads(p)["stateOperators"])
