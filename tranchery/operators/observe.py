"""Engine event logs as tables: task skew per stage, and plan-node metrics per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranchery.operators.changelog import latest_per_key

_TASK = "struct<`Stage ID`:int,`Task Info`:struct<`Launch Time`:bigint,`Finish Time`:bigint>>"


def task_skew(log: DataFrame, least_tasks: int = 2) -> DataFrame:
    """Per stage with so many tasks: number, least, median and greatest milliseconds, greatest over median, sum.

    ``log``: event, value (JSON), as ``read_event_log`` gives it."""
    t = log.where("event = 'SparkListenerTaskEnd'").select(F.from_json("value", _TASK).alias("t"))
    ms = F.col("t.Task Info.Finish Time") - F.col("t.Task Info.Launch Time")
    out = t.groupBy(F.col("t.Stage ID").alias("stage_id")).agg(F.count("*").alias("tasks"), F.min(ms).alias("min_ms"), F.median(ms).alias("median_ms"), F.max(ms).alias("max_ms"), F.sum(ms).alias("total_ms"))
    return out.where(F.col("tasks") >= least_tasks).withColumn("skew", F.round(F.col("max_ms") / F.nullif(F.col("median_ms"), F.lit(0.0)), 2))


_NODE = "nodeName string, metrics array<struct<name:string,accumulatorId:bigint>>, children array<string>"


def plan_metrics(log: DataFrame) -> DataFrame:
    """(execution_id, node, metric, value): the plan nodes, at any depth, of the last plan of each query, with the sums
    of their accumulator updates in tasks.  Children are kept as text and read level by level until none is left."""
    plans = log.where("event like '%SparkListenerSQLExecutionStart' or event like '%SparkListenerSQLAdaptiveExecutionUpdate'")
    plans = plans.withColumn("adaptive", F.col("event").like("%Adaptive%").cast("int")).withColumn("order", F.monotonically_increasing_id())
    plans = plans.select(F.from_json("value", "executionId bigint, sparkPlanInfo string").alias("p"), "adaptive", "order")
    last = latest_per_key(plans.select(F.col("p.executionId").alias("execution_id"), F.col("p.sparkPlanInfo").alias("n"), "adaptive", "order"), ["execution_id"], ["adaptive", "order"])
    level, nodes = last.select("execution_id", "n"), None
    while True:
        read = level.select("execution_id", F.from_json("n", _NODE).alias("n"))
        here = read.select("execution_id", F.col("n.nodeName").alias("node"), F.explode("n.metrics").alias("m")).select("execution_id", "node", F.col("m.name").alias("metric"), F.col("m.accumulatorId").alias("id"))
        nodes = here if nodes is None else nodes.unionByName(here)
        level = read.select("execution_id", F.explode("n.children").alias("n"))
        if level.isEmpty():
            break
    updates = log.where("event = 'SparkListenerTaskEnd'").select(F.explode(F.from_json(F.get_json_object("value", "$.Task Info.Accumulables"), "array<struct<ID:bigint,Update:string>>")).alias("a"))
    sums = updates.groupBy(F.col("a.ID").alias("id")).agg(F.sum(F.col("a.Update").try_cast("long")).alias("value"))
    return nodes.distinct().join(sums, "id").select("execution_id", "node", "metric", "value")
