"""Connected components of a table of links, by hooking to the least neighbour and pointer jumping in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranchery.llm.shared import discard, staged


def components(links: DataFrame) -> DataFrame:
    """(v, c) for every vertex of the links (x, y), staged: c is the least vertex it can reach.

    Each round labels a vertex with the least label around it and then follows that label's own label; labels only
    fall, and the rounds end when none changes.  Rounds are staged, so lineage stays short, and a round's table goes
    when the next one stands.  A vertex of many links makes a skewed join key, which adaptive joins split.
    """
    both = staged(links.select(F.col("x").alias("v"), F.col("y").alias("w")).union(links.select("y", "x")).distinct(), "links")
    labels = staged(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("c")), "labels")
    while True:
        around = both.join(labels.select(F.col("v").alias("w"), F.col("c").alias("cw")), "w").groupBy("v").agg(F.min("cw").alias("m"))
        low = labels.select("v", "c").join(around, "v").select("v", F.least("c", "m").alias("n"), F.col("c").alias("old"))
        jump = labels.select(F.col("v").alias("n"), F.col("c").alias("cn"))
        new = staged(low.join(jump, "n", "left").select("v", F.least("n", F.coalesce("cn", "n")).alias("c"), "old"), "labels")
        discard(labels)
        if not new.where("c != old").limit(1).count():
            discard(both)
            out = new.select("v", "c")
            out.staged_path = new.staged_path
            return out
        labels = new
