"""File layout: listings, writes with files of bounded size, compaction by bytes, and what a scan has read.

Partitioned writes give every partition value as many files as its rows call for, each written by a task of its own, so
neither a month with nine tenths of all rows nor thousands of small months end up in one task or in tiny files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: output files whose plan is broadcast (at most about 1 KB each); beyond that it is shuffled
PLANNED = 200_000
#: hash cells that the rows of a file are dealt out by, where a partition value has several files
CELLS = 32


def listed_files(spark: SparkSession, path: str, by: str | None = None, fmt: str = "parquet") -> DataFrame:
    """(file, bytes and, with ``by``, the partition value as text) of all files of a table.  Tasks list and stat the
    files; none is opened, and no row is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{fmt}").load(path)
    found = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")]
    if by:
        raw = F.regexp_extract(F.col("_metadata.file_path"), f"/{by}=([^/]*)/", 1)
        found.append(F.nullif(_unescaped(_unescaped(raw)), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(by))
    return files.select(*found)


def _unescaped(text: Column) -> Column:
    """Percent codes of a path; a plus sign stands for itself."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def file_stats(spark: SparkSession, path: str, by: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Number and sizes of a table's files, in all or per partition value, from a listing."""
    files = listed_files(spark, path, by, fmt)
    grouped = files.groupBy(by) if by else files.groupBy()
    return grouped.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.avg("bytes").alias("avg_bytes"), F.min("bytes").alias("min_bytes"), F.max("bytes").alias("max_bytes"))


def _written(placed: DataFrame, files: int, path: str, column: str | None, mode: str, fmt: str, max_records: int | None = None) -> None:
    """Each number in ``_file`` is one task and one file."""
    writer = placed.repartitionById(max(files, 1), F.col("_file").cast("int")).drop("_file").write.format(fmt).mode(mode)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if column:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(column)
    writer.save(path)


def write_bounded(df: DataFrame, path: str, column: str, rows_per_file: int = 1_000_000, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Partitioned by ``column``; no file has more than ``rows_per_file`` rows.  In mode overwrite only the partitions
    that the input holds are replaced.

    A value of more rows than that gets a tenth more files than would just do.  Its rows fall into ``CELLS`` hash cells a
    file, which are counted first, and every file takes the cells that begin in its equal share of the rows: files exceed
    their share by less than a cell, well within that tenth, so the number of files does not hang on how the hash falls.
    Rows that are equal in all columns stay together; only where these outgrow the tenth a file is cut in two."""
    sizes = df.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    files = F.when(F.col("_n") > rows_per_file, F.expr(f"(_n * 11 + {10 * rows_per_file - 1}) div {10 * rows_per_file}")).otherwise(F.lit(1).cast("long"))
    sizes = sizes.withColumn("_files", files)
    first = F.sum("_files").over(Window.orderBy("_value")) - F.col("_files")  # as many rows as partitions
    sizes = sizes.withColumn("_first", first)
    known = sizes.collect()
    total = sum(r["_files"] for r in known)
    spark, hashed = df.sparkSession, F.xxhash64(*df.columns)
    plan = spark.createDataFrame(known, sizes.schema)
    met = df.join(F.broadcast(plan) if len(known) <= PLANNED else plan, F.col(column).eqNullSafe(F.col("_value")))
    placed = met.withColumn("_file", F.col("_first"))
    if total > len(known):
        met = met.withColumn("_cell", F.when(F.col("_files") > 1, F.pmod(hashed, F.col("_files") * CELLS)))
        cells = met.where("_cell is not null").groupBy("_first", "_files", "_n", "_cell").agg(F.count("*").alias("_rows"))
        before = F.sum("_rows").over(Window.partitionBy("_first").orderBy("_cell")) - F.col("_rows")
        cells = cells.withColumn("_before", before).withColumn("_to", F.col("_first") + F.expr("_before * _files div _n"))
        grouped = cells.groupBy("_first", F.expr(f"_cell div {CELLS}").alias("_group")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_cell") % CELLS, "_to"))).alias("_at"))
        dealt = spark.createDataFrame(grouped.collect(), grouped.schema)  # as many rows as files
        met = met.withColumn("_group", F.expr(f"_cell div {CELLS}")).join(F.broadcast(dealt) if total <= PLANNED else dealt, ["_first", "_group"], "left")
        placed = met.withColumn("_file", F.coalesce(F.element_at("_at", F.col("_cell") % CELLS), F.col("_first")))
    _written(placed.select(*df.columns, "_file"), total, path, column, mode, fmt, rows_per_file)


def compact(spark: SparkSession, path: str, out: str, column: str | None = None, target_bytes: int = 128 << 20, fmt: str = "parquet") -> None:
    """Rewrite a table so that its files are between half of ``target_bytes`` and all of it, but for one smaller file
    per partition value; sizes are those of the files given, by their listing.

    Files of up to half the target are packed in order of their names, larger ones stay alone, and those beyond the
    target are dealt out by a hash of the row over as many files as they need."""
    files = listed_files(spark, path, column, fmt)
    value = [column] if column else []
    small = F.col("bytes") * 2 <= target_bytes
    before = Window.partitionBy(*value, small).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bin_ = F.when(small, F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) * 2 / target_bytes))
    bins = files.select("file", *value, "bytes", bin_.alias("bin")).withColumn("alone", F.when(F.col("bin").isNull(), F.col("file")))
    outs = bins.groupBy(*value, "bin", "alone").agg(F.max(F.when(F.col("alone").isNotNull(), F.ceil(F.col("bytes") / target_bytes)).otherwise(1)).alias("parts"))
    outs = outs.withColumn("first", F.sum("parts").over(Window.orderBy(*value, "bin", "alone")) - F.col("parts"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*value, "bin", "alone")]
    plan = bins.alias("a").join(outs.alias("b"), on).select("a.file", "b.parts", "b.first").collect()  # one row per file
    if not plan:
        return
    total = max(r["first"] + r["parts"] for r in plan)
    df = spark.read.format(fmt).load(path)
    known = spark.createDataFrame(plan, "_path string, _parts long, _first long")
    met = df.select("*", F.col("_metadata.file_path").alias("_path")).join(F.broadcast(known) if len(plan) <= PLANNED else known, "_path")
    placed = met.withColumn("_file", F.col("_first") + F.pmod(F.xxhash64(*df.columns), F.col("_parts")))
    _written(placed.select(*df.columns, "_file"), total, out, column, "overwrite", fmt)


def scanned(df: DataFrame) -> dict[str, int]:
    """What the scans of ``df`` took by their own counters, once it has run: files, their bytes, rows that came out.

    Runs the query and leaves its rows alone; meant for small results, such as aggregates."""
    df.collect()
    out = {"files": 0, "bytes": 0, "rows": 0}
    names = {"numFiles": "files", "filesSize": "bytes", "numOutputRows": "rows"}
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "FileSourceScanExec":
                for name, to in names.items():
                    out[to] += node.metrics().apply(name).value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return out
