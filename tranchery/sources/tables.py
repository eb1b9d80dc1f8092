"""Sources and sinks: raw text with junk, delimited files, Parquet, ORC, JDBC, partition overwrite, compaction, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranchery.sources.layout import compact, file_stats, write_bounded  # noqa: F401

#: blanks around values are kept
AS_IS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_DATA_LINE = "^([0-9]+[.]?[0-9]*|[.][0-9]+)$"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_line_kind(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines with ``kind``: data (the first comma field is a number), or junk (header, footers, section titles, blanks)."""
    first = F.split_part(F.col(column), F.lit(","), F.lit(1))
    return lines.withColumn("kind", F.when(F.coalesce(first.rlike(_DATA_LINE), F.lit(False)), "data").otherwise("junk"))


def split_raw(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(data lines, rejected lines) of a raw text file, which may be compressed; one gzip file is one task."""
    lines = with_line_kind(spark.read.text(path))
    return lines.where("kind = 'data'").select("value"), lines.where("kind = 'junk'").select("value")


def parse_raw(data: DataFrame, header: list[str], wanted: list[str]) -> DataFrame:
    """Data lines as string columns; only the wanted ones are kept."""
    schema = ", ".join(f"`{h}` string" for h in header)
    parsed = data.select(F.from_csv("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select(*[F.col(f"r.`{w}`").alias(w) for w in wanted])


def column_kinds(df: DataFrame, keys: list[str] = (), sample_rows: int | None = None) -> DataFrame:
    """One row per column: non-null and non-blank counts, whether all values are numbers, the kept type (null: dropped).

    Judged over all rows in one pass; ``sample_rows`` judges a prefix only."""
    given = df.limit(sample_rows) if sample_rows else df
    aggs = []
    for i, c in enumerate(given.columns):
        text = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        aggs.append(F.array(F.count(c), F.count(text), F.count(text.try_cast("double"))).alias(f"s{i}"))
    one = given.agg(*aggs)
    stacked = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("s")) for i, c in enumerate(given.columns)])).alias("r"))
    full, solid, numeric = F.col("r.s")[0], F.col("r.s")[1], F.col("r.s")[2]
    kind = F.when(F.col("r.column_name").isin(list(keys)), "string").when(solid == 0, None).when(solid == numeric, "double").otherwise("string")
    return stacked.select("r.column_name", full.alias("non_null"), solid.alias("non_blank"), kind.alias("kept_type"))


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key (a deterministic row cap)."""
    return df.orderBy(key).limit(n)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**AS_IS).option("sep", "\t").option("nullValue", "\\N").option("emptyValue", "").option("compression", "none").csv(path)


def read_tsv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Tab-separated with ``\\N`` for null; a line that does not fit the schema fails the read."""
    return spark.read.schema(schema).options(**AS_IS).option("sep", "\t").option("nullValue", "\\N").option("emptyValue", "").option("mode", "FAILFAST").csv(path)


def write_csv_single(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with header; null is empty."""
    df.coalesce(1).write.mode("overwrite").options(**AS_IS).option("header", True).option("nullValue", "").csv(path)


def jdbc_write(df: DataFrame, url: str, name: str, mode: str = "append", batch: int = 5000, **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=batch, **options).mode(mode).save()


def jdbc_read(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def jdbc_read_ranges(spark: SparkSession, url: str, name: str, column: str, partitions: int, quote: str = '"', **options) -> DataFrame:
    """A whole table by ranges of an integer column, one task each; the bounds are asked for first.  ``quote`` is the
    store's quotation mark for column names."""
    low, high = jdbc_read(spark, url, f"select min({quote}{column}{quote}) a, max({quote}{column}{quote}) b from {name}", **options).first()
    if low is None:
        return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=column, lowerBound=low, upperBound=high + 1, numPartitions=partitions, **options).load()


def overwrite_partitions(df: DataFrame, path: str, column: str, fmt: str = "parquet", rows_per_file: int = 1_000_000) -> None:
    """Replace only those partitions that the input holds; a partition has files of at most ``rows_per_file`` rows."""
    write_bounded(df, path, column, rows_per_file, "overwrite", fmt)


def reload_checked(df: DataFrame, path: str) -> int:
    """Overwrite a table and verify that it holds as many rows as were given; returns the count."""
    expected = df.count()
    df.write.mode("overwrite").parquet(path)
    actual = df.sparkSession.read.parquet(path).count()
    if actual != expected:
        raise ValueError(f"{path}: {actual} rows written, {expected} expected")
    return actual


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of engine event logs (plain or gzip) with their event name."""
    return spark.read.text(path).select(F.get_json_object("value", "$.Event").alias("event"), "value")
