"""One run over raw loans that writes all layers in order, checks them on the way and stops on a failed ERROR check.

Every layer is read back from what was written before the next is built, so nothing upstream is worked out twice.  The
detail layers are checked before any dimension, snapshot or metric is built on them; metrics are checked at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranchery.operators import layers, metrics, quality
from tranchery.sources.layout import write_bounded

SEGMENTS = ["grade", "income_band", "fico_band"]


class StoppedByChecks(RuntimeError):
    """A run's ERROR checks failed; ``report`` has all checks so far, ``tables`` what had been written."""

    def __init__(self, report: DataFrame, tables: dict[str, DataFrame]):
        failed = [r["check_name"] for r in report.where("level = 'ERROR' and not passed").collect()]
        super().__init__(f"failed checks: {', '.join(failed)}")
        self.report, self.tables, self.failed = report, tables, failed


class LoanRun:
    def __init__(self, raw: DataFrame, path: str, end: str, rows_per_file: int = 1_000_000):
        self.raw, self.path, self.end, self.rows_per_file = raw, path.rstrip("/"), end, rows_per_file
        self.spark, self.tables, self.checks = raw.sparkSession, {}, []

    def _keep(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        at = f"{self.path}/{name}"
        if by:
            write_bounded(df, at, by, self.rows_per_file)
        else:
            df.write.mode("overwrite").parquet(at)
        self.tables[name] = self.spark.read.schema(df.schema).parquet(at)
        return self.tables[name]

    def _check(self, *checks: DataFrame) -> None:
        """Writes the checks' rows beside the layers; raises where one of level ERROR has failed."""
        quality.report(list(checks)).coalesce(1).write.mode("overwrite" if not self.checks else "append").parquet(f"{self.path}/checks")
        self.checks += checks
        report = self.report()
        if quality.failed_errors(report):
            raise StoppedByChecks(report, dict(self.tables))

    def report(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/checks")

    def land(self) -> None:
        """Raw loans as they are, once: every layer reads this copy, and not what ``raw`` is made of."""
        at = f"{self.path}/landed"
        self.raw.write.mode("overwrite").parquet(at)
        self.raw = self.spark.read.schema(self.raw.schema).parquet(at)

    def detail(self) -> None:
        facts, rejects = layers.split_rejects(layers.application_facts(self.raw))
        facts, rejects = self._keep("facts", facts, "issue_month"), self._keep("rejects", rejects)
        perf = self._keep("performance", layers.performance_facts(self.raw, self.end))
        row = quality.check_row
        known = F.col("loan_status").isNotNull() & (F.col("dpd_bucket") == "UNKNOWN")
        self._check(
            row(quality.conserved_counts(self.raw, facts, rejects), "row_conservation", "ERROR", "facts", F.first("n_facts") + F.first("n_rejects"), F.first("n_raw")),
            row(quality.duplicates(facts, ["loan_id"]), "pk_unique", "ERROR", "facts", F.count("*")),
            row(facts, "amount_non_negative", "ERROR", "facts", F.count_if((F.col("loan_amnt") <= 0) | (F.col("funded_amnt") < 0))),
            row(perf.select("loan_status", "dpd_bucket").distinct(), "enum_valid", "ERROR", "performance", F.count_if(known)),
            row(quality.leaked_columns(facts), "no_leakage", "ERROR", "facts", F.count("*")),
            row(quality.month_gaps(facts, "issue_month"), "month_gaps", "WARN", "facts", F.count("*")),
        )

    def dimensions(self) -> None:
        self._keep("applicants", layers.applicants(self.raw))
        self._keep("products", layers.products(self.raw))
        edges = self.tables["facts"].agg(F.min("issue_date"), F.max("issue_date")).first()
        if edges[0] is not None:
            self._keep("calendar", layers.calendar(self.spark, str(edges[0]), str(edges[1])))

    def snapshot(self) -> None:
        at, schema = f"{self.path}/snapshot", layers.month_end_snapshot(self.raw, self.end).schema
        layers.build_snapshot(self.raw, self.end, at, rows_per_file=self.rows_per_file)
        self.tables["snapshot"] = self.spark.read.schema(schema).parquet(at)
        counted = layers.expected_snapshot_rows(self.raw, self.end).crossJoin(self.tables["snapshot"].agg(F.count("*").alias("n")))
        self._check(quality.check_row(counted, "snapshot_rows", "ERROR", "snapshot", F.first("n"), F.first("expected_rows")))

    def results(self) -> None:
        t = self.tables
        terminal = metrics.terminal(t["facts"], t["performance"]).join(t["applicants"].select("loan_id", "income_band", "fico_band"), "loan_id")
        segments = self._keep("segments", metrics.risk_segments(terminal, SEGMENTS))
        self._keep("delinquency", metrics.delinquency(t["snapshot"]))
        self._keep("vintages", metrics.vintage(t["snapshot"], monotone=True))
        rates = self._keep("roll_rates", metrics.roll_rates(t["snapshot"]))
        total = segments.where("dim_type = 'grade'").agg(F.sum("bad_cnt").alias("a")).crossJoin(t["performance"].where("is_terminal = 1").agg(F.sum("is_bad").alias("b")))
        uneven = rates.groupBy("from_month", "from_bucket").agg(F.sum("rate").alias("s"))
        self._check(
            quality.check_row(total, "agg_consistency", "ERROR", "segments", F.coalesce(F.first("a"), F.lit(0)), F.coalesce(F.first("b"), F.lit(0))),
            quality.check_row(uneven, "rates_sum_to_one", "WARN", "roll_rates", F.count_if(F.abs(F.col("s") - 1) > 0.001)),
        )

    def all(self) -> dict[str, DataFrame]:
        """Every layer by name; raises :class:`StoppedByChecks` before building on a layer that failed."""
        for step in (self.land, self.detail, self.dimensions, self.snapshot, self.results):
            step()
        return self.tables
