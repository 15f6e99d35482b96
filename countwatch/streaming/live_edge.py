"""The live edge as an append-only store fed by a file stream.

Each poll of the source lands one vintage of readings. The stream picks up whatever has landed since
its checkpoint and hands every vintage, oldest first, to ``LiveEdge.ingest``. All tables are
partitioned by vintage and a vintage writes only its own partitions, reading only earlier ones, so a
batch retried after a lost executor rewrites the same rows and never scores or issues twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countwatch.config import Harness
from countwatch.functions import months
from countwatch.operators import forecast, live, scoring
from countwatch.session import stage

READING = "vintage string, last_updated string, product_code string, time string, count bigint"

TABLES = {
    "manifest": "product_code string, buckets bigint, sha256 string, last_updated string",
    "reading": "product_code string, mi int, reports bigint",
    "body": "product_code string, time string, count bigint, last_updated string",
    "reread": "product_code string, mi int, frozen bigint, live bigint, listed_frozen bigint, live_at_disposition bigint, verdict string",
    "series": "product_code string, mi int, reports_as_seen bigint, last_updated string",
    "score": (
        "product_code string, model string, origin_mi int, target_mi int, horizon int, issued_by string, point double,"
        "lower50 double, upper50 double, lower80 double, upper80 double, actual bigint, actual_vintage string,"
        "error double, abs_error double, covered50 boolean, covered80 boolean, wis double"
    ),
    "forecast": (
        "product_code string, model string, origin_mi int, target_mi int, horizon int, point double,"
        "lower50 double, upper50 double, lower80 double, upper80 double, calibration_n int"
    ),
    "run": (
        "last_updated string, status string, passed boolean, checks_total bigint, failed_checks string,"
        "months_appended bigint, forecasts_scored bigint, forecasts_issued bigint, advanced boolean, error string"
    ),
    "frozen_month": "product_code string, mi int, raw_reports bigint, y bigint",
    "frozen_error": "product_code string, model string, horizon int, target_mi int, error double",
    "frozen_outlook": (
        "product_code string, model string, origin_mi int, target_mi int, horizon int, point double,"
        "lower50 double, upper50 double, lower80 double, upper80 double, calibration_n int"
    ),
}
FROZEN = "0000"  # partition that holds what was frozen, and the empty start of every live table


def fingerprint(readings: DataFrame) -> DataFrame:
    """Per code the bucket count and a hash of its buckets in time order (at most one per period)."""
    body = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "time", "count"))), ",")
    return readings.groupBy("product_code").agg(
        F.count(F.lit(1)).alias("buckets"), F.sha2(body, 256).alias("sha256"), F.max("last_updated").alias("last_updated")
    )


@dataclass
class LiveEdge:
    spark: SparkSession
    root: str
    harness: Harness
    frozen_last_updated: str
    dispositions: DataFrame
    with_candidate: bool = True

    # store -----------------------------------------------------------------------------------

    def _path(self, name: str, vintage: str) -> str:
        return f"{self.root}/{name}/vintage={vintage}"

    def _write(self, name: str, df: DataFrame, vintage: str) -> DataFrame:
        schema = T._parse_datatype_string(TABLES[name])
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.mode("overwrite").parquet(
            self._path(name, vintage)
        )
        return self.part(name, vintage)

    def part(self, name: str, vintage: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self._path(name, vintage))

    def table(self, name: str, before: str | None = None) -> DataFrame:
        whole = self.spark.read.schema(f"{TABLES[name]}, vintage string").parquet(f"{self.root}/{name}")
        return whole.filter(F.col("vintage") < before) if before else whole

    def freeze(self, monthly: DataFrame, scored: DataFrame, outlook: DataFrame) -> "LiveEdge":
        """Write the frozen tables and an empty first partition of every live table."""
        for name, schema in TABLES.items():
            if not name.startswith("frozen_"):
                self._write(name, self.spark.createDataFrame([], schema), FROZEN)
        self._write("frozen_month", monthly, FROZEN)
        self._write("frozen_error", scored.withColumn("error", F.round("error", 6)), FROZEN)
        self._write("frozen_outlook", outlook.withColumn("point", F.round("point", 6)), FROZEN)
        return self

    # one vintage -----------------------------------------------------------------------------

    def store(self, readings: DataFrame, vintage: str) -> None:
        """Keep the whole view of the source as received and its hashes, then its months."""
        readings = self._write("body", readings, vintage)
        self._write("manifest", fingerprint(readings), vintage)
        by_month = readings.filter(months.valid_day("time")).groupBy("product_code", months.day_to_mi("time").alias("mi")).agg(
            F.sum("count").alias("reports")
        )
        self._write("reading", by_month.filter(F.col("mi") >= self.harness.start_mi), vintage)

    def last_seen(self, before: str) -> str | None:
        row = (
            self.table("run", before)
            .filter("advanced")
            .agg(F.max_by("last_updated", "vintage").alias("lu"))
            .first()
        )
        return row.lu

    def ingest(self, readings: DataFrame, vintage: str, last_updated: str | None) -> None:
        """Check, keep, re-read, append, score once, re-issue once; the run row is always written."""
        status, error, advanced = None, None, False
        checks: list[tuple[str, bool]] = []
        appended = scored = issued = 0
        try:
            problems = live.bucket_problems(readings).agg(F.coalesce(F.sum("malformed"), F.lit(0)).alias("n")).first().n
            checks.append(("buckets well formed", problems == 0))
            datum = live.datum_checks(readings.select("last_updated").distinct(), self.frozen_last_updated).collect()
            checks += [(r.check, r.passed) for r in datum]
            absent = live.absent_codes(readings, self.codes()).count()
            checks.append(("every code answered", absent == 0))
            if all(ok for _, ok in checks):
                if last_updated == self.last_seen(vintage):
                    status = f"skipped: nothing newer than {last_updated}"
                else:
                    self.store(readings, vintage)
                    compared, material, appended = self._reread_and_append(vintage, last_updated)
                    checks.append(("frozen months compared", compared > 0))
                    checks.append(("no unlisted fall of a frozen month", material == 0))
                    scored, issued, unfitted = self._score(vintage), *self._issue(vintage)
                    checks.append(("candidate fits", unfitted == 0))
                    advanced = True
            elif absent:
                # What is absent is not zero: nothing is stored, and the next vintage starts from here.
                status = "stopped"
        except Exception as exc:
            error = f"{type(exc).__name__}: {exc}"
            raise
        finally:
            rows = self.spark.createDataFrame(checks or [("run started", True)], "check string, passed boolean")
            run = live.run_status(rows, status, error).select(
                F.lit(last_updated).cast("string").alias("last_updated"), "status", "passed", "checks_total", "failed_checks",
                F.lit(appended).alias("months_appended"), F.lit(scored).alias("forecasts_scored"),
                F.lit(issued).alias("forecasts_issued"), F.lit(advanced).alias("advanced"), "error",
            )
            self._write("run", run, vintage)

    def codes(self) -> DataFrame:
        return self.part("frozen_month", FROZEN).select("product_code").distinct()

    def _reread_and_append(self, vintage: str, last_updated: str) -> tuple[int, int, int]:
        frozen, reading = self.part("frozen_month", FROZEN), self.part("reading", vintage)
        reread = self._write("reread", live.frozen_reread(frozen, reading, self.dispositions, self.harness), vintage)
        told = reread.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "material").alias("material")).first()
        fresh = live.new_months(reading, self.codes(), last_updated, vintage, self.harness)
        return told.n, told.material, self._write("series", fresh, vintage).count()

    def latest(self, upto: str) -> DataFrame:
        return live.latest_reading(self.table("series").filter(F.col("vintage") <= upto))

    def _score(self, vintage: str) -> int:
        frozen = self.part("frozen_outlook", FROZEN).withColumn("issued_by", F.lit("frozen"))
        issued = self.table("forecast", vintage).drop("vintage").withColumn("issued_by", F.lit("live"))
        rows = live.score_once(frozen.unionByName(issued), self.table("score", vintage), self.latest(vintage), vintage)
        return self._write("score", rows, vintage).count()

    def _issue(self, vintage: str) -> tuple[int, int]:
        """Rows issued, and how many of the candidate's have no point because its fit failed."""
        latest = self.latest(vintage)
        origins = latest.groupBy("product_code").agg(F.max("mi").alias("origin_mi"))
        issued = self.table("forecast", vintage).select("product_code", "origin_mi").distinct()
        due = origins.join(issued, ["product_code", "origin_mi"], "left_anti")
        history = (
            self.part("frozen_month", FROZEN).select("product_code", "mi", "y")
            .unionByName(latest.select("product_code", "mi", F.col("actual").alias("y")))
        )
        keep = ["product_code", "model", "horizon", "target_mi", "error"]
        seen = self.table("score").filter(F.col("vintage") <= vintage)
        errors = self.part("frozen_error", FROZEN).select(*keep).unionByName(
            seen.select(*keep).withColumn("error", F.round("error", 6))
        )
        rows = live.reissue(history, errors, due, self.harness, vintage, self.with_candidate)
        written = self._write("forecast", rows.withColumn("point", F.round("point", 6)), vintage)
        told = written.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("model") == "candidate") & F.col("point").isNull()).alias("unfitted")).first()
        return told.n, told.unfitted

    # the stream ------------------------------------------------------------------------------

    def run_available(self, landing: str) -> None:
        """L1: process every vintage that has landed since the last call, oldest first, then stop."""

        def each_batch(batch: DataFrame, batch_id: int) -> None:
            # What has landed of a vintage is kept first, each batch in its own folder: a vintage that comes
            # in several batches is then read whole, and a retried batch replaces its own part.
            batch.write.mode("overwrite").partitionBy("vintage").parquet(f"{self.root}/landed/batch={batch_id}")
            whole = self.spark.read.schema(READING).parquet(f"{self.root}/landed")
            names = [r.vintage for r in batch.select("vintage").distinct().orderBy("vintage").collect()]
            for name in names:
                rows = whole.filter(F.col("vintage") == name).select(*batch.columns).distinct()
                self.ingest(rows, name, rows.agg(F.max("last_updated").alias("lu")).first().lu)

        stream = self.spark.readStream.schema(READING).json(landing)
        query = (
            stream.writeStream.foreachBatch(each_batch)
            .option("checkpointLocation", f"{self.root}/_stream")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def freeze_from_counts(edge: LiveEdge, monthly: DataFrame) -> LiveEdge:
    """Forecast the frozen series once and store what the live edge needs from it."""
    series = monthly.select("product_code", "mi", "y")
    fc = stage(forecast.forecast(series, edge.harness, edge.with_candidate), "frozen-forecast")
    scored = scoring.scored(fc, edge.harness)
    return edge.freeze(monthly, scored, fc.filter("period = 'outlook'"))
