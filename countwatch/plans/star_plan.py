"""The star-schema plan: every stage of the engine as a lazily built DataFrame.

Lines and orders are rolled up once per folder into bucketed record tables; what leaves a scan of those is at most
codes x months rows and is staged to the shared folder before the forecasting layers read it repeatedly.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.config import STAR, Harness
from countwatch.operators import forecast, measures, recall, records, review, scoring
from countwatch.session import stage
from countwatch.sources import star


class StarPlan:
    """Cached properties are plans, not data; only what ``stage`` writes is computed here."""

    def __init__(self, spark: SparkSession, sf_dir: str, harness: Harness = STAR, code: str = star.CODE):
        self.spark, self.dir, self.harness, self.code = spark, sf_dir, harness, code

    # records ---------------------------------------------------------------------------------

    @cached_property
    def codes(self) -> DataFrame:
        return star.code_list(self.spark, self.dir, self.code)

    @cached_property
    def devices(self) -> DataFrame:
        return star.devices(self.spark, self.dir, code=self.code)

    @cached_property
    def records(self) -> tuple[DataFrame, DataFrame]:
        """Reports and bridge, bucketed by the report key, written by the first plan that asks."""
        return star.stored_records(self.spark, self.dir, self.harness, self.code)

    @property
    def reports(self) -> DataFrame:
        return self.records[0]

    @property
    def bridge(self) -> DataFrame:
        return self.records[1]

    @cached_property
    def members(self) -> DataFrame:
        return star.memberships(self.reports, self.bridge)

    @cached_property
    def eligible(self) -> DataFrame:
        return self.members.filter("not excluded")

    @cached_property
    def daily(self) -> DataFrame:
        return star.daily_series(self.spark, self.dir, self.code)

    def monthly_lazy(self) -> DataFrame:
        return measures.on_spine(self.codes, measures.monthly_counts(self.members), self.harness)

    @cached_property
    def monthly(self) -> DataFrame:
        """M-01 staged: codes x months rows."""
        return stage(self.monthly_lazy(), "monthly")

    @cached_property
    def gate(self) -> DataFrame:
        """D7/D8 from the record counts (the M3 gate holds them equal to the independent series)."""
        raw = self.monthly.select("product_code", "mi", F.col("raw_reports").alias("series_reports"))
        return measures.gate_b(measures.gate_a(raw, self.harness), self.monthly, self.harness)

    @cached_property
    def series(self) -> DataFrame:
        passed = self.gate.filter("forecast").select("product_code")
        eligible = self.monthly.select("product_code", "mi", F.col("eligible_reports").alias("y"))
        return eligible.join(passed, "product_code", "left_semi")

    # forecasts -------------------------------------------------------------------------------

    def forecast_lazy(self) -> DataFrame:
        return forecast.forecast(self.series, self.harness)

    @cached_property
    def forecast(self) -> DataFrame:
        return stage(self.forecast_lazy(), "forecast")

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.scored(self.forecast, self.harness)

    @cached_property
    def cells(self) -> DataFrame:
        return scoring.cells(self.scored)

    @cached_property
    def promotion(self) -> DataFrame:
        return scoring.promotion(self.cells, self.harness)

    @cached_property
    def evaluated(self) -> DataFrame:
        return stage(review.evaluated(self.scored, self.promotion, self.harness), "evaluated")

    @cached_property
    def episodes(self) -> DataFrame:
        return review.episodes(self.evaluated, self.harness)

    @cached_property
    def code_state(self) -> DataFrame:
        return review.code_state(self.evaluated, self.harness)

    @cached_property
    def queue(self) -> DataFrame:
        return review.queue(self.episodes, self.code_state)

    @cached_property
    def workload(self) -> DataFrame:
        return review.workload(self.episodes, self.code_state)

    # recalls ---------------------------------------------------------------------------------

    @cached_property
    def recall_timeline(self) -> DataFrame:
        product, enforcement = star.recall_records(self.spark, self.dir, self.code), star.enforcement(self.spark, self.dir)
        span = _dashed(self.harness.window_start), _dashed(self.harness.as_of)
        return recall.timeline(product, enforcement, None, *span, star.recall_dates(self.spark, self.dir))

    @property
    def evaluated_span(self) -> tuple[str, str]:
        return self.harness.locked[0], self.harness.recent[1]

    @cached_property
    def class_one_months(self) -> DataFrame:
        found = recall.class_one(self.recall_timeline, self.gate.filter("forecast"), self.evaluated_span)
        return stage(recall.initiations_by_month(found), "class-one")


def _dashed(day: str) -> str:
    return f"{day[:4]}-{day[4:6]}-{day[6:]}"
