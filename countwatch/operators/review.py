"""The review rule: flags, episodes, queue and workload (M-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countwatch.config import Harness
from countwatch.functions import months


def flag(harness: Harness) -> Column:
    """Strictly above the range and at least five reports above the point."""
    y = F.col("actual").cast("double")
    return (y > F.col("upper80")) & (y - F.col("point") >= harness.min_excess)


def evaluated(scored: DataFrame, promotion: DataFrame, harness: Harness) -> DataFrame:
    """Horizon-1 locked and recent rows of the model in use, flagged."""
    in_use = promotion.select("product_code", F.col("model_in_use").alias("model"))
    rows = scored.filter((F.col("horizon") == 1) & F.col("period").isin(*harness.evaluated_periods))
    return rows.join(in_use, ["product_code", "model"]).select(
        "product_code", "model", "target_mi", "period", "actual", "point", "upper80", "covered80",
        F.coalesce(flag(harness), F.lit(False)).alias("flagged"),
    )


def runs(rows: DataFrame, key: str = "product_code", order: str = "target_mi") -> DataFrame:
    """Flagged runs of consecutive rows as islands between unflagged rows."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(F.when(F.col("flagged"), 0).otherwise(1)).over(w))


def episodes(rows: DataFrame, harness: Harness, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of at least two flagged rows, with their largest excess over the point."""
    found = (
        runs(rows)
        .filter("flagged")
        .groupBy("product_code", *extra_keys, "island")
        .agg(
            F.min("target_mi").alias("start_mi"), F.max("target_mi").alias("end_mi"),
            F.count(F.lit(1)).alias("months_in_episode"),
            F.max(F.col("actual").cast("double") - F.col("point")).alias("excess"),
        )
    )
    return found.filter(F.col("months_in_episode") >= harness.min_run).drop("island")


def code_state(rows: DataFrame, harness: Harness) -> DataFrame:
    """Per code: evaluated and flagged months, locked coverage, rule gate (J8) and pending mark."""
    w = Window.partitionBy("product_code").orderBy("target_mi")
    marked = rows.withColumn("before", F.lag("flagged").over(w))
    last = F.max_by(F.struct("flagged", "before"), "target_mi")
    coverage = F.round(F.avg(F.when(F.col("period") == "locked", F.col("covered80").cast("double"))), 6)
    return (
        marked.groupBy("product_code", "model")
        .agg(
            F.count(F.lit(1)).alias("evaluated_months"),
            F.count_if("flagged").alias("flagged_months"),
            coverage.alias("coverage80"),
            F.max("target_mi").alias("last_mi"),
            last.alias("last"),
        )
        .withColumn("rule_enabled", F.coalesce(F.col("coverage80") >= harness.coverage_floor, F.lit(False)))
        .withColumn("pending", F.col("last.flagged") & ~F.coalesce(F.col("last.before"), F.lit(False)))
        .drop("last")
    )


def queue(found: DataFrame, state: DataFrame) -> DataFrame:
    """The published queue of enabled codes."""
    enabled = state.filter("rule_enabled").select("product_code", "model", "last_mi")
    return found.join(enabled, "product_code").select(
        "product_code",
        F.col("model").alias("model_in_use"),
        months.label("start_mi").alias("episode_start"),
        months.label("end_mi").alias("episode_end"),
        "months_in_episode",
        F.round("excess", 1).alias("max_excess_over_point"),
        F.when(F.col("end_mi") < F.col("last_mi"), "closed").otherwise("open at the freeze").alias("status"),
    )


def workload(found: DataFrame, state: DataFrame) -> DataFrame:
    """J10."""
    per_code = found.groupBy("product_code").agg(F.count(F.lit(1)).alias("all_episodes"))
    n = F.when(F.col("rule_enabled"), F.coalesce("all_episodes", F.lit(0))).otherwise(F.lit(0))
    return (
        state.join(per_code, "product_code", "left")
        .withColumn("episodes", n)
        .select(
            "product_code",
            F.col("model").alias("model_in_use"),
            "rule_enabled",
            F.round("coverage80", 3).alias("locked_coverage80"),
            "evaluated_months",
            "flagged_months",
            "episodes",
            F.bround(F.col("episodes") / F.col("evaluated_months"), 4).alias("episodes_per_evaluated_month"),
            (F.col("rule_enabled") & F.col("pending")).alias("pending_single_flag_at_end"),
        )
    )


def diagnostic(found: DataFrame, state: DataFrame) -> DataFrame:
    """The rule with and without its coverage gate, per code."""
    per_code = found.groupBy("product_code").agg(F.count(F.lit(1)).alias("n"))
    ungated = F.coalesce("n", F.lit(0))
    return state.join(per_code, "product_code", "left").select(
        "product_code", "evaluated_months", "flagged_months", "rule_enabled",
        ungated.alias("ungated_episodes"),
        F.when(F.col("rule_enabled"), ungated).otherwise(F.lit(0)).alias("gated_episodes"),
    )


def chance_expectation(months_evaluated, tail: float = 0.10, run: int = 2) -> Column:
    """Runs expected by chance among ``months`` when each month flags with probability ``tail``."""
    m = F.col(months_evaluated) if isinstance(months_evaluated, str) else months_evaluated
    return m / F.lit((1.0 / tail) ** run)
