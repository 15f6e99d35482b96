"""Forecast scores and the promotion rule (M-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countwatch.config import Harness
from countwatch.functions import months
from countwatch.functions.intervals import exact_mean, weighted_interval_score


def score_columns(rows: DataFrame) -> DataFrame:
    """J1 expressions. The point is read as published (six places); derived values stay unrounded."""
    y = F.col("actual").cast("double")
    inside = lambda lo, hi: y.between(F.col(lo), F.col(hi))
    return (
        rows.withColumn("point", F.round("point", 6))
        .withColumn("error", y - F.col("point"))
        .withColumn("abs_error", F.abs(y - F.col("point")))
        .withColumn("covered50", inside("lower50", "upper50"))
        .withColumn("covered80", inside("lower80", "upper80"))
        .withColumn("width50", F.col("upper50") - F.col("lower50"))
        .withColumn("width80", F.col("upper80") - F.col("lower80"))
        .withColumn(
            "wis",
            weighted_interval_score(
                y, F.col("point"), F.col("lower50"), F.col("upper50"), F.col("lower80"), F.col("upper80")
            ),
        )
    )


def published(rows: DataFrame) -> DataFrame:
    """The scored table as published: month labels and six-place values."""
    six = lambda c: F.round(c, 6).alias(c)
    return rows.select(
        "product_code", "model", months.label("origin_mi").alias("origin"), months.label("target_mi").alias("target"),
        F.col("horizon").cast("long").alias("horizon"), "period",
        F.col("actual").cast("long").alias("actual"), "point", "lower50", "upper50", "lower80", "upper80",
        F.col("calibration_n").cast("long").alias("calibration_n"),
        six("error"), six("abs_error"), "covered50", "covered80", six("width50"), six("width80"), six("wis"),
    )


def scored(fc: DataFrame, harness: Harness) -> DataFrame:
    """Only scored periods, with a point, a range and an actual."""
    keep = (
        F.col("period").isin(*harness.scored_periods)
        & F.col("point").isNotNull()
        & F.col("lower80").isNotNull()
        & F.col("actual").isNotNull()
    )
    return score_columns(fc.filter(keep))


def cells(rows: DataFrame, keys=("product_code", "model", "horizon", "period")) -> DataFrame:
    """The score cell."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    mean = lambda c: exact_mean(F.col(c))
    measures = [
        ("mae", mean("abs_error")), ("coverage50", share("covered50")), ("coverage80", share("covered80")),
        ("width50", mean("width50")), ("width80", mean("width80")), ("wis", mean("wis")),
    ]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[v.alias(k) for k, v in measures],
        F.bround(F.avg("calibration_n"), 1).alias("mean_calibration_n"),
    )


def scaled(cell: DataFrame) -> DataFrame:
    """Each cell's MAE over baseline A's in the same cell; null when that is missing or zero."""
    same = Window.partitionBy("product_code", "horizon", "period")
    base = F.max(F.when(F.col("model") == "baseline_a", F.col("mae"))).over(same)
    return cell.withColumn("mae_scaled_vs_a", F.when(base != 0, F.round(F.col("mae") / base, 6)))


def promotion(cell: DataFrame, harness: Harness) -> DataFrame:
    """The model in use per code, decided on development cells at horizon 1."""
    of = lambda model, what: F.max(F.when(F.col("model") == model, F.col(what)))
    wide = (
        cell.filter((F.col("period") == "development") & (F.col("horizon") == 1))
        .groupBy("product_code")
        .agg(
            *[
                of(m, w).alias(f"{w}_{m}")
                for m in harness.models
                for w in ("mae", "wis", "coverage80")
            ]
        )
    )
    complete = F.col("mae_baseline_a").isNotNull() & F.col("mae_baseline_b").isNotNull() & F.col("mae_candidate").isNotNull()
    a_wins = F.col("mae_baseline_a") <= F.col("mae_baseline_b")
    best_mae = F.when(a_wins, F.col("mae_baseline_a")).otherwise(F.col("mae_baseline_b"))
    best_wis = F.when(a_wins, F.col("wis_baseline_a")).otherwise(F.col("wis_baseline_b"))
    promoted = complete & (F.col("mae_candidate") <= harness.improvement * best_mae) & (F.col("wis_candidate") <= best_wis)
    return (
        wide.withColumn("candidate_promoted", F.coalesce(promoted, F.lit(False)))
        .withColumn(
            "model_in_use",
            F.when(~complete, "baseline_a")
            .when(F.col("candidate_promoted"), "candidate")
            .otherwise(F.when(a_wins, "baseline_a").otherwise("baseline_b")),
        )
        .withColumn(
            "reason",
            F.when(~complete, "a model has no development scores")
            .when(F.col("candidate_promoted"), "candidate at least 10% better and WIS not worse")
            .otherwise("better baseline kept"),
        )
    )


def promote_once(decisions: DataFrame, path: str) -> DataFrame:
    """Write the decision where none exists; an existing one is never revisited."""
    decisions.write.mode("errorifexists").parquet(path)
    return decisions.sparkSession.read.schema(decisions.schema).parquet(path)
