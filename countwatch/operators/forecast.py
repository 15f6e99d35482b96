"""Rolling-origin forecasts with ranges taken from each model's own past errors (M-03).

Everything is keyed by product code, so one hash partitioning by code serves the baseline windows,
the error history and the ranges; no join is needed between a forecast and its actual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countwatch.config import Harness, mi_of
from countwatch.functions import months
from countwatch.functions.intervals import quantile_of_array, six_places
from countwatch.operators import ets

BOUNDS = ("lower50", "upper50", "lower80", "upper80")


def baseline_columns(series: DataFrame, horizons) -> DataFrame:
    """E1, C5 and the actual at the target, by calendar-range frames (a missing month stays missing).

    Baseline A is the mean of three months present up to the origin, the same at every horizon;
    baseline B the value twelve months before the target.
    """
    w = Window.partitionBy("product_code").orderBy("mi")
    at = lambda k: F.max("y").over(w.rangeBetween(k, k))
    trailing = w.rangeBetween(-2, 0)
    out = series.withColumn("a", F.when(F.count("y").over(trailing) == 3, F.avg("y").over(trailing)))
    for h in horizons:
        out = out.withColumn(f"b{h}", at(h - 12).cast("double")).withColumn(f"y{h}", at(h))
    return out


def baselines(series: DataFrame, horizons=(1, 3)) -> DataFrame:
    """I2/I3 in long form: (code, origin, horizon, model, point, actual); absent points are null."""
    wide = baseline_columns(series, horizons)
    cells = []
    for h in horizons:
        for model, point in (("baseline_a", F.col("a")), ("baseline_b", F.col(f"b{h}"))):
            cells.append(
                F.struct(
                    F.lit(h).alias("horizon"), F.lit(model).alias("model"),
                    point.alias("point"), F.col(f"y{h}").alias("actual"),
                )
            )
    return wide.select(
        "product_code", F.col("mi").alias("origin_mi"), F.explode(F.array(*cells)).alias("c")
    ).select("product_code", "origin_mi", "c.*")


def rolling_points(series: DataFrame, harness: Harness, with_candidate: bool = True) -> DataFrame:
    """Origins x horizons x models with point and actual, from the first origin on."""
    hs = harness.horizons
    wide = baseline_columns(series, hs)
    if with_candidate:
        fitted = ets.fits(series)
        cand = fitted.select(
            "product_code", F.col("origin_mi").alias("mi"),
            *[
                F.when(F.col("fit_error").isNull(), F.greatest(F.lit(0.0), F.expm1(ets.log_point(h)))).alias(f"c{h}")
                for h in hs
            ],
        )
        wide = wide.join(cand, ["product_code", "mi"], "left")
    cells = []
    for h in hs:
        named = [("baseline_a", F.col("a")), ("baseline_b", F.col(f"b{h}"))]
        if with_candidate:
            named.append(("candidate", F.col(f"c{h}")))
        for model, point in named:
            cells.append(
                F.struct(
                    F.lit(model).alias("model"), F.lit(h).alias("horizon"),
                    point.alias("point"), F.col(f"y{h}").alias("actual"),
                )
            )
    origins = wide.filter(F.col("mi").between(mi_of(harness.first_origin), harness.end_mi))
    return origins.select(
        "product_code", F.col("mi").alias("origin_mi"), F.explode(F.array(*cells)).alias("c")
    ).select("product_code", "origin_mi", (F.col("origin_mi") + F.col("c.horizon")).alias("target_mi"), "c.*")


def elapsed_errors(points: DataFrame, harness: Harness) -> DataFrame:
    """At every origin the latest 36 known errors of the same model and horizon.

    Step one keeps, for each known error, the 36 errors ending at its target (a row frame over rows
    whose error is known, so gaps never shorten it). Step two reads the last such array whose target
    has elapsed at the origin: a growing frame that ends ``h`` months before the origin. Both frames
    sit on the code's own rows: no range join, no ranking, at most 36 values per row.
    """
    keyed = points.repartition("product_code").withColumn("err", F.col("actual") - F.col("point"))
    known = Window.partitionBy("product_code", "model", "horizon", F.col("err").isNull()).orderBy("origin_mi")
    latest = F.collect_list("err").over(known.rowsBetween(1 - harness.calibration_window, 0))
    held = keyed.withColumn("tail", F.when(F.col("err").isNotNull(), latest))
    by_model = Window.partitionBy("product_code", "model", "horizon").orderBy("origin_mi")
    calib = None
    for h in harness.horizons:
        elapsed = F.last("tail", ignorenulls=True).over(by_model.rangeBetween(Window.unboundedPreceding, -h))
        here = F.col("horizon") == h
        calib = F.when(here, elapsed) if calib is None else calib.when(here, elapsed)
    empty = F.array().cast("array<double>")
    return held.withColumn("calib", F.sort_array(F.coalesce(calib, empty))).drop("tail", "err")


def period(origin_mi: Column, target_mi: Column, harness: Harness) -> Column:
    """B17."""
    span = lambda p: target_mi.between(mi_of(p[0]), mi_of(p[1]))
    return (
        F.when(target_mi > harness.end_mi, "outlook")
        .when(span(harness.recent), F.when(origin_mi >= mi_of(harness.recent_min_origin), "recent").otherwise("unscored"))
        .when(span(harness.locked), F.when(origin_mi >= mi_of(harness.locked_min_origin), "locked").otherwise("unscored"))
        .when(span(harness.development), "development")
        .when(span(harness.warmup), "warmup")
        .otherwise("unscored")
    )


def add_ranges(rows: DataFrame, harness: Harness) -> DataFrame:
    """Point plus error quantiles, floored at zero, absent under twelve errors.

    Bounds are rounded to six places before anything is compared with them.
    """
    enough = F.col("point").isNotNull() & (F.size("calib") >= harness.min_calibration)
    out = rows.withColumn("calibration_n", F.size("calib"))
    for name, p in zip(BOUNDS, harness.levels):
        shifted = F.greatest(F.lit(0.0), F.col("point") + quantile_of_array(F.col("calib"), p))
        out = out.withColumn(name, F.when(enough, six_places(shifted)))
    return out


def forecast(series: DataFrame, harness: Harness, with_candidate: bool = True) -> DataFrame:
    """The forecast table, with ``point`` at full precision and its target's actual."""
    rows = add_ranges(elapsed_errors(rolling_points(series, harness, with_candidate), harness), harness)
    label = period(F.col("origin_mi"), F.col("target_mi"), harness)
    issued = F.when(F.col("period") == "outlook", F.lit(harness.outlook_issue_date)).otherwise(
        months.first_day_after("origin_mi")
    )
    return rows.withColumn("period", label).withColumn("issue_date", issued)


def published(fc: DataFrame) -> DataFrame:
    """The table as published: month labels and six-place values."""
    return fc.select(
        "product_code", "model", months.label("origin_mi").alias("origin"), months.label("target_mi").alias("target"),
        F.col("horizon").cast("long").alias("horizon"), "issue_date", "period",
        F.round("point", 6).alias("point"), *BOUNDS, F.col("calibration_n").cast("long").alias("calibration_n"),
    )


def dots(fc: DataFrame, harness: Harness) -> DataFrame:
    """Quantiles at ``(i - 0.5) / n`` of the calibration errors added to the point."""
    cells = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("dot"),
                F.greatest(F.lit(0.0), F.col("point") + quantile_of_array(F.col("calib"), (i - 0.5) / harness.dots)).alias("v"),
            )
            for i in range(1, harness.dots + 1)
        ]
    )
    ready = fc.filter(F.col("point").isNotNull() & (F.size("calib") > 0))
    keys = [c for c in ("product_code", "model", "origin_mi", "target_mi", "horizon") if c in fc.columns]
    return ready.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.dot", F.round("c.v", 6).alias("value"))


def merge_stage(existing: DataFrame, new_rows: DataFrame, boundary_mi: int, stage: str) -> DataFrame:
    """Keep the other stage's rows and add this stage's; development ends before ``boundary_mi``."""
    other = F.col("origin_mi") >= boundary_mi if stage == "development" else F.col("origin_mi") < boundary_mi
    mine = F.col("origin_mi") < boundary_mi if stage == "development" else F.col("origin_mi") >= boundary_mi
    return existing.filter(other).unionByName(new_rows.filter(mine))


def require_stage_order(existing: DataFrame | None, promotion: DataFrame | None, codes: DataFrame, boundary_mi: int) -> None:
    """Before a locked run every code has a decision and no locked row exists yet."""
    if promotion is None or codes.join(promotion, "product_code", "left_anti").limit(1).count():
        raise ValueError("a code has no promotion decision; decide on the development period first")
    if existing is not None and existing.filter(F.col("origin_mi") >= boundary_mi).limit(1).count():
        raise ValueError("locked-period rows already exist; the locked test runs once")
