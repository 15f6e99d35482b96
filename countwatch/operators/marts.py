"""Tables behind the report's charts (2.N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countwatch.config import Harness
from countwatch.functions import months
from countwatch.operators import review


def lag_view(lags: DataFrame, harness: Harness, ks: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Arrivals by event month, which windows are still filling, and the three-month line a year before."""
    mi = months.month_to_mi("event_month")
    age = F.lit(harness.end_mi) - F.col("mi")
    w = Window.partitionBy("product_code").orderBy("mi").rangeBetween(-12, -12)
    return (
        lags.withColumn("mi", mi)
        .withColumn("within_3_year_before", F.max("within_3").over(w))
        .select(
            "product_code", "event_month", "reports_with_event_month", *[f"within_{k}" for k in ks],
            *[(age < k).alias(f"filling_{k}") for k in ks],
            "within_3_year_before",
        )
    )


def coverage_by_code(cells: DataFrame, state: DataFrame, harness: Harness) -> DataFrame:
    """Locked horizon-1 coverage of the model in use, months inside, gate and band."""
    locked = cells.filter((F.col("period") == "locked") & (F.col("horizon") == 1)).select(
        "product_code", "model", F.col("coverage80").alias("coverage80_locked"), "n"
    )
    low, high = harness.coverage_band
    c = F.col("coverage80_locked")
    return state.join(locked, ["product_code", "model"]).select(
        "product_code", F.col("model").alias("model_in_use"), c.alias("coverage80"), "n",
        F.round(c * F.col("n")).cast("long").alias("inside"),
        "rule_enabled",
        c.between(low, high).alias("in_band"),
    )


def _month_list(col: str):
    return F.array_join(F.array_sort(F.collect_list(col)), " ")


def lanes(evaluated: DataFrame, episodes: DataFrame, state: DataFrame, class_one_months: DataFrame) -> DataFrame:
    """Per code its flagged months, episodes with and without the gate, and Class I initiations.

    Lists hold at most one entry per evaluated month; initiations are counted, not listed.
    """
    flagged = evaluated.filter("flagged").groupBy("product_code").agg(
        _month_list_of("target_mi").alias("flagged_list")
    )
    spans = episodes.select(
        "product_code", F.concat(months.label("start_mi"), F.lit(".."), months.label("end_mi")).alias("span")
    )
    ungated = spans.groupBy("product_code").agg(F.count(F.lit(1)).alias("n"), _month_list("span").alias("ungated_list"))
    initiations = class_one_months.groupBy("product_code").agg(F.sum("n").alias("c"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = state.join(flagged, "product_code", "left").join(ungated, "product_code", "left").join(
        initiations, "product_code", "left"
    )
    return joined.select(
        "product_code", F.col("model").alias("model_in_use"), "rule_enabled", "flagged_months",
        blank("flagged_list").alias("flagged_list"),
        F.when(F.col("rule_enabled"), zero("n")).otherwise(F.lit(0)).alias("gated_episodes"),
        zero("n").alias("ungated_episodes"),
        blank("ungated_list").alias("ungated_list"),
        zero("c").alias("class_i_initiations"),
    ).orderBy(F.desc("rule_enabled"), F.desc("flagged_months"), "product_code")


def _month_list_of(mi: str):
    return F.array_join(F.array_sort(F.collect_list(months.label(mi))), " ")


def outlook(fc: DataFrame, promotion: DataFrame, origin_mi: int) -> DataFrame:
    """Outlook rows selected by origin, each model with its in-use mark."""
    used = promotion.select("product_code", "model_in_use")
    return (
        fc.filter((F.col("period") == "outlook") & (F.col("origin_mi") == origin_mi))
        .join(used, "product_code")
        .select(
            "product_code", "model", (F.col("model") == F.col("model_in_use")).alias("in_use"),
            F.col("horizon").cast("long").alias("horizon"), months.label("target_mi").alias("target"),
            F.round("point", 6).alias("point"), "lower50", "upper50", "lower80", "upper80",
            F.col("calibration_n").cast("long").alias("calibration_n"),
        )
    )


def _of_model_in_use(fc: DataFrame, promotion: DataFrame) -> DataFrame:
    used = promotion.select("product_code", F.col("model_in_use").alias("model"))
    return fc.join(used, ["product_code", "model"])


def outlook_history(series: DataFrame, fc: DataFrame, promotion: DataFrame) -> DataFrame:
    """Every month with its actual and, from the locked year on, the model in use one month ahead.

    Months before the drawn points have none; a month not yet in the source has no actual.
    """
    drawn = _of_model_in_use(fc, promotion).filter((F.col("horizon") == 1) & F.col("period").isin("locked", "recent", "outlook"))
    ahead = drawn.select("product_code", F.col("target_mi").alias("mi"), F.round("point", 6).alias("point"), "lower80", "upper80")
    months_of = series.select("product_code", "mi", F.col("y").cast("long").alias("actual")).join(ahead, ["product_code", "mi"], "full_outer")
    return promotion.select("product_code", "model_in_use").join(months_of, "product_code").select(
        "product_code", "model_in_use", months.label("mi").alias("month"), "actual", "point", "lower80", "upper80"
    )


def outlook_evidence(fc: DataFrame, promotion: DataFrame, horizon: int) -> DataFrame:
    """The locked targets that back the column drawn at ``horizon``, each with its range and whether the actual fell inside."""
    rows = _of_model_in_use(fc, promotion).filter(
        (F.col("period") == "locked") & (F.col("horizon") == horizon) & F.col("lower80").isNotNull() & F.col("actual").isNotNull()
    )
    point = F.round("point", 6)
    return rows.select(
        "product_code", F.col("model").alias("model_in_use"), months.label("target_mi").alias("target"), months.label("origin_mi").alias("origin"),
        F.col("actual").cast("long").alias("actual"), point.alias("point"), "lower80", "upper80",
        F.col("actual").between(F.col("lower80"), F.col("upper80")).alias("inside"), F.round(F.abs(F.col("actual") - point), 6).alias("miss"),
    )


def outlook_lead(fc: DataFrame, promotion: DataFrame, cells: DataFrame, harness: Harness, horizon: int) -> DataFrame:
    """Per code the outlook at ``horizon`` from the outlook origin, the month elapsed since, and the locked coverage behind it.

    Rows are selected by origin: at the longer horizon earlier origins have outlook rows too.
    """
    at_origin = _of_model_in_use(fc, promotion).filter((F.col("period") == "outlook") & (F.col("origin_mi") == harness.end_mi))
    lead = at_origin.filter(F.col("horizon") == horizon).select(
        "product_code", F.col("model").alias("model_in_use"), months.label("origin_mi").alias("origin"), months.label("target_mi").alias("target"),
        F.round("point", 6).alias("point"), "lower50", "upper50", "lower80", "upper80", F.col("calibration_n").cast("long").alias("calibration_n"),
        F.size("calib").cast("long").alias("errors"),
    )
    elapsed = at_origin.filter("horizon = 1").select(
        "product_code", months.label("target_mi").alias("elapsed_target"), F.round("point", 6).alias("elapsed_point"),
        F.col("lower80").alias("elapsed_lower80"), F.col("upper80").alias("elapsed_upper80"),
    )
    cell = cells.filter((F.col("period") == "locked") & (F.col("horizon") == horizon)).select(
        "product_code", F.col("model").alias("model_in_use"), "n", "coverage80", F.round(F.col("coverage80") * F.col("n")).cast("long").alias("inside"), "mae"
    )
    return lead.join(elapsed, "product_code", "left").join(cell, ["product_code", "model_in_use"], "left")


def outlook_gate(lead: DataFrame, evidence: DataFrame, dots: DataFrame, history: DataFrame, series: DataFrame, harness: Harness) -> DataFrame:
    """What is drawn against what is published, a row per code and check.

    The evidence must have the score cell's number of rows, number inside and mean miss; the dots rest on as many errors as the
    published range tells and are all drawn; every month of the series is drawn with its actual. A code that one side lacks fails.
    """
    number = lambda c: F.col(c).cast("double")
    shown = evidence.groupBy("product_code").agg(F.count(F.lit(1)).alias("rows"), F.count_if("inside").alias("within"), F.round(F.avg("miss"), 6).alias("mean_miss"))
    dotted = dots.groupBy("product_code").agg(F.count_distinct("dot").alias("dots"))
    drawn = history.groupBy("product_code").agg(F.count("actual").alias("drawn_months"), F.sum("actual").alias("drawn_reports"))
    whole = series.groupBy("product_code").agg(F.count("y").alias("months"), F.sum("y").alias("reports"))
    both = lead
    for side in (shown, dotted, drawn, whole):
        both = both.join(side, "product_code", "full_outer")
    pairs = {
        "evidence rows": ("rows", number("n")), "evidence inside": ("within", number("inside")), "evidence mean miss": ("mean_miss", number("mae")),
        "errors behind the dots": ("errors", number("calibration_n")), "dots": ("dots", F.lit(float(harness.dots))),
        "months": ("drawn_months", number("months")), "reports": ("drawn_reports", number("reports")),
    }
    cells = F.array(*[F.struct(F.lit(k).alias("check"), number(d).alias("drawn"), p.alias("published")) for k, (d, p) in pairs.items()])
    near = F.abs(F.col("drawn") - F.col("published")) <= 2e-6
    return both.select("product_code", F.explode(cells).alias("c")).select("product_code", "c.*").withColumn("passed", F.coalesce(near, F.lit(False)))


def locked_test(fc: DataFrame, promotion: DataFrame) -> DataFrame:
    """The locked year at horizon 1: actual, both points, band, months outside, largest miss.

    The largest miss is the earliest of equals.
    """
    rows = fc.filter((F.col("period") == "locked") & (F.col("horizon") == 1))
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    used = promotion.select("product_code", "model_in_use")
    in_use = F.col("model") == F.col("model_in_use")
    wide = (
        rows.join(used, "product_code")
        .groupBy("product_code", "model_in_use", "target_mi")
        .agg(
            F.max("actual").alias("actual"),
            F.round(of("candidate", "point"), 6).alias("candidate_point"),
            F.round(of("baseline_a", "point"), 6).alias("baseline_point"),
            F.round(F.max(F.when(in_use, F.col("point"))), 6).alias("point"),
            F.max(F.when(in_use, F.col("lower80"))).alias("lower80"),
            F.max(F.when(in_use, F.col("upper80"))).alias("upper80"),
        )
    )
    miss = F.round(F.abs(F.col("actual") - F.col("point")), 6)
    by_code = Window.partitionBy("product_code")
    worst = F.max(F.struct(F.col("miss"), (-F.col("target_mi")).alias("t"))).over(by_code)
    return (
        wide.withColumn("miss", miss)
        .withColumn("worst", worst)
        .select(
            "product_code", "model_in_use", months.label("target_mi").alias("target"),
            F.col("actual").cast("long").alias("actual"), "candidate_point", "baseline_point", "lower80", "upper80",
            ((F.col("actual") < F.col("lower80")) | (F.col("actual") > F.col("upper80"))).alias("outside"),
            (F.col("worst.t") == -F.col("target_mi")).alias("largest_miss"),
        )
    )


def largest_episode(evaluated: DataFrame, queue: DataFrame) -> DataFrame:
    """The queued episode with the largest excess (first code and start on a tie) and its peak month."""
    spans = queue.select(
        "product_code", "episode_start", "episode_end", months.month_to_mi("episode_start").alias("s"),
        months.month_to_mi("episode_end").alias("e"),
    )
    inside = evaluated.join(spans, "product_code").filter(F.col("target_mi").between(F.col("s"), F.col("e")))
    excess = F.col("actual").cast("double") - F.col("point")
    return (
        inside.withColumn("excess", F.round(excess, 6))
        .orderBy(F.desc("excess"), "product_code", "episode_start", "target_mi")
        .limit(1)
        .select(
            "product_code", "episode_start", "episode_end", months.label("target_mi").alias("peak_month"),
            F.col("actual").cast("long").alias("actual"), "point", "excess",
        )
    )


def headline_code(series: DataFrame, state: DataFrame, harness: Harness) -> DataFrame:
    """Largest twelve-month volume among enabled codes using the candidate, else enabled, else all."""
    recent = series.filter(F.col("mi").between(harness.end_mi - 11, harness.end_mi))
    volume = recent.groupBy("product_code").agg(F.sum("y").alias("last_12_months"))
    pool = (
        F.when(F.col("rule_enabled") & (F.col("model") == "candidate"), 0)
        .when(F.col("rule_enabled"), 1)
        .otherwise(2)
    )
    return (
        volume.join(state.select("product_code", "model", "rule_enabled"), "product_code")
        .withColumn("pool", pool)
        .orderBy("pool", F.desc("last_12_months"), F.desc("product_code"))
        .limit(1)
        .select("product_code", F.col("model").alias("model_in_use"), "rule_enabled", "last_12_months")
    )


def cohort_facts(classes: DataFrame) -> DataFrame:
    """The class set of each code and whether it is eligible for summary reporting."""
    return classes.groupBy("product_code").agg(
        F.array_join(F.array_sort(F.collect_set("device_class")), "|").alias("classes"),
        F.bool_or("eligible").alias("eligible"),
    )


def figures(diagnostic: DataFrame) -> DataFrame:
    """J11/N8 totals with the chance expectation, one named figure per row."""
    total = diagnostic.agg(
        F.sum("evaluated_months").cast("double").alias("evaluated_months"),
        F.sum("flagged_months").cast("double").alias("flagged_months"),
        F.coalesce(F.sum(F.when(F.col("rule_enabled"), F.col("evaluated_months"))), F.lit(0)).cast("double").alias("enabled_months"),
        F.sum("gated_episodes").cast("double").alias("gated_episodes"),
        F.sum("ungated_episodes").cast("double").alias("ungated_episodes"),
    ).withColumn("chance_episodes", F.round(review.chance_expectation("enabled_months"), 6))
    cells = F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).alias("value")) for c in total.columns])
    return total.select(F.explode(cells).alias("c")).select("c.figure", "c.value")
