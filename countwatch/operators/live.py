"""The live edge over vintages of a changing source (M-07): re-read, append, score once, re-issue once."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countwatch.config import Harness, mi_of
from countwatch.functions import months
from countwatch.operators import forecast, scoring

# The exact key set and label of a disposition record.
DISPOSITION_KEYS = {"code", "month", "frozen", "live_at_disposition", "dispositioned", "classification", "decision"}
DISPOSITION_LABEL = "source revision"
DISPOSITION_SCHEMA = (
    "product_code string, month string, frozen bigint, live_at_disposition bigint, dispositioned string, decision string"
)
FORECAST_KEY = ["product_code", "model", "origin_mi", "target_mi", "horizon"]


def bucket_problems(buckets: DataFrame) -> DataFrame:
    """Buckets and malformed buckets per code; ``time`` is eight digits, ``count`` a non-negative integer."""
    good = months.valid_day("time") & F.coalesce(F.col("count").cast("string").rlike("^[0-9]+$"), F.lit(False))
    return buckets.groupBy("product_code").agg(
        F.count(F.lit(1)).alias("buckets"), F.count_if(~good).alias("malformed")
    )


def datum_checks(meta: DataFrame, frozen_last_updated: str) -> DataFrame:
    """L2: one ``last_updated`` across the batch, present, and not before the frozen datum."""
    one = meta.agg(
        F.count_distinct("last_updated").alias("n"), F.min("last_updated").alias("low"), F.count_if(F.expr("last_updated is null")).alias("absent")
    )
    rows = F.array(
        F.struct(F.lit("one last_updated across the batch").alias("check"), (F.col("n") <= 1).alias("passed")),
        F.struct(F.lit("last_updated present").alias("check"), ((F.col("n") > 0) & (F.col("absent") == 0)).alias("passed")),
        F.struct(
            F.lit("last_updated not before the frozen datum").alias("check"),
            F.coalesce(F.col("low") >= frozen_last_updated, F.lit(False)).alias("passed"),
        ),
    )
    return one.select(F.explode(rows).alias("c")).select("c.check", "c.passed")


DISPOSITION_ENTRY = ", ".join(f"{k} string" for k in sorted(DISPOSITION_KEYS)) + ", entry int, other_keys string, absent_keys string"


def disposition_faults(entries: DataFrame, cohort: set[str], first: str, last: str) -> DataFrame:
    """L4: one row per (entry, rule) that a listed revision breaks; an empty list breaks none.

    ``entries`` has the record's fields as text, the entry's number, and the names of fields that are too many
    or lacking. The rules are constraint columns, so the list may come from anywhere.
    """
    whole = lambda c: F.coalesce(F.col(c).rlike("^[0-9]+$"), F.lit(False))
    size = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    shape = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    month = shape("month", "^[0-9]{4}-[0-9]{2}$") & F.col("month").between(first, last)
    entries = entries.withColumn("listed", F.count(F.lit(1)).over(Window.partitionBy("code", "month")))
    rules = {
        "fields": (F.col("other_keys") == "") & (F.col("absent_keys") == ""),
        "cohort": F.coalesce(F.col("code").isin(*sorted(cohort)), F.lit(False)),
        "frozen month": month,
        "counts": whole("frozen") & whole("live_at_disposition") & F.coalesce(size("live_at_disposition") < size("frozen"), F.lit(False)),
        "day": shape("dispositioned", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
        "label": F.coalesce(F.col("classification") == DISPOSITION_LABEL, F.lit(False)),
        "decision": shape("decision", "^D[0-9]+$"),
        "single": F.col("listed") == 1,
    }
    held = F.array(*(F.struct(F.lit(name).alias("rule"), ok.alias("holds")) for name, ok in rules.items()))
    return entries.select("entry", F.explode(held).alias("r")).where("not r.holds").select("entry", "r.rule")


def dispositions(spark: SparkSession, entries: Iterable[Mapping], cohort: set[str], first: str, last: str) -> DataFrame:
    """L4/A10: the hand-written revision list as a table; any broken rule stops before anything is read."""
    text_of = lambda v: None if isinstance(v, bool) else str(v) if isinstance(v, (int, str)) else v and str(v)
    rows = []
    for n, entry in enumerate(entries, start=1):
        fields = dict(entry) if isinstance(entry, Mapping) else {}
        typed = {k: text_of(fields.get(k)) for k in DISPOSITION_KEYS}
        for k in ("frozen", "live_at_disposition"):  # a quoted number is no count
            typed[k] = typed[k] if isinstance(fields.get(k), int) else None
        rows.append((*(typed[k] for k in sorted(DISPOSITION_KEYS)), n, ",".join(sorted(set(fields) - DISPOSITION_KEYS)), ",".join(sorted(DISPOSITION_KEYS - set(fields)))))
    listed = spark.createDataFrame(rows, DISPOSITION_ENTRY)
    faults = disposition_faults(listed, cohort, first, last).groupBy("entry").agg(F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("rules")).orderBy("entry").collect()
    if faults:
        raise ValueError("; ".join(f"entry {r.entry} breaks: {r.rules}" for r in faults))
    return listed.select(
        F.col("code").alias("product_code"), "month", F.col("frozen").cast("bigint").alias("frozen"),
        F.col("live_at_disposition").cast("bigint").alias("live_at_disposition"), "dispositioned", "decision",
    )


def frozen_reread(frozen: DataFrame, live: DataFrame, disposed: DataFrame, harness: Harness) -> DataFrame:
    """Every frozen code-month against the live reading, with its verdict.

    A month the source no longer returns reads zero. A fall of more than one percent is material
    unless it is listed at the same frozen count and reads no deeper than when it was listed.
    """
    listed = disposed.select(
        "product_code", months.month_to_mi("month").alias("mi"), F.col("frozen").alias("listed_frozen"), "live_at_disposition"
    )
    rows = (
        frozen.select("product_code", "mi", F.col("raw_reports").alias("frozen"))
        .join(live.select("product_code", "mi", F.col("reports").alias("live")), ["product_code", "mi"], "left")
        .withColumn("live", F.coalesce("live", F.lit(0)))
        .join(listed, ["product_code", "mi"], "left")
    )
    drop = F.col("frozen") - F.col("live")
    known = (F.col("listed_frozen") == F.col("frozen")) & (F.col("live") >= F.col("live_at_disposition"))
    verdict = (
        F.when(drop < 0, "higher")
        .when(drop == 0, "same")
        .when(drop <= harness.material_decrease * F.col("frozen"), "lower")
        .when(F.coalesce(known, F.lit(False)), "known")
        .otherwise("material")
    )
    return rows.withColumn("verdict", verdict)


def variance_summary(reread: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Months compared and their verdicts. The months themselves are rows of ``revised_months``."""
    v = F.col("verdict")
    return reread.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months_compared"),
        F.count_if(v == "higher").alias("months_reading_higher"),
        F.coalesce(F.sum(F.when(v == "higher", F.col("live") - F.col("frozen"))), F.lit(0)).alias("reports_added"),
        F.count_if(v.isin("lower", "known", "material")).alias("months_reading_lower"),
        F.count_if(v == "known").alias("known_revisions"),
        F.count_if(v == "material").alias("material_downward"),
    )


def revised_months(reread: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every known and material code-month as a row, with why a listed revision did not hold.

    Nothing is cut here; a report that shows the first few cuts where it is written.
    """
    note = F.when(F.col("verdict") == "material", F.when(F.col("listed_frozen").isNull(), "not listed").when(F.col("listed_frozen") != F.col("frozen"), "listed at another frozen count").otherwise("reads deeper than listed"))
    return reread.where(F.col("verdict").isin("known", "material")).select(*keys, "product_code", months.label("mi").alias("month"), "frozen", "live", "verdict", note.alias("note"))


def new_months(readings: DataFrame, codes: DataFrame, last_updated: str, vintage: str, harness: Harness) -> DataFrame:
    """The months elapsed beyond the freeze as this vintage sees them.

    A month without reports reads zero, but only for a code that answered in this vintage at all: of a code
    without any reading nothing is known, and nothing is appended.
    """
    answered = codes.join(readings.select("product_code").distinct(), "product_code", "left_semi")
    seen = answered.select("product_code", F.explode(months.months_seen(F.lit(last_updated), harness.end_mi)).alias("mi"))
    return seen.join(readings.select("product_code", "mi", "reports"), ["product_code", "mi"], "left").select(
        F.lit(vintage).alias("vintage"), "product_code", "mi",
        F.coalesce("reports", F.lit(0)).alias("reports_as_seen"), F.lit(last_updated).alias("last_updated"),
    )


def absent_codes(readings: DataFrame, codes: DataFrame) -> DataFrame:
    """L1: cohort codes that a vintage does not answer for."""
    return codes.join(readings.select("product_code").distinct(), "product_code", "left_anti")


def latest_reading(live_series: DataFrame) -> DataFrame:
    """The newest vintage's reading of every (code, month)."""
    return (
        live_series.groupBy("product_code", "mi")
        .agg(F.max_by(F.struct("vintage", "reports_as_seen"), "vintage").alias("r"))
        .select("product_code", "mi", F.col("r.vintage").alias("actual_vintage"), F.col("r.reports_as_seen").alias("actual"))
    )


def score_once(candidates: DataFrame, done: DataFrame, latest: DataFrame, vintage: str) -> DataFrame:
    """Forecasts whose target has now been seen and that no earlier run scored.

    ``candidates`` carries ``issued_by`` and the forecast columns; a forecast without a range is
    scored on its point alone.
    """
    due = candidates.filter(F.col("point").isNotNull()).join(done.select(*FORECAST_KEY).distinct(), FORECAST_KEY, "left_anti")
    seen = latest.withColumnRenamed("mi", "target_mi")
    rows = scoring.score_columns(due.drop("actual").join(seen, ["product_code", "target_mi"]))
    return rows.withColumn("scored_vintage", F.lit(vintage))


def reissue(
    history: DataFrame, errors: DataFrame, origins: DataFrame, harness: Harness, vintage: str, with_candidate: bool = True
) -> DataFrame:
    """Points at each code's origin with ranges from the scored errors elapsed by then (basis 'scored').

    ``history``: product_code, mi, y through the origin. ``errors``: product_code, model, horizon,
    target_mi, error. ``origins``: product_code, origin_mi, one row per code to issue.
    """
    hs = harness.horizons
    point_rows = forecast.rolling_points(
        history.join(origins, "product_code").filter("mi <= origin_mi").select("product_code", "mi", "y"),
        harness.with_(last_actual="2999-12"),
        with_candidate,
    ).join(origins, ["product_code", "origin_mi"], "left_semi")
    elapsed = errors.join(origins, "product_code").filter("target_mi <= origin_mi")
    w = Window.partitionBy("product_code", "model", "horizon").orderBy(F.desc("target_mi"))
    kept = (
        elapsed.withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= harness.calibration_window)
        .groupBy("product_code", "model", "horizon")
        .agg(F.sort_array(F.collect_list("error")).alias("calib"))
    )
    empty = F.array().cast("array<double>")
    rows = point_rows.join(kept, ["product_code", "model", "horizon"], "left").withColumn(
        "calib", F.when(F.col("point").isNotNull(), F.coalesce("calib", empty)).otherwise(empty)
    )
    out = forecast.add_ranges(rows.filter(F.col("horizon").isin(*hs)), harness)
    return out.select(
        F.lit(vintage).alias("issued_vintage"), *FORECAST_KEY, "point", *forecast.BOUNDS, "calibration_n"
    )


def run_status(checks: DataFrame, stopped: str | None = None, error: str | None = None) -> DataFrame:
    """Ok, skipped, stopped or failed; passed only with no failed check and no error."""
    failed = F.count_if(~F.col("passed"))
    tally = checks.agg(
        F.count(F.lit(1)).alias("checks_total"),
        failed.alias("checks_failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))), "; ").alias("failed_checks"),
    )
    status = (
        F.when(F.lit(error is not None), "failed")
        .when(F.lit(stopped is not None), F.lit(stopped))
        .when(F.col("checks_failed") > 0, "failed")
        .otherwise("ok")
    )
    return (
        tally.withColumn("status", status)
        .withColumn("error", F.lit(error).cast("string"))
        .withColumn("passed", (F.col("status") != "failed") & (F.col("checks_failed") == 0) & F.col("error").isNull())
    )


def run_rollup(runs: DataFrame) -> DataFrame:
    """One row over the run history: how many runs of each outcome, and the newest run that was fine, was not, or failed a check.

    A run is known by its vintage, whose order is the order of runs. A skipped run is not fine and has not failed; one that was stopped
    failed the check that stopped it.
    """
    status = F.substring_index("status", ":", 1)
    newest = lambda what, where: F.max_by(what, F.when(where, F.col("vintage")))
    failed = (status == "failed") | (F.coalesce("failed_checks", F.lit("")) != "") | F.col("error").isNotNull()
    return runs.agg(
        F.count(F.lit(1)).alias("runs_recorded"),
        *[F.count_if(status == s).alias(f"runs_{s}") for s in ("ok", "skipped", "stopped", "failed")],
        F.min("vintage").alias("first_run"),
        F.max("vintage").alias("newest_run"),
        F.max_by("status", "vintage").alias("newest_status"),
        newest("vintage", status == "ok").alias("last_ok_run"),
        newest("vintage", status != "ok").alias("last_not_ok_run"),
        newest("status", status != "ok").alias("last_not_ok_status"),
        newest("vintage", failed).alias("last_failed_run"),
        newest("failed_checks", failed).alias("last_failed_checks"),
        newest("last_updated", F.col("advanced")).alias("source_last_updated_seen"),
    )


def newest_reread(reread: DataFrame) -> DataFrame:
    """The totals of the newest vintage that re-read the frozen months; no row before the first."""
    return variance_summary(reread, ("vintage",)).orderBy(F.desc("vintage")).limit(1).withColumnRenamed("vintage", "reread_vintage")


def listed_totals(disposed: DataFrame) -> DataFrame:
    """The hand-written revisions in sum."""
    return disposed.agg(
        F.count(F.lit(1)).alias("revisions_listed"),
        F.coalesce(F.sum(F.col("frozen") - F.col("live_at_disposition")), F.lit(0)).alias("revisions_reports_removed"),
        F.count_distinct("decision").alias("revisions_decisions"),
    )


def newest_outlook(live_forecast: DataFrame, in_use: DataFrame) -> DataFrame:
    """Next month as the model in use sees it from each code's newest live origin."""
    used = in_use.select("product_code", F.col("model_in_use").alias("model"))
    rows = live_forecast.filter((F.col("horizon") == 1) & F.col("point").isNotNull()).join(used, ["product_code", "model"])
    newest = Window.partitionBy("product_code")
    return rows.withColumn("newest", F.max("origin_mi").over(newest)).filter("origin_mi = newest").drop("newest")


def health(
    latest: DataFrame, live_series: DataFrame, live_forecast: DataFrame, scores: DataFrame, in_use: DataFrame, runs: DataFrame,
    reread: DataFrame, disposed: DataFrame,
) -> DataFrame:
    """One row of live-edge totals: readings, scores, run history, newest re-read, listed revisions, newest outlook.

    Every part is an aggregate of one row (the re-read none before its first run), so the row is there from the first day on.
    """
    one = F.lit(1)
    used = in_use.select("product_code", F.col("model_in_use").alias("model"))
    mine = scores.filter(F.col("horizon") == 1).join(used, ["product_code", "model"])
    parts = [
        live_series.agg(F.count(one).alias("readings_recorded"), F.count_distinct("vintage").alias("vintages")),
        latest.agg(
            F.count_distinct("mi").alias("months_seen"), months.label(F.max("mi")).alias("newest_month_seen")
        ),
        live_forecast.agg(F.count(one).alias("forecasts_issued"), months.label(F.max("origin_mi")).alias("latest_origin")),
        scores.agg(F.count(one).alias("forecasts_scored")),
        mine.agg(
            F.count(one).alias("in_use_h1_scored"),
            F.round(F.avg("abs_error"), 3).alias("in_use_h1_mae"),
            F.round(F.avg(F.col("covered80").cast("double")), 4).alias("in_use_h1_coverage80"),
        ),
        run_rollup(runs),
        listed_totals(disposed),
        newest_outlook(live_forecast, in_use).agg(
            F.count(one).alias("outlook_codes"), months.label(F.max("target_mi")).alias("outlook_target"), F.round(F.sum("point"), 3).alias("outlook_reports")
        ),
        newest_reread(reread),
    ]
    joined = parts[0].withColumn("one", one)
    for p in parts[1:]:
        joined = joined.join(p.withColumn("one", one), "one", "left")
    return joined.drop("one")
