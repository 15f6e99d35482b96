"""Registered queries over vintages of the source and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.config import STAR_FROZEN, mi_of, month_of
from countwatch.functions import months
from countwatch.operators import forecast, live, measures, scoring
from countwatch.session import shared_folder, stage
from countwatch.sources import star
from countwatch.streaming import daily_counts
from countwatch.streaming.live_edge import FROZEN, LiveEdge, fingerprint, freeze_from_counts

# Codes whose revised month is listed, the first as it reads, the second at a wrong frozen count.
LISTED = (("PROMO", 0), ("STANDARD", 1))


def vintage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code x month x vintage counts on the dense grid through the newest vintage's month, staged."""
    seen = stage(star.vintage_counts(spark, sf_dir), "vintage-counts")
    newest = seen.agg(F.max("mi").alias("mi")).first().mi or STAR_FROZEN.end_mi
    h = STAR_FROZEN.with_(last_actual=month_of(max(newest, STAR_FROZEN.end_mi)))
    return stage(measures.on_spine(star.code_list(spark, sf_dir), seen, h), "vintages")


def _frozen(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("mi") <= STAR_FROZEN.end_mi).select(
        "product_code", "mi", F.col("v0").alias("raw_reports"), F.col("eligible").alias("y")
    )


def readings(counts: DataFrame, vintage: str, last_updated: str) -> DataFrame:
    """A vintage as the source returns it: one bucket per month that holds anything."""
    return counts.filter(F.col(vintage) > 0).select(
        F.lit(vintage).alias("vintage"), F.lit(last_updated).alias("last_updated"), "product_code",
        F.regexp_replace(months.label("mi"), "-", "").alias("ym"), F.col(vintage).alias("count"),
    ).select("vintage", "last_updated", "product_code", F.concat("ym", F.lit("01")).alias("time"), "count")


def _dispositions(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """The revised month of two codes, listed with the counts that its first revised vintage showed."""
    codes = {c: off for c, off in LISTED}
    cells = counts.filter(F.col("product_code").isin(*codes) & (F.col("mi") == mi_of(star.REVISED_MONTH))).collect()  # two rows
    entries = [
        {"code": r.product_code, "month": star.REVISED_MONTH, "frozen": r.v0 + codes[r.product_code], "live_at_disposition": r[star.REVISED_FROM],
         "dispositioned": "2001-07-03", "classification": live.DISPOSITION_LABEL, "decision": f"D{n}"}
        for n, r in enumerate(cells, start=1)
        if r[star.REVISED_FROM] < r.v0 + codes[r.product_code]
    ]
    return live.dispositions(spark, entries, set(codes), "1995-01", "2001-04")


#: What lands, in order: name, the vintage whose counts it returns, its last_updated, a code it leaves out.
PLAIN = tuple((v, v, lu, None) for v, lu in star.STAR_VINTAGES[1:])
#: With a poll of an unchanged source and one that does not answer for a code.
EVENTFUL = (PLAIN[0], ("v1a", "v1", PLAIN[0][2], None), ("v1b", "v2", PLAIN[1][2], "STANDARD"), *PLAIN[1:])


def live_edge(spark: SparkSession, sf_dir: str, landings=PLAIN) -> LiveEdge:
    """Land the vintages one after another and let the stream ingest each."""
    counts = vintage_grid(spark, sf_dir)
    root = shared_folder(spark, "live-edge")
    edge = LiveEdge(spark, root, STAR_FROZEN, star.STAR_VINTAGES[0][1], _dispositions(spark, counts))
    freeze_from_counts(edge, _frozen(counts))
    for name, column, last_updated, left_out in landings:
        rows = readings(counts, column, last_updated).withColumn("vintage", F.lit(name))
        rows = rows.where(F.col("product_code") != left_out) if left_out else rows
        rows.write.mode("append").json(f"{root}_landing")
        edge.run_available(f"{root}_landing")
    return edge


def live_series(spark, sf_dir):
    """Every elapsed month as each vintage saw it, with the newest reading marked."""
    counts = vintage_grid(spark, sf_dir)
    parts = [
        live.new_months(
            counts.select("product_code", "mi", F.col(v).alias("reports")), star.code_list(spark, sf_dir), lu, v, STAR_FROZEN
        )
        for v, lu in star.STAR_VINTAGES[1:]
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    newest = live.latest_reading(rows).select("product_code", "mi", "actual_vintage")
    return rows.join(newest, ["product_code", "mi"]).select(
        "vintage", "product_code", months.label("mi").alias("month"), "reports_as_seen", "last_updated",
        (F.col("vintage") == F.col("actual_vintage")).alias("latest"),
    )


def frozen_variance(spark, sf_dir):
    """The frozen months re-read by every later vintage."""
    return live.variance_summary(_reread(spark, sf_dir), ("vintage",))


def revised_months(spark, sf_dir):
    """Every frozen code-month that a later vintage reads lower by more than the limit."""
    return live.revised_months(_reread(spark, sf_dir), ("vintage",))


def _reread(spark, sf_dir):
    counts = vintage_grid(spark, sf_dir)
    frozen, disposed = _frozen(counts).filter("raw_reports > 0"), _dispositions(spark, counts)
    parts = None
    for v, _ in star.STAR_VINTAGES[1:]:
        reading = counts.select("product_code", "mi", F.col(v).alias("reports"))
        one = live.frozen_reread(frozen, reading, disposed, STAR_FROZEN).withColumn("vintage", F.lit(v))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def vintage_manifest(spark, sf_dir):
    counts = vintage_grid(spark, sf_dir)
    rows = None
    for v, lu in star.STAR_VINTAGES[1:]:
        one = fingerprint(readings(counts, v, lu)).withColumn("vintage", F.lit(v))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def live_scores(spark, sf_dir):
    six = lambda c: F.round(c, 6).alias(c)
    return live_edge(spark, sf_dir).table("score").select(
        "vintage", "product_code", "model", months.label("origin_mi").alias("origin"), months.label("target_mi").alias("target"),
        F.col("horizon").cast("long").alias("horizon"), "issued_by", "point", "lower50", "upper50", "lower80", "upper80",
        F.col("actual").alias("actual_as_seen"), "actual_vintage", six("error"), six("abs_error"), "covered50", "covered80", six("wis"),
    )


def live_reissue(spark, sf_dir):
    return live_edge(spark, sf_dir).table("forecast").select(
        "vintage", "product_code", "model", months.label("origin_mi").alias("origin"), months.label("target_mi").alias("target"),
        F.col("horizon").cast("long").alias("horizon"), "point", "lower50", "upper50", "lower80", "upper80",
        F.col("calibration_n").cast("long").alias("calibration_n"),
    )


def _in_use(edge: LiveEdge) -> DataFrame:
    """The model in use as the frozen development decision has it."""
    h = edge.harness
    frozen = edge.part("frozen_month", FROZEN).select("product_code", "mi", "y")
    return stage(scoring.promotion(scoring.cells(scoring.scored(forecast.forecast(frozen, h), h)), h), "in-use")


def live_health(spark, sf_dir):
    """D19/L10 over a history in which runs were fine, skipped, stopped and failed."""
    edge = live_edge(spark, sf_dir, EVENTFUL)
    newest = star.STAR_VINTAGES[-1][0]
    return live.health(
        edge.latest(newest), edge.table("series"), edge.table("forecast"), edge.table("score"), _in_use(edge), edge.table("run"), edge.table("reread"), edge.dispositions
    )


def live_outlook(spark, sf_dir):
    """The newest outlook of the model in use, a row per code."""
    edge = live_edge(spark, sf_dir)
    return live.newest_outlook(edge.table("forecast"), _in_use(edge)).select(
        "product_code", "model", months.label("origin_mi").alias("origin"), months.label("target_mi").alias("target"), "point",
        "lower80", "upper80", F.col("calibration_n").cast("long").alias("calibration_n"), F.col("vintage").alias("issued_vintage"),
    )


def run_history(spark, sf_dir):
    return live_edge(spark, sf_dir).table("run").select(
        "vintage", "last_updated", "status", "passed", "checks_total", "failed_checks", "months_appended",
        "forecasts_scored", "forecasts_issued",
    )


def stream_daily_counts(spark, sf_dir):
    out = shared_folder(spark, "daily-counts")
    daily_counts.run_available(spark, f"{sf_dir.rstrip('/')}/events.parque[t]", out)
    return daily_counts.read_closed(spark, out).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 4).alias("total")
    )


def stream_every_reading(spark, sf_dir):
    """The view without a watermark, in which late rows and the newest days count too."""
    days = daily_counts.every_reading(spark, f"{sf_dir.rstrip('/')}/events.parque[t]", shared_folder(spark, "every-reading"))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 4).alias("total"))


#: Days that land together, and how many landings later every 37th event comes.
LANDING_DAYS, LATE_EVERY, LATE_BY = 4, 37, 2


def land_events(spark, sf_dir, root):
    """The events as a stream would bring them: a landing per four days, some events two landings late; runs the split after each."""
    events = star.table(spark, sf_dir, "events").where("ts IS NOT NULL")
    first = events.agg(F.min("ts")).first()[0]
    days = F.datediff(F.col("ts"), F.lit(first).cast("timestamp_ntz"))
    delayed = F.when(F.col("event_id") % LATE_EVERY == 0, LATE_BY).otherwise(0)
    landed = stage(events.withColumn("landing", F.floor(days / LANDING_DAYS) + delayed), "landings")
    last = landed.agg(F.max("landing")).first()[0]
    for n in range((-1 if last is None else last) + 1):
        landed.where(F.col("landing") == n).drop("landing").write.mode("append").parquet(f"{root}_landing")
        daily_counts.split_late(spark, f"{root}_landing", root)


def stream_late_rows(spark, sf_dir):
    """The events that came behind the watermark, as rows, with the landing that brought them."""
    root = shared_folder(spark, "late-rows")
    land_events(spark, sf_dir, root)
    late = daily_counts.read_split(spark, root).where("late")
    return late.select("event_id", "event_type", "value", F.col("batch").alias("landing"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


QUERIES = {
    f.__name__: f
    for f in (
        live_series, frozen_variance, revised_months, vintage_manifest, live_scores, live_reissue, live_health, live_outlook, run_history,
        stream_daily_counts, stream_every_reading, stream_late_rows,
    )
}
