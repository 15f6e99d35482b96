"""Corruption runs over the star tables: every gate, its tables and the one-row changes that it must catch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.operators import gates, measures
from countwatch.operators.corruptions import Gate, Table, prove
from countwatch.plans import live_queries
from countwatch.plans.record_queries import audit_rows
from countwatch.plans.star_plan import StarPlan
from countwatch.session import stage
from countwatch.sources import star
from countwatch.streaming.live_edge import fingerprint

WINDOW = ("product_code", "mi")
TOKENS = (*star.STAR_TOKENS.firm, *star.STAR_TOKENS.brand)


def tables(p: StarPlan) -> dict[str, Table]:
    """The gates' tables by name; what is read by several runs is staged, all but the record tables small."""
    spark, h = p.spark, p.harness
    series = stage(measures.day_counts_to_months(p.daily, h.window_start, h.as_of), "series")
    monthly = stage(measures.spine_variance(p.monthly, series), "spine")
    audit = stage(audit_rows(p), "audit")
    held = p.monthly.select(*WINDOW, F.col("raw_reports").alias("api_total")).where("api_total > 0")
    log = stage(series.withColumnRenamed("series_reports", "expected").join(held, list(WINDOW), "left").withColumn("status", F.lit("complete")), "log")
    path = F.col("doc_id").cast("string").alias("path")
    doc = star.table(spark, p.dir, "documents").select(path, F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    totals = lambda rows, n: rows.groupBy(F.col("product_code").alias("figure")).agg(F.sum(n).cast("double").alias("value"))
    vintage, last_updated = star.STAR_VINTAGES[1]
    readings = stage(live_queries.readings(live_queries.vintage_grid(spark, p.dir), vintage, last_updated), "readings")
    return {
        "report": Table(p.reports, ("report_key",), "countable and size(codes) > 0"),
        "bridge": Table(p.bridge.select("report_key", "product_code"), ("report_key", "product_code")),
        "monthly": Table(monthly, ("product_code", "month"), "raw_reports > 0"),
        "audit": Table(audit, ("report_key", "product_code", "field", "token")),
        "receipt": Table(stage(measures.exclusion_receipt(audit, p.members), "receipt"), ("product_code", "field"), "field not like '%(%' and reports_matched > 0"),
        "log": Table(log, WINDOW),
        "published": Table(stage(p.monthly.where("raw_reports > 0").select(*WINDOW, "raw_reports"), "published"), WINDOW),
        "derived": Table(series.withColumnRenamed("series_reports", "raw_reports"), WINDOW),
        "stored": Table(stage(doc, "stored"), ("path",)),
        "manifest": Table(stage(doc, "manifest"), ("path",)),
        "figures": Table(stage(totals(p.monthly, "raw_reports"), "figures"), ("figure",)),
        "bands": Table(stage(totals(series, "series_reports").select("figure", F.col("value").alias("low"), F.col("value").alias("high")), "bands"), ("figure",)),
        "readings": Table(readings, ("product_code", "time")),
        "landed": Table(stage(fingerprint(readings), "landed"), ("product_code",)),
    }


def all_gates(p: StarPlan) -> dict[str, Gate]:
    """Each gate over the tables above with the mutations it is named for."""
    newest = p.reports.where("countable").agg(F.max("date_received").alias("day")).first().day
    harness = p.harness.with_(as_of=newest or p.harness.as_of)
    each = lambda table, *kinds: tuple(f"{table}:{kind}" for kind in kinds)
    return {
        "M1 manifest": Gate(
            lambda t: gates.manifest_gate(t["stored"], t["manifest"]),
            (
                *each("stored", "drop", "repeat", "shift:path", "blank:path", "shift:sha256", "blank:sha256", "swap:sha256"),
                *each("manifest", "drop", "repeat", "shift:path", "shift:sha256", "swap:sha256"),
            ),
        ),
        "M2 windows": Gate(
            lambda t: gates.window_gate(t["log"], t["published"], WINDOW),
            each("log", "drop", "repeat", "shift:expected", "blank:expected", "shift:api_total", "blank:api_total", "shift:status", "blank:status"),
        ),
        "M3 monthly": Gate(
            lambda t: gates.monthly_gate(t["monthly"]),
            each("monthly", *(f"{k}:{c}" for k in ("shift", "blank") for c in ("raw_reports", "series_reports", "excluded_reports", "eligible_reports")), "swap:raw_reports"),
        ),
        "M4 reports": Gate(lambda t: gates.report_gate(t["report"], harness), each("report", "repeat", "shift:date_received", "blank:date_received", "shift:countable")),
        "M5 bridge": Gate(lambda t: gates.bridge_gate(t["bridge"], t["report"]), (*each("bridge", "repeat", "blank:report_key"), *each("report", "drop"))),
        "M6 receipt": Gate(
            lambda t: gates.receipt_gate(t["receipt"], t["audit"], TOKENS),
            (*each("receipt", "drop", "shift:reports_matched", "blank:reports_matched", "shift:field"), *each("audit", "drop", "shift:token", "shift:field")),
        ),
        "M13 second path": Gate(
            lambda t: gates.cells_gate(t["published"], t["derived"], WINDOW, ("raw_reports",)),
            tuple(m for table in ("published", "derived") for m in each(table, "drop", "repeat", "shift:mi", "shift:raw_reports", "blank:raw_reports", "swap:raw_reports")),
        ),
        "M16 figures": Gate(
            lambda t: gates.figures_gate(t["figures"], t["bands"]),
            (*each("figures", "drop", "shift:figure", "shift:value", "blank:value", "swap:value"), *each("bands", "drop", "shift:low", "blank:high", "swap:low")),
        ),
        "live store": Gate(
            lambda t: gates.store_gate(fingerprint(t["readings"]), t["landed"]),
            (
                *each("readings", "drop", "repeat", "shift:product_code", "shift:time", "shift:count", "blank:count", "shift:last_updated"),
                *each("landed", "drop", "repeat", "shift:buckets", "blank:sha256", "swap:sha256"),
            ),
        ),
    }


def corruption_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per gate and mutation whether it was caught, and by which checks."""
    p = StarPlan(spark, sf_dir)
    return prove(tables(p), all_gates(p))


QUERIES = {"corruption_runs": corruption_runs}
