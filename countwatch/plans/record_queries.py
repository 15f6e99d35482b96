"""Registered queries over the record tables (measures M-01, M-02 and their companions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.config import STAR
from countwatch.functions import months, text
from countwatch.operators import compare, gates, live, measures, records
from countwatch.plans.star_plan import StarPlan
from countwatch.session import stage
from countwatch.sources import manifests, star


def m01_monthly_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = StarPlan(spark, sf_dir).monthly_lazy()
    return monthly.select(
        "product_code", months.label("mi").alias("month"), "raw_reports", "excluded_reports", "eligible_reports"
    )


def m01_spine_variance(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    by_month = measures.day_counts_to_months(p.daily, STAR.window_start, STAR.as_of)
    return measures.spine_variance(p.monthly_lazy(), by_month)


def m02_lag_matched(spark, sf_dir):
    return measures.lag_matched(StarPlan(spark, sf_dir).eligible, STAR)


def lag_summary(spark, sf_dir):
    return measures.lag_summary(StarPlan(spark, sf_dir).eligible, STAR)


def event_type_mix(spark, sf_dir):
    return measures.event_type_mix(StarPlan(spark, sf_dir).eligible)


def remedial_count(spark, sf_dir):
    return measures.remedial_counts(StarPlan(spark, sf_dir).eligible, text.mentions("remedial_action", "urgent"))


def remedial_by_month(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    counts = measures.remedial_counts(p.eligible, text.mentions("remedial_action", "urgent"))
    return measures.remedial_by_month(counts, p.codes, STAR)


def audit_rows(p: StarPlan) -> DataFrame:
    """B5 from device rows: distinct (report, code, field, token) hits."""
    hits = F.array(
        F.struct(F.lit("device.brand_name").alias("field"), F.col("brand_token").alias("token")),
        F.struct(F.lit("device.manufacturer_d_name").alias("field"), F.col("firm_token").alias("token")),
    )
    return (
        p.devices.filter("brand_token is not null or firm_token is not null")
        .select("report_key", "product_code", F.explode(hits).alias("h"))
        .filter("h.token is not null")
        .select("report_key", "product_code", "h.field", "h.token")
        .distinct()
    )


def exclusion_audit(spark, sf_dir):
    return audit_rows(StarPlan(spark, sf_dir))


def exclusion_receipt(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    return measures.exclusion_receipt(audit_rows(p), p.members)


def receipt_gate(spark, sf_dir):
    """M6: the published receipt against the audit's own counts, and every audited token against the list."""
    p = StarPlan(spark, sf_dir)
    audit = stage(audit_rows(p), "audit")
    return gates.receipt_gate(measures.exclusion_receipt(audit, p.members), audit, (*star.STAR_TOKENS.firm, *star.STAR_TOKENS.brand))


def window_completeness(spark, sf_dir):
    """M2: each code-month is a window of the extraction; it is complete when it holds what the series expects."""
    p = StarPlan(spark, sf_dir)
    expected = measures.day_counts_to_months(p.daily).withColumnRenamed("series_reports", "expected")
    held = measures.monthly_counts(p.members).select("product_code", "mi", F.col("raw_reports").alias("api_total"))
    log = expected.join(held, ["product_code", "mi"], "left").withColumn("status", F.when(F.col("mi") <= STAR.end_mi, "complete").otherwise("open"))
    late = manifests.incomplete_windows(log).groupBy("product_code").agg(F.count(F.lit(1)).alias("incomplete"))
    totals = log.groupBy("product_code").agg(F.count(F.lit(1)).alias("windows"))
    return totals.join(late, "product_code", "left").select("product_code", "windows", F.coalesce("incomplete", F.lit(0)).alias("incomplete"))


def quarantine(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    received = star.table(spark, sf_dir, "orders").select(star.day_string("o_orderdate").alias("date_received"))
    line = star.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = star.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    pages = line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("p_type").alias("queried_code"), F.col("l_orderkey").alias("mdr_report_key")
    )
    return records.quarantine(received, p.harness, records.duplicates_within_code(pages))


def cohort_gate(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    stage_a = measures.gate_a(measures.day_counts_to_months(p.daily), STAR)
    return measures.gate_b(stage_a, p.monthly_lazy(), STAR)


def _searches(spark, sf_dir) -> DataFrame:
    """Stand-in for the exclusion searches: each part row names the searches that return its brand."""
    found = {
        "EX-01": text.mentions("p_name", "red anvil"),
        "EX-02": F.col("p_size") >= 49,
        "EX-03": F.col("p_retailprice") > 1900,
        "EX-04": F.col("p_type") == "PROMO",
    }
    ids = F.filter(F.array(*[F.when(cond, q) for q, cond in found.items()]), lambda q: q.isNotNull())
    part = star.table(spark, sf_dir, "part").select("p_brand", "p_name", "p_size", "p_retailprice", "p_type")
    return part.select(F.col("p_brand").alias("code"), F.explode(ids).alias("query_id"))


def excluded_code_union(spark, sf_dir):
    return measures.excluded_code_union(_searches(spark, sf_dir))


def product_code_dim(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    part = star.table(spark, sf_dir, "part").select("p_type", "p_size", "p_retailprice", "p_brand")
    classification = part.groupBy(F.col("p_type").alias("product_code")).agg(
        F.min("p_size").cast("long").alias("smallest_size"),
        F.max("p_size").cast("long").alias("largest_size"),
        F.count(F.lit(1)).alias("parts"),
    )
    reference = spark.createDataFrame([("REFERENCE",)], "product_code string")
    listed = p.codes.select("product_code", F.lit(True).alias("in_cohort"), F.lit(False).alias("reference_only")).unionByName(
        reference.select("product_code", F.lit(False).alias("in_cohort"), F.lit(True).alias("reference_only"))
    )
    excluded = part.filter("p_size = 50 and p_brand = 'Brand#1'").select(F.col("p_type").alias("product_code"))
    return measures.code_dimension(listed, classification, excluded, p.gate)


def record_facts(spark, sf_dir):
    return measures.summary_composition(StarPlan(spark, sf_dir).eligible)


def distinct_totals(spark, sf_dir):
    return measures.distinct_totals(StarPlan(spark, sf_dir).reports)


CAPACITY = 150


def capacity_windows(spark, sf_dir):
    return measures.capacity_windows(StarPlan(spark, sf_dir).daily, CAPACITY, STAR.window_start, STAR.as_of)


def record_first_seen(spark, sf_dir):
    first = star.page_records(spark, sf_dir, records.first_copies).drop("position")
    first = records.finish_reports(records.shape_records(first, star.STAR_TOKENS, ()), STAR)
    return first.select(
        F.col("mdr_report_key").alias("report_key"), "first_code", "copies", "report_number", "date_received",
        "date_of_event", "event_type", "remedial_action", F.col("n_devices").cast("long").alias("n_devices"),
        "device_codes", F.col("lag_months").cast("long").alias("lag_months"), "excluded",
        F.coalesce("quarantine_reason", F.lit("")).alias("quarantine_reason"), "countable",
    )


def lag_view(spark, sf_dir):
    """Lag shares by event month, months still filling, and the year before."""
    p = StarPlan(spark, sf_dir)
    from countwatch.operators import marts

    return marts.lag_view(measures.lag_matched(p.eligible, STAR), STAR)


def second_path_monthly(spark, sf_dir):
    """M-01 as published against counts taken straight from lines, cell by cell."""
    p = StarPlan(spark, sf_dir)
    derived = measures.day_counts_to_months(p.daily, STAR.window_start, STAR.as_of).withColumnRenamed(
        "series_reports", "raw_reports"
    )
    return compare.compare_cells(
        measures.monthly_counts(p.members), derived, ["product_code", "mi"], ["raw_reports"]
    )


def gate_results(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    return gates.record_gates(spark, sf_dir, p)


def hash_reconcile(spark, sf_dir):
    """Stored bodies (documents) against a manifest of their content hashes."""
    doc = star.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    path = F.col("doc_id").cast("string").alias("path")
    stored = doc.select(path, F.sha2("text", 256).alias("sha256"))
    # What was listed when the bodies were received: a body's own length then tells whether it was cut since.
    manifest = doc.select(path, F.sha2(F.substring("text", F.lit(1), F.col("n_chars").cast("int")), 256).alias("sha256"))
    return manifests.reconcile(stored, manifest).groupBy("verdict").agg(F.count(F.lit(1)).alias("files"))


def source_register(spark, sf_dir):
    """A13."""
    doc = star.table(spark, sf_dir, "documents").select("source", "lang", "text")
    return manifests.source_summary(
        doc.select("source", F.octet_length("text").alias("bytes"), F.col("lang").alias("last_updated"))
    )


def off_grid(spark, sf_dir):
    """Report counts that the code x month grid would not show, by reason."""
    p = StarPlan(spark, sf_dir)
    receipts = p.reports.select("receipt_mi", F.explode("codes").alias("product_code"))
    counts = receipts.groupBy("product_code", F.col("receipt_mi").alias("mi")).agg(F.count(F.lit(1)).alias("reports"))
    return measures.off_grid(p.codes, counts, STAR).groupBy("reason").agg(F.sum("reports").alias("reports"))


def keyed_objects(spark, sf_dir):
    """A4: JSON objects keyed by name to rows."""
    ev = star.table(spark, sf_dir, "events").select("event_type", "props")
    return manifests.keyed_rows(ev, "props", "bigint", "event_type").groupBy("event_type", "key").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("value").alias("total")
    )


def unparsed_objects(spark, sf_dir):
    """A4: rows whose object text cannot be read, by event type."""
    ev = star.table(spark, sf_dir, "events").select("event_type", "props")
    return manifests.unparsed_rows(ev, "props", "bigint", "event_type")


# Words the corpus scan refuses.
SCAN_TOKENS = ("license", "password", "copyright")


def token_scan(spark, sf_dir):
    """Documents with listed tokens, by id and count only."""
    doc = star.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return gates.token_scan(doc, SCAN_TOKENS, "—")


def bucket_check(spark, sf_dir):
    """B19 over daily buckets rendered as source text; a bucket from a December is given a bad day."""
    daily = StarPlan(spark, sf_dir).daily
    time = F.when(F.col("day").substr(5, 2) == "12", F.concat(F.col("day"), F.lit("x"))).otherwise(F.col("day"))
    return live.bucket_problems(daily.select("product_code", time.alias("time"), "count"))


QUERIES = {
    f.__name__: f
    for f in (
        m01_monthly_count, m01_spine_variance, m02_lag_matched, lag_summary, event_type_mix, remedial_count,
        remedial_by_month, exclusion_audit, exclusion_receipt, quarantine, cohort_gate, excluded_code_union,
        off_grid, receipt_gate, window_completeness, product_code_dim, record_facts, distinct_totals, capacity_windows, record_first_seen, lag_view,
        second_path_monthly, gate_results, hash_reconcile, source_register, keyed_objects, unparsed_objects, token_scan, bucket_check,
    )
}
