"""Data-quality gates as check rows ``(check, passed, failures)`` (2.M)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.config import Harness, mi_of
from countwatch.functions import months, text
from countwatch.operators import compare, measures
from countwatch.sources import manifests


def check_rows(counts: DataFrame) -> DataFrame:
    """One-row table of failure counts to check rows; a count of zero passes."""
    cells = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("failures")) for c in counts.columns])
    return counts.select(F.explode(cells).alias("c")).select(
        "c.check", (F.col("c.failures") == 0).alias("passed"), "c.failures"
    )


def _none(n) -> Column:
    return F.coalesce(n, F.lit(0))


def report_gate(report: DataFrame, harness: Harness) -> DataFrame:
    """M4, M5 (keys) and M9 in one pass that first reduces to one row per key."""
    per_key = report.groupBy("report_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("countable").alias("countable"),
        F.count_if(F.col("countable") & ~months.valid_day("date_received")).alias("bad_day"),
        F.count_if(
            F.col("countable") & ~F.coalesce(F.col("date_received").between(harness.window_start, harness.as_of), F.lit(False))
        ).alias("outside"),
        F.count_if(~F.col("countable")).alias("held_back"),
        F.count_if(
            ~months.valid_day("date_received")
            | (F.col("date_received") > harness.as_of)
            | (F.col("date_received") < harness.window_start)
        ).alias("quarantined"),
        F.max(F.when(F.col("countable"), F.col("date_received"))).alias("newest"),
    )
    return check_rows(
        per_key.agg(
            _none(F.sum(F.col("n") - 1)).alias("report keys are unique"),
            _none(F.sum("bad_day")).alias("countable receipt days have eight digits"),
            _none(F.sum("outside")).alias("countable receipt days lie in the window"),
            F.abs(_none(F.sum("held_back")) - _none(F.sum("quarantined"))).alias("total minus countable equals quarantined"),
            F.when(F.max("newest") == harness.as_of, 0).otherwise(1).alias("newest receipt day is the as-of day"),
        )
    )


def bridge_gate(bridge: DataFrame, report: DataFrame) -> DataFrame:
    """M5: bridge pairs unique, and no bridge row without its report."""
    pairs = bridge.groupBy("report_key", "product_code").agg(F.count(F.lit(1)).alias("n"))
    known = report.select("report_key").distinct().withColumn("known", F.lit(True))
    return check_rows(
        pairs.join(known, "report_key", "left").agg(
            _none(F.sum(F.col("n") - 1)).alias("bridge pairs are unique"),
            F.count_if(F.expr("known is null")).alias("no bridge row without a report"),
        )
    )


def monthly_gate(monthly: DataFrame) -> DataFrame:
    """M3 on a table with raw, series, excluded and eligible counts."""
    return check_rows(
        monthly.agg(
            F.count_if(F.expr("raw_reports is distinct from series_reports")).alias("raw equals the independent series"),
            F.count_if(F.expr("eligible_reports is null or eligible_reports is distinct from raw_reports - excluded_reports")).alias("eligible is raw minus excluded"),
        )
    )


def receipt_gate(receipt: DataFrame, audit: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """M6: every per-field figure equals the audit's, and every audit token is on the list.

    Fails closed: an empty list cannot be checked against.
    """
    if not tokens:
        raise ValueError("the token list is absent; the receipt cannot be checked")
    per_field = audit.groupBy("product_code", "field").agg(F.count_distinct("report_key").alias("audited"))
    fields = receipt.filter("field not like '%(%'")
    both = fields.join(per_field, ["product_code", "field"], "full_outer")
    allowed = F.col("token").rlike("(?i)^(?:" + "|".join(tokens) + ")$")
    mismatch = both.agg(
        F.count_if(~F.col("reports_matched").eqNullSafe(F.col("audited"))).alias("receipt equals the audit")
    )
    strange = audit.agg(F.count_if(~allowed).alias("every audit token is on the list"))
    return check_rows(mismatch).unionByName(check_rows(strange))


def forecast_gate(fc: DataFrame, gated_codes: DataFrame, harness: Harness) -> DataFrame:
    """M7 and M10."""
    dev = F.col("period") == "development"
    inside = F.col("target_mi").between(mi_of(harness.development[0]), mi_of(harness.development[1]))
    chronology = fc.agg(
        F.count_if(F.expr("origin_mi >= target_mi")).alias("every origin precedes its target"),
        F.count_if((F.col("period") == "locked") & (F.col("origin_mi") < mi_of(harness.locked_min_origin))).alias(
            "locked origins are not before the minimum"
        ),
        F.count_if(dev & ~inside).alias("development targets lie in the span"),
        F.count_if((F.size("calib") < harness.min_calibration) & F.col("lower80").isNotNull()).alias(
            "no range under the minimum calibration"
        ),
    )
    outsiders = fc.join(gated_codes, "product_code", "left_anti").agg(
        F.count(F.lit(1)).alias("forecasts only for gated codes")
    )
    return check_rows(chronology).unionByName(check_rows(outsiders))


def queue_gate(queue: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Every month of a queued episode satisfies the rule and the span has the claimed length."""
    spans = queue.select(
        "product_code", "episode_start", months.month_to_mi("episode_start").alias("s"),
        months.month_to_mi("episode_end").alias("e"), "months_in_episode",
    )
    q, r = spans.alias("q"), evaluated.alias("r")
    joined = q.join(
        r, (F.col("q.product_code") == F.col("r.product_code")) & F.col("r.target_mi").between(F.col("q.s"), F.col("q.e")), "left"
    )
    per = joined.groupBy("q.product_code", "q.episode_start", "q.months_in_episode").agg(
        F.count("r.target_mi").alias("found"), F.count_if("r.flagged").alias("flagged")
    )
    return check_rows(
        per.agg(
            F.count_if(F.expr("found <> flagged")).alias("every queued month satisfies the rule"),
            F.count_if(F.expr("found <> months_in_episode")).alias("every span has its claimed length"),
        )
    )


def locked_versions(locked: DataFrame, version: str = "version") -> DataFrame:
    """M8: a content hash of the locked rows per stored version; one locked result means one hash.

    Row hashes are folded into order-free sums, so no version is gathered into one task.
    """
    cols = sorted(c for c in locked.columns if c != version)
    row = F.xxhash64(*cols)
    return locked.groupBy(version).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(row.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor(row).alias("hash_xor"),
    )


def token_scan(corpus: DataFrame, tokens: Sequence[str], forbidden: str | None = None) -> DataFrame:
    """Ids of texts with listed tokens or a forbidden character, with counts; never the text."""
    if not tokens:
        raise ValueError("the token list is absent; the scan fails closed")
    pattern = text.token_pattern(tokens)
    hits = F.regexp_count("text", F.lit(pattern)).cast("long")
    bad = (F.length("text") - F.length(F.replace("text", F.lit(forbidden), F.lit("")))).cast("long") if forbidden else F.lit(0).cast("long")
    return (
        corpus.select("id", hits.alias("token_hits"), bad.alias("forbidden_characters"))
        .filter("token_hits > 0 or forbidden_characters > 0")
    )


def numbers_gate(figures: DataFrame, bands: DataFrame) -> DataFrame:
    """Each figure beside its pre-stated band; a figure outside is reported, not edited."""
    return figures.join(bands, "figure", "left").select(
        "figure", "value", "low", "high", F.col("value").between(F.col("low"), F.col("high")).alias("in_band")
    )


def manifest_gate(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """M1: every listed body is stored as listed, nothing else is stored, and no side tells a path twice."""
    found = manifests.reconcile(stored, manifest).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("stray", "missing", "moved"))
    )
    return check_rows(
        found.agg(
            _none(F.sum("stray")).alias("no stored body is unlisted"),
            _none(F.sum("missing")).alias("no listed body is missing"),
            _none(F.sum("moved")).alias("every body has its listed hash"),
            _none(F.sum(F.col("n") - 1)).alias("a path is told once"),
        )
    )


def window_gate(log: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M2: every wanted window is in the log, once, and complete; a missing window is never read as zero."""
    late = manifests.incomplete_windows(log).agg(F.count(F.lit(1)).alias("every window is complete"))
    logged = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    held = wanted.select(*keys).distinct().join(logged, list(keys), "left").agg(
        F.count_if(F.col("n").isNull()).alias("every window is logged"), F.count_if(F.col("n") > 1).alias("no window is logged twice")
    )
    return check_rows(late).unionByName(check_rows(held))


def cells_gate(published: DataFrame, derived: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """Every published cell equals the one derived on the second path; neither side holds a key alone or twice."""
    cells = compare.compare_cells(published, derived, keys, values, tolerance)
    found = cells.select(
        F.concat(F.col("column"), F.lit(" equals the second path")).alias("check"), (F.col("differing") + F.col("one_sided")).alias("failures")
    )
    twice = lambda side: side.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("more"))
    keyed = twice(published).unionByName(twice(derived)).agg(_none(F.sum("more")).alias("a cell is told once"))
    return found.select("check", (F.col("failures") == 0).alias("passed"), "failures").unionByName(check_rows(keyed))


def figures_gate(figures: DataFrame, bands: DataFrame) -> DataFrame:
    """M16 as a gate: every figure lies in its pre-stated band, and every band has its figure."""
    seen = figures.select("figure").distinct().withColumn("seen", F.lit(True))
    inside = numbers_gate(figures, bands).agg(F.count_if(~F.coalesce("in_band", F.lit(False))).alias("every figure lies in its band"))
    absent = bands.join(seen, "figure", "left").agg(F.count_if(F.col("seen").isNull()).alias("every band has its figure"))
    return check_rows(inside).unionByName(check_rows(absent))


def store_gate(recomputed: DataFrame, manifest: DataFrame) -> DataFrame:
    """The live store's kept readings against the manifest written when they landed, code by code."""
    parts = ("buckets", "sha256", "last_updated")
    a, b = recomputed.alias("a"), manifest.alias("b")
    both = a.join(b, F.col("a.product_code").eqNullSafe(F.col("b.product_code")), "full_outer")
    per_code = manifest.groupBy("product_code").agg((F.count(F.lit(1)) - 1).alias("more"))
    differing = both.agg(*(F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c} as landed") for c in parts))
    return check_rows(differing).unionByName(check_rows(per_code.agg(_none(F.sum("more")).alias("a code is listed once"))))


def record_gates(spark: SparkSession, sf_dir: str, p) -> DataFrame:
    """M3, M4, M5, M9 over the star tables; keys are checked where they lie, in the bucketed record tables."""
    reports, bridge = p.records
    daily = measures.day_counts_to_months(p.daily, p.harness.window_start, p.harness.as_of)
    monthly = measures.spine_variance(p.monthly_lazy(), daily)
    return (
        monthly_gate(monthly)
        .unionByName(report_gate(reports, p.harness))
        .unionByName(bridge_gate(bridge, reports))
    )
