"""Record measures: monthly counts, lag tables, mixes, receipts, gates (2.D).

``members`` is one row per countable (report, code) pair; the pair is unique, so a plain
conditional count equals a distinct count and needs no Expand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countwatch.config import Harness, mi_of
from countwatch.functions import months, text


def n_if(cond) -> Column:
    c = F.expr(cond) if isinstance(cond, str) else cond
    return F.count_if(c)


def monthly_counts(members: DataFrame) -> DataFrame:
    """D1 / M-01: raw, excluded and eligible reports by code and receipt month."""
    return members.groupBy("product_code", F.col("receipt_mi").alias("mi")).agg(
        F.count(F.lit(1)).alias("raw_reports"),
        n_if("excluded").alias("excluded_reports"),
        n_if("not excluded").alias("eligible_reports"),
    )


def month_spine(codes: DataFrame, start_mi: int, end_mi: int) -> DataFrame:
    """Every code with every month of a fixed span."""
    return codes.select(
        "product_code", F.explode(F.sequence(F.lit(start_mi), F.lit(end_mi))).alias("mi")
    )


def on_spine(codes: DataFrame, counts: DataFrame, harness: Harness) -> DataFrame:
    """Counts on the dense grid, absent cells read as zero. ``off_grid`` tells what lies outside it."""
    values = [c for c in counts.columns if c not in ("product_code", "mi")]
    dense = month_spine(codes, harness.start_mi, harness.end_mi).join(counts, ["product_code", "mi"], "left")
    return dense.select("product_code", "mi", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def off_grid(codes: DataFrame, counts: DataFrame, harness: Harness) -> DataFrame:
    """Counts of a code or month that the grid does not have, with the reason; none should be there."""
    listed = counts.join(codes.select("product_code", F.lit(True).alias("listed")).distinct(), "product_code", "left")
    outside = ~F.col("mi").between(harness.start_mi, harness.end_mi)
    reason = F.when(F.col("listed").isNull(), "code not listed").when(F.col("mi").isNull(), "no month").when(outside, "month outside the window")
    return listed.withColumn("reason", reason).where("reason is not null").drop("listed")


def day_counts_to_months(daily: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A2: a daily count series summed by month, optionally only days inside a window."""
    if start and end:
        daily = daily.filter(F.col("day").between(start, end))
    return daily.groupBy("product_code", months.day_to_mi("day").alias("mi")).agg(
        F.sum("count").alias("series_reports")
    )


def spine_variance(monthly: DataFrame, series: DataFrame) -> DataFrame:
    """The record count beside the independent series, and the difference."""
    both = monthly.join(series, ["product_code", "mi"], "left")
    against = F.coalesce("series_reports", F.lit(0))
    return both.select(
        "product_code",
        months.label("mi").alias("month"),
        "raw_reports",
        against.alias("series_reports"),
        (F.col("raw_reports") - against).alias("variance_raw_vs_series"),
        "excluded_reports",
        "eligible_reports",
    )


def lag_matched(members: DataFrame, harness: Harness | None = None, lags: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """D2 / M-02 on eligible members: totals and 0..k month arrivals by event month."""
    known = members.filter(F.col("event_mi").isNotNull() & F.col("receipt_mi").isNotNull())
    if harness is not None:
        known = known.filter(F.col("event_mi").between(mi_of(harness.history_start[:4] + "-01"), harness.end_mi))
    delta = months.lag("event_mi", "receipt_mi")
    return (
        known.withColumn("lag", delta)
        .groupBy("product_code", "event_mi")
        .agg(
            F.count(F.lit(1)).alias("reports_with_event_month"),
            *[n_if(F.col("lag").between(0, k)).alias(f"within_{k}") for k in lags],
            n_if("lag < 0").alias("negative_lag"),
        )
        .withColumn("event_month", months.label("event_mi"))
        .drop("event_mi")
    )


def lag_summary(members: DataFrame, harness: Harness) -> DataFrame:
    """D3 on eligible members."""
    before = mi_of(harness.history_start[:4] + "-01")
    return members.groupBy("product_code").agg(
        F.count(F.lit(1)).alias("eligible_reports"),
        n_if("event_mi is null").alias("missing_event_date"),
        n_if(F.col("event_mi") < before).alias("event_month_before_window"),
        n_if("receipt_mi < event_mi").alias("negative_lag"),
    )


def event_type_mix(members: DataFrame) -> DataFrame:
    """D4."""
    return (
        members.groupBy("product_code", "receipt_mi", text.blank_label("event_type").alias("event_type"))
        .agg(F.count(F.lit(1)).alias("eligible_reports"))
        .select("product_code", months.label("receipt_mi").alias("month"), "event_type", "eligible_reports")
    )


def remedial_counts(members: DataFrame, condition: Column) -> DataFrame:
    """Eligible members whose remedial action satisfies ``condition``."""
    return (
        members.filter(condition)
        .groupBy("product_code", "receipt_mi")
        .agg(F.count(F.lit(1)).alias("eligible_reports_with_recall_action"))
        .select("product_code", months.label("receipt_mi").alias("month"), "eligible_reports_with_recall_action")
    )


def exclusion_receipt(audit: DataFrame, members: DataFrame) -> DataFrame:
    """Per field, plus the ANY (removed) and ALL (countable) rows of each code."""
    per_field = (
        audit.select("product_code", "field", "report_key")
        .distinct()
        .groupBy("product_code", "field")
        .agg(F.count(F.lit(1)).alias("reports_matched"))
    )
    totals = (
        members.groupBy("product_code")
        .agg(n_if("excluded").alias("removed"), F.count(F.lit(1)).alias("countable"))
        .selectExpr(
            "product_code",
            "stack(2, 'ANY (reports removed)', removed, 'ALL (countable reports)', countable) as (field, reports_matched)",
        )
    )
    return per_field.unionByName(totals)


def gate_a(series: DataFrame, harness: Harness) -> DataFrame:
    """Months with reports in training, training and window totals, pass mark."""
    training = F.col("mi").between(harness.start_mi, mi_of(harness.train_end))
    inside = F.col("mi").between(harness.start_mi, harness.end_mi)
    n = F.col("series_reports")
    return (
        series.groupBy("product_code")
        .agg(
            n_if(training & (n > 0)).alias("complete_months_training"),
            F.sum(F.when(training, n).otherwise(0)).alias("raw_training_reports"),
            F.sum(F.when(inside, n).otherwise(0)).alias("raw_window_reports"),
        )
        .withColumn("stage_a_pass", F.col("complete_months_training") >= harness.min_complete_months)
    )


def gate_b(stage_a: DataFrame, monthly: DataFrame, harness: Harness) -> DataFrame:
    """Eligible training reports added, and the final decision."""
    training = F.col("mi").between(harness.start_mi, mi_of(harness.train_end))
    eligible = monthly.groupBy("product_code").agg(
        F.sum(F.when(training, F.col("eligible_reports")).otherwise(0)).alias("eligible_training_reports")
    )
    return (
        stage_a.join(eligible, "product_code", "left")
        .withColumn("eligible_training_reports", F.coalesce("eligible_training_reports", F.lit(0)))
        .withColumn("stage_b_pass", F.col("eligible_training_reports") >= harness.min_eligible_training)
        .withColumn("forecast", F.col("stage_a_pass") & F.col("stage_b_pass"))
    )


def code_dimension(codes: DataFrame, classification: DataFrame, excluded_codes: DataFrame, gate: DataFrame) -> DataFrame:
    """Every listed code with its classification (blank when absent) and flags.

    ``codes`` carries ``product_code``, ``in_cohort`` and ``reference_only``.
    """
    details = [c for c in classification.columns if c != "product_code"]
    marked = excluded_codes.select("product_code").distinct().withColumn("marker", F.lit(True))
    return (
        codes.join(classification, "product_code", "left")
        .join(marked, "product_code", "left")
        .join(gate.select("product_code", "forecast"), "product_code", "left")
        .select(
            "product_code",
            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in details],
            "in_cohort",
            "reference_only",
            F.coalesce("marker", F.lit(False)).alias("in_excluded_set"),
            F.coalesce("forecast", F.lit(False)).alias("forecast"),
        )
    )


def summary_composition(members: DataFrame) -> DataFrame:
    """How many reports are summaries, and how many events they stand for."""
    flagged = F.col("summary_report_flag") == "Y"
    events = F.when(flagged, text.safe_int("noe_summarized"))
    return members.groupBy("product_code").agg(
        F.count(F.lit(1)).alias("reports"),
        n_if(flagged).alias("summary_reports"),
        n_if(events > 1).alias("multi_event_reports"),
        F.coalesce(F.max(events).cast("long"), F.lit(0)).alias("max_events"),
        F.coalesce(F.sum(events), F.lit(0)).alias("events_summarised"),
    )


def distinct_totals(report: DataFrame) -> DataFrame:
    """Distinct reports, memberships, and reports carrying more than one code.

    Reports are unique rows with their code array, so no second pass over the bridge is needed.
    """
    n_codes = F.size("codes")
    return report.filter(F.col("countable") & (n_codes > 0)).agg(
        F.count(F.lit(1)).alias("distinct_raw"),
        n_if("not excluded").alias("distinct_eligible"),
        F.coalesce(F.sum(n_codes), F.lit(0)).cast("long").alias("memberships"),
        n_if(n_codes > 1).alias("multi_code_reports"),
    )


def remedial_by_month(remedial: DataFrame, codes: DataFrame, harness: Harness) -> DataFrame:
    """One row per code and month, gaps read as zero; a table with a column per code is the reader's."""
    counted = remedial.select("product_code", months.month_to_mi("month").alias("mi"), F.col("eligible_reports_with_recall_action").alias("reports"))
    return on_spine(codes, counted, harness).select("product_code", months.label("mi").alias("month"), "reports")


def excluded_code_union(hits: DataFrame) -> DataFrame:
    """Codes with the number of searches that returned them and the sorted search ids.

    ``hits`` has columns (code, query_id); duplicates combine on the map side.
    """
    unique = hits.select(text.normal_code("code").alias("product_code"), "query_id").filter("product_code <> ''").distinct()
    return unique.groupBy("product_code").agg(
        F.count(F.lit(1)).alias("queries_hit"),
        F.array_join(F.array_sort(F.collect_set("query_id")), " ").alias("query_ids"),
    )


def capacity_windows(daily: DataFrame, cap: int, start: str, end: str) -> DataFrame:
    """Per code and year, consecutive days grouped greedily so that a group stays within ``cap``.

    A year within the cap is one window spanning the year. One row per (code, year) holds at most
    366 day counts, which is the bound on the array the fold walks over.
    """
    rows = daily.filter(F.col("day").between(start, end))
    years = rows.groupBy("product_code", F.substring("day", 1, 4).alias("year")).agg(
        F.array_sort(F.collect_list(F.struct("day", "count"))).alias("days"), F.sum("count").alias("total")
    )
    first = F.greatest(F.lit(start), F.concat("year", F.lit("0101")))
    last = F.least(F.lit(end), F.concat("year", F.lit("1231")))
    kind = "array<struct<start:string,end:string,expected:bigint>>"
    # The open window is the last element; a day that would overflow a non-empty window opens the next one.
    step = f"""
        aggregate(days, named_struct('done', cast(array() as {kind}), 'start', y_start, 'last', y_start, 'sum', 0L),
          (a, d) -> if(a.sum + d.count > {cap} and a.sum > 0,
            named_struct('done', array_append(a.done, named_struct('start', a.start, 'end', a.last, 'expected', a.sum)),
                         'start', d.day, 'last', d.day, 'sum', d.count),
            named_struct('done', a.done, 'start', a.start, 'last', d.day, 'sum', a.sum + d.count)),
          a -> array_append(a.done, named_struct('start', a.start, 'end', y_end, 'expected', a.sum)))
    """
    whole = f"cast(array(named_struct('start', y_start, 'end', y_end, 'expected', total)) as {kind})"
    return (
        years.withColumn("y_start", first)
        .withColumn("y_end", last)
        .select("product_code", F.expr(f"explode(if(total <= {cap}, {whole}, {step}))").alias("w"))
        .select("product_code", F.col("w.start").alias("start_day"), F.col("w.end").alias("end_day"), F.col("w.expected").alias("expected"))
    )
