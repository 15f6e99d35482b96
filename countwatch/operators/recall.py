"""Dated external events beside the series (M-06): roll-up, timeline, the one pre-registered count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countwatch.config import Harness, mi_of
from countwatch.functions import months, text


def _set(col):
    """Sorted distinct non-empty values of a group; collect_set already drops nulls."""
    return F.sort_array(F.array_remove(F.collect_set(col), ""))


def event_rollup(records: DataFrame) -> DataFrame:
    """One row per event over its product records.

    ``records``: event_number, product_code, initiated, posted, root_cause, cites_reports,
    has_k_numbers, has_pma_numbers. Sets are bounded by the code and cause lists; dates are minima.
    """
    return (
        records.filter(text.present(records, "event_number"))
        .groupBy("event_number")
        .agg(
            _set("product_code").alias("codes"),
            F.min(F.nullif("initiated", F.lit(""))).alias("initiated"),
            F.min(F.nullif("posted", F.lit(""))).alias("posted"),
            _set(F.trim("root_cause")).alias("causes"),
            F.bool_or("cites_reports").alias("reason_cites_reports"),
            F.count(F.lit(1)).alias("product_records"),
            F.count_if("has_k_numbers").alias("records_with_k_numbers"),
            F.count_if("has_pma_numbers").alias("records_with_pma_numbers"),
        )
    )


def enforcement_rollup(enforcement: DataFrame) -> DataFrame:
    """Enforcement rows reduced to one per event before they are joined."""
    return (
        enforcement.filter(text.present(enforcement, "event_id"))
        .groupBy(F.col("event_id").alias("event_number"))
        .agg(
            _set(F.trim("classification")).alias("classes"),
            F.min(F.nullif("report_date", F.lit(""))).alias("enforcement_report_date"),
            F.min(F.nullif("classification_date", F.lit(""))).alias("enforcement_classification_date"),
            F.lit(True).alias("in_enforcement"),
        )
    )


def timeline(
    records: DataFrame, enforcement: DataFrame, codes: DataFrame | None, start: str, end: str, dates: DataFrame | None = None
) -> DataFrame:
    """K1: events in cohort (C8) initiated inside the window, with enforcement beside them.

    ``dates`` (event_number, initiated) gives the initiation where the records do not carry it; it meets the
    events after they are rolled up, so a hot event is one row by then.
    """
    scoped = records.join(codes, "product_code", "left_semi") if codes is not None else records
    events = event_rollup(scoped)
    if dates is not None:
        events = events.drop("initiated").join(dates, "event_number")
    events = events.filter(F.col("initiated").between(start, end))
    return (
        events.join(enforcement_rollup(enforcement), "event_number", "left")
        .withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))
        .withColumn("in_enforcement", F.coalesce("in_enforcement", F.lit(False)))
    )


def published(rows: DataFrame) -> DataFrame:
    """The timeline with sets joined to text."""
    return rows.select(
        F.col("event_number").cast("string").alias("event_number"),
        F.array_join("codes", "|").alias("product_codes"),
        F.col("initiated").alias("event_date_initiated"),
        F.col("posted").alias("event_date_posted"),
        F.array_join("classes", "|").alias("classification"),
        "enforcement_report_date",
        "enforcement_classification_date",
        F.array_join("causes", "|").alias("root_cause"),
        "reason_cites_reports", "product_records", "records_with_k_numbers", "records_with_pma_numbers",
        "in_enforcement",
    )


def meta(records: DataFrame, rows: DataFrame) -> DataFrame:
    """In-scope product records and their numbers, then the events of the timeline."""
    scoped = records.agg(
        F.count(F.lit(1)).alias("in_scope_product_records"),
        F.count_if("has_k_numbers").alias("records_with_k_numbers"),
        F.count_if("has_pma_numbers").alias("records_with_pma_numbers"),
        F.lit(1).alias("one"),
    )
    events = rows.agg(
        F.count(F.lit(1)).alias("events_in_window"),
        F.count_if(F.array_contains("classes", "Class I")).alias("class_i_events"),
        F.count_if(~F.col("in_enforcement")).alias("events_not_in_enforcement"),
        F.lit(1).alias("one"),
    )
    return scoped.join(events, "one").drop("one")


def class_one(rows: DataFrame, workload_codes: DataFrame, span: tuple[str, str]) -> DataFrame:
    """(code, initiation month, event) of Class I events in the evaluated span.

    The class test is membership in the class set, so "Class II" never counts.
    """
    init_mi = months.month_to_mi(F.substring("initiated", 1, 7))
    return (
        rows.filter(F.array_contains("classes", "Class I"))
        .select(F.explode("codes").alias("product_code"), init_mi.alias("init_mi"), "event_number")
        .filter(F.col("init_mi").between(mi_of(span[0]), mi_of(span[1])))
        .join(workload_codes.select("product_code"), "product_code", "left_semi")
    )


def initiations_by_month(initiations: DataFrame) -> DataFrame:
    """Class I initiations counted by (code, month): at most codes x months rows."""
    return initiations.groupBy("product_code", "init_mi").agg(F.count(F.lit(1)).alias("n"))


def pre_registered_count(per_month: DataFrame, queue: DataFrame, span: tuple[str, str], harness: Harness) -> DataFrame:
    """K3/K4/C11: episodes starting in the 18 months before a Class I initiation, and the converse.

    ``per_month`` holds initiations already counted by (code, month), so the interval join meets small
    sides however many events there are. Each event has one initiation month, hence the distinct
    (code, event) count is the sum of those counts.
    """
    first, last = mi_of(span[0]), mi_of(span[1])
    back = harness.lookback
    starts = queue.select("product_code", months.month_to_mi("episode_start").alias("start_mi"))
    window = F.col("start_mi").between(F.col("init_mi") - back, F.col("init_mi") - 1)
    i, s = per_month.alias("i"), starts.alias("s")
    same = F.col("i.product_code") == F.col("s.product_code")
    preceded = i.join(s, same & window, "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("preceded"))
    in_window = s.join(i, same & window, "left_semi").distinct().agg(F.count(F.lit(1)).alias("episodes_in_window"))
    always = (F.col("init_mi") - 1 >= first) & (F.col("init_mi") - back <= last)
    totals = per_month.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("class_i_initiations"),
        F.coalesce(F.sum(F.when(always, F.col("n"))), F.lit(0)).alias("always_flag_preceded"),
    )
    episodes = starts.agg(F.count(F.lit(1)).alias("episodes_total"))
    # Four single-row aggregates side by side.
    one = lambda df: df.withColumn("one", F.lit(1))
    joined = one(totals)
    for part in (episodes, in_window, preceded):
        joined = joined.join(one(part), "one")
    return joined.drop("one")


def looked_back(per_month: DataFrame, queue: DataFrame, span: tuple[str, str], harness: Harness) -> DataFrame:
    """K3: every (code, initiation month) with its initiations, the episodes that start in the months before, and the always-flag rule."""
    first, last, back = mi_of(span[0]), mi_of(span[1]), harness.lookback
    starts = queue.select(F.col("product_code").alias("of_code"), months.month_to_mi("episode_start").alias("start_mi"))
    before = (F.col("product_code") == F.col("of_code")) & F.col("start_mi").between(F.col("init_mi") - back, F.col("init_mi") - 1)
    return (
        per_month.join(starts, before, "left")
        .groupBy("product_code", "init_mi")
        .agg(F.max("n").alias("n"), F.count("start_mi").alias("episodes_before"))
        .withColumn("preceded", F.col("episodes_before") > 0)
        .withColumn("always_flag_preceded", (F.col("init_mi") - 1 >= first) & (F.col("init_mi") - back <= last))
    )


def initiation_list(initiations: DataFrame, seen: DataFrame) -> DataFrame:
    """K3: the Class I initiations one by one, each with what precedes its month; ``seen`` is codes x months at most."""
    return initiations.join(seen.drop("n"), ["product_code", "init_mi"]).select(
        "product_code", months.label("init_mi").alias("month"), F.col("event_number").cast("string").alias("event_number"), "episodes_before", "preceded", "always_flag_preceded"
    )


def code_workload(seen: DataFrame, queue: DataFrame, work: DataFrame, harness: Harness) -> DataFrame:
    """Per code the initiations and their rate beside the rule's episodes and theirs."""
    starts = queue.select("product_code", months.month_to_mi("episode_start").alias("start_mi"))
    after = seen.select(F.col("product_code").alias("of_code"), "init_mi")
    near = (F.col("product_code") == F.col("of_code")) & F.col("start_mi").between(F.col("init_mi") - harness.lookback, F.col("init_mi") - 1)
    hit = starts.join(after, near, "left_semi").groupBy("product_code").agg(F.count(F.lit(1)).alias("hit"))
    per_code = seen.groupBy("product_code").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("months_hit"), F.sum(F.when(F.col("preceded"), F.col("n"))).alias("pre"),
        F.sum(F.when(F.col("always_flag_preceded"), F.col("n"))).alias("alw"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return work.join(per_code, "product_code", "left").join(hit, "product_code", "left").select(
        "product_code", "rule_enabled", "evaluated_months", zero("n").alias("class_i_initiations"),
        F.bround(zero("n") / F.col("evaluated_months"), 4).alias("initiations_per_month"), zero("months_hit").alias("initiation_months"),
        zero("pre").alias("preceded"), zero("alw").alias("always_flag_preceded"), "episodes", zero("hit").alias("episodes_in_window"),
        "episodes_per_evaluated_month",
    )


def known_events(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """K5/C20: every known event is found with its code, initiation date and class."""
    k, t = expected.alias("k"), rows.alias("t")
    found = F.col("t.event_number").isNotNull()
    ok = (
        found
        & F.array_contains(F.col("t.codes"), F.col("k.product_code"))
        & (F.col("t.initiated") == F.col("k.initiated"))
        & F.array_contains(F.col("t.classes"), F.col("k.classification"))
    )
    return k.join(t, F.col("k.event_number") == F.col("t.event_number"), "left").select(
        F.col("k.event_number").cast("string").alias("event_number"),
        F.col("k.product_code").alias("product_code"),
        found.alias("found"),
        F.coalesce(ok, F.lit(False)).alias("recovered"),
    )
