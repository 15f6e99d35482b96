"""Record-level operators over nested source records (B4, B5, B12, E6, E7) and their bridge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countwatch.config import Harness
from countwatch.functions import months, text
from countwatch.functions.text import TokenLists

# Report-level fields that can name a firm.
FIRM_FIELDS = ("manufacturer_name", "manufacturer_g1_name", "distributor_name")


def _hit(field: str, token: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), token.alias("token"))


def exclusion_hits(lists: TokenLists, firm_fields: Sequence[str] = FIRM_FIELDS) -> Column:
    """Distinct (field, token) hits of one record, over flat fields and the device array."""
    flat = F.array(*[_hit(f, text.firm_token(f, lists)) for f in firm_fields]) if firm_fields else None
    maker = F.transform("device", lambda d: _hit("device.manufacturer_d_name", text.firm_token(d["manufacturer_d_name"], lists)))
    brand = F.transform("device", lambda d: _hit("device.brand_name", text.brand_token(d["brand_name"], lists)))
    nothing = F.array().cast("array<struct<field:string,token:string>>")
    nested = [F.coalesce(maker, nothing), F.coalesce(brand, nothing)]
    every = F.concat(*([flat] if flat is not None else []), *nested)
    return F.sort_array(F.array_distinct(F.filter(every, lambda h: h["token"].isNotNull())))


def own_codes(device: str = "device") -> Column:
    """Sorted distinct upper-case codes among a record's devices."""
    return text.sorted_distinct(
        F.transform(device, lambda d: F.upper(F.trim(d["device_report_product_code"])))
    )


def shape_records(records: DataFrame, lists: TokenLists, firm_fields: Sequence[str] = FIRM_FIELDS) -> DataFrame:
    """Per source record: report attributes as published plus its exclusion hits; no explode.

    ``records`` carries ``queried_code`` besides the source fields; fields it lacks read as blank.
    """
    given = set(records.columns)

    def attr(name: str) -> Column:
        return (F.coalesce(F.col(name), F.lit("")) if name in given else F.lit("")).alias(name)

    def listed(name: str) -> Column:
        return (text.joined(name) if name in given else F.lit("")).alias(name)

    carried = [c for c in ("queried_code", "position", "copies") if c in given]
    return records.filter(text.present(records, "mdr_report_key")).select(
        "mdr_report_key",
        *carried,
        *[
            attr(n)
            for n in (
                "report_number", "date_received", "date_of_event", "date_report", "event_type",
                "report_source_code", "summary_report_flag", "noe_summarized", "number_devices_in_event",
            )
        ],
        listed("type_of_report"),
        listed("remedial_action"),
        F.coalesce(F.size("device"), F.lit(0)).alias("n_devices"),
        F.array_join(text.mark_absent_code(own_codes(), "queried_code"), "|").alias("device_codes"),
        exclusion_hits(lists, firm_fields).alias("hits"),
    )


def first_copies(copies: DataFrame) -> DataFrame:
    """E6 on narrow rows: per key the first copy's code and position, and the number of copies.

    For sources whose wide fields hang on the position: reduce keys and positions, then join the fields.
    """
    first = copies.filter(text.present(copies, "mdr_report_key")).groupBy("mdr_report_key").agg(
        F.min(F.struct("position", "queried_code")).alias("first"), F.count(F.lit(1)).alias("copies")
    )
    return first.select("mdr_report_key", F.col("first.queried_code").alias("queried_code"), F.col("first.position").alias("position"), "copies")


def first_seen(records: DataFrame) -> DataFrame:
    """Per report key the record with the smallest ``position`` (cohort order, file, place).

    ``min_by`` combines on the map side, so many copies of one key cost one row per task. Reduce
    first and shape afterwards: patterns then run on one copy per report.
    """
    kept = [c for c in records.columns if c not in ("mdr_report_key", "position")]
    first = records.filter(text.present(records, "mdr_report_key")).groupBy("mdr_report_key").agg(
        F.min_by(F.struct(*kept), "position").alias("r"), F.count(F.lit(1)).alias("copies")
    )
    return first.select("mdr_report_key", "copies", "r.*")


def bridge(records: DataFrame) -> DataFrame:
    """Distinct (report, code) pairs over every copy."""
    return records.select("mdr_report_key", F.col("queried_code").alias("product_code")).distinct()


def duplicates_within_code(records: DataFrame) -> DataFrame:
    """How many records repeat a key already seen under the same code."""
    per_pair = records.groupBy(F.col("queried_code").alias("product_code"), "mdr_report_key").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_pair.groupBy("product_code").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def audit(first: DataFrame) -> DataFrame:
    """Distinct (key, code, field, token) of excluded reports. Restricted output."""
    return first.select(
        "mdr_report_key", F.col("queried_code").alias("product_code"), F.explode("hits").alias("h")
    ).select("mdr_report_key", "product_code", "h.field", "h.token")


def finish_reports(first: DataFrame, harness: Harness) -> DataFrame:
    """Months, lag, exclusion and countable flags of the first-seen records."""
    receipt, event = months.day_to_mi("date_received"), months.day_to_mi("date_of_event")
    return (
        first.withColumn("receipt_mi", receipt)
        .withColumn("event_mi", event)
        .withColumn("lag_months", months.lag("event_mi", "receipt_mi"))
        .withColumn("excluded", F.size("hits") > 0)
        .withColumn("quarantine_reason", quarantine_reason("date_received", harness))
        .withColumn("countable", F.col("quarantine_reason").isNull())
        .withColumnRenamed("queried_code", "first_code")
        .drop("hits")
    )


def quarantine_reason(day, harness: Harness) -> Column:
    """Why a report is not countable, null when it is. Days compare as strings."""
    d = F.col(day) if isinstance(day, str) else day
    return (
        F.when(~months.valid_day(d), "missing_or_malformed_date_received")
        .when(d > harness.as_of, "received_after_as_of")
        .when(d < harness.window_start, "received_before_window")
    )


def quarantine(reports: DataFrame, harness: Harness, duplicates: DataFrame | None = None) -> DataFrame:
    """Reports by reason, with duplicate keys per code added as their own reasons."""
    by_reason = (
        reports.select(quarantine_reason("date_received", harness).alias("reason"))
        .filter(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("reports"))
    )
    if duplicates is None:
        return by_reason
    extra = duplicates.filter("duplicates > 0").select(
        F.concat(F.lit("duplicate_key_within_"), "product_code", F.lit("_pages")).alias("reason"),
        F.col("duplicates").alias("reports"),
    )
    return by_reason.unionByName(extra)
