"""Adapter from the star-schema tables to reports, devices, recalls and readings.

Every heavy table is scanned for only the columns it contributes. Token matching runs once per
part and per supplier row, before the join to lines, so no regular expression runs per line.
Joins carry no broadcast hint: the planner and adaptive execution broadcast a dimension only
while its measured size is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merge
with skew splitting.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.config import Harness
from countwatch.functions import months, text
from countwatch.functions.text import TokenLists
from countwatch.session import stage
from countwatch.sources.record_tables import record_tables

# Stand-in token lists for the private exclusion list.
STAR_TOKENS = TokenLists(
    firm=("supplier#000000001", "supplier#000000002"),
    not_firm=("supplier#000000002",),
    brand=("red anvil",),
)


#: What serves as the product code: six part types; ``BRANDS`` gives 25 sparser series.
CODE = "p_type"
BRANDS = "upper(p_brand)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def iso_day(ts):
    """``YYYY-MM-DD`` by casts, several times cheaper per row than a date formatter."""
    return F.col(ts).cast("date").cast("string")


def day_string(ts):
    return F.replace(iso_day(ts), F.lit("-"), F.lit(""))


def in_window(ts: str, harness: Harness):
    """Countable receipt days as a timestamp range, which reaches the Parquet scan as a pushed filter."""
    first = datetime.strptime(harness.window_start, "%Y%m%d")
    after = datetime.strptime(harness.as_of, "%Y%m%d") + timedelta(days=1)
    return (F.col(ts) >= F.lit(first).cast("timestamp_ntz")) & (F.col(ts) < F.lit(after).cast("timestamp_ntz"))


#: Codes told apart by the bits of one long, and how many longs a code list may take.
WORD, WORDS = 63, 4


def short_list(codes: DataFrame) -> tuple[str, ...] | None:
    """The codes of a list that ``WORDS`` longs can hold, sorted; None for a longer one."""
    held = [r[0] for r in codes.where("product_code is not null").limit(WORD * WORDS + 1).collect()]
    return tuple(sorted(held)) if len(held) <= WORD * WORDS else None


def _words(listed: tuple[str, ...]) -> list[tuple[str, tuple[str, ...]]]:
    """Name and codes of each long."""
    return [(f"codes_{at // WORD}", listed[at : at + WORD]) for at in range(0, len(listed), WORD)]


def devices(spark: SparkSession, sf_dir: str, lists: TokenLists = STAR_TOKENS, code: str = CODE, listed: tuple[str, ...] | None = None) -> DataFrame:
    """One row per order line: key, product code, event day and the tokens its device fields hit.

    With ``listed`` codes a row has its code as a bit too, set per part, so that codes are gathered by ``bit_or``.
    """
    bits = lambda held: reduce(lambda w, c: w.when(F.col("product_code") == c[1], F.lit(1 << c[0]).cast("long")), enumerate(held), F.when(F.lit(False), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(code).alias("product_code"), text.brand_token("p_name", lists).alias("brand_token")
    )
    words = _words(listed or ())
    part = part.select("*", *[bits(held).alias(name) for name, held in words])
    firm = firm_hits(spark, sf_dir, lists)
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(firm, line.l_suppkey == firm.s_suppkey, "left")
        .select(
            F.col("l_orderkey").alias("report_key"),
            "product_code",
            F.col("l_shipdate").alias("event_ts"),
            "brand_token",
            "firm_token",
            *[name for name, _ in words],
        )
    )


def firm_hits(spark: SparkSession, sf_dir: str, lists: TokenLists) -> DataFrame:
    """The suppliers whose name hits the list, staged.

    Only these can exclude a report, and the list is short. Staged, their size on disk is known when
    the join to lines is planned, so the lines are not shuffled by supplier unless the hits really
    outgrow the broadcast threshold; a filter inside the plan would be sized as the whole table.
    """
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", text.firm_token("s_name", lists).alias("firm_token"))
    return stage(supplier.filter("firm_token is not null"), "firm-hits")


def report_rollup(device_rows: DataFrame, listed: tuple[str, ...] | None = None) -> DataFrame:
    """Per report: its distinct codes, earliest event day, line count and exclusion flag.

    One aggregation with map-side combine, so a report holding a large share of all lines is
    reduced before the shuffle; the code set is bounded by the code list. Rows that carry the bits of
    ``listed`` codes are aggregated as numbers, without an object or a sort per report.
    """
    words = _words(listed) if listed is not None else None
    sets = [F.sort_array(F.collect_set("product_code")).alias("codes")] if words is None else [F.bit_or(name).alias(name) for name, _ in words]
    rolled = device_rows.groupBy("report_key").agg(
        *sets,
        F.min("event_ts").alias("event_ts"),
        F.count(F.lit(1)).alias("n_lines"),
        F.bool_or(F.col("brand_token").isNotNull() | F.col("firm_token").isNotNull()).alias("hit"),
    )
    if words is None:
        return rolled
    named = [F.when(F.getbit(name, F.lit(i)) == 1, F.lit(c)) for name, held in words for i, c in enumerate(held)]
    none = F.array().cast("array<string>")
    # Joined and split again, which is compiled where a filter of the array would be interpreted per report and code.
    mark = next(m for m in map(chr, range(0xE000, 0xF8FF)) if not any(m in c for c in listed))
    some = reduce(Column.__or__, [F.col(name) != 0 for name, _ in words], F.lit(False))
    codes = F.when(some, F.split(F.concat_ws(mark, *named), mark)).otherwise(none) if named else none
    return rolled.select("report_key", codes.alias("codes"), "event_ts", "n_lines", "hit")


def reports(
    spark: SparkSession, sf_dir: str, harness: Harness, lists: TokenLists = STAR_TOKENS, device_rows=None, rolled=None
) -> DataFrame:
    """The report table: one row per order with derived months, exclusion and countable flags."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("report_key"), "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    if rolled is None:
        rolled = report_rollup(devices(spark, sf_dir, lists) if device_rows is None else device_rows)
    return orders.join(rolled, "report_key", "left").select(
        "report_key",
        day_string("o_orderdate").alias("date_received"),
        day_string("event_ts").alias("date_of_event"),
        F.col("o_orderstatus").alias("event_type"),
        F.col("o_orderpriority").alias("remedial_action"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Y").alias("summary_report_flag"),
        F.col("n_lines").cast("string").alias("noe_summarized"),
        F.col("codes"),
        F.coalesce("hit", F.lit(False)).alias("excluded"),
        months.timestamp_to_mi("o_orderdate").alias("receipt_mi"),
        months.timestamp_to_mi("event_ts").alias("event_mi"),
        in_window("o_orderdate", harness).alias("countable"),
    )


#: What a member row carries of its report.
MEMBER_FIELDS = (
    "date_received", "date_of_event", "event_type", "remedial_action", "summary_report_flag", "noe_summarized",
    "excluded", "receipt_mi", "event_mi",
)


def bridge(report: DataFrame) -> DataFrame:
    """Report x code pairs. Codes are already distinct per report, so the pair is unique."""
    return report.select("report_key", F.explode("codes").alias("product_code"))


def stored_records(spark: SparkSession, sf_dir: str, harness: Harness, code: str = CODE, lists: TokenLists = STAR_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The report table and its bridge, bucketed by the report key and written once per folder."""
    sources = [table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "supplier")]

    def made() -> DataFrame:
        listed = short_list(code_list(spark, sf_dir, code))
        rolled = report_rollup(devices(spark, sf_dir, lists, code, listed), listed)
        return reports(spark, sf_dir, harness, lists, rolled=rolled)

    return record_tables(spark, f"{code} {lists} {harness.window_start} {harness.as_of}", sources, made, bridge)


def memberships(report: DataFrame, pairs: DataFrame) -> DataFrame:
    """Countable report x code, joined by the key that both tables are bucketed by."""
    return report.filter("countable").select("report_key", *MEMBER_FIELDS).join(pairs, "report_key")


def code_list(spark: SparkSession, sf_dir: str, code: str = CODE) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(code).alias("product_code")).distinct()


def daily_series(spark: SparkSession, sf_dir: str, code: str = CODE) -> DataFrame:
    """The independent (code, day, count) series, counted from lines without the report table's rules."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(code).alias("p_code"))
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    # Codes per order, a set bounded by the code list: one shuffle by order serves the set and the join.
    pair = line.join(part, line.l_partkey == part.p_partkey).groupBy("l_orderkey").agg(F.collect_set("p_code").alias("codes"))
    return (
        pair.join(order, pair.l_orderkey == order.o_orderkey)
        .withColumn("product_code", F.explode("codes"))
        .groupBy("product_code", day_string("o_orderdate").alias("day"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def page_records(spark: SparkSession, sf_dir: str, reduce=None) -> DataFrame:
    """Nested source records: every line is one paged copy of its order's report with a device array.

    ``position`` orders the copies of a key as (code, page position, remaining fields), so the first
    seen copy is the same on every run. A part of size 50 leaves its own device code blank.
    """
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    # The copies stay narrow: names and the order's fields are joined to what is left of them by the caller's
    # ``first`` (the first copy of each key), so no wide copy is sorted or shuffled.
    copies = line.join(part.select("p_partkey", "p_type"), line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("mdr_report_key"), F.col("p_type").alias("queried_code"),
        F.struct("p_type", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag").alias("position"),
    )
    if reduce is not None:
        copies = reduce(copies)
    carried = [c for c in copies.columns if c != "position"]
    joined = (
        copies.select(*carried, "position.*")
        .join(part.drop("p_type"), F.col("l_partkey") == part.p_partkey)
        .join(supplier, F.col("l_suppkey") == supplier.s_suppkey)
        .join(order, F.col("mdr_report_key") == order.o_orderkey)
    )
    device = F.struct(
        F.when(F.col("p_size") < 50, F.col("p_type")).otherwise("").alias("device_report_product_code"),
        F.col("s_name").alias("manufacturer_d_name"),
        F.col("p_name").alias("brand_name"),
    )
    return joined.select(
        *carried,
        F.struct("p_type", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag").alias("position"),
        F.concat_ws("-", "mdr_report_key", "l_linenumber").alias("report_number"),
        day_string("o_orderdate").alias("date_received"),
        day_string("l_shipdate").alias("date_of_event"),
        F.col("o_orderstatus").alias("event_type"),
        F.array(F.col("o_orderpriority"), F.lit(""), F.col("l_returnflag")).alias("remedial_action"),
        F.array(device).alias("device"),
    )


def recall_records(spark: SparkSession, sf_dir: str, code: str = CODE) -> DataFrame:
    """Recall product records: returned lines, keyed by order as the event number.

    The event's date is the order's and joined to rolled-up events (``recall_dates``), never to lines: an
    order with a large share of all lines is reduced to one row first.
    """
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        "l_orderkey", "l_partkey", "l_shipdate", "l_linestatus", "l_tax", "l_discount"
    )
    part = table(spark, sf_dir, "part").select(
        "p_partkey", text.normal_code(F.expr(code)).alias("product_code"), F.col("p_name").rlike(r"(?i)\b(?:rings?|bolts?)\b").alias("cites_reports")
    )
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .select(
            F.col("l_orderkey").alias("event_number"),
            "product_code",
            F.lit(None).cast("string").alias("initiated"),
            iso_day("l_shipdate").alias("posted"),
            F.col("l_linestatus").alias("root_cause"),
            "cites_reports",
            (F.col("l_tax") > 0.04).alias("has_k_numbers"),
            (F.col("l_discount") > 0.05).alias("has_pma_numbers"),
        )
    )


def recall_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initiation day per event, known to the order alone."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_number"), iso_day("o_orderdate").alias("initiated"))


def enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enforcement records: orders not in process, their class from the priority."""
    grade = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Class I")
        .when(F.col("o_orderpriority") == "2-HIGH", "Class II")
        .otherwise("Class III")
    )
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("event_id"),
        grade.alias("classification"),
        F.date_add("o_orderdate", 14).cast("string").alias("report_date"),
        F.date_add("o_orderdate", 30).cast("string").alias("classification_date"),
    )


# Readings of the source, as (vintage, last_updated). The first is the frozen one.
STAR_VINTAGES = (("v0", "2001-05-02"), ("v1", "2001-06-02"), ("v2", "2001-07-02"), ("v3", "2001-08-02"))
LATE_DAYS = 30
REVISED_MONTH = "1999-03"
REVISED_FROM = "v2"


def visible(vintage: str, last_updated: str):
    """Which orders a vintage shows: low-priority ones load late, and one month is later revised down."""
    day = F.to_date("o_orderdate")
    late = (F.col("o_orderpriority") == "5-LOW") & (day >= F.date_sub(F.to_date(F.lit(last_updated)), LATE_DAYS))
    shown = (day < F.to_date(F.lit(last_updated))) & ~late
    if vintage >= REVISED_FROM:
        withdrawn = (
            (F.col("o_orderstatus") == "P")
            & (F.col("o_orderpriority") == "3-MEDIUM")
            & (F.date_format("o_orderdate", "yyyy-MM") == REVISED_MONTH)
        )
        shown = shown & ~withdrawn
    return shown


def vintage_counts(spark: SparkSession, sf_dir: str, vintages=STAR_VINTAGES, lists: TokenLists = STAR_TOKENS) -> DataFrame:
    """Code x month counts of every vintage from one pass: raw per vintage, eligible for the frozen one."""
    order = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("report_key"), "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    shown = order.select(
        "report_key", months.timestamp_to_mi("o_orderdate").alias("mi"),
        *[visible(v, lu).alias(v) for v, lu in vintages],
    )
    rolled = report_rollup(devices(spark, sf_dir, lists)).select("report_key", "codes", "hit")
    frozen = vintages[0][0]
    return (
        shown.join(rolled, "report_key")
        .withColumn("product_code", F.explode("codes"))
        .groupBy("product_code", "mi")
        .agg(
            *[F.count_if(v).alias(v) for v, _ in vintages],
            F.count_if(F.col(frozen) & ~F.col("hit")).alias("eligible"),
        )
    )
