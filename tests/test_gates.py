"""Prove-failable: every gate passes on a clean copy and fails on a corrupted one."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from countwatch.config import STAR, mi_of
from countwatch.operators import compare, gates, measures, recall
from countwatch.plans.star_plan import StarPlan


@pytest.fixture(scope="module")
def tables(spark, sf_small):
    p = StarPlan(spark, sf_small)
    report = p.reports.cache()
    bridge = p.devices.select("report_key", "product_code").distinct().cache()
    series = measures.day_counts_to_months(p.daily, STAR.window_start, STAR.as_of)
    monthly = measures.spine_variance(p.monthly, series).cache()
    audit = p.devices.filter("brand_token is not null").select(
        "report_key", "product_code", F.lit("device.brand_name").alias("field"), F.col("brand_token").alias("token")
    ).distinct().cache()
    receipt = measures.exclusion_receipt(audit, p.members).cache()
    harness = STAR.with_(as_of=report.filter("countable").agg(F.max("date_received")).first()[0])
    return dict(report=report, bridge=bridge, monthly=monthly, audit=audit, receipt=receipt, harness=harness)


def outcome(rows):
    return {r.check: r.passed for r in rows.collect()}


def test_clean_copies_pass(tables):
    for rows in (
        gates.report_gate(tables["report"], tables["harness"]),
        gates.bridge_gate(tables["bridge"], tables["report"]),
        gates.monthly_gate(tables["monthly"]),
        gates.receipt_gate(tables["receipt"], tables["audit"], ["red anvil"]),
    ):
        assert all(outcome(rows).values()), outcome(rows)


REPORT = [
    ("report keys are unique", lambda d: d.unionByName(d.limit(1))),
    ("countable receipt days have eight digits", lambda d: d.withColumn("date_received", F.when(F.col("countable"), F.concat("date_received", F.lit("x"))).otherwise(F.col("date_received")))),
    ("countable receipt days lie in the window", lambda d: d.withColumn("date_received", F.lit("19800101"))),
    ("total minus countable equals quarantined", lambda d: d.withColumn("countable", F.lit(False))),
    ("newest receipt day is the as-of day", lambda d: d.filter(F.col("date_received") < "20010101")),
]


@pytest.mark.parametrize("check,corrupt", REPORT)
def test_report_gate_fails(tables, check, corrupt):
    assert not outcome(gates.report_gate(corrupt(tables["report"]), tables["harness"]))[check]


BRIDGE = [
    ("bridge pairs are unique", lambda d: d.unionByName(d.limit(1))),
    ("no bridge row without a report", lambda d: d.withColumn("report_key", -F.col("report_key") - 1)),
]


@pytest.mark.parametrize("check,corrupt", BRIDGE)
def test_bridge_gate_fails(tables, check, corrupt):
    assert not outcome(gates.bridge_gate(corrupt(tables["bridge"]), tables["report"]))[check]


MONTHLY = [
    ("raw equals the independent series", lambda d: d.withColumn("series_reports", F.col("series_reports") + 1)),
    ("eligible is raw minus excluded", lambda d: d.withColumn("eligible_reports", F.col("raw_reports") + 1)),
    ("raw equals the independent series", lambda d: second_row(d, "raw_reports")),
]


def second_row(df, column):
    """Only the second row in (code, month) order is changed."""
    rn = F.row_number().over(Window.orderBy("product_code", "month"))
    return df.withColumn("rn", rn).withColumn(column, F.when(F.col("rn") == 2, F.col(column) + 1).otherwise(F.col(column))).drop("rn")


@pytest.mark.parametrize("check,corrupt", MONTHLY)
def test_monthly_gate_fails(tables, check, corrupt):
    assert not outcome(gates.monthly_gate(corrupt(tables["monthly"])))[check]


def test_receipt_gate_fails(tables):
    inflated = tables["receipt"].withColumn("reports_matched", F.col("reports_matched") + 1)
    assert not outcome(gates.receipt_gate(inflated, tables["audit"], ["red anvil"]))["receipt equals the audit"]
    strange = tables["audit"].withColumn("token", F.lit("unlisted"))
    assert not outcome(gates.receipt_gate(tables["receipt"], strange, ["red anvil"]))["every audit token is on the list"]
    with pytest.raises(ValueError):
        gates.receipt_gate(tables["receipt"], tables["audit"], [])


FORECAST_SCHEMA = "product_code string, origin_mi int, target_mi int, period string, calib array<double>, lower80 double"
CLEAN = [("A", mi_of("1999-12"), mi_of("2000-01"), "locked", [1.0] * 12, 1.0), ("A", mi_of("1998-01"), mi_of("1998-02"), "development", [], None)]
BAD = [
    ("every origin precedes its target", ("A", 24000, 24000, "recent", [], None)),
    ("locked origins are not before the minimum", ("A", mi_of("1999-10"), mi_of("2000-01"), "locked", [], None)),
    ("development targets lie in the span", ("A", mi_of("1990-01"), mi_of("1990-02"), "development", [], None)),
    ("no range under the minimum calibration", ("A", 24000, 24001, "recent", [1.0], 5.0)),
    ("forecasts only for gated codes", ("Z", 24000, 24001, "recent", [], None)),
]


@pytest.mark.parametrize("check,row", BAD)
def test_forecast_gate_fails(spark, check, row):
    gated = spark.createDataFrame([("A",)], "product_code string")
    clean = outcome(gates.forecast_gate(spark.createDataFrame(CLEAN, FORECAST_SCHEMA), gated, STAR))
    assert all(clean.values())
    bad = outcome(gates.forecast_gate(spark.createDataFrame(CLEAN + [row], FORECAST_SCHEMA), gated, STAR))
    assert {c for c, ok in bad.items() if not ok} == {check}


def test_queue_gate(spark):
    rows = [("A", mi_of("2000-01") + i, f) for i, f in enumerate([True, True, False])]
    ev = spark.createDataFrame(rows, "product_code string, target_mi int, flagged boolean")
    queue = lambda end, n: spark.createDataFrame([("A", "2000-01", end, n)], "product_code string, episode_start string, episode_end string, months_in_episode bigint")
    assert all(outcome(gates.queue_gate(queue("2000-02", 2), ev)).values())
    assert not outcome(gates.queue_gate(queue("2000-03", 3), ev))["every queued month satisfies the rule"]
    assert not outcome(gates.queue_gate(queue("2000-02", 3), ev))["every span has its claimed length"]


def test_locked_versions(spark):
    base = spark.range(5).select("id", (F.col("id") * 2.5).alias("point"))
    two = base.withColumn("version", F.lit("a")).unionByName(base.orderBy(F.desc("id")).withColumn("version", F.lit("b")))
    hashes = lambda df: gates.locked_versions(df).select("hash_sum", "hash_xor").distinct().count()
    assert hashes(two) == 1
    assert hashes(two.withColumn("point", F.when((F.col("version") == "b") & (F.col("id") == 3), 0.0).otherwise(F.col("point")))) == 2


def test_token_scan(spark):
    corpus = spark.createDataFrame([(1, "a License and licensed"), (2, "clean"), (3, "dash — here")], "id bigint, text string")
    got = {r.id: (r.token_hits, r.forbidden_characters) for r in gates.token_scan(corpus, ("license",), "—").collect()}
    assert got == {1: (2, 0), 3: (0, 1)}
    with pytest.raises(ValueError):
        gates.token_scan(corpus, ())


def test_compare_cells(spark):
    a = spark.createDataFrame([("x", 1.0, 2.0), ("y", 1.0, None)], "k string, u double, v double")
    clean = {r.column: (r.differing, r.one_sided) for r in compare.compare_cells(a, a, ["k"], ["u", "v"]).collect()}
    assert clean == {"u": (0, 0), "v": (0, 0)}
    b = spark.createDataFrame([("x", 1.00005, 2.1), ("z", 1.0, 0.0)], "k string, u double, v double")
    got = {r.column: (r.differing, r.one_sided) for r in compare.compare_cells(a, b, ["k"], ["u", "v"]).collect()}
    assert got == {"u": (0, 2), "v": (1, 2)}
    assert compare.same_rows(a, a) and not compare.same_rows(a, b)
    assert [r.k for r in compare.orphans(b, a, ["k"]).collect()] == ["z"]


def test_known_events(spark):
    timeline = spark.createDataFrame(
        [("1", ["A"], "2020-01-02", ["Class I"])], "event_number string, codes array<string>, initiated string, classes array<string>"
    )
    expected = [("1", "A", "2020-01-02", "Class I"), ("1", "B", "2020-01-02", "Class I"), ("1", "A", "2020-01-03", "Class I"), ("2", "A", "2020-01-02", "Class I")]
    df = spark.createDataFrame(expected, "event_number string, product_code string, initiated string, classification string")
    got = [(r.found, r.recovered) for r in recall.known_events(df, timeline).orderBy("event_number", "product_code", F.desc("recovered")).collect()]
    assert sorted(got) == [(False, False), (True, False), (True, False), (True, True)]
