"""Hand-computed golden cases, typed in as literals (relative tolerance 1e-6)."""

import pytest
from pyspark.sql import functions as F

from countwatch.config import STAR, mi_of, month_of
from countwatch.functions import months
from countwatch.functions.intervals import weighted_interval_score
from countwatch.operators import ets, forecast, measures, review, scoring

SHAPE = [0, 1, 2, 3, 2, 1, 0, -1, -2, -3, -2, -1]


@pytest.fixture(scope="module")
def golden_series(spark):
    start = mi_of("2020-01")
    rows = [("GLD", start + t, 100 + 10 * SHAPE[t % 12] + t) for t in range(48)]
    return spark.createDataFrame(rows, "product_code string, mi int, y bigint")


BASELINES = [
    ("2021-12", 1, "baseline_a", 102), ("2021-12", 3, "baseline_a", 102),
    ("2021-12", 1, "baseline_b", 112), ("2021-12", 3, "baseline_b", 134),
    ("2023-06", 1, "baseline_a", 160), ("2023-06", 3, "baseline_a", 160),
    ("2023-06", 1, "baseline_b", 130), ("2023-06", 3, "baseline_b", 112),
    ("2020-05", 1, "baseline_a", 126.333333), ("2020-02", 1, "baseline_a", None),
    ("2020-03", 3, "baseline_b", None), ("2020-03", 1, "baseline_a", 111),
]


def test_baselines(golden_series):
    got = {
        (r.origin_mi, r.horizon, r.model): r.point for r in forecast.baselines(golden_series).collect()
    }
    for origin, h, model, want in BASELINES:
        value = got[(mi_of(origin), h, model)]
        assert value is None if want is None else value == pytest.approx(want, rel=1e-6), (origin, h, model)


def test_ets_recurrence(spark):
    season = [0.10, 0.05, 0.00, -0.05, -0.10, -0.05, 0.00, 0.05, 0.10, 0.15, 0.10, 0.05]
    state = spark.createDataFrame([(4.6, 0.05, 0.9, season)], "level double, trend double, phi double, season array<double>")
    want = {1: 4.745, 2: 4.7355, 3: 4.72195, 6: 4.76085155, 12: 4.97290670858, 13: 5.035616037725}
    row = state.select(*[ets.log_point(h).alias(f"h{h}") for h in want]).first()
    for h, value in want.items():
        assert row[f"h{h}"] == pytest.approx(value, rel=1e-9)


def test_episodes(spark):
    values = [
        (100, 95, 105), (112, 100, 110), (118, 101, 111), (115, 102, 112), (105, 103, 113), (125, 104, 114),
        (108, 105, 115), (130, 106, 116), (120, 107, 117), (122, 118, 121), (111, 109, 119), (124, 110, 120),
    ]
    rows = [("GLD", "baseline_a", mi_of("2024-01") + i, "locked", a, float(p), float(u), True) for i, (a, p, u) in enumerate(values)]
    df = spark.createDataFrame(
        rows, "product_code string, model string, target_mi int, period string, actual bigint, point double, upper80 double, covered80 boolean"
    ).withColumn("flagged", review.flag(STAR))
    got = sorted((month_of(r.start_mi), month_of(r.end_mi), r.months_in_episode) for r in review.episodes(df, STAR).collect())
    assert got == [("2024-02", "2024-04", 3), ("2024-08", "2024-09", 2)]
    state = review.code_state(df, STAR).first()
    assert state.pending and state.rule_enabled and state.evaluated_months == 12
    queue = {r.episode_start: r for r in review.queue(review.episodes(df, STAR), review.code_state(df, STAR)).collect()}
    assert queue["2024-02"].status == "closed" and queue["2024-08"].max_excess_over_point == 24.0


def test_lag(spark):
    rows = [
        ("r1", "20240115", "20240210"), ("r2", "20240120", "20240502"), ("r3", "20240105", "20240930"),
        ("r4", "20240125", "20250301"), ("r5", "", "20240201"), ("r6", "20240310", "20240228"), ("r7", "20240131", "20240401"),
    ]
    df = spark.createDataFrame(rows, "report_key string, date_of_event string, date_received string").select(
        F.lit("GLD").alias("product_code"),
        months.day_to_mi("date_of_event").alias("event_mi"),
        months.day_to_mi("date_received").alias("receipt_mi"),
    )
    got = {r.event_month: tuple(r[c] for c in ("reports_with_event_month", "within_3", "within_6", "within_12", "negative_lag"))
           for r in measures.lag_matched(df).collect()}
    assert got == {"2024-01": (5, 2, 3, 4, 0), "2024-03": (1, 0, 0, 0, 1)}
    summary = measures.lag_summary(df, STAR).first()
    assert summary.missing_event_date == 1 and summary.negative_lag == 1


def test_scores(spark):
    rows = [(100, 90.0, 85.0, 95.0, 80.0, 100.0), (50, 60.0, 55.0, 65.0, 50.0, 70.0), (70, 70.0, 65.0, 75.0, 60.0, 80.0)]
    df = spark.createDataFrame(rows, "actual bigint, point double, lower50 double, upper50 double, lower80 double, upper80 double")
    for name, value in (("product_code", "GLD"), ("model", "m"), ("period", "locked")):
        df = df.withColumn(name, F.lit(value))
    df = df.withColumn("horizon", F.lit(1)).withColumn("calibration_n", F.lit(36))
    cell = scoring.cells(scoring.score_columns(df)).first()
    assert (cell.n, cell.mae, cell.coverage50, cell.coverage80) == (3, 6.666667, 0.333333, 1.0)
    assert (cell.width50, cell.width80, cell.wis) == (10.0, 20.0, 4.466667)
