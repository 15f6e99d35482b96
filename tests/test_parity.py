"""Published results for one code, re-derived from its published monthly counts."""

import pytest
from pyspark.sql import functions as F

from countwatch.config import Harness, mi_of
from countwatch.operators import forecast, measures, review, scoring

PUBLISHED = Harness(
    history_start="2016-01", last_actual="2026-08", as_of="20260831", first_origin="2018-12",
    warmup=("2019-01", "2021-12"), development=("2022-01", "2023-12"), locked=("2024-01", "2025-12"),
    locked_min_origin="2023-12", recent=("2026-01", "2026-08"), recent_min_origin="2025-12",
    outlook_issue_date="2026-10-06", train_end="2023-12",
)

# Eligible reports of one code, 2016-01 .. 2026-08.
COUNTS = [
    int(v)
    for v in """
    37 30 44 27 35 43 29 44 33 30 45 22 32 40 36 29 41 78 279 404 270 356 310 289 254 256 339 314 281 278 259 322 238 253 283
    254 265 261 328 362 287 303 263 349 265 317 251 301 263 280 277 258 169 265 299 286 308 320 337 331 258 394 327 345 317 360
    347 433 353 427 388 396 290 350 428 417 419 413 472 483 399 433 441 568 967 611 552 505 594 586 463 566 540 485 567 544 537
    629 584 618 645 534 620 640 610 684 552 666 613 561 753 678 499 524 721 507 612 640 610 785 1751 626 690 820 608 607 748 731
    """.split()
]

# Published score cells (model, horizon, period, n, mae, cov50, cov80, width50, width80, wis, calibration, scaled).
CELLS = [
    ("baseline_a", 1, "development", 24, 75.111111, 0.416667, 0.666667, 58.972222, 137.715278, 62.161389, 36.0, 1.0),
    ("baseline_a", 1, "locked", 24, 63.666667, 0.5, 0.708333, 68.65625, 174.631945, 45.666181, 36.0, 1.0),
    ("baseline_a", 1, "recent", 8, 301.375, 0.0, 0.5, 99.260417, 243.4375, 258.388542, 36.0, 1.0),
    ("baseline_a", 3, "development", 24, 86.75, 0.208333, 0.666667, 68.756944, 136.944444, 71.357639, 35.6, 1.0),
    ("baseline_a", 3, "locked", 22, 66.5, 0.454545, 0.772727, 94.560606, 201.007576, 44.816061, 36.0, 1.0),
    ("baseline_a", 3, "recent", 6, 193.777778, 0.5, 0.5, 112.083333, 217.166667, 169.900556, 36.0, 1.0),
    ("baseline_b", 1, "development", 24, 116.208333, 0.375, 0.666667, 72.802083, 161.958333, 73.596042, 36.0, 1.547152),
    ("baseline_b", 1, "locked", 24, 96.625, 0.416667, 0.75, 94.708333, 196.729167, 72.323333, 36.0, 1.51767),
    ("baseline_b", 1, "recent", 8, 231.375, 0.5, 0.625, 130.875, 228.8125, 180.54, 36.0, 0.767731),
    ("baseline_b", 3, "development", 24, 116.208333, 0.375, 0.625, 71.645833, 162.25, 74.704583, 35.6, 1.339577),
    ("baseline_b", 3, "locked", 22, 85.045455, 0.454545, 0.727273, 90.681818, 193.340909, 56.515455, 36.0, 1.278879),
    ("baseline_b", 3, "recent", 6, 108.0, 0.5, 0.666667, 132.583333, 233.416667, 60.161667, 36.0, 0.557339),
]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("DSP", mi_of("2016-01") + i, v) for i, v in enumerate(COUNTS)]
    series = spark.createDataFrame(rows, "product_code string, mi int, y bigint")
    fc = forecast.forecast(series, PUBLISHED, with_candidate=False)
    return scoring.scored(fc, PUBLISHED).cache()


def test_score_cells(scored):
    got = {(r.model, r.horizon, r.period): r for r in scoring.scaled(scoring.cells(scored)).collect()}
    assert len(got) == len(CELLS)
    for model, h, period, n, *values in CELLS:
        r = got[(model, h, period)]
        names = ("mae", "coverage50", "coverage80", "width50", "width80", "wis", "mean_calibration_n", "mae_scaled_vs_a")
        assert r.n == n
        assert [r[c] for c in names] == pytest.approx(values, abs=1.01e-6), (model, h, period)


def test_queue_and_workload(spark, scored):
    decision = spark.createDataFrame([("DSP", "baseline_a")], "product_code string, model_in_use string")
    rows = review.evaluated(scored, decision, PUBLISHED)
    found, state = review.episodes(rows, PUBLISHED), review.code_state(rows, PUBLISHED)
    assert [tuple(r) for r in review.queue(found, state).collect()] == [
        ("DSP", "baseline_a", "2025-12", "2026-01", 2, 1072.7, "closed")
    ]
    w = review.workload(found, state).first()
    assert (w.rule_enabled, w.locked_coverage80, w.evaluated_months, w.flagged_months, w.episodes) == (True, 0.708, 32, 4, 1)
    assert w.episodes_per_evaluated_month == 0.0312 and not w.pending_single_flag_at_end


def test_promotion_without_candidate_scores(scored):
    decided = scoring.promotion(scoring.cells(scored), PUBLISHED).first()
    assert decided.model_in_use == "baseline_a" and decided.reason == "a model has no development scores"


PROMOTION = [  # (mae a, b, c), (wis a, b, c) -> model in use
    ((10.0, 12.0, 9.0), (5.0, 6.0, 5.0), "candidate"), ((10.0, 12.0, 9.01), (5.0, 6.0, 4.0), "baseline_a"),
    ((10.0, 12.0, 8.0), (5.0, 6.0, 5.1), "baseline_a"), ((10.0, 10.0, 9.5), (5.0, 4.0, 3.0), "baseline_a"),
    ((10.0, 8.0, 7.3), (5.0, 6.0, 1.0), "baseline_b"), ((10.0, 8.0, 7.2), (5.0, 6.0, 6.0), "candidate"),
]


def test_promotion_rule(spark):
    rows = []
    for i, (mae, wis, _) in enumerate(PROMOTION):
        for m, a, w in zip(("baseline_a", "baseline_b", "candidate"), mae, wis):
            rows.append((f"C{i}", m, 1, "development", a, w, 0.8))
            rows.append((f"C{i}", m, 1, "locked", 0.0, 0.0, 0.8))  # must not be read
    cells = spark.createDataFrame(rows, "product_code string, model string, horizon int, period string, mae double, wis double, coverage80 double")
    got = {r.product_code: r.model_in_use for r in scoring.promotion(cells, PUBLISHED).collect()}
    assert got == {f"C{i}": want for i, (_, _, want) in enumerate(PROMOTION)}


def test_decision_written_once(spark, tmp_path):
    path = str(tmp_path / "decision")
    first = spark.createDataFrame([("A", "candidate")], "product_code string, model_in_use string")
    assert scoring.promote_once(first, path).first().model_in_use == "candidate"
    with pytest.raises(Exception):
        scoring.promote_once(first.withColumn("model_in_use", F.lit("baseline_a")), path)
    codes = first.select("product_code")
    forecast.require_stage_order(None, first, codes, mi_of("2023-12"))
    with pytest.raises(ValueError):
        forecast.require_stage_order(None, None, codes, mi_of("2023-12"))
    existing = spark.createDataFrame([("A", mi_of("2024-01"))], "product_code string, origin_mi int")
    with pytest.raises(ValueError):
        forecast.require_stage_order(existing, first, codes, mi_of("2023-12"))
    merged = forecast.merge_stage(existing, existing.withColumn("origin_mi", F.lit(mi_of("2023-11"))), mi_of("2023-12"), "development")
    assert sorted(r.origin_mi for r in merged.collect()) == [mi_of("2023-11"), mi_of("2024-01")]


def test_gaps_do_not_shorten_calibration(spark):
    """With missing months the latest 36 known errors reach further back than 36 months."""
    import numpy as np

    start = mi_of("2016-01")
    months = [i for i in range(128) if i % 5 != 3]
    rows = [("X", start + i, COUNTS[i]) for i in months]
    series = spark.createDataFrame(rows, "product_code string, mi int, y bigint")
    fc = forecast.forecast(series, PUBLISHED, with_candidate=False).filter("model = 'baseline_b'").collect()
    y = {start + i: COUNTS[i] for i in months}
    origins = sorted(m for m in y if mi_of("2018-12") <= m <= mi_of("2026-08"))
    by_key = {(r.origin_mi, r.horizon): r for r in fc}
    for h in (1, 3):
        points = {o: y.get(o + h - 12) for o in origins}
        for o in origins:
            errs = [y[p + h] - points[p] for p in origins if p + h <= o and points[p] is not None and p + h in y][-36:]
            r = by_key[(o, h)]
            assert r.calibration_n == len(errs)
            if points[o] is not None and len(errs) >= 12:
                want = [max(0.0, points[o] + q) for q in np.quantile(errs, PUBLISHED.levels)]
                assert [r.lower50, r.upper50, r.lower80, r.upper80] == pytest.approx(want, abs=1e-6)
            else:
                assert r.lower80 is None


def test_candidate_filter_against_plain_loop(spark):
    """The batched filter equals a scalar walk; its export reproduces the filter's own steps."""
    import math

    from countwatch.operators import ets

    start = mi_of("2016-01")
    rows = [("DSP", start + i, v) for i, v in enumerate(COUNTS)] + [("FLAT", start + i, 7) for i in range(40)] + [("NEW", start + i, i) for i in range(20)]
    series = spark.createDataFrame(rows, "product_code string, mi int, y bigint")
    z = [math.log1p(v) for v in COUNTS]
    a, b, g, p = ets.grid()[5]
    l0 = sum(z[:12]) / 12
    l, t, s, q = l0, (sum(z[12:24]) / 12 - l0) / 12, [v - l0 for v in z[:12]], 0.0
    for v in z:
        e = v - (l + p * t + s[0])
        l, t, s, q = l + p * t + a * e, p * t + b * e, s[1:] + [s[0] + g * e], q + e * e
    paths = ets.filter_paths(series.filter("product_code = 'DSP'"))
    last = paths.filter(f"pid = 5 and origin_mi = {start + 127}").first()
    assert (last.level, last.trend, last.sse) == pytest.approx((l, t, q)) and list(last.season) == pytest.approx(s)
    following = series.select("product_code", (F.col("mi") - 1).alias("origin_mi"), F.log1p(F.col("y").cast("double")).alias("z_next"))
    assert ets.export_mismatch(paths.join(following, ["product_code", "origin_mi"])).count() == 0
    fitted = {(r.product_code, r.origin_mi): r for r in ets.fits(series).collect()}
    assert len(fitted) == 128 + 40 + 20
    assert fitted[("FLAT", start + 39)].fit_error == "constant history" and fitted[("FLAT", start + 39)].level is None
    assert fitted[("NEW", start + 19)].fit_error == "fewer than 24 observations"
    best = paths.filter(f"origin_mi = {start + 90}").orderBy("sse", "pid").first()
    assert fitted[("DSP", start + 90)].pid == best.pid and fitted[("DSP", start + 90)].fit_error is None
