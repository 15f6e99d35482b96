"""The refined fit: never above the grid, near the optimum of finer searches, exports that agree, likelihoods by definition."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from countwatch.config import mi_of
from countwatch.operators import ets
from countwatch.operators import ets_refine as er
from countwatch.plans.star_plan import StarPlan

SHAPE = [0, 1, 2, 3, 2, 1, 0, -1, -2, -3, -2, -1]


def simulated(theta, months, seed, noise=0.05):
    """log1p values of a series that follows the model."""
    rng = np.random.default_rng(seed)
    a, b, g, p = theta
    level, trend, season, out = 4.5, 0.02, list(0.05 * np.array(SHAPE, dtype=float)), []
    for _ in range(months):
        e, base = rng.normal(0, noise), level + p * trend
        out.append(base + season[0] + e)
        level, trend, season = base + a * e, p * trend + b * e, [*season[1:], season[0] + g * e]
    return np.array(out)


def plain_sse(z, theta, start):
    a, b, g, p = theta
    level, trend, season, total = start[0], start[1], list(start[2:]), 0.0
    for v in z:
        e = v - level - p * trend - season[0]
        total += e * e
        level, trend, season = level + p * trend + a * e, p * trend + b * e, [*season[1:], season[0] + g * e]
    return total, level, trend, season


def best_start_by_lstsq(z, theta):
    """The least squares over initial states, one impulse at a time."""
    def errors(start, data):
        a, b, g, p = theta
        level, trend, season, out = start[0], start[1], list(start[2:]), []
        for v in data:
            e = v - level - p * trend - season[0]
            out.append(e)
            level, trend, season = level + p * trend + a * e, p * trend + b * e, [*season[1:], season[0] + g * e]
        return np.array(out)

    basis = np.zeros((er.FREE, 14))
    basis[0, 0] = basis[1, 1] = 1
    for j in range(11):
        basis[2 + j, 2 + j], basis[2 + j, 13] = 1, -1
    r = np.stack([errors(x, np.zeros(len(z))) for x in basis], axis=1)
    x = np.linalg.lstsq(r, -errors(np.zeros(14), z), rcond=None)[0]
    return x @ basis


@pytest.mark.parametrize("seed", range(4))
def test_filter_and_start_against_plain_loops(seed):
    theta, z = np.array([0.4, 0.1, 0.2, 0.9]), simulated((0.3, 0.05, 0.1, 0.9), 40 + seed * 7, seed)
    start = best_start_by_lstsq(z, theta)
    want = plain_sse(z, theta, start)
    padded = np.concatenate([z, np.zeros(9)])[None, :]
    sse, level, trend, season = er.filtered(padded, np.array([len(z)]), theta[None, :])
    assert sse[0] == pytest.approx(want[0], rel=1e-6)
    assert (level[0], trend[0]) == (pytest.approx(want[1], rel=1e-4), pytest.approx(want[2], abs=1e-4))
    assert season[0] == pytest.approx(want[3], abs=1e-4)


def test_against_a_finer_search():
    z = np.stack([simulated((0.35, 0.05, 0.1, 0.93), 72, s) for s in range(6)])
    n = np.full(6, 72)
    start = np.tile([0.3, 0.1, 0.05, 0.98], (6, 1))
    got = er.refine(z, n, start)
    fine = np.full(6, np.inf)
    for u in itertools.product(np.linspace(0, 1, 6), repeat=4):
        theta = np.tile(er.unbox(np.array(u)), (6, 1))
        fine = np.minimum(fine, er.filtered(z, n, theta)[0])
    assert (got["sse"] <= fine * 1.02).all() and (got["sse"] <= er.filtered(z, n, start, er.fixed_start(z))[0]).all()
    alpha, beta, gamma, phi = got["theta"].T
    assert (0 < alpha).all() and (alpha < 1).all() and (beta <= alpha).all() and (gamma <= 1 - alpha).all() and ((0.8 <= phi) & (phi <= 0.98)).all()


def test_rows_do_not_depend_on_their_batch():
    z = np.stack([simulated((0.3, 0.05, 0.1, 0.9), 60, s) for s in range(5)])
    n = np.array([60, 24, 31, 45, 60])
    z = np.where(np.arange(60) < n[:, None], z, 0)
    theta = np.tile([0.1, 0.01, 0.05, 0.8], (5, 1))
    together = er.refine(z, n, theta)
    for i in range(5):
        alone = er.refine(z[i : i + 1, : n[i]], n[i : i + 1], theta[:1])
        assert alone["sse"][0] == pytest.approx(together["sse"][i], rel=1e-9)


def test_state_table(spark):
    start = mi_of("2020-01")
    rows = [("GLD", start + t, 100 + 10 * SHAPE[t % 12] + t) for t in range(48)]
    rows += [("FLAT", start + t, 7) for t in range(30)] + [("SHORT", start + t, t) for t in range(10)] + [("GAP", start + t + (t > 25), 20 + t % 5) for t in range(30)]
    table = er.refined(spark.createDataFrame(rows, "product_code string, mi int, y bigint")).collect()
    by = {}
    for r in table:
        by.setdefault((r.product_code, r.fit_error), []).append(r)
    assert {k: len(v) for k, v in by.items()} == {
        ("GLD", None): 25, ("GLD", "fewer than 24 observations"): 23, ("FLAT", "fewer than 24 observations"): 23, ("FLAT", "constant history"): 7,
        ("SHORT", "fewer than 24 observations"): 10, ("GAP", "fewer than 24 observations"): 23, ("GAP", None): 3, ("GAP", "missing month"): 5,
    }
    for r in by["GLD", None]:
        assert r.sse <= r.grid_sse and r.export_mismatch is None and r.steps <= er.MAX_STEPS
        k = er.K_ESTIMATED if r.estimated_start else er.K_FIXED
        ll = -r.n_obs / 2 * (np.log(2 * np.pi * r.sse / r.n_obs) + 1)
        assert (r.log_likelihood, r.aic) == (pytest.approx(ll), pytest.approx(2 * k - 2 * ll))
    last = max(by["GLD", None], key=lambda r: r.origin_mi)
    # The golden series is a line with a fixed shape: the next value is 100 + 10 * SHAPE[0] + 48.
    point = np.expm1(last.level + last.phi * last.trend + last.season[0])
    assert point == pytest.approx(148, rel=0.02)


def test_mismatch_names_the_first_horizon(spark):
    season = [0.1 * i for i in range(12)]
    rows = [(1.0, 0.5, 0.9, season, [1.45, 1.955, 2.4195 + d]) for d in (0.0, 1e-3)]
    df = spark.createDataFrame(rows, "level double, trend double, phi double, season array<double>, path array<double>")
    got = [r[0] for r in df.select(er.mismatch()).collect()]
    assert got[0] is None and got[1].startswith("h=3: recurrence 2.42")


def test_refined_lowers_the_sum_on_the_star_series(spark, sf_small):
    rows = er.refined(StarPlan(spark, sf_small).series).where("fit_error is null")
    r = rows.agg(F.sum("sse"), F.sum("grid_sse"), F.count_if(F.col("export_mismatch").isNotNull()), F.count("*")).first()
    assert r[3] > 0 and r[0] < r[1] and r[2] == 0


def test_grid_of_the_oracle():
    from countwatch.plans import oracle

    assert [tuple(map(float, p.split())) for p in oracle.GRID.split(",")] == ets.grid()
