"""The candidate refined: smoothing parameters that move off the grid, initial states estimated, likelihoods.

For given parameters every one-step error is affine in the initial states (level, trend, twelve seasonals that sum to
zero), so the best initial states are a least-squares solution and only ``(alpha, beta, gamma, phi)`` are searched. The search is a
simplex in the box ``0 < alpha < 1, 0 < beta <= alpha, 0 < gamma <= 1 - alpha, 0.8 <= phi <= 0.98`` that starts at
the grid's choice for that origin; as that point, with the grid's own initial states, stays a contender, the sum of squares never ends above the grid's.

Fits at different (code, origin) pairs do not depend on each other. Spark deals the pairs; each Arrow batch moves the simplices
of all its pairs together, one month of all pairs per numpy step, and pairs that have settled leave the batch.

With ``n`` observations and ``k`` estimated values (four parameters, thirteen free initial states, one variance),
``log_likelihood = -n/2 (ln(2 pi sse / n) + 1)`` and ``aic = 2k - 2 log_likelihood``; where the grid's fixed initial states
stay, ``k`` is 5. ``export_mismatch`` names the first horizon at which the recurrence, run on without errors,
and the point formula on the exported states differ by more than 1e-6; the formula is evaluated by Spark, the recurrence by the fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countwatch.operators import ets
from countwatch.session import ship

PERIOD = ets.PERIOD
#: Free initial states: level, trend and eleven seasonals; the twelfth is minus their sum.
FREE = 2 + PERIOD - 1
K_ESTIMATED, K_FIXED = 4 + FREE + 1, 4 + 1
PHI_LOW, PHI_SPAN = 0.80, 0.18
EDGE = 1e-4
MAX_STEPS = 150
#: A simplex is settled when its corners' sums differ by less, relatively.
SETTLED = 1e-9
#: Pairs whose simplices move together.
PAIRS = 512
MISMATCH = 1e-6

SCHEMA = (
    "product_code string, origin_mi int, n_obs bigint, alpha double, beta double, gamma double, phi double, level double, trend double,"
    "season array<double>, sse double, grid_sse double, estimated_start boolean, steps int, path array<double>"
)


def unbox(u: np.ndarray) -> np.ndarray:
    """Parameters of points in the unit box."""
    u = np.clip(u, 0.0, 1.0)
    alpha = EDGE + (1 - 2 * EDGE) * u[..., 0]
    return np.stack([alpha, alpha * np.maximum(u[..., 1], EDGE), (1 - alpha) * np.maximum(u[..., 2], EDGE), PHI_LOW + PHI_SPAN * u[..., 3]], axis=-1)


def box(theta: np.ndarray) -> np.ndarray:
    """Points in the unit box of parameters."""
    alpha, beta, gamma, phi = np.moveaxis(theta, -1, 0)
    return np.stack([(alpha - EDGE) / (1 - 2 * EDGE), beta / alpha, gamma / (1 - alpha), (phi - PHI_LOW) / PHI_SPAN], axis=-1)


def filtered(z: np.ndarray, n: np.ndarray, theta: np.ndarray, start: np.ndarray | None = None):
    """Run the recurrence on histories ``z`` (pairs x months, ``n`` of them used) with one parameter row per pair.

    Without ``start`` the initial states are solved for. Returns (sse, level, trend, seasons oldest first) after month ``n``.
    """
    pairs, months = z.shape
    alpha, beta, gamma, phi = (theta[:, i, None] for i in range(4))
    if start is None:
        start = _best_start(z, n, theta)
    level, trend = start[:, :1].copy(), start[:, 1:2].copy()
    season = start[:, 2:].copy()
    sse = np.zeros(pairs)
    for t in range(months):
        on = (t < n)[:, None]
        damped, old = level + phi * trend, season[:, t % PERIOD, None]
        error = np.where(on, z[:, t, None] - damped - old, 0.0)
        sse += error[:, 0] ** 2
        level = np.where(on, damped + alpha * error, level)
        trend = np.where(on, phi * trend + beta * error, trend)
        season[:, t % PERIOD] += (gamma * error)[:, 0]
    order = (n[:, None] + np.arange(PERIOD)) % PERIOD  # the month that comes next is the oldest
    return sse, level[:, 0], trend[:, 0], np.take_along_axis(season, order, axis=1)


def _best_start(z: np.ndarray, n: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The initial states with the least squares: errors of a zero start plus one response per free state."""
    pairs, months = z.shape
    alpha, beta, gamma, phi = (theta[:, i, None] for i in range(4))
    wide = 1 + FREE  # column 0: the data from a zero start; the others: no data, one state of one
    level, trend = np.zeros((pairs, wide)), np.zeros((pairs, wide))
    season = np.zeros((PERIOD, pairs, wide))
    level[:, 1] = trend[:, 2] = 1.0
    for j in range(PERIOD - 1):
        season[j, :, 3 + j], season[PERIOD - 1, :, 3 + j] = 1.0, -1.0
    gram = np.zeros((pairs, wide, wide))
    for t in range(months):
        damped, old = level + phi * trend, season[t % PERIOD]
        error = -(damped + old)
        error[:, 0] += z[:, t]
        error = np.where((t < n)[:, None], error, 0.0)
        gram += error[:, :, None] * error[:, None, :]
        level, trend = damped + alpha * error, phi * trend + beta * error
        season[t % PERIOD] = old + gamma * error
    a, g = gram[:, 1:, 1:], gram[:, 1:, 0]
    # A touch of ridge keeps directions that the data do not tell apart from blowing up.
    ridge = 1e-10 * np.trace(a, axis1=1, axis2=2)[:, None, None] * np.eye(FREE)
    x = -np.linalg.solve(a + ridge, g[:, :, None])[:, :, 0]
    return np.concatenate([x, -x[:, 2:].sum(axis=1, keepdims=True)], axis=1)


def fixed_start(z: np.ndarray) -> np.ndarray:
    """The grid's initial states, by formula."""
    first, second = z[:, :PERIOD].mean(axis=1, keepdims=True), z[:, PERIOD : 2 * PERIOD].mean(axis=1, keepdims=True)
    return np.concatenate([first, (second - first) / PERIOD, z[:, :PERIOD] - first], axis=1)


def simplex(loss, start: np.ndarray, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least points of ``loss(rows, points)`` in the unit box, one simplex per row, all moved together.

    Returns (points, losses, steps taken); the start is a corner, so no loss ends above its own.
    """
    rows, dims = start.shape
    corners = np.repeat(start[:, None, :], dims + 1, axis=1)
    for d in range(dims):
        corners[:, d + 1, d] += np.where(start[:, d] < 0.5, 0.25, -0.25)
    everyone = np.arange(rows)
    values = np.stack([loss(everyone, corners[:, c]) for c in range(dims + 1)], axis=1)
    steps = np.zeros(rows, dtype=np.int32)
    live = everyone
    for _ in range(max_steps):
        order = np.argsort(values[live], axis=1, kind="stable")
        corners[live] = np.take_along_axis(corners[live], order[:, :, None], axis=1)
        values[live] = np.take_along_axis(values[live], order, axis=1)
        apart = values[live, -1] - values[live, 0] > SETTLED * (np.abs(values[live, 0]) + 1e-300)
        wide = np.ptp(corners[live], axis=1).max(axis=1) > 1e-6
        live = live[apart & wide]
        if not len(live):
            break
        steps[live] += 1
        x, v = corners[live], values[live]
        centre, worst = x[:, :-1].mean(axis=1), x[:, -1]

        def at(scale: np.ndarray, rows=slice(None)) -> np.ndarray:
            return np.clip(centre[rows] + scale * (centre[rows] - worst[rows]), 0.0, 1.0)

        first = at(1.0)
        f1 = loss(live, first)
        best, middling = f1 < v[:, 0], (f1 >= v[:, 0]) & (f1 < v[:, -2])
        scale = np.where(best, 2.0, np.where(f1 < v[:, -1], 0.5, -0.5))
        second, f2 = first.copy(), np.full(len(live), np.inf)
        again = ~middling
        if again.any():
            second[again] = at(scale[again, None], again)
            f2[again] = loss(live[again], second[again])
        take2 = np.where(best, f2 < f1, f2 < np.minimum(f1, v[:, -1])) & again
        take1 = ~take2 & (best | middling)
        new, f = np.where(take2[:, None], second, first), np.where(take2, f2, f1)
        moved = take1 | take2
        corners[live[moved], -1], values[live[moved], -1] = new[moved], f[moved]
        shrink = live[~moved]
        for c in range(1, dims + 1):
            if len(shrink):
                corners[shrink, c] = 0.5 * (corners[shrink, c] + corners[shrink, 0])
                values[shrink, c] = loss(shrink, corners[shrink, c])
    least = values.argmin(axis=1)
    return corners[everyone, least], values[everyone, least], steps


def refine(z: np.ndarray, n: np.ndarray, theta: np.ndarray, max_steps: int = MAX_STEPS) -> dict[str, np.ndarray]:
    """Fits of histories ``z`` from the grid's parameters: the simplex's answer, or the grid's own where that is not above it."""
    point, _, steps = simplex(lambda rows, u: filtered(z[rows], n[rows], unbox(u))[0], np.clip(box(theta), 0.0, 1.0), max_steps)
    found, ways = unbox(point), [filtered(z, n, unbox(point))]
    ways.append(filtered(z, n, theta, fixed_start(z)))
    kept = ways[1][0] <= ways[0][0]
    sse, level, trend = (np.where(kept, b, a) for a, b in zip(ways[0][:3], ways[1][:3], strict=True))
    season = np.where(kept[:, None], ways[1][3], ways[0][3])
    chosen = np.where(kept[:, None], theta, found)
    return {
        "theta": chosen, "sse": sse, "level": level, "trend": trend, "season": season, "estimated": ~kept, "steps": steps,
        "path": ahead(chosen, level, trend, season, 3),
    }


def ahead(theta: np.ndarray, level: np.ndarray, trend: np.ndarray, season: np.ndarray, months: int) -> np.ndarray:
    """The recurrence run on without errors: log points of the next months, pairs x months."""
    out = []
    for h in range(months):
        trend = theta[:, 3] * trend
        level = level + trend
        out.append(level + season[:, h % PERIOD])
    return np.stack(out, axis=1)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def refined(series: DataFrame, points=None, max_steps: int = MAX_STEPS) -> DataFrame:
    """The state table: one row per (code, origin) as in ``ets.fits``, refined where that fit is usable."""
    ship(series.sparkSession)
    grid = ets.fits(series, points)
    keys = ["product_code", "origin_mi", "n_obs"]
    history = ets.histories(series).select(F.col("product_code").alias("code_"), "z")
    usable = grid.where("fit_error is null").select(*keys, "alpha", "beta", "gamma", "phi", F.col("sse").alias("grid_sse"))
    # Every pair gets the part of the history that its origin knows; pairs, not codes, are dealt over the tasks.
    pairs = usable.join(history, F.col("product_code") == F.col("code_")).drop("code_").withColumn("z", F.slice("z", F.lit(1), F.col("n_obs").cast("int")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), PAIRS):
                block = pdf.iloc[lo : lo + PAIRS]
                n = block["n_obs"].to_numpy()
                z = np.zeros((len(block), n.max()))
                for i, h in enumerate(block["z"]):
                    z[i, : len(h)] = h
                fit = refine(z, n, block[["alpha", "beta", "gamma", "phi"]].to_numpy(), max_steps)
                out = block[[*keys, "grid_sse"]].copy()
                out[["alpha", "beta", "gamma", "phi"]] = fit["theta"]
                for name in ("level", "trend", "sse", "steps"):
                    out[name] = fit[name]
                out["season"], out["path"], out["estimated_start"] = list(fit["season"]), list(fit["path"]), fit["estimated"]
                yield out[[c.split()[0] for c in SCHEMA.split(",")]]

    fitted = pairs.repartition(_tasks(series), "product_code", "origin_mi").mapInPandas(run, SCHEMA)
    told = fitted.select(*keys, *_state(), *likelihood(F.when(F.col("estimated_start"), K_ESTIMATED).otherwise(K_FIXED)), "steps", "estimated_start", mismatch().alias("export_mismatch"))
    failed = grid.where("fit_error is not null").select(*keys, "fit_error")
    return told.withColumn("fit_error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def _state() -> list[str]:
    return ["alpha", "beta", "gamma", "phi", "level", "trend", "season", "sse", "grid_sse"]


def likelihood(k: Column) -> list[Column]:
    """Log-likelihood and AIC of a fit with ``k`` estimated values, from its sum of squares; null for a perfect fit."""
    n = F.col("n_obs").cast("double")
    ll = F.when(F.col("sse") > 0, -n / 2 * (F.log(2 * F.pi() * F.col("sse") / n) + 1))
    return [ll.alias("log_likelihood"), (2 * k - 2 * ll).alias("aic")]


def mismatch(path: str = "path", horizons: int = 3, tolerance: float = MISMATCH) -> Column:
    """The first horizon at which the exported states' point and the recurrence differ, as text; null if none does."""
    out = None
    for h in range(1, horizons + 1):
        point, stepped = ets.log_point(h), F.element_at(path, h)
        off = F.abs(point - stepped) > tolerance * F.greatest(F.lit(1.0), F.abs(point))
        text = F.concat(F.lit(f"h={h}: recurrence "), F.round(stepped, 9).cast("string"), F.lit(", formula "), F.round(point, 9).cast("string"))
        out = F.when(off, text) if out is None else out.when(off, text)
    return out
