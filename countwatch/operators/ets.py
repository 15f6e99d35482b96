"""The candidate model: additive-error, damped-trend, additive-seasonal smoothing.

Definition used here. On ``z = log1p(y)`` with period 12::

    f = l + phi*b + s[t-12]        e = z - f
    l' = l + phi*b + alpha*e       b' = phi*b + beta*e       s' = s[t-12] + gamma*e

Initial level is the mean of the first twelve values, initial trend the mean step from the
first to the second twelve, initial seasonals the first twelve minus the level. Parameters come
from a declared grid with ``beta <= alpha`` and ``gamma <= 1 - alpha``; for fixed initial states
the Gaussian likelihood is largest where the sum of squared errors is smallest, so the fit at an
origin is the grid point with the smallest sum through that origin (ties to the lower number).

The state path does not depend on the origin, so each (code, grid point) is filtered once over
the whole history and every origin reads its states from that one path. The recurrence is
sequential in time and independent across codes and grid points: Spark spreads the codes, and each
Arrow batch advances all of its (code, grid point) pairs together, one month per step. Interpreted
higher-order functions over the same arrays were measured about a hundred times slower.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countwatch.session import ship

# The declared parameter grid.
ALPHAS = (0.1, 0.3, 0.5)
BETAS = (0.01, 0.1)
GAMMAS = (0.05, 0.3)
PHIS = (0.8, 0.98)
PERIOD = 12
MIN_OBS = 24


def grid() -> list[tuple[float, float, float, float]]:
    return [
        (a, b, g, p)
        for a, b, g, p in product(ALPHAS, BETAS, GAMMAS, PHIS)
        if b <= a and g <= 1 - a
    ]


def histories(series: DataFrame) -> DataFrame:
    """One row per code: its values by calendar month from its first to its last, and the first gap.

    Values after a month that is missing are not used: the recurrence would take them for the months
    before. ``gap_mi`` is that month (null without one), ``last_mi`` the last month of the series. Codes are dealt
    by their own hash over the session's shuffle partitions, whatever cores it has at the moment.
    """
    ship(series.sparkSession)
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = series.filter(F.col("y").isNotNull()).repartition(tasks, "product_code")
    packed = spread.groupBy("product_code").agg(
        F.array_sort(F.collect_list(F.struct("mi", "y"))).alias("h")
    )
    first, last = F.element_at("h", 1)["mi"], F.element_at("h", -1)["mi"]
    together = F.filter("h", lambda r, i: r["mi"] == first + i)
    gap = F.when(F.size(together) < F.size("h"), first + F.size(together))
    return packed.select(
        "product_code", first.alias("first_mi"), gap.alias("gap_mi"), last.alias("last_mi"),
        F.transform(together, lambda r: F.log1p(r["y"].cast("double"))).alias("z"),
    )


STATE = ("level", "trend", "sse", "season")
PATH_SCHEMA = (
    "product_code string, pid int, alpha double, beta double, gamma double, phi double,"
    "origin_mi int, n_obs bigint, level double, trend double, sse double, season array<double>"
)
FIT_SCHEMA = (
    "product_code string, origin_mi int, n_obs bigint, pid int, alpha double, beta double, gamma double, phi double,"
    "level double, trend double, sse double, season array<double>, fit_error string"
)
PAIRS_PER_STEP = 50_000  # (code, grid point) pairs advanced together, to bound a task's memory


def advance(z: np.ndarray, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Filter equal-length histories ``z`` (codes x months) under every grid point.

    Yields (months used, level, trend, sum of squared errors, seasonals oldest first) after each
    month from the 24th on; arrays are codes x points, seasonals 12 x codes x points.
    """
    alpha, beta, gamma, phi = points.T
    first, second = z[:, :PERIOD].mean(axis=1), z[:, PERIOD : 2 * PERIOD].mean(axis=1)
    shape = (len(z), len(points))
    level = np.broadcast_to(first[:, None], shape)
    trend = np.broadcast_to(((second - first) / PERIOD)[:, None], shape)
    season = [np.broadcast_to((z[:, i] - first)[:, None], shape) for i in range(PERIOD)]
    sse = np.zeros(shape)
    for t in range(z.shape[1]):
        damped = level + phi * trend
        oldest = season.pop(0)
        error = z[:, t, None] - (damped + oldest)
        level, trend, sse = damped + alpha * error, phi * trend + beta * error, sse + error * error
        season.append(oldest + gamma * error)
        if t + 1 >= MIN_OBS:
            yield t + 1, level, trend, sse, np.stack(season)


def _blocks(pdf: pd.DataFrame, per_block: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of one batch grouped by history length and cut to a bounded size."""
    for _, same in pdf.groupby(pdf["z"].map(len)):
        for lo in range(0, len(same), per_block):
            block = same.iloc[lo : lo + per_block]
            yield block, np.stack(block["z"].to_list())


def filter_paths(series: DataFrame, points=None) -> DataFrame:
    """State after every month from the 24th for every (code, grid point)."""
    chosen = np.array(points or grid())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, z in _blocks(pdf[pdf["z"].map(len) >= MIN_OBS], max(1, PAIRS_PER_STEP // len(chosen))):
                n, g = len(block), len(chosen)
                for t, level, trend, sse, season in advance(z, chosen):
                    alpha, beta, gamma, phi = np.tile(chosen, (n, 1)).T
                    yield pd.DataFrame(
                        {
                            "product_code": np.repeat(block["product_code"].to_numpy(), g),
                            "pid": np.tile(np.arange(g), n), "alpha": alpha, "beta": beta, "gamma": gamma, "phi": phi,
                            "origin_mi": np.repeat(block["first_mi"].to_numpy() + t - 1, g), "n_obs": t,
                            "level": level.ravel(), "trend": trend.ravel(), "sse": sse.ravel(),
                            "season": list(season.reshape(PERIOD, -1).T),
                        }
                    )

    return histories(series).mapInPandas(run, PATH_SCHEMA)


def fits(series: DataFrame, points=None) -> DataFrame:
    """The chosen state per (code, origin), one row for every month of history.

    A fit fails, and says so, on fewer than 24 observations, on a constant history, and from a missing
    month on.
    """
    chosen = np.array(points or grid())

    def broken(pdf: pd.DataFrame) -> pd.DataFrame:
        """A row per month from a code's first missing one to its last."""
        gone = pdf[pdf["gap_mi"].notna()]
        spans = [np.arange(int(g), last + 1) for g, last in zip(gone["gap_mi"], gone["last_mi"])]
        sizes = [len(s) for s in spans]
        one = gone.loc[gone.index.repeat(sizes), ["product_code"]].assign(first_mi=np.concatenate([*spans, np.zeros(0, dtype=int)]).astype("int32"))
        known = np.repeat([len(z) for z in gone["z"]], sizes)
        return _fit_rows(one, np.array([1])).assign(n_obs=known, fit_error="missing month")

    def short(block: pd.DataFrame, upto: int) -> pd.DataFrame:
        t = np.arange(1, upto + 1)
        return _fit_rows(block, t).assign(fit_error=f"fewer than {MIN_OBS} observations")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf["gap_mi"].notna().any():
                yield broken(pdf)
            for block, z in _blocks(pdf, max(1, PAIRS_PER_STEP // len(chosen))):
                yield short(block, min(z.shape[1], MIN_OBS - 1))
                if z.shape[1] < MIN_OBS:
                    continue
                row = np.arange(len(block))
                for t, level, trend, sse, season in advance(z, chosen):
                    best = sse.argmin(axis=1)  # the first smallest, so ties go to the lower number
                    constant = (z[:, :t] == z[:, :1]).all(axis=1)
                    out = _fit_rows(block, np.array([t]))
                    out["pid"] = best
                    out[["alpha", "beta", "gamma", "phi"]] = chosen[best]
                    out["level"], out["trend"], out["sse"] = level[row, best], trend[row, best], sse[row, best]
                    out["season"] = list(season[:, row, best].T)
                    out["fit_error"] = np.where(constant, "constant history", None)
                    yield out

    fitted = histories(series).mapInPandas(run, FIT_SCHEMA)
    state = ["pid", "alpha", "beta", "gamma", "phi", *STATE]
    usable = F.col("fit_error").isNull()
    return fitted.select(
        "product_code", "origin_mi", "n_obs", *[F.when(usable, F.col(c)).alias(c) for c in state], "fit_error"
    )


def _fit_rows(block: pd.DataFrame, t: np.ndarray) -> pd.DataFrame:
    """Key columns for every (code, months used) with the state columns empty."""
    k = len(t)
    rows = pd.DataFrame(
        {
            "product_code": np.repeat(block["product_code"].to_numpy(), k),
            "origin_mi": np.repeat(block["first_mi"].to_numpy(), k) + np.tile(t, len(block)) - 1,
            "n_obs": np.tile(t, len(block)),
        }
    )
    empty = {"pid": 0, "alpha": 0.0, "beta": 0.0, "gamma": 0.0, "phi": 0.0, "level": 0.0, "trend": 0.0, "sse": 0.0}
    return rows.assign(**empty, season=[[]] * len(rows), fit_error=None)


def log_point(h, level="level", trend="trend", phi="phi", season="season") -> Column:
    """``level + trend * (phi + ... + phi^h) + s[(h-1) mod 12]``, seasonals oldest first."""
    step = F.lit(h) if isinstance(h, int) else h
    damping = F.aggregate(
        F.sequence(F.lit(1), step), F.lit(0.0), lambda acc, j: acc + F.pow(F.col(phi), j)
    )
    seasonal = F.element_at(F.col(season), (F.pmod(step - 1, F.lit(PERIOD)) + 1).cast("int"))
    return F.col(level) + F.col(trend) * damping + seasonal


def points(fitted: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Back-transformed point per (code, origin, horizon), floored at zero."""
    per_h = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.greatest(F.lit(0.0), F.expm1(log_point(h))).alias("point"))
            for h in horizons
        ]
    )
    return (
        fitted.filter("fit_error is null")
        .select("product_code", "origin_mi", F.explode(per_h).alias("q"))
        .select("product_code", "origin_mi", "q.horizon", "q.point")
    )


def export_mismatch(paths: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """States whose exported one-step point differs from the step the filter itself took.

    ``paths`` carries ``z_next``, the value that followed. The filter moved its level by
    ``alpha`` times the error of its own step, so that step is ``z_next - (l' - l - phi*b) / alpha``.
    """
    w = Window.partitionBy("product_code", "pid").orderBy("origin_mi")
    moved = F.lead("level").over(w) - F.col("level") - F.col("phi") * F.col("trend")
    compared = paths.withColumn("taken", F.col("z_next") - moved / F.col("alpha")).withColumn("exported", log_point(1))
    return compared.filter(F.abs(F.col("taken") - F.col("exported")) > tolerance)
