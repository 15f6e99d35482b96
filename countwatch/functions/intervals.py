"""Interval score, weighted interval score, empirical quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_score(y: Column, low: Column, high: Column, alpha: float) -> Column:
    """Width plus ``2/alpha`` times the distance outside the interval."""
    miss = F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0))
    return (high - low) + F.lit(2.0 / alpha) * miss


def weighted_interval_score(y: Column, m: Column, lo50: Column, hi50: Column, lo80: Column, hi80: Column) -> Column:
    """J3 with K = 2: weights one half on the median, alpha/2 on each interval."""
    total = (
        F.lit(0.5) * F.abs(y - m)
        + F.lit(0.25) * interval_score(y, lo50, hi50, 0.5)
        + F.lit(0.10) * interval_score(y, lo80, hi80, 0.2)
    )
    return total / F.lit(2.5)


def quantile_of_array(values: Column, p: float) -> Column:
    """Linear-interpolation quantile of a small array (numpy's default, ``percentile``).

    ``values`` must be sorted; its length is bounded by the calibration window.
    """
    position = (F.size(values) - 1) * F.lit(p)
    below = F.floor(position).cast("int")
    low = F.element_at(values, below + 1)
    high = F.element_at(values, F.least(below + 2, F.size(values)))
    return low + (high - low) * (position - below)


def quantiles_of_array(values: Column, levels: Sequence[float]) -> list[Column]:
    ordered = F.sort_array(values)
    return [quantile_of_array(ordered, p) for p in levels]


def _whole_quotient(a: Column, b: Column) -> Column:
    return (a - F.pmod(a, b)) / b


def exact_mean(value: Column, places: int = 6) -> Column:
    """Group mean of non-negative values with at most eight decimals, rounded half up exactly.

    Summed as whole units of 1e-8, so neither row order nor binary fractions can move a tie.
    """
    units = F.sum(F.round(value * F.lit(1e8)).cast("long"))
    n = F.count(value)
    cut = 10 ** (8 - places)
    return _whole_quotient(units * 2 + n * cut, n * 2 * cut) / F.lit(float(10**places))


def six_places(value: Column) -> Column:
    """Half-up rounding to six places through a nine-place decimal, so a true tie never hangs on float noise."""
    return F.round(value.cast("decimal(28,9)"), 6).cast("double")
