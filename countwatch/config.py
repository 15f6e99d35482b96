"""Harness configuration: periods, horizons, quantile levels and rule constants.

One frozen dataclass lives on the driver; everything else is a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


def mi_of(month: str) -> int:
    """Integer month index ``y * 12 + m`` of ``YYYY-MM`` or ``YYYYMM...``."""
    digits = month.replace("-", "")
    return int(digits[:4]) * 12 + int(digits[4:6])


def month_of(mi: int) -> str:
    return f"{(mi - 1) // 12:04d}-{(mi - 1) % 12 + 1:02d}"


@dataclass(frozen=True)
class Harness:
    """Everything fixed before the first forecast row exists (months as YYYY-MM)."""

    history_start: str
    last_actual: str
    as_of: str  # YYYYMMDD, newest countable receipt day
    first_origin: str
    warmup: tuple[str, str]
    development: tuple[str, str]
    locked: tuple[str, str]
    locked_min_origin: str
    recent: tuple[str, str]
    recent_min_origin: str
    outlook_issue_date: str
    train_end: str
    horizons: tuple[int, ...] = (1, 3)
    # The method's published constants.
    calibration_window: int = 36
    min_calibration: int = 12
    levels: tuple[float, ...] = (0.25, 0.75, 0.10, 0.90)
    dots: int = 20
    min_excess: float = 5.0
    min_run: int = 2
    coverage_floor: float = 0.70
    coverage_band: tuple[float, float] = (0.60, 0.95)
    improvement: float = 0.90
    lookback: int = 18
    material_decrease: float = 0.01
    min_complete_months: int = 36
    min_eligible_training: int = 120
    scored_periods: tuple[str, ...] = ("development", "locked", "recent")
    evaluated_periods: tuple[str, ...] = ("locked", "recent")
    models: tuple[str, ...] = field(default=("baseline_a", "baseline_b", "candidate"))

    @property
    def window_start(self) -> str:
        return self.history_start.replace("-", "") + "01"

    @property
    def start_mi(self) -> int:
        return mi_of(self.history_start)

    @property
    def end_mi(self) -> int:
        return mi_of(self.last_actual)

    def with_(self, **changes) -> "Harness":
        return replace(self, **changes)


# Periods for the star-schema tables: 80 receipt months, 1995-01 .. 2001-08-01.
STAR = Harness(
    history_start="1995-01",
    last_actual="2001-07",
    as_of="20010731",
    first_origin="1996-12",
    warmup=("1997-01", "1997-12"),
    development=("1998-01", "1999-12"),
    locked=("2000-01", "2000-12"),
    locked_min_origin="1999-12",
    recent=("2001-01", "2001-07"),
    recent_min_origin="2000-12",
    outlook_issue_date="2001-08-02",
    train_end="1999-12",
)

# The same series frozen three months earlier, so that later vintages add months.
STAR_FROZEN = STAR.with_(
    last_actual="2001-04",
    as_of="20010430",
    recent=("2001-01", "2001-04"),
    outlook_issue_date="2001-05-02",
)
