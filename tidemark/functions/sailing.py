"""Boat speeds from polar tables, wind and current samples, storm windows (Column expressions, JVM only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most angles and wind speeds of a polar table: it is a literal of the expression.
MAX_ANGLES, MAX_WINDS = 181, 61
#: Hours of forecast used alone, hours at which climatology has replaced it, knots below which a current is none, metres of wave height that bar a passage.
FORECAST_HOURS, BLEND_END_HOURS = 168, 240
CURRENT_MIN_KNOTS, WAVE_LIMIT_M = 0.15, 2.5
#: Boxes (west, east, south, north) of open ocean for titles without a place.
OCEAN_REGIONS = [(-170, -110, -30, 30), (-50, -20, -30, 30), (60, 90, -30, 10), (140, 170, -30, 10)]


@dataclass(frozen=True)
class Polar:
    """Boat speeds: one row per true wind angle (rising, above 0), one column per wind speed (rising)."""

    angles: tuple[float, ...]
    winds: tuple[float, ...]
    speeds: tuple[tuple[float, ...], ...]

    def __post_init__(self):
        if not (0 < len(self.angles) <= MAX_ANGLES and 0 < len(self.winds) <= MAX_WINDS):
            raise ValueError("a polar table has 1 to 181 angles and 1 to 61 wind speeds")
        if len(self.speeds) != len(self.angles) or {len(r) for r in self.speeds} != {len(self.winds)}:
            raise ValueError("speeds must have a row per angle and a column per wind speed")


def _bracket(value: Column, steps: tuple[float, ...]) -> tuple[Column, Column, Column]:
    """Places (from 0) of the steps around a value, and its share of the way between them; outside: the edge."""
    below = sum((value >= F.lit(float(s))).cast("int") for s in steps)
    low = F.greatest(below - 1, F.lit(0))
    high = F.least(low + 1, F.lit(len(steps) - 1))
    at = F.array(*[F.lit(float(s)) for s in steps])
    a, b = F.get(at, low), F.get(at, high)
    inside = F.least(F.greatest(value, F.lit(float(steps[0]))), F.lit(float(steps[-1])))
    return low, high, F.when(b > a, (inside - a) / (b - a)).otherwise(0.0)


def polar_speed(polar: Polar, angle: Column, wind: Column) -> Column:
    """Boat speed at a true wind angle and wind speed, 3 decimals.

    Bilinear inside the table; below its first angle a linear fade to 0; angles and winds beyond it take
    the last row and column; without wind or angle 0. Halves go up, whatever their last binary digit.
    """
    a, first = F.least(F.abs(angle), F.lit(180.0)), polar.angles[0]
    i0, i1, fa = _bracket(a, polar.angles)
    j0, j1, fw = _bracket(wind, polar.winds)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in polar.speeds])
    v = lambda i, j: F.get(F.get(rows, i), j)
    whole = v(i0, j0) * (1 - fa) * (1 - fw) + v(i1, j0) * fa * (1 - fw) + v(i0, j1) * (1 - fa) * fw + v(i1, j1) * fa * fw
    return F.when((wind <= 0) | (a <= 0), 0.0).otherwise(F.round(whole * F.least(a / first, F.lit(1.0)) + 1e-9, 3))


def made_good(speed: Column, angle: Column) -> Column:
    """Speed made good toward the wind."""
    return speed * F.cos(F.radians(angle))


def blend_share(hours: Column) -> Column:
    """Share of climatology in the wind so many hours ahead: 0 while the forecast holds, 1 beyond its end."""
    return F.least(F.greatest((hours - FORECAST_HOURS) / float(BLEND_END_HOURS - FORECAST_HOURS), F.lit(0.0)), F.lit(1.0))


def wave_hazard(p90: Column, has_percentiles: Column, limit: float = WAVE_LIMIT_M) -> Column:
    """Whether the 90th percentile exceeds the limit; null where there is none: a mean never stands for it."""
    return F.when(has_percentiles & p90.isNotNull(), p90 > limit)


def in_day_range(start: Column, end: Column, months: Column, month: int, day: int | None, days: int) -> Column:
    """Whether a storm touches the days around a calendar day of its year; without dates or a day, its months decide."""
    by_month = F.array_contains(months, month)
    if day is None:
        return by_month
    last = 28 if month == 2 else 30 if month in (4, 6, 9, 11) else 31
    centre = F.make_date(F.year(start), F.lit(month), F.lit(min(day, last)))
    within = (F.to_date(start) <= F.date_add(centre, days)) & (F.to_date(end) >= F.date_sub(centre, days))
    return F.when(start.isNull() | end.isNull(), by_month).otherwise(within)


def ocean_fallback(title: Column) -> tuple[Column, Column]:
    """Latitude and longitude in the open ocean drawn from the digest of a title.

    The 128-bit digest is reduced digit by digit to a remainder that all three parts can be read from.
    """
    modulus = 1024 * 1000 * len(OCEAN_REGIONS)
    digits = F.split(F.md5(title.cast("binary")), "")
    rest = F.aggregate(digits, F.lit(0).cast("long"), lambda acc, x: (acc * 16 + F.conv(x, 16, 10).cast("long")) % modulus)
    box = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in OCEAN_REGIONS]), (rest % len(OCEAN_REGIONS)).cast("int"))
    x, y = (rest % 1000) / 1000.0, F.floor(rest / 1024) % 1000 / 1000.0
    return F.get(box, 2) + y * (F.get(box, 3) - F.get(box, 2)), F.get(box, 0) + x * (F.get(box, 1) - F.get(box, 0))
