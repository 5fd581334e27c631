"""Column expressions on displacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude(dx: Column, dy: Column, px: Column) -> Column:
    """Length of a displacement in metres."""
    return F.sqrt(dx * dx + dy * dy) * px


def per_year(value: Column, left_year: Column, right_year: Column) -> Column:
    """A displacement per year; null for pairs within a year."""
    return F.try_divide(value, F.abs(left_year - right_year))


def direction(dx: Column, dy: Column) -> Column:
    """Angle of (dx, dy) in degrees, in (-180, 180]."""
    return F.degrees(F.atan2(dy + F.lit(0.0), dx + F.lit(0.0)))


def component(mode: str, dx: Column, dy: Column, px: Column, left_year: Column, right_year: Column) -> Column:
    """One of m, x, y (displacement) and vm, vx, vy (velocity), in any case."""
    mode = mode.lower()
    base = {"m": magnitude(dx, dy, px), "x": dx, "y": dy}
    if mode.removeprefix("v") not in base or len(mode) > 2:
        raise ValueError(f"unknown component {mode!r}")
    value = base[mode.removeprefix("v")]
    return per_year(value, left_year, right_year) if mode.startswith("v") else value


def vector_attributes(dx: Column, dy: Column, px: Column, py: Column, left_year: Column, right_year: Column) -> dict[str, Column]:
    """The nine attributes of a vector; metres change sign for pairs that run back in time, pixels don't."""
    sign = F.when(left_year > right_year, F.lit(-1.0)).otherwise(F.lit(1.0))
    mx, my = dx * px * sign, dy * py * sign
    norm = F.sqrt(mx * mx + my * my)
    year = lambda v: per_year(v, left_year, right_year)
    return {
        "dx_in_pixels": dx, "dy_in_pixels": dy, "dx_in_meters": mx, "dy_in_meters": my, "d_in_meters": norm,
        "dx_in_meters_per_year": year(mx), "dy_in_meters_per_year": year(my), "d_in_meters_per_year": year(norm), "direction": direction(dx, dy),
    }


def outlier_filter(v: Column, lo: float = -10, hi: float = 10) -> Column:
    """Null for values at or outside the bounds."""
    return F.when((v > lo) & (v < hi), v)


def cc_filter(v: Column, cc: Column, least: float = 0.5) -> Column:
    """Keeps values whose correlation is ``least`` or more; a missing correlation drops the value."""
    return F.when(~F.isnan(cc) & (cc >= least), v)


def time_direction(left_year: Column, right_year: Column) -> Column:
    return F.when(left_year > right_year, "reversed").otherwise("regular")
