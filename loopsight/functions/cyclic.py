"""Column arithmetic on coordinates that wrap at a period."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wrap(x: Column, period: float | None) -> Column:
    """x within [0, period); x itself without a period."""
    return x if period is None else F.pmod(x, F.lit(float(period)))


def cyclic_difference(a: Column, b: Column, period: float) -> Column:
    """a - b, brought to [-period / 2, period / 2)."""
    return F.pmod(a - b + F.lit(period / 2), F.lit(float(period))) - F.lit(period / 2)


def phase_at(frame: Column, velocity: float, period: float | None, reference: float = 0.0, start: float = 0.0) -> Column:
    return wrap(F.lit(float(reference)) - F.lit(float(velocity)) * (frame - F.lit(float(start))), period)


def artifact_row(y: Column, phase: Column, period: int) -> Column:
    """Belt row of an image row, rounded half up."""
    return F.pmod(F.floor(y + phase + F.lit(0.5)), F.lit(period))


def finite(x: Column) -> Column:
    """x, or null where it's null, NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def circular_distance(a: Column, b: Column, period: float) -> Column:
    """The shorter way round between a and b."""
    d = F.pmod(F.abs(a - b), F.lit(float(period)))
    return F.least(d, F.lit(float(period)) - d)


def surface_row(y: Column, phase: Column, height: float) -> Column:
    """Where an image row lies on the surface."""
    return F.pmod(y + phase, F.lit(float(height)))


def visible(row: Column, phase: Column, frame_height: float, height: float) -> Column:
    """Whether a surface row lies within a frame."""
    return F.pmod(row - phase, F.lit(float(height))) < F.lit(float(frame_height))


def circular_mean(values: Column, period: float, least: float = 1e-12) -> Column:
    """An aggregate: the direction of the mean unit vector as a coordinate; null where it has none.

    Where the mean lies on the seam, the last bits of the sums say whether it's 0 or just short of the
    period, so each step is in the order of the SQL.
    """
    whole = F.lit(2 * math.pi)
    angle = values * F.lit(2) * F.lit(math.pi) / F.lit(float(period))
    x, y = F.avg(F.cos(angle)), F.avg(F.sin(angle))
    return F.when(F.sqrt(x * x + y * y) > least, (F.atan2(y, x) + whole) % whole * F.lit(float(period)) / whole)


def revolution_of(frame: Column, first: Column, velocity: float, period: float) -> Column:
    """Whole turns since the first frame."""
    return F.floor(F.lit(abs(velocity)) * (frame - first) / F.lit(float(period)))


def phase_fraction(phase: Column, period: float | None) -> Column:
    """The share of a turn; null where the surface has no period."""
    return F.lit(None).cast("double") if period is None else phase / F.lit(float(period))


def phase_radians(phase: Column, period: float | None) -> Column:
    return phase_fraction(phase, period) * 2.0 * F.lit(math.pi)


def true_phase(frame: Column, listed: Column, shift: Column, period: Column) -> Column:
    """The listed phase of a frame if that's finite, else minus shift times frame; both within the period."""
    given = finite(F.get(listed, frame.cast("int")))
    return F.pmod(F.coalesce(F.when(frame >= 0, given), -shift * frame), period)


def _jump(value: str, order: str, by: list[str], period: float) -> Column:
    """What to add to a step so that it goes the nearest way round; a step of exactly half a period keeps its sign."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.col(value) - F.lag(value).over(w)
    near = F.pmod(step + F.lit(period / 2), F.lit(float(period))) - F.lit(period / 2)
    near = F.when((near == -period / 2) & (step > 0), F.lit(period / 2)).otherwise(near)
    return F.coalesce(near - step, F.lit(0.0))


def unwrap(rows: DataFrame, value: str, order: str, by: list[str], period: float, name: str = "unwrapped") -> DataFrame:
    """rows with their values unwrapped along order within each group; by names a bounded sequence, such as a run."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(name, _jump(value, order, by, period))
    return out.withColumn(name, F.col(value) + F.sum(name).over(w))


def supplied_velocity(velocity: Column, unit: Column, stride: Column) -> Column:
    """Velocity per selected frame: one per source frame counts stride times. Without a unit, stride has to be 1."""
    known = F.when(unit == "source_frame", velocity * stride).when(unit == "selected_frame", velocity)
    return F.coalesce(known, F.when(unit.isNull() & (stride == 1), velocity))
