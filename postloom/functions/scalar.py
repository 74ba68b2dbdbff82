"""Number, date and array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds at which time-ordered post ids begin.
ID_EPOCH = 1288834974657


def sigmoid_mean(x: Column, params: list[tuple[float, float]]) -> Column:
    """Mean over (slope, intercept) of 1 / (1 + exp(-(slope * x + intercept)))."""
    return reduce(Column.__add__, [1 / (1 + F.exp(-(F.lit(a) * x + F.lit(b)))) for a, b in params]) / len(params)


def sigmoid_root(slope: float, intercept: float) -> float:
    """Where a calibrated score is one half."""
    return -intercept / slope


def bisect_root(f, low: float, high: float, steps: int = 60) -> float:
    """A root of a rising function between two bounds."""
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return (low + high) / 2


def nearest_index(values: Column, x: Column) -> Column:
    """Index from 0 of the value nearest to x, the first on ties."""
    distance = F.transform(values, lambda v: F.abs(v - x))
    return (F.array_position(distance, F.array_min(distance)) - 1).cast("int")


def activity_rate(n: Column, days: Column) -> Column:
    return F.try_divide(n, days)


def month_end(year: Column, month: Column) -> Column:
    return F.last_day(F.make_date(year, month, F.lit(1)))


def year_bounds(year: Column) -> tuple[Column, Column]:
    return F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def array_mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(values))


def id_time(post_id: Column) -> Column:
    """The time that a time-ordered post id holds."""
    return F.timestamp_millis(F.shiftright(post_id, 22) + F.lit(ID_EPOCH))


def path_number(path: Column, name: str = "iter") -> Column:
    return F.regexp_extract(path, rf"{name}_(\d+)-", 1)
