"""Aggregates by name or function, over rows and over arrays. NaN values are left out of max and min; nulls everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cytolake.config import aggregate
from cytolake.functions.scalar import nan


#: A name, or what makes an aggregate of a column (built-in functions, or a grouped-aggregate pandas_udf).
Aggregate = str | Callable[[Column], Column]


def over_rows(name: Aggregate, value: Column) -> Column:
    """The aggregate of a group; the sum of nothing is 0, every other named aggregate of nothing is NaN."""
    if callable(name):
        return name(value)
    real = F.when(~F.isnan(value), value)
    return {
        "mean": lambda: F.coalesce(F.avg(value), nan()),
        "sum": lambda: F.coalesce(F.sum(value), F.lit(0.0)),
        "gmean": lambda: F.coalesce(F.exp(F.avg(F.when(value > 0, F.log(F.when(value > 0, value))).otherwise(F.when(value.isNotNull(), F.lit(float("-inf")))))), nan()),
        "median": lambda: F.coalesce(F.median(value), nan()),
        "max": lambda: F.coalesce(F.max(real), nan()),
        "min": lambda: F.coalesce(F.min(real), nan()),
    }[aggregate(name)]()


def over_array(name: Aggregate, values: Column) -> Column:
    """The same for the elements of an array without nulls; a function gets the array."""
    if callable(name):
        return name(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    size = F.size(values)
    ordered = F.array_sort(values)
    middle = (F.element_at(ordered, F.floor((size + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(size / 2).cast("int") + 1)) / 2
    some = {
        "mean": total / size,
        "sum": total,
        "gmean": F.exp(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.when(x > 0, F.log(F.when(x > 0, x))).otherwise(F.lit(float("-inf")))) / size),
        "median": middle,
        "max": F.array_max(values),
        "min": F.array_min(values),
    }[aggregate(name)]
    return F.when(size > 0, some).otherwise(F.lit(0.0) if aggregate(name) == "sum" else nan())
