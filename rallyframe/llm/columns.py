"""Column expressions that several text operators use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def up_to(values: Column, most: Column) -> Column:
    """How many members of a sorted array are ``most`` at the most, by binary search."""
    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))

    def halve(acc, _):
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        open_, right = acc["low"] < acc["high"], F.get(values, mid) <= most
        return F.struct(F.when(open_ & right, mid + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~right, mid).otherwise(acc["high"]).alias("high"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + 1.0)).cast("int") + 1)
    return F.aggregate(rounds, start, halve, lambda acc: acc["low"])
