"""Search windows that are halved until none has more rows than a search may return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.sources.staging import staged


def _kept(df: DataFrame) -> DataFrame:
    path = staged(df.sparkSession, "windows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bisected(rows: DataFrame, day: str, region: str, cap: int) -> DataFrame:
    """(start, stop, region, n, capped): windows with fewer than ``cap`` rows, and days that have more by region.

    ``capped`` marks a day's region that still has ``cap`` rows or more. The rows are counted by day and region once; windows are
    halved level by level on running sums of the days, so there are as many rounds as the logarithm of the days. Null days
    are in no window; a table without days gives no windows; the regions of windows are blank.
    """
    each = _kept(rows.where(F.col(day).isNotNull()).groupBy(F.col(day).alias("day"), F.coalesce(region, F.lit("")).alias("region")).agg(F.count("*").alias("n")))
    # one row a day of the calendar, however many rows the table has
    bounds = each.agg(F.min("day").alias("a"), F.max("day").alias("b")).where(F.col("a").isNotNull())
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("day")).join(each.groupBy("day").agg(F.sum("n").alias("n")), "day", "left")
    sums = _kept(days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day")), F.lit(0)).alias("upto"), F.coalesce("n", F.lit(0)).alias("n")))
    first = sums.select(F.col("day").alias("start"), (F.col("upto") - F.col("n")).alias("before"))
    last = sums.select(F.col("day").alias("stop"), "upto")

    def counted(windows: DataFrame) -> DataFrame:
        return windows.join(first, "start").join(last, "stop").select("start", "stop", (F.col("upto") - F.col("before")).alias("n"))

    live = _kept(counted(bounds.select(F.col("a").alias("start"), F.col("b").alias("stop"))))
    leaves = []
    while True:
        split = (F.col("n") >= cap) & (F.col("start") < F.col("stop"))
        leaves.append(live.where(~split))
        if live.where(split).isEmpty():
            break
        middle = F.date_add("start", F.floor(F.date_diff("stop", "start") / 2).cast("int"))
        halves = F.inline(F.array(F.struct(F.col("start").alias("start"), middle.alias("stop")), F.struct(F.date_add(middle, 1).alias("start"), F.col("stop").alias("stop"))))
        live = _kept(counted(live.where(split).select(halves)))
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    full = found.where(F.col("n") >= cap).select("start", "stop").join(each, F.col("start") == F.col("day"))
    by_region = full.select("start", "stop", "region", "n", (F.col("n") >= cap).alias("capped"))
    return found.where(F.col("n") < cap).select("start", "stop", F.lit("").alias("region"), "n", F.lit(False).alias("capped")).unionByName(by_region)
