"""Sources that were collected page by page: which pages count is decided by counts a page, never by a walk on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rallyframe.operators.rows import first_seen


def _up_to(rows: DataFrame, source: str, page: str, last: DataFrame) -> DataFrame:
    """The rows of each source's pages up to its ``_last``; all of them where there is none."""
    return rows.join(last, source, "left").where(F.col("_last").isNull() | (F.col(page) <= F.col("_last"))).drop("_last")


def until_short(rows: DataFrame, source: str, page: str, size: int) -> DataFrame:
    """Rows up to and with the first page of fewer than ``size`` rows. Pages are numbered from 0; a missing one is an empty one."""
    full = rows.groupBy(source, page).agg(F.count("*").alias("n")).where(F.col("n") >= size)
    # full pages 0, 1, 2, ... without a gap are those numbered as they are counted
    nth = F.row_number().over(Window.partitionBy(source).orderBy(page))
    runs = full.withColumn("nth", nth).where(F.col(page) == F.col("nth") - 1).groupBy(source).agg(F.count("*").alias("n"))
    stops = rows.select(source).distinct().join(runs, source, "left")
    return _up_to(rows, source, page, stops.select(source, F.coalesce("n", F.lit(0)).alias("_last")))


def until_empty(rows: DataFrame, source: str, page: str) -> DataFrame:
    """Rows of the pages before the first that holds none."""
    return until_short(rows, source, page, 1)


def until_nothing_new(rows: DataFrame, source: str, page: str, key: str) -> DataFrame:
    """First sightings of keys on the pages before the first one that brings no new key."""
    fresh = first_seen(rows, [source, key], [page])
    return until_empty(fresh, source, page)


def host_allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a URL is http or https and its host is one of ``hosts`` or below one; false for anything else."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    fits = F.lit(False)
    for h in hosts:
        fits |= (host == h) | F.endswith(host, F.lit(f".{h}"))
    return F.coalesce(fits, F.lit(False))
