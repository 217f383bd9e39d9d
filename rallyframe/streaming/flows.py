"""Event streams: tails, windows with watermarks, sessions, gates with hysteresis.

Each flow is a function from a (batch or streaming) DataFrame to a DataFrame. ``drained`` runs one over what a source holds
now and keeps the result as a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rallyframe.operators.rows import carried
from rallyframe.sources.staging import staged


def tail(log: DataFrame, seq: str, after: int) -> DataFrame:
    """Lines past an offset."""
    return log.where(F.col(seq) > after)


def windowed(events: DataFrame, ts: str, every: str, late: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts in tumbling (or sliding) windows of event time; rows later than ``late`` are left out of a stream."""
    span = F.window(ts, every, slide) if slide else F.window(ts, every)
    return events.withWatermark(ts, late).groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Stretches of activity without a pause of ``gap``."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def inactive(events: DataFrame, ts: str, key: str, as_of: Column, minutes: int) -> DataFrame:
    """Keys whose last event is older than the timeout."""
    last = events.groupBy(key).agg(F.max(ts).alias("last"))
    return last.where(F.col("last") < as_of - F.make_dt_interval(mins=F.lit(minutes)))


def gate(load: Column, order: list[str], key: str, close_at: int, open_at: int, known: bool = True) -> Column:
    """Whether a gate is open after each reading: it closes at ``close_at``, opens again at ``open_at`` and holds between.

    The state is the last reading that decided anything, so a window finds it; before the first one the gate is open.
    Where the gate's state was not ``known`` at the start, only a load that opens it opens it.
    """
    decided = F.when(load >= close_at, False).when(load <= open_at, True)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(F.last(decided, ignorenulls=True).over(w), F.lit(known))


def gated(events: DataFrame, load: Column, order: list[str], key: str, close_at: int, open_at: int, known: bool = True) -> DataFrame:
    """``events`` with ``open``, as ``gate`` tells it, also where one key has most of them."""
    decided = F.when(load >= close_at, False).when(load <= open_at, True)
    return carried(events, key, order, decided, "open").withColumn("open", F.coalesce("open", F.lit(known)))


def drained(spark: SparkSession, path: str, flow: Callable[[DataFrame], DataFrame], mode: str = "complete", key: tuple[str, ...] = ()) -> DataFrame:
    """Runs a flow over all rows of a Parquet source as a stream and returns its last result as a table.

    In ``update`` mode each micro-batch has a folder of its own and the last row of each ``key`` counts.
    """
    now = spark.read.parquet(path)
    schema, found = now.schema, now.inputFiles()
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    if len(found) == 1 and found[0].endswith(f"/{name}"):  # one file: a stream watches its folder for this name
        reader, path = reader.option("pathGlobFilter", name), folder
    out = staged(spark, "stream")
    stream = flow(reader.parquet(path))
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", staged(spark, "stream-state"))
    if mode == "update":
        run = writer.foreachBatch(lambda df, n: df.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{out}/n-{n}")).start()
    elif mode == "append":
        run = writer.format("parquet").option("path", out).start()
    else:
        run = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    run.awaitTermination()
    if mode == "update":
        rows = spark.read.schema(stream.schema.add("_batch", "long")).parquet(f"{out}/n-*")
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("last"))
        return last.select("last.*")
    return spark.read.schema(stream.schema).parquet(out)
