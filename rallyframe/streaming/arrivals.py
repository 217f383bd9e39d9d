"""Streams that wait for event time: pairs of two streams within an interval, and keys that have fallen silent.

``fed`` hands a flow its input in several runs with one checkpoint, as arrivals do, each run a restart of the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.sources.staging import staged


def matched(starts: DataFrame, ends: DataFrame, key: str, start_at: str, end_at: str, within: str, late: str) -> DataFrame:
    """Starts beside the ends of their key that follow within an interval; a start without one comes alone.

    It does once both watermarks have passed its interval. Rows later than ``late`` are dropped, and counted by the stream.
    """
    left, right = starts.withWatermark(start_at, late), ends.withWatermark(end_at, late).withColumnRenamed(key, "_key")
    near = (F.col(key) == F.col("_key")) & (F.col(end_at) >= F.col(start_at)) & (F.col(end_at) <= F.col(start_at) + F.expr(f"INTERVAL {within}"))
    return left.join(right, near, "leftOuter").drop("_key")


def silent(events: DataFrame, key: str, ts: str, minutes: int, late: str = "0 seconds") -> DataFrame:
    """(key, last, out): out once the watermark is over ``minutes`` past a key's last event, not out again with its next event.

    A key whose events have no time is kept. The state of a key is its last time, and goes when the key is out.
    """
    wait, kind = minutes * 60_000, dict(events.dtypes)[key]

    def step(names: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, out = state.get[0], True
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for b in batches:
                if len(times := b["_micros"].dropna()):
                    last = max(int(times.max()), last if last is not None else int(times.min()))
            out = last is not None and last // 1000 + wait < state.getCurrentWatermarkMs()
            if out:
                state.remove() if state.exists else None
            elif last is not None:
                state.update((last,))
                state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [names[0]], "last": pd.to_datetime([last], unit="us"), "out": [out]})

    timed = events.withWatermark(ts, late).withColumn("_micros", F.unix_micros(ts))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last timestamp, out boolean", "last bigint", "update", "EventTimeTimeout")


def fed(spark: SparkSession, arrivals: list[DataFrame], flow: Callable[[DataFrame], DataFrame], mode: str = "append") -> tuple[DataFrame, int]:
    """(all rows that a flow gives, rows dropped as late) when ``arrivals`` come one after another.

    ``_batch`` tells the run and micro-batch of a row.
    """
    source, state, out, dropped = staged(spark, "arrivals"), staged(spark, "arrivals-state"), staged(spark, "arrivals-out"), 0
    schema = arrivals[0].schema
    for n, rows in enumerate(arrivals):
        rows.write.mode("append").parquet(source)
        stream = flow(spark.readStream.schema(schema).parquet(source))

        def keep(df: DataFrame, batch: int, run: int = n) -> None:
            df.withColumn("_batch", F.lit(run * 1_000_000 + batch)).write.mode("overwrite").parquet(f"{out}/n-{run}-{batch}")

        q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(keep).start()
        q.awaitTermination()
        dropped += sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    return spark.read.schema(stream.schema.add("_batch", "integer")).parquet(f"{out}/n-*"), dropped
