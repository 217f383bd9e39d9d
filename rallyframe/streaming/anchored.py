"""Windows whose start depends on the one before: the first event opens one, the first event after its end the next.

Each moment of a key points to the first moment at or after the end of a window that it would open. The moments that do open one
are those reached from a key's first; pointer doubling over tables finds them in as many rounds as the logarithm of the most
windows of a key, so a key with a third of all events is not one long fold. Every window function and join is by key and
slot (a stretch of time as long as a window), never by key alone: a window reaches from its slot into the next only.

Defined cases: events without a time open nothing and are counted nowhere; null keys are a key; events of one moment share a
window; an event at the very end of a window opens the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.sources.staging import staged


def _kept(df: DataFrame) -> DataFrame:
    """Written and read again, so that rounds do not pile up in one plan."""
    path = staged(df.sparkSession, f"anchors-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _slot(micros: Column, width: int) -> Column:
    return ((micros - F.pmod(micros, F.lit(width))) / width).cast("bigint")


def successors(moments: DataFrame, width: int) -> DataFrame:
    """(k, at, next) of distinct (k, at): the first moment of the key at ``at + width`` or later, or null."""
    placed = moments.select("k", _slot(F.col("at"), width).alias("slot"), "at")
    first = placed.groupBy("k", "slot").agg(F.min("at").alias("first"))
    # slots of one key are as many as its time is long, not as its events
    later = first.select("k", "slot", F.lead("first").over(Window.partitionBy("k").orderBy("slot")).alias("beyond"))
    probes = placed.select("k", (F.col("slot") + 1).alias("slot"), (F.col("at") + width).alias("by"), F.col("at").alias("of"), F.lit(None).cast("bigint").alias("there"))
    there = placed.select("k", "slot", F.col("at").alias("by"), F.lit(None).cast("bigint").alias("of"), F.col("at").alias("there"))
    ahead = Window.partitionBy("k", "slot").orderBy("by", F.col("there").isNull().desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = probes.unionByName(there).withColumn("next", F.first("there", ignorenulls=True).over(ahead)).where(F.col("of").isNotNull())
    # nothing left in the next slot: the first moment of the first slot after it
    after_next = first.select("k", (F.col("slot") - 1).alias("slot")).withColumn("has_next", F.lit(True))
    follow = later.join(after_next, on=(later.k.eqNullSafe(after_next.k)) & (later.slot == after_next.slot), how="left").select(later.k.alias("fk"), later.slot.alias("fs"), later.beyond, "has_next")
    two = follow.select(F.col("fk").alias("tk"), F.col("fs").alias("ts"), F.col("beyond").alias("beyond2"))
    out = found.withColumn("own", F.col("slot") - 1)
    out = out.join(follow, out.k.eqNullSafe(follow.fk) & (out.own == follow.fs), "left").join(two, out.k.eqNullSafe(two.tk) & (out.slot == two.ts), "left")
    return out.select("k", F.col("of").alias("at"), F.coalesce("next", F.when(F.col("has_next"), F.col("beyond2")).otherwise(F.col("beyond"))).alias("next"))


def openings(moments: DataFrame, width: int) -> DataFrame:
    """(k, at) of the moments that open a window."""
    jumps = _kept(successors(moments, width))
    reached = _kept(moments.groupBy("k").agg(F.min("at").alias("at")))
    while True:
        j = jumps.select(F.col("k").alias("jk"), F.col("at").alias("ja"), F.col("next").alias("jn")).where(F.col("next").isNotNull())
        step = reached.join(j, reached.k.eqNullSafe(j.jk) & (reached.at == j.ja)).select("k", F.col("jn").alias("at"))
        more = _kept(step)
        if more.isEmpty():
            return reached
        reached = _kept(reached.unionByName(more))
        left = jumps.where(F.col("next").isNotNull())
        jumps = _kept(left.join(j, left.k.eqNullSafe(j.jk) & (left.next == j.ja)).select("k", "at", F.col("jn").alias("next")))


def anchored_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """(key, start, n): events of each window of ``seconds`` that opens at the first event after the window before has ended."""
    width = seconds * 1_000_000
    each = _kept(events.where(F.col(ts).isNotNull()).groupBy(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).agg(F.count("*").alias("n")))
    starts = openings(each.select("k", "at"), width).select("k", F.col("at").alias("start"))
    # an event lies in the window that opened in its slot or the one before: at most two windows
    spread = starts.select("k", "start", F.explode(F.array(_slot(F.col("start"), width), _slot(F.col("start"), width) + 1)).alias("slot"))
    placed = each.withColumn("slot", _slot(F.col("at"), width)).select(F.col("k").alias("ek"), F.col("slot").alias("es"), "at", "n")
    met = placed.join(spread, placed.ek.eqNullSafe(spread.k) & (placed.es == spread.slot) & (placed.at >= spread.start) & (placed.at < spread.start + width))
    return met.groupBy("k", "start").agg(F.sum("n").alias("n")).select(F.col("k").alias(key), F.timestamp_micros("start").alias("start"), "n")
