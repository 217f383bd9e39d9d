"""A store of matches under their identity: inserts add what was never seen, and running them again adds nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions.dates import identity_date
from rallyframe.operators import identity, rows
from rallyframe.sources.staging import staged

#: Longest texts of the columns that are stored beside the whole row.
PROMOTED = {"tournament_name": 300, "draw_name": 120, "draw_gender": 20, "winner_team": 200, "loser_team": 200}


def stored_row(wide: DataFrame, source: str, run: str | None, *keep: str) -> DataFrame:
    """Widened rows as the store holds them: identity, ISO date, promoted columns cut to their lengths, origin, the whole row.

    ``run``: the run that saw a row first; imports have none.
    """
    hashed = wide.withColumn("match_hash", identity.canonical_hash())
    canonical = identity.canonical_row(hashed, identity.CANONICAL, *keep, "match_hash")
    cut = [F.substring(c, 1, n).alias(c) for c, n in PROMOTED.items()]
    whole = F.to_json(F.struct(*identity.CANONICAL)).alias("data")
    origin = [F.lit(source).alias("source"), F.lit(run).cast("string").alias("first_seen_run")]
    return canonical.select(*keep, "match_hash", identity_date(F.col("date")).alias("date_norm"), *cut, *origin, whole)


class HashStore:
    """A table bucketed by ``key``, so that what an insert compares with is read without a shuffle, and only its key.

    The rows of an insert are written before they are appended: what was new is decided once, whatever fails later.
    """

    def __init__(self, spark: SparkSession, key: str = "match_hash", buckets: int = 32):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.name, self.path, self.empty = f"store_{uuid.uuid4().hex}", staged(spark, "store"), True

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, batch: DataFrame, order: list[str]) -> DataFrame:
        """The first row of each key of the batch by ``order``, unless the store has the key."""
        first = rows.first_seen(batch, [self.key], order)
        if self.empty:
            return first
        dealt = first.repartition(self.buckets, self.key)  # as the store's buckets are; equal partitionings need no exchange
        return dealt.join(self.table().select(self.key), self.key, "left_anti").select(*batch.columns)

    def insert(self, batch: DataFrame, order: list[str]) -> tuple[DataFrame, int, int]:
        """(what was new, its count, rows skipped: those the store has and repeats within the batch)."""
        path = staged(self.spark, "batch")
        self.unseen(batch, order).write.parquet(path, compression="zstd")  # halves digests in hexadecimal, most of a row
        new = self.spark.read.schema(batch.schema).parquet(path)
        found = new.count()
        new.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path).option("compression", "zstd").mode("append").saveAsTable(self.name)
        self.empty = False
        return new, found, batch.count() - found

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
