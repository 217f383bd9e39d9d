"""Row operators over whole tables: first and latest rows, inserts of what is new, pages, ranks without a single task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_seen(df: DataFrame, key: list[Column | str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, which should be total; ties are broken by the remaining columns.

    An aggregation, not a window: rows are combined before the shuffle, so a key of a third of all rows stays small. Columns
    named in ``key`` are the same in all rows of a key and travel once (numbers with fractions do not: 0.0 and -0.0 are one key).
    """
    kinds = dict(df.dtypes)
    same = {k: f"_k{i}" for i, k in enumerate(key) if isinstance(k, str) and k not in order and kinds[k] in ("string", "bigint", "int", "date", "boolean")}
    rest = [c for c in df.columns if c not in order and c not in same]
    found = df.groupBy(*((F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(key))).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return found.select(*(F.col(same[c]).alias(c) if c in same else F.col(f"_row.{c}") for c in df.columns))


def last_seen(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in order]
    return df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(key))).agg(F.max(F.struct(*order, *rest)).alias("_row")).select(*(f"_row.{c}" for c in df.columns))


def id_or(id_col: str, *others: str) -> Column:
    """A dedup key: the id where given, else the other columns."""
    return F.when(F.col(id_col) != "", F.array(F.col(id_col))).otherwise(F.array(F.lit(""), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in others)))


def latest(rows: DataFrame, key: str, order: list[str], **values: str) -> DataFrame:
    """One row a key with the number of rows and, of the latest by ``order``, the named values."""
    by = F.struct(*order)
    return rows.groupBy(key).agg(F.count("*").alias("n"), *(F.max_by(c, by).alias(a) for a, c in values.items()))


def has_match(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """``left`` with a boolean that says whether ``right`` has its key."""
    seen = right.select(key).distinct().withColumn(name, F.lit(True))
    return left.join(seen, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def only_new(new: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What an insert-if-absent adds: of each key the first new row, unless the key exists already."""
    return first_seen(new, [key], order).join(existing.select(key), key, "left_anti").select(*new.columns)


def update_or_create(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Existing rows with the non-null values of ``changes``, and rows for keys not there yet."""
    other = [c for c in existing.columns if c != key]
    new = changes.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") if c in changes.columns else F.lit(None).cast(existing.schema[c].dataType).alias(f"_{c}") for c in other))
    both = existing.join(new, F.col(key) == F.col("_k"), "full_outer")
    return both.select(F.coalesce(key, "_k").alias(key), *(F.coalesce(f"_{c}", c).alias(c) for c in other))


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Columns changed where a condition holds; null conditions count as false."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str, allowed: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, deleted rows): rows whose id is listed and whose state allows it go."""
    gone = df.where(F.coalesce(allowed, F.lit(False))).join(ids.select(key).distinct(), key, "left_semi")
    return df.join(gone.select(key), key, "left_anti"), gone


class Refused(ValueError):
    """A replacement that would lose too much."""


def replace_all(existing: DataFrame, new: DataFrame, allow_shrink: bool = False) -> DataFrame:
    """The new table; the old one where the new has under nine tenths of its rows, unless that is allowed.

    A new table without rows is refused before anything is compared. Both are counted in one job.
    """
    sizes = existing.select(F.lit(0).alias("n")).unionByName(new.select(F.lit(1).alias("n"))).agg(F.count_if(F.col("n") == 0).alias("old"), F.count_if(F.col("n") == 1).alias("new")).first()
    if not sizes.new:
        raise Refused("the new table has no rows")
    return existing if sizes.new * 10 < sizes.old * 9 and not allow_shrink else new


def fan_out(events: DataFrame, users: DataFrame, on: str, pieces: int = 64, block: int = 64, group: int = 512) -> DataFrame:
    """Each event with each user of its ``on``; every pair is a row of the result.

    Keys with over a ``pieces``-th of the events, of which there are fewer than that, are split: their events are dealt over ``pieces``
    parts by a hash and their users repeated in each, so one key's pairs are made by many tasks. Null keys have no users.
    Events of a part meet users as blocks of at most ``block``, users in groups of at most ``group``: what is joined stays as small as
    the tables, and the pairs of a block come user by user, in runs and repeats that a columnar file stores in a fraction of a byte
    each. A task holds the pairs of one block at a time, so ``block`` is small.
    """
    events, users = events.where(F.col(on).isNotNull()), users.where(F.col(on).isNotNull())
    sizes = events.groupBy(on).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    hot = [r[on] for r in sizes.where(F.col("_n") * pieces > total).collect()]
    split = F.col(on).isin(hot) if hot else F.lit(False)

    def blocks(df: DataFrame, key: list[str], name: str, size: int) -> DataFrame:
        own = [c for c in df.columns if c not in key]
        place = F.row_number().over(Window.partitionBy(*key).orderBy(*own)) - 1
        held = F.collect_list(F.struct(*own))
        return df.withColumn("_block", F.floor(place / size)).groupBy(*key, "_block").agg((held[own[0]] if len(own) == 1 else held).alias(name)).drop("_block")

    dealt = events.withColumn("_piece", F.when(split, F.pmod(F.xxhash64(*events.columns), F.lit(pieces))).otherwise(0).cast("int"))
    # a number of parts of its own: few bytes make many pairs, so parts must not be joined for being small
    told = blocks(dealt.repartition(pieces, on, "_piece"), [on, "_piece"], "_events", block)
    repeated = blocks(users, [on], "_users", group).withColumn("_piece", F.explode(F.when(split, F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))))
    met = told.join(repeated, [on, "_piece"])

    def each(name: str, own: list[str]) -> Column:
        return F.explode(name).alias(own[0]) if len(own) == 1 else F.inline(name)  # plain values make no object a row

    own = [[c for c in df.columns if c != on] for df in (events, users)]
    return met.select(on, "_events", each("_users", own[1])).select(on, each("_events", own[0]), *own[1])


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows that name a parent which is gone, for a cascade or a reset."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti").select(*child.columns)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page, clamped to the last one; there is at least one page. Only the rows up to its end are kept sorted."""
    pages = max(1, math.ceil(df.count() / size))
    k = min(max(number, 1), pages)
    return df.orderBy(*order).offset((k - 1) * size).limit(size)


def _quantiles(df: DataFrame, lead: Column, most: int) -> list:
    return df.agg(F.percentile_approx(lead, [(i + 1) / most for i in range(most - 1)], 10_000).alias("c")).first().c or []


def _cuts(df: DataFrame, lead: Column, most: int) -> list:
    return sorted(set(_quantiles(df, lead, most)))


def _below(cuts: list, value: Column) -> Column:
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c < value)) if cuts else F.lit(0)


def range_of(df: DataFrame, lead: str, then: str | None = None, ranges: int = 64) -> Column:
    """A number that rises with ``lead``, of ranges of similar size; a value that fills several is cut into as many by ``then``."""
    moment = dict(df.dtypes)[lead].startswith("timestamp")
    value = (F.unix_micros(F.col(lead).cast("timestamp")) if moment else F.col(lead)).cast("double")
    found = _quantiles(df, value, ranges)
    hot = {v: found.count(v) for v in found if found.count(v) > 1}
    if not then or not hot:
        return _below(sorted(set(found)), value)
    after, inside = F.col(then).cast("double"), F.lit(0)
    shares = [(i + 1) / ranges for i in range(ranges - 1)]
    for r in df.select(value.alias("v"), after.alias("t")).where(F.col("v").isin([*hot])).groupBy("v").agg(F.percentile_approx("t", shares, 10_000).alias("c")).collect():
        cuts = sorted({r.c[k * ranges // hot[r.v] - 1] for k in range(1, hot[r.v])})
        inside = F.when(value == r.v, 1 + _below(cuts, after)).otherwise(inside)
    return _below(sorted(set(found)), value) * (ranges + 1) + inside


def numbered(df: DataFrame, lead: str, order: list[Column], rank: str = "place", total_of: str | None = None, total: str = "total", ranges: int = 64, then: str | None = None) -> DataFrame:
    """``df`` with each row's place in a total order, and the running total of ``total_of``.

    ``lead`` is the first column of ``order``, ascending and not null, of a numeric or time type. Its values are cut into
    ranges of similar size; each is numbered by itself and shifted by the counts before it, so no task sorts the whole
    table. Only one count and one sum a range reach the driver. ``then`` is the numeric column that comes next in ``order``,
    ascending and not null: by it a value of ``lead`` that many rows share is cut too.
    """
    rows = df.withColumn("_bucket", range_of(df, lead, then, ranges))
    amount = F.col(total_of).cast("double") if total_of else F.lit(0.0)
    each = sorted(rows.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum(amount).alias("s")).collect())
    counts, sums, n, s = [], [], 0, 0.0
    for b in each:
        counts += [F.lit(b["_bucket"]), F.lit(n).cast("long")]
        sums += [F.lit(b["_bucket"]), F.lit(s)]
        n, s = n + b["n"], s + (b["s"] or 0.0)
    w = Window.partitionBy("_bucket").orderBy(*order)
    shift = [F.try_element_at(F.create_map(*x), F.col("_bucket")) if each else F.lit(0) for x in (counts, sums)]
    out = rows.withColumn(rank, F.row_number().over(w) + shift[0].cast("long"))
    if total_of:
        out = out.withColumn(total, F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + shift[1])
    return out.drop("_bucket")


def carried(df: DataFrame, key: str, order: list[str], value: Column, name: str, ranges: int = 64) -> DataFrame:
    """``df`` with the last non-null ``value`` at or before each row of its key, by ``order`` (nulls first).

    ``order`` begins with a numeric or time column that is not null. Its values are cut into ranges; each key's last value of
    each range goes on to its later ranges, of which there are few, and every range of a key is finished by itself: a key
    with half of all rows is as many pieces as there are ranges.
    """
    lead = order[0]
    moment = dict(df.dtypes)[lead].startswith("timestamp")
    at = (F.unix_micros(F.col(lead).cast("timestamp")) if moment else F.col(lead)).cast("double")
    cuts = _cuts(df, at, ranges)
    rows = df.withColumn("_range", F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c < at)) if cuts else F.lit(0)).withColumn("_value", value)
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(last.alias("_last")).select("_key", "_of", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    within = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.join(ends, rows[key].eqNullSafe(ends._key) & (rows._range == ends._of), "left")
    return met.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(within), "_before")).drop("_range", "_value", "_key", "_of", "_before")


def dealt(df: DataFrame, place: str, ways: int, name: str = "lane") -> DataFrame:
    """Round-robin lanes (strided slices) of rows that have a place from 1."""
    return df.withColumn(name, ((F.col(place) - 1) % ways).cast("int"))


def with_settings(rows: DataFrame, settings: DataFrame, source: str, **defaults) -> DataFrame:
    """Rows with the settings of their source; of a source without a row, or with a null in it, the defaults hold."""
    found = rows.join(settings, source, "left")
    return found.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
