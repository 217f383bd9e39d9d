"""What each of several document filters removes, alone and in every order of application, with exact Shapley shares.

Each document has a mask of the filters it fails. A part's counts by mask define its removal polynomial: with filter i
applied with probability x_i, R(x) = sum over masks m of n_m (1 - prod over i in m of (1 - x_i)) documents go. In monomials,
a_T = (-1)^(|T|+1) sum over m containing T of n_m. A corner of the cube tells what a set of filters removes, so all orders are
read off 32 corners; a filter's Shapley share is the integral of its partial derivative along the diagonal, exact in rationals.

Spark reads the texts once and reduces them to counts by part and mask; a part has at most 32 of them.

Defined cases: a null text counts as empty; null parts are the empty string; a null doc_id is neither smaller nor greater than
another, so its text is never a repeat and makes none; rows of one id and text are all first ones; of several label rows of a
document any 1 counts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from fractions import Fraction
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import written

NAMES = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The filters that see one text: under 50 words, repeated words, capitals, signs. A null text counts as empty."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": lambda w: F.size(w) < 50,
        "B": lambda w: 100 * F.size(F.array_distinct(w)) < 65 * F.size(w),
        "C": lambda w: 100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"),
        "D": lambda w: text.rlike("[#$%&*|]"),
    } | {"words": words}


def masked(docs: DataFrame, part: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, part, digest, mask) with the bits of the filters that see one text; A is bit 0."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rules = failures(F.col("text"))
    found = own.withColumn("words", rules.pop("words"))
    bits = sum((F.when(rule(F.col("words")), 1 << i).otherwise(0) for i, rule in enumerate(rules.values())), F.lit(0))
    return found.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.cast("int").alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, with those labelled quality 1 and toxic 1.

    A text's first id is found by an aggregation that combines before the shuffle, and its row by a join on text and id, so a
    text that a third of all rows share is no hot key.
    """
    seen = written(masked(docs, part, text, id_col), "masks")
    first = seen.groupBy("digest").agg(F.min("id").alias("id"))
    repeat = seen.where(F.col("id").isNotNull()).join(first, ["digest", "id"], "left_anti")
    kept = seen.join(first, ["digest", "id"], "left_semi").unionByName(seen.where(F.col("id").isNull()))
    every = kept.select("id", "part", "mask").unionByName(repeat.select("id", "part", (F.col("mask") + 16).alias("mask")))
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = every.join(known, "id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


class RemovalPolynomial:
    """The multilinear polynomial of expected removals, from counts by mask; ``coefficients[T]`` belongs to the product of x_i, i in T."""

    def __init__(self, counts: dict[int, int], n: int = len(NAMES)):
        self.n = n
        self.coefficients = [0] * (1 << n)
        for mask, count in counts.items():
            t = mask
            while t:  # all non-empty subsets of the mask
                self.coefficients[t] += count if t.bit_count() % 2 else -count
                t = (t - 1) & mask

    def corner(self, applied: int) -> int:
        """Documents that a set of filters removes: the value where x_i is 1 for those and 0 for others."""
        total, t = 0, applied
        while t:
            total += self.coefficients[t]
            t = (t - 1) & applied
        return total

    def share(self, i: int) -> Fraction:
        """The integral of the partial derivative by x_i along the diagonal from 0 to 1."""
        return sum((Fraction(a, t.bit_count()) for t, a in enumerate(self.coefficients) if t >> i & 1), Fraction(0))


def orders(rows: list[tuple[int, int, int, int]]) -> list[tuple]:
    """For one part's (mask, n, good, toxic): one row for each order and step."""
    n = len(NAMES)
    lost, good, toxic = (RemovalPolynomial({r[0]: r[k] for r in rows}) for k in (1, 2, 3))
    total = sum(r[1] for r in rows)
    corners = [[p.corner(s) for s in range(1 << n)] for p in (lost, good, toxic)]
    shapley = [int(lost.share(i) * factorial(n)) for i in range(n)]
    unique = [sum(r[1] for r in rows if r[0] == 1 << i) for i in range(n)]
    out = []
    for order in itertools.permutations(range(n)):
        name, before = "".join(NAMES[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = corners[0][after] - corners[0][before]
            out.append((name, step, total - corners[0][after], removed, corners[0][1 << i] - removed, unique[i], corners[1][after] - corners[1][before], corners[2][after] - corners[2][before], shapley[i]))
            before = after
    return out


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part.

    ``shapley``: what the step's filter removes, summed over all 120 orders.
    """
    counts = mask_counts(docs, labels, part, text, id_col)
    each = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))

    def run(batches):
        for b in batches:
            for name, rows in zip(b.column("part").to_pylist(), b.column("rows").to_pylist(), strict=True):
                found = orders([(r["mask"], r["n"], r["good"], r["toxic"]) for r in rows])
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(columns[0]), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["part", "filter_order", "step", *COLUMNS])

    return each.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} bigint' for c in COLUMNS)}")
