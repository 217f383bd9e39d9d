"""Sources as declarations: what each field of the common rows comes from, compiled to one plan for all of them.

A run of a declared flow has the outputs of every run: the items, the errors, and counts with a status. Items and errors are
written in one pass over the sources, which also counts them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rallyframe.functions.classify import gender_code
from rallyframe.functions.dates import identity_date
from rallyframe.functions.scores import closed
from rallyframe.functions.text import collapse, strip
from rallyframe.sources.staging import staged

ISO = r"^\d{4}-\d{2}-\d{2}$"
#: Kinds of fields: the value of a text, and whether a text that is given has one.
KINDS = {
    "text": (collapse, None),
    "date": (identity_date, lambda c: identity_date(c).rlike(ISO)),
    "number": (strip, lambda c: strip(c).rlike(r"^[+-]?\d+$")),
    "score": (closed, lambda c: strip(c).rlike(r"\d")),
    "gender": (gender_code, lambda c: gender_code(c) != ""),
}


@dataclass(frozen=True)
class Field:
    """A field of the common rows: a SQL expression over the source's columns, its kind, and whether a row needs it."""

    name: str
    of: str
    kind: str = "text"
    required: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: unknown kind {self.kind}")


@dataclass(frozen=True)
class Source:
    """A source: its name, what tells its items from other rows, and its fields."""

    name: str
    fields: tuple[Field, ...]
    items: str = "true"
    wants: str = "true"  # items outside are left out without being an error

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"{self.name}: fields declared twice: {', '.join(twice)}")


def compiled(source: Source, rows: DataFrame, names: list[str]) -> DataFrame:
    """(source, the common fields, problems): one row an item; a field that a source does not declare is blank."""
    declared = {f.name: f for f in source.fields}
    if unknown := sorted(set(declared) - set(names)):
        raise ValueError(f"{source.name}: fields that the common rows lack: {', '.join(unknown)}")
    raw = rows.where(source.items).where(source.wants).select(*(F.expr(f.of).cast("string").alias(f"_{f.name}") for f in source.fields))

    def problem(f: Field) -> Column:
        given, readable = strip(F.col(f"_{f.name}")) != "", KINDS[f.kind][1]
        missing = F.when(~given, F.lit(f"{f.name}: missing")) if f.required else F.lit(None).cast("string")
        return F.coalesce(missing, F.when(given & ~readable(F.col(f"_{f.name}")), F.lit(f"{f.name}: no {f.kind}"))) if readable else missing

    values = [KINDS[declared[n].kind][0](F.col(f"_{n}")).alias(n) if n in declared else F.lit("").alias(n) for n in names]
    problems = F.array_compact(F.array(*(problem(f) for f in source.fields))) if source.fields else F.array().cast("array<string>")
    return raw.select(F.lit(source.name).alias("source"), *values, problems.alias("problems"))


@dataclass(frozen=True)
class Outcome:
    """Items, errors (source, the fields, problem) and counts (source, items, errors, status)."""

    items: DataFrame
    errors: DataFrame
    counts: DataFrame


def status(items: int, errors: int) -> str:
    """Without errors a run is a success; with some it is one if it has items too."""
    return "success" if items or not errors else "failed"


def run(sources: list[tuple[Source, DataFrame]], names: list[str]) -> Outcome:
    """Runs all declared sources as one plan, written once; rows with problems are errors, one a problem, and no items."""
    watched, whole = [], None
    for source, rows in sources:
        seen = Observation()
        bad = F.size("problems") > 0
        each = compiled(source, rows, names).observe(seen, F.count_if(~bad).alias("items"), F.count_if(bad).alias("errors"))
        watched.append((source.name, seen))
        whole = each if whole is None else whole.unionByName(each)
    path = staged(whole.sparkSession, "declared")
    whole.write.parquet(path)
    kept = whole.sparkSession.read.schema(whole.schema).parquet(path)
    found = [(name, seen.get["items"], seen.get["errors"], status(seen.get["items"], seen.get["errors"])) for name, seen in watched]
    counts = whole.sparkSession.createDataFrame(found, "source string, items bigint, errors bigint, status string")
    return Outcome(kept.where(F.size("problems") == 0).drop("problems"), kept.select("source", *names, F.explode("problems").alias("problem")), counts)
