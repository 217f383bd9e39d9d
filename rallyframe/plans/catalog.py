"""All queries of the library with the SQL each must agree with; the modules below register theirs on import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "jon05_latest_status"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query under its name, with the SQL it must agree with."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


FACTS: dict[str, tuple[str, list[tuple], Callable[..., Column | dict[str, Column]]]] = {}


def facts(name: str, inputs: str, cases: list[tuple], f: Callable[..., Column | dict[str, Column]]) -> None:
    """The stated cases of an expression, which tests compare; ``whole`` makes the query that applies it to a table.

    ``inputs``: DDL of the input columns. ``cases``: inputs and then the expected value or values.
    """
    if taken := {"id", "k"} & {*OUTPUTS.get(name, []), *(c.split()[0] for c in split_ddl(inputs))}:
        raise ValueError(f"{name}: reserved column names {sorted(taken)}")
    FACTS[name] = (inputs, cases, f)


OUTPUTS: dict[str, list[str]] = {}


def split_ddl(ddl: str) -> list[str]:
    """Columns of a DDL string, commas inside type brackets kept."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def fields(name: str, outputs: str, inputs: str, cases: list[tuple], f: Callable[..., Column]) -> None:
    """As ``facts`` for an expression that gives a struct; ``outputs``: its fields."""
    OUTPUTS[name] = outputs.split()
    facts(name, inputs, cases, lambda *c: {o: f(*c)[o] for o in outputs.split()})


from rallyframe.plans import dashboards, dedup, feeds, scalars, streams, tables, whole  # noqa: E402,F401
