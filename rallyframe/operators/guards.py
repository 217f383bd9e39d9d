"""Which URLs may be fetched: schemes, local names, allowed hosts and addresses that are not public."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.functions import addresses


def guarded(urls: DataFrame, url: str = "url", hosts: tuple[str, ...] = (), resolved: DataFrame | None = None) -> DataFrame:
    """The rows with ``host``, ``address`` (32 hex digits, where the host states one) and ``refused``, the first reason of these, or null.

    ``host``: not http or https, or without a readable host; ``name``: a local name; ``list``: not one of ``hosts`` or below one;
    ``address``: not public. ``resolved`` (host, address): what names resolve to, as collected; each address of a name must be public, one
    that cannot be read is not, and a name without any is ``unresolved``. Without that table names are taken as public.
    One dot at the end of a name does not count.
    """
    if taken := {"host", "address", "refused"} & {*urls.columns}:
        raise ValueError(f"columns {sorted(taken)} are there already")
    found = urls.withColumn("host", addresses.host(F.col(url)))
    found = found.withColumn("address", addresses.address(F.col("host")))
    name = F.regexp_replace("host", r"\.$", "")
    allowed = F.lit(not hosts)
    for h in hosts:
        allowed |= (name == h) | name.endswith(f".{h}")
    no_host = F.col("host").isNull() | (F.col("host").startswith("[") & F.col("address").isNull())
    reason = F.when(no_host, "host").when(name.rlike(addresses.LOCAL_NAME), "name").when(~allowed, "list").when(~addresses.is_public(F.col("address")), "address")
    if resolved is None:
        return found.withColumn("refused", reason)
    known = resolved.select(F.regexp_replace(F.lower("host"), r"\.$", "").alias("_name"), addresses.address(F.lower("address")).alias("_address"))
    known = known.select("_name", F.coalesce(addresses.is_public(F.col("_address")), F.lit(False)).alias("_public")).groupBy("_name").agg(F.bool_and("_public").alias("_public"))
    named = found.withColumn("_name", F.when(F.col("address").isNull(), name)).join(known, "_name", "left")
    late = F.when(F.col("address").isNull() & F.col("_public").isNull(), "unresolved").when(F.col("address").isNull() & ~F.col("_public"), "address")
    return named.withColumn("refused", F.coalesce(reason, late)).drop("_name", "_public").select(*urls.columns, "host", "address", "refused")
