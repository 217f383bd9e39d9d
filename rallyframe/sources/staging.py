"""A folder all machines share, for tables and text files written on the way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def staged(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's checkpoint folder; where it names none a temporary folder serves a local session, and no other."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = getattr(staged, "own", None)
        if base is None:
            base = staged.own = tempfile.mkdtemp(prefix="rallyframe-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
