"""A cleaning pipeline over ``documents``: each stage works on all that the one before it kept and is written as Parquet.

Toxic documents go; of near copies the one with the smallest id stays; contaminated documents go; secrets in texts are
blotted out; what remains is encoded. All stages but the last return the columns of ``documents``, other columns of the input
are dropped. Null and empty texts pass every stage (in the second all texts without words are copies of each other), and an
empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import decontaminate, lattice_sample, near_copies, queries, secret_scan, toxicity
from rallyframe.llm.common import discard, scratch, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half. Null texts are scored as empty and stay null."""
    voters, _, linear = queries.toxicity_model(spark, sf_dir, docs)
    return toxicity.score(docs.select(*COLUMNS), voters, linear, keep=COLUMNS).where(F.col("score") < 0.5).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word shingles, proposed by SimHash and MinHash, Jaccard similarity 0.8
    or more verified): that of smallest id, null ids last; of equal ids, repeated rows too, one row.

    Texts without a word have no shingles, and so form one group.
    """
    return near_copies.one_of_each(docs, COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule does not reject."""
    judged = decontaminate.contamination(docs.select(*COLUMNS), queries.table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return judged.where(~F.col("contaminated")).select(*COLUMNS)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret's span replaced by a mark; n_chars follows where a text changed.

    Identifiers and endpoints beside a secret stay.
    """
    found = secret_scan.scan(docs.select(*COLUMNS), keep=COLUMNS).withColumn("gone", secret_scan.secrets(F.col("all_spans")))
    found = found.withColumn("blotted", secret_scan.redact(F.col("text"), F.col("gone")))
    n_chars = F.when(F.size("gone") > 0, F.char_length("blotted").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("blotted").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text with their piece ids, read back for round_trip."""
    return lattice_sample.sample_segmentations(docs, queries.tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", blot_secrets), ("encoding", encode)]

#: Scores, components and sampled segmentations have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage has written on its way, and its input, go once its result is complete."""
    docs = queries.table(spark, sf_dir, "documents").select(*COLUMNS)
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", stays=True)
        if before is not None:
            discard(before)
        before = docs
    return docs
