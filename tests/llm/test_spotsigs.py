import hashlib
import itertools
import random

import pyarrow as pa
import pytest
import xxhash
from fixtures import documents, empty, words
from pyspark.sql import functions as F

from rallyframe.llm import spotsigs


def sets(texts):
    keys = spotsigs.signature_keys(pa.array(texts, pa.string())).tolist()
    out = [set() for _ in texts]
    for k in keys:
        out[k >> 32].add(k & 0xFFFFFFFF)
    return out


def likeness(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 1))
    out = []
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, n = r[1] or "", nxt[1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        a, b, c = sets([t, e, n])
        out.append((str(r[0]), len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{x:08x}" for x in sorted(a)), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out)


def compare(df, rows):
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())
    assert got == expected(rows)


def test_against_brute_force_in_one_and_many_ranges(spark):
    docs, rows = documents(spark)
    compare(spotsigs.fingerprint_with_next(docs), rows)
    compare(spotsigs.fingerprint_with_next(docs, bucket_bytes=500), rows)


def test_single_and_empty_tables(spark):
    one = spark.createDataFrame([(5, "the quick brown fox and the lazy dog")], "doc_id bigint, text string")
    compare(spotsigs.fingerprint_with_next(one), [(5, "the quick brown fox and the lazy dog")])
    assert spotsigs.fingerprint_with_next(empty(spark)).count() == 0


def test_hot_and_null_ids_are_cut(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 30)) for i in range(60)] + [(30, words(rng, 30)) for _ in range(80)] + [(None, words(rng, 30)) for _ in range(80)] + [(-9, "the same text of all")] * 30
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, _bucket int, _h int")
    compare(spotsigs.fingerprint_with_next(docs, bucket_bytes=600), rows)
    named = docs.select(F.col("doc_id").cast("int").alias("key"), F.col("text").alias("body"))
    assert spotsigs.fingerprint_with_next(named, "body", "key").columns[0] == "key"
    ranges, _ = spotsigs._ranges(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("_h")), 600, 1000)
    spread = {r._id: r.n for r in ranges.groupBy("_id").agg(F.countDistinct("_bucket").alias("n")).collect()}
    assert spread[30] > 8 and spread[None] > 8 and spread[5] == 1
    with pytest.raises(ValueError, match="whole number"):
        spotsigs.fingerprint_with_next(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_signatures_follow_anchors_by_hand():
    a, b, c, d = sets(["the alpha of beta gamma", "the alpha of beta gamma delta", "zz", "alpha beta gamma delta"])
    assert len(a) == 2 and a == b and len(c) == 1 and len(d) == 2
    assert sets(["zz"]) == sets(["ZZ"]) and sets([""]) == [set()]


def test_join_against_brute_force(spark):
    docs, rows = documents(spark)
    members, pairs = spotsigs.near_pairs(docs.where("doc_id IS NOT NULL"), least=0.8)
    own = {}
    for r, s in zip(rows, sets([r[1] for r in rows]), strict=True):
        if r[0] is not None:
            key = frozenset(s)
            own[key] = min(own.get(key, r[0]), r[0])
    want = {tuple(sorted((own[a], own[b]))) for a, b in itertools.combinations(own, 2) if a and b and likeness(a, b) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert members.count() == sum(r[0] is not None for r in rows)


def test_join_of_a_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    members, pairs = spotsigs.near_pairs(docs)
    own = {}
    texts = docs.select("doc_id", "text").collect()
    found = sets([r.text or "" for r in texts])
    for r, s in zip(texts, found, strict=True):
        own[frozenset(s)] = min(own.get(frozenset(s), r.doc_id), r.doc_id)
    want = {tuple(sorted((own[a], own[b]))) for a, b in itertools.combinations(own, 2) if a and b and 5 * len(a & b) >= 4 * len(a | b)}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert {r.doc_id: r.class_id for r in members.collect()} == {r.doc_id: own[frozenset(s)] for r, s in zip(texts, found, strict=True)}
