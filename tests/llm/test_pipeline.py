"""Each stage of the pipeline against a brute-force version, with nulls, repeated rows and ids, long texts and clashing names."""

import os
import re

import corpus_pipeline
import pytest
from fixtures import SCHEMA, documents, empty
from pyspark.sql import functions as F
from test_decontaminate import judge_by_windows
from test_near_copies import expected
from test_secret_scan import EXTRA, base

from rallyframe.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with awkward rows added to the documents."""
    at = tmp_path_factory.mktemp("sf")
    for name in ("benchmark", "labels"):
        os.symlink(f"{SMALL}/{name}.parquet", at / f"{name}.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("text IS NOT NULL").orderBy("item_id").first().text
    extra = [*EXTRA, f"Before. {item} After.", item.upper(), "you stupid worthless idiot, shut up you pathetic moron " * 3, "w " * 200_000]
    docs, rows = documents(spark, extra=extra)
    rows = [(r[0] and r[0] + 10**6, *r[1:]) for r in rows]
    rows = [*rows, rows[0], rows[0], rows[5], *(tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect())]
    spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("spans", F.lit(1)).write.parquet(str(at / "documents.parquet"))
    return str(at), rows


def plain(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_toxic_documents_go(spark, folder):
    at, rows = folder
    docs = queries.table(spark, at, "documents")
    bad = {r.doc_id for r in queries.op3_toxicity(spark, at).collect() if r.predicted}
    scored = corpus_pipeline.queries.toxicity.score(docs.select("doc_id", "text"), *[queries.toxicity_model(spark, at, docs)[i] for i in (0, 2)], keep=("doc_id", "text")).collect()
    gone = {(r.doc_id, r.text) for r in scored if r.score >= 0.5}
    assert {i for i, _ in gone} == bad and bad
    assert plain(corpus_pipeline.reject_toxic(spark, docs, at)) == sorted((r for r in rows if (r[0], r[1]) not in gone), key=str)


def test_one_of_each_group_stays(spark, folder):
    at, rows = folder
    kept = plain(corpus_pipeline.drop_near_copies(spark, queries.table(spark, at, "documents"), at))
    assert sorted((r[0] for r in kept), key=str) == expected(rows) and set(kept) <= set(rows)


def test_contaminated_documents_go(spark, folder):
    at, rows = folder
    items = [tuple(r) for r in queries.table(spark, at, "benchmark").select("item_id", "text").collect()]
    docs, judged = spark.createDataFrame(rows, SCHEMA), judge_by_windows(items)
    want = [r for r in rows if not judged(r[1])[4]]
    assert plain(corpus_pipeline.drop_contaminated(spark, docs, at)) == sorted(want, key=str) and len(want) < len(rows)


def test_secrets_are_blotted_out(spark, folder):
    at, rows = folder
    got = plain(corpus_pipeline.blot_secrets(spark, queries.table(spark, at, "documents"), at))
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r[0], []).append(r)
    for i, t, lang, source, n in rows:
        mine = [x for x in texts[i] if x[2:4] == (lang, source)]
        spans = base(t)
        if not spans and not re.search(r"(?i)user|account|https?:", t or ""):
            assert (i, t, lang, source, n) in mine
        elif spans:
            assert any(x[4] == len(x[1]) and "[SECRET]" in x[1] and not any(t[s:e] in x[1] for s, _, _, e in spans) for x in mine)


def test_encoded_texts_read_back(spark, folder):
    at, rows = folder
    got = corpus_pipeline.encode(spark, queries.table(spark, at, "documents"), at).collect()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    assert {str(r.doc_id) for r in got} == {str(r[0]) for r in rows}


def test_whole_run_and_what_it_leaves(spark, folder):
    at, rows = folder
    base_dir = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base_dir)) if os.path.isdir(base_dir) else set()
    got = corpus_pipeline.run(spark, at)
    docs = queries.table(spark, at, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, at), "by-hand")
    fields = ("doc_id", "sample", "ids_xxh64")
    assert sorted(map(str, got.select(*fields).collect())) == sorted(map(str, docs.select(*fields).collect()))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(base_dir)) - before}
    assert "stage-encoding" in left and not {x for x in left if x.startswith("stage-")} - {"stage-encoding"} and "scratch" not in left


def test_empty_table(spark, folder):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[0])
        assert docs.count() == 0
