"""The registered queries themselves, on whole small tables: against SQL, the library, brute force, or held-out labels."""

import zlib

import numpy as np
import pytest
import xxhash
from fixtures import SCHEMA
from test_decontaminate import judge_by_windows
from test_secret_scan import base
from test_spotsigs import expected

from rallyframe.llm import queries, secret_scan

from tests.oracle import connection, spark_rows, sql_rows

SMALL, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def texts(spark, sf_dir=SMALL):
    return {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    con = connection(SMALL)
    sql = sql_rows(con, queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, SMALL)
    assert spark_rows(found.select(*sql[0])) == sql


def auc(scores, labels):
    one, zero = (np.array([s for s, y in zip(scores, labels, strict=True) if y == v]) for v in (1, 0))
    return float(np.mean((one[:, None] > zero) + 0.5 * (one[:, None] == zero)))


@pytest.mark.parametrize(("name", "label", "folds", "fold", "least"), [("op3_toxicity", "toxic", 5, 0, 0.8), ("op9_quality", "quality", 3, 1, 0.95)])
def test_models_on_held_out_rows(spark, name, label, folds, fold, least):
    rows = queries.QUERIES[name](spark, NEXT).collect()
    docs = texts(spark, NEXT)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    by_text = {}
    for r in rows:
        by_text.setdefault(docs[r.doc_id], set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    known = {r.doc_id: r[label] for r in queries.table(spark, NEXT, "labels").select("doc_id", label).collect()}
    held = [(r.score, known[r.doc_id]) for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert auc(*zip(*held, strict=True)) > least


def simhash(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op4_against_all_pairs(spark):
    docs = texts(spark)
    fp = {i: simhash(t) for i, t in docs.items()}
    root = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if (fp[a] ^ fp[b]).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in docs}


def test_op5_ids_decode_to_the_texts(spark):
    rows, docs = queries.op5_sentencepiece(spark, SMALL).collect(), texts(spark)
    assert {r.doc_id for r in rows} == set(docs) and all(r.round_trip for r in rows)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    for r in rows[::7]:
        assert sp.decode(list(r.ids)).strip() == (docs[r.doc_id] or "").strip()
    twice = {}
    for r in rows:
        twice.setdefault(r.doc_id, []).append(tuple(r.ids))
    assert all(len(set(x)) == len(x) for x in twice.values())


def test_op6_to_op8_against_brute_force(spark):
    docs = texts(spark)
    for r in queries.op6_secret_scan(spark, SMALL).collect():
        want = [f"{k}:{s}:{e}" for s, _, k, e in base(docs[r.doc_id])]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in secret_scan.KINDS)
        assert set(want) <= set(r.spans.split(",")) | {""}
    items = [tuple(r) for r in queries.table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    judged, found = judge_by_windows(items), queries.op7_decontaminate(spark, SMALL).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for r in found:
        assert tuple(r)[1:6] == judged(docs[r.doc_id])
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    for r in queries.op8_token_count(spark, SMALL).collect():
        n = len(library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), n, n > 512)


def test_op10_against_brute_force(spark):
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in queries.op10_spotsigs(spark, SMALL).collect())
    assert got == expected(list(texts(spark).items()))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("pages", "conversations", "benchmark", "labels"):
        queries.table(spark, SMALL, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "op2_chat_format" else 0)
