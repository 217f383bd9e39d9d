"""Cases of the third round's findings, on the smallest tables with rows changed."""

from __future__ import annotations

import os
import pathlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from rallyframe.llm import near_copies
from rallyframe.operators import identity, rows, store
from rallyframe.plans.catalog import ORACLE_SQL, QUERIES
from rallyframe.streaming import admission

from .oracle import TABLES, connection, spark_rows, sql_rows

SMALL = "/root/testdata/sf0.001"


def changed(folder, **selects: str) -> str:
    """A folder of the smallest tables, those named made by a SELECT over all of them."""
    con = connection(SMALL)
    for t in TABLES:
        if t in selects:
            con.execute(f"COPY ({selects[t]}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SMALL}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def agrees(spark, name: str, folder: str) -> list[tuple]:
    found = spark_rows(QUERIES[name](spark, folder))
    assert found == sql_rows(connection(folder), ORACLE_SQL[name])
    return found[1]


def test_customers_without_orders(spark, tmp_path):
    agrees(spark, "jon05_latest_status", changed(tmp_path, orders="SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_custkey % 3 > 0"))


def test_references_without_semicolon(spark, tmp_path):
    ends = ["&amp", "&amp;", "&am", "&", "&ampx", "&amp;lt", "&amp;lt;", "&lt", "&lt;b&gt;", "&quot;x&quot", "&&amp;&amp", "AT&T", "&x;", "&ampx;", "&#", "& amp;"]
    pages = " UNION ALL ".join(f"SELECT {i} AS page_id, 'u' AS url, '<p>x&amp</p><a href=\"?a=1&amp;b&amp\">l</a><h1 class=\"h\">a {e}</h1><p>z' AS html" for i, e in enumerate(ends))
    found = agrees(spark, "src19_first_heading", changed(tmp_path, pages=pages))
    assert ("a &amp", "0") in found and ("a &", "1") in found


def test_pages_come_in_small_batches(spark, tmp_path):
    before = "10000"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    try:
        pages = "SELECT CAST(i AS bigint) AS page_id, 'u' AS url, concat('<p>', i, '</p>') AS html FROM range(3000) AS r(i)"
        found = QUERIES["src20_paragraphs"](spark, changed(tmp_path, pages=pages))
        assert sorted(tuple(r) for r in found.collect()) == [(i, str(i)) for i in range(3000)]
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_key_columns_travel_once(spark):
    df = spark.createDataFrame([(2, "a", "x", 1.0), (1, "a", "z", 2.0), (1, "a", "y", 3.0), (5, None, "q", 0.0), (4, None, "r", -0.0)], "seq int, k string, v string, d double")
    found = rows.first_seen(df, ["k"], ["seq"])
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "a", "y", 3.0), (4, None, "r", -0.0)]
    shuffled = found._jdf.queryExecution().optimizedPlan().toString()
    assert "seq, seq" in shuffled and "k, k" not in shuffled
    assert {tuple(r) for r in rows.first_seen(df, ["d"], ["seq"]).select("seq", "k").collect()} == {(2, "a"), (1, "a"), (4, None)}


def test_links_of_a_dense_group_are_contracted(spark):
    edges = [(a, b) for a in range(40) for b in range(a + 1, 40)] + [(100, 101), (101, 102), (100, 103), (102, 103)]
    few = [tuple(r) for r in near_copies.contracted(spark.createDataFrame(edges, "a bigint, b bigint")).collect()]
    assert len(few) == len(set(few)) <= 39 + 4 and all(a < b for a, b in few)
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in few:
            root[a] = root[b] = min(root[a], root[b])
    assert {x: 0 if x < 40 else 100 for x in root} == root


def test_fan_out_comes_in_runs_that_a_file_stores_in_little(spark, tmp_path):
    e = spark.range(6000).select("id", (F.col("id") * 7919 % 3).alias("team"))
    u = spark.range(600).select((F.col("id") * 31).alias("user"), (F.col("id") % 3).alias("team"))
    got = rows.fan_out(e, u, "team", pieces=4).select("id", "user")
    got.write.parquet(f"{tmp_path}/pairs")
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 500_000  # 1.2 million pairs
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    assert pairs.count() == pairs.distinct().count() == e.join(u, "team").join(pairs, ["id", "user"]).count() == 1_200_000


def test_fan_out_keeps_null_values_and_equal_rows(spark):
    e = spark.createDataFrame([(None, 1), (5, 1), (5, 1), (6, None)], "id int, team int")
    u = spark.createDataFrame([(None, 1), (2, 1), (3, None)], "user int, team int")
    want = [(i, 1, n) for i in (None, 5, 5) for n in (None, 2)]
    assert sorted(map(str, (tuple(r) for r in rows.fan_out(e, u, "team").select("id", "team", "user").collect()))) == sorted(map(str, want))


def test_waiting_jobs_and_events_are_held_in_few_bytes():
    import sys

    pool = admission.Pool(running=[(0, 0, 1, True)])
    for n in range(100_000):
        pool.ask(n, n % 7, n % 16 + 1, n % 50 == 0)
    assert not hasattr(pool.queue, "__len__") and sum(map(sys.getsizeof, (pool.queue.jobs, pool.queue.sources, pool.queue.codes))) < 2_500_000
    assert sum(map(len, pool.queue.packed())) == 1_700_000 and admission.EVENT.itemsize == 35


def test_jobs_leave_the_middle_of_the_queue_in_order():
    rng, q, plain = random.Random(3), admission.Queue(), []
    for n in range(3000):
        q.add(n, n % 5, n % 16 + 1, n % 9 == 0)
        plain.append(n)
        if rng.random() < 0.6 and plain:
            i = rng.randrange(min(4, len(plain)))
            q.remove(q.first + i)
            del plain[i]
    again = admission.Queue(*q.packed())
    assert again.jobs.tolist() == plain and again.sources.tolist() == [n % 5 for n in plain]
    assert again.codes.tolist() == [(n % 16 + 1) * 2 + (n % 9 == 0) for n in plain]


def test_store_keeps_digests_in_half_their_length(spark):
    kept = store.HashStore(spark, "k", buckets=2)
    batch = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("k"))
    assert kept.insert(batch, ["id"])[1:] == (20_000, 0)
    assert sum(f.stat().st_size for f in pathlib.Path(kept.path).glob("*.parquet")) < 20_000 * 50  # 64 characters each
    kept.drop()


def test_canonical_rows_are_compiled_by_the_jvm(spark):
    found = QUERIES["prj04_canonical_row"](spark, SMALL)
    code = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "codegen")
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000  # longer methods are interpreted


def test_canonical_texts_lose_white_space_of_any_kind_at_their_ends(spark):
    white = [chr(i) for i in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    texts = ["", " ", "\r\n", "\n \xa0", "a", "~", " a  b ", "a\r\nb", "é", "\xa0é\u3000é  ", "\x1c a\x1f", "\u200ba\u200b", "\x7f", " 😀 "]
    texts += [f for w in white for f in (w, f"{w}a{w}b{w}", f"é{w}", f" {w}\n~")]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, date string")
    want = {i: re.sub("[\r\n]", " ", t).strip("".join(white)) for i, t in enumerate(texts)} | {-1: ""}
    assert dict(map(tuple, identity.canonical_row(df, ["date"], "id").collect())) == want


def test_widened_copies_and_genders(spark):
    df = spark.createDataFrame([(1, " d\n", "Singles", None, "F"), (2, None, None, " ", "M"), (3, "e", "", "x", None)], "k int, tournament_date string, draw_team_type string, draw_gender string, tournament_gender string")
    wide = identity.widened(df, "k")
    assert wide.columns == ["k", *identity.CANONICAL]
    shown = wide.select("k", "date", "tournament_start_date", "tournament_end_date", "draw_team_type", "draw_type", "draw_gender", "ball_type", "score")
    assert sorted(map(tuple, shown.collect())) == [(1, *[" d\n"] * 3, "Singles", "Singles", "F", "Yellow", ""), (2, *[""] * 5, " ", "Yellow", ""), (3, *["e"] * 3, "", "", "x", "Yellow", "")]
