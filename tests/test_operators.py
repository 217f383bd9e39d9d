"""Operators on hand-made rows: the edge cases that the tables do not hold."""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from rallyframe.operators import declared, evidence, identity, pages, rows, store, windows
from rallyframe.plans.catalog import QUERIES
from rallyframe.sources import files, html
from rallyframe.streaming import flows


def match(date, players, score="6-3;", teams=("A", "B"), gender="Male"):
    return (date, gender, "MS", "Doubles", *players, score, *teams)


def hashes(spark, data):
    df = spark.createDataFrame(data, "d string, g string, w string, k string, p1 string, p2 string, p3 string, p4 string, s string, t1 string, t2 string")
    c = F.col
    return [r[0] for r in df.select(identity.identity_hash(c("d"), c("g"), c("w"), c("k"), [c("p1"), c("p2")], [c("p3"), c("p4")], c("s"), c("t1"), c("t2"))).collect()]


def test_identity_ignores_partners_order_and_spelling(spark):
    ana = match("2026-05-04", ("Ana  B", "Bo C", "Di E", "Fe G"))
    one, partners, rematch, swapped, teams, joined = hashes(spark, [ana, match("5/4/26", ("bo c", "ANA B", "Fe G", "Di E"), "6-3", ("a", " b")), match("2026-05-05", ana[4:8]), match("2026-05-04", ("Di E", "Fe G", "Ana B", "Bo C")), match("2026-05-04", ana[4:8], teams=("B", "A")), match("2026-05-04", ("Ana B", "", "Bo C", "Di E"))])
    assert one == partners and len({one, rematch, swapped, teams, joined}) == 5


def test_identity_is_the_digest_of_its_nine_parts(spark):
    got = hashes(spark, [match("May 4, 1999", ("Bo C", "Ana  B", None, "Di E"), " 6-3, 6-4 ;", ("Team  A", None), "Female")])
    parts = ["1999-05-04", "f", "ms", "doubles", "ana b|bo c", "di e", "6-3,6-4", "team a", ""]
    assert got == [hashlib.sha256("\x1f".join(parts).encode()).hexdigest()]


def test_identity_of_nulls(spark):
    a, b = hashes(spark, [match(None, (None, "", None, None), None, (None, None), None), match("", ("", "", "", ""), "", ("", ""), "")])
    assert a == b and len(a) == 64


def test_store_takes_each_match_once(spark):
    kept = store.HashStore(spark, "k", buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "n int, k string")
    new, count, skipped = kept.insert(first, ["n"])
    assert {tuple(r) for r in new.collect()} == {(1, "a"), (2, "b")} and (count, skipped) == (2, 1)
    assert kept.insert(first, ["n"])[1:] == (0, 3)
    more = spark.createDataFrame([(4, "b"), (5, "c")], "n int, k string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = kept.unseen(more, ["n"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert kept.insert(more, ["n"])[1:] == (1, 1)
    assert sorted(tuple(r) for r in kept.table().collect()) == [(1, "a"), (2, "b"), (5, "c")]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # between the join and the stored table there is a sort and no exchange
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan and "Exchange" not in plan[plan.rindex("Sort [") :]
    kept.drop()


def test_first_seen_and_only_new(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, None, "z"), (2, None, "z")], "n int, k string, v string")
    assert {(r.k, r.n, r.v) for r in rows.first_seen(df, [F.col("k")], ["n"]).collect()} == {("a", 1, "y"), (None, 2, "z")}
    assert rows.only_new(df, df.where("k = 'a'").select("k"), "k", ["n"]).select("v").collect()[0].v == "z"
    assert rows.first_seen(df.limit(0), [F.col("k")], ["n"]).count() == 0


def test_conflicts_go_blank_in_any_order(spark):
    df = spark.createDataFrame([("a", "x"), ("a", ""), ("a", "x"), ("b", "x"), ("b", "y"), ("b", "x"), ("c", None)], "k string, v string")
    assert {r.k: r.v for r in df.groupBy("k").agg(evidence.agreeing(F.col("v")).alias("v")).collect()} == {"a": "x", "b": "", "c": ""}


def test_majority(spark):
    """A side without opposition decides, one vote too; two against one does not, three against one does."""
    votes = {"alone": "F", "empty": " ", "2:1": "MMF", "3:1": "MMMF", "0:2": "FF", "tie": "MF"}
    data = [(g, f"{g}{i}", v) for g, vs in votes.items() for i, v in enumerate(vs)] + [("both", "p", "M"), ("both", "p", "F"), ("both", "q", "F"), ("other", "p", "X"), ("other", "q", "M")]
    df = spark.createDataFrame(data, "g string, p string, v string")
    assert {r.g: r.verdict for r in evidence.majority(df, ["g"], "p", "v", ("M", "F")).collect()} == {"alone": "F", "2:1": "", "3:1": "M", "0:2": "F", "tie": "", "both": "F", "other": "M"}


def test_genders_are_written_over(spark):
    columns = [*evidence.DRAW_KEY, "draw_gender", *(f"{s}_{c}" for s in evidence.SLOTS for c in ("name", "gender"))]
    data = [
        ("u", "Open", "Group 1", "Singles", "Male", "Ana", "F", "", "", "Bo", "M ", None, None),
        ("u", "Open", "Group 1", "Singles", "Male", "Cy", "F", "", "", "Di", "F", None, None),
        ("u", "Open", "Group 1", "Singles", "", "Bo", "F", "", "x", "Eve", "F", None, None),
        ("u", "Girls Cup", "Group 1", "Singles", "Male", "Ana", "M", "", "", "Bo", "M", None, None),
        ("u", "Open", "Mixed", "Singles", None, "Ana", "M", "", "", "Bo", "M", None, None),
        ("v", "Open", "Group 1", None, None, "Ana", "M", "", "", "Bo", "F", None, None),
    ]
    got = evidence.back_fill_genders(spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))).orderBy("tournament_url", "tournament_name", "draw_name", "winner_1_name").collect()
    found = [(r.draw_gender, r.winner_1_gender, r.winner_2_gender, r.loser_1_gender, r.changed) for r in got]
    assert found == [("Male", "M", "", "M", 0), ("Female", "F", "", "F", 2), ("Female", "F", "x", "F", 1), ("Female", "F", "", "F", 1), (None, "M", "", "M", 0), (None, "M", "", "F", 0)]


def test_pages_clamp(spark):
    df = spark.range(23)
    assert [r.id for r in rows.page(df, [F.col("id")], 99, 10).collect()] == [20, 21, 22]
    assert rows.page(df.limit(0), [F.col("id")], 3, 10).count() == 0


def test_fan_out_splits_a_team_with_most_events(spark):
    e = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 40).when(F.col("id") % 3 == 1, 7).alias("team"))
    u = spark.createDataFrame([(n, n % 50) for n in range(200)] + [(999, None)], "user int, team bigint")
    got = rows.fan_out(e, u, "team", pieces=8)
    teams = {r.id: r.team for r in e.collect()}
    members = {}
    for r in u.collect():
        members.setdefault(r.team, []).append(r.user)
    assert sorted((r.id, r.user, r.team) for r in got.collect()) == sorted((i, n, t) for i, t in teams.items() if t is not None for n in members[t])
    assert sorted(got.columns) == ["id", "team", "user"]
    assert rows.fan_out(e.limit(0), u, "team").count() == 0


def test_a_value_that_most_rows_share_is_cut_by_the_next_column(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, F.col("id") % 100).otherwise(50).alias("a"), F.lit(2).alias("t"))
    sizes = {r["b"]: r["count"] for r in df.groupBy(rows.range_of(df, "a", "id", 16).alias("b")).count().collect()}
    assert max(sizes.values()) < 700 and max(r["count"] for r in df.groupBy(rows.range_of(df, "a", None, 16).alias("b")).count().collect()) >= 3000
    got = rows.numbered(df, "a", [F.col("a"), F.col("id")], total_of="t", ranges=16, then="id").collect()
    assert [(r.a, r.id) for r in sorted(got, key=lambda r: r.place)] == sorted((r.a, r.id) for r in got)
    assert sorted(r.place for r in got) == list(range(1, 4001)) and all(r.total == 2 * r.place for r in got)
    assert rows.numbered(df.limit(0), "a", [F.col("a"), F.col("id")], then="id").count() == 0


def test_numbered_is_a_total_order(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), "id")
    got = sorted((r.place, r.a, r.id) for r in rows.numbered(df, "a", [F.col("a"), F.col("id")], ranges=5).collect())
    assert [p for p, *_ in got] == list(range(1, 5001))
    assert [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_guarded_delete_and_update(spark):
    df = spark.createDataFrame([(1, "done"), (2, "running"), (3, None)], "id int, s string")
    kept, gone = rows.delete_by_ids(df, spark.createDataFrame([(1,), (2,), (1,)], "id int"), "id", F.col("s") != "running")
    assert {r.id for r in kept.collect()} == {2, 3} and {r.id for r in gone.collect()} == {1}
    assert [r.s for r in rows.update_where(df, F.col("s") == "done", s=F.lit("old")).orderBy("id").collect()] == ["old", "running", None]


def test_replace_all_guard(spark):
    assert rows.replace_all(spark.range(100), spark.range(89)).count() == 100
    assert rows.replace_all(spark.range(100), spark.range(90)).count() == 90
    assert rows.replace_all(spark.range(11), spark.range(9)).count() == 11 and rows.replace_all(spark.range(11), spark.range(9), True).count() == 9
    assert rows.replace_all(spark.range(0), spark.range(1)).count() == 1
    with pytest.raises(rows.Refused):
        rows.replace_all(spark.range(0), spark.range(0))


def test_csv_with_bom_aliases_and_guard(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Full Name,Home-Town,x\n"Lee, Ana",Split,1\nBo,,2\n', encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), ["full_name", "home_town", "club"])
    assert [tuple(r) for r in got.collect()] == [("Lee, Ana", "Split", ""), ("Bo", "", "")]
    files.write_csv(spark.createDataFrame([("=1+1", None)], "player_id string, note string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.csv"))
    assert text.splitlines()[0] == "Player ID,Note" and "'=1+1" in text


def test_registry_checks(spark, tmp_path):
    (tmp_path / "r.csv").write_text("ID,Name\n1,a\n2,b,c\n3,d\n")
    assert [r.id for r in files.read_registry(spark, str(tmp_path / "r.csv"), ["id", "name"]).collect()] == ["1", "3"]
    (tmp_path / "s.csv").write_text("ID,Name,City,Day,Month,Year,Gender\n1,a,x,1,2,2000,F\n2,Bo\n3,Cy,Lyon,x,1,1,M,9\n4,d,,,,,\n")
    assert [r.id for r in files.read_registry(spark, str(tmp_path / "s.csv"), ["id", "name"]).collect()] == ["1", "4"]
    with pytest.raises(ValueError, match="club"):
        files.read_registry(spark, str(tmp_path / "r.csv"), ["id", "club"])


def test_utf16_is_sniffed(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("id,name\n1,é\n".encode("utf-16"))
    path = str(tmp_path / "u.csv")
    assert files.headers(spark, path, None) == {("UTF-16", "id,name"): [f"file:{path}"]}
    assert files.read_csv(spark, path, ["id", "name"], encoding="UTF-16").first().name == "é"


def test_files_of_several_encodings(spark, tmp_path):
    for name, text, encoding in (("a", "id,name\n1,é\n", "utf-16-le"), ("b", "name,ID\né,2\n", "utf-16-be"), ("c", "id,name\n3,é\n", "utf-8-sig"), ("d e%20", "id,name\n4,é\n", "utf-8"), ("f", "\r\n\r\nid,name\r\n5,é\r\n", "utf-8"), ("g", "", "utf-8"), ("h", "\n\n", "utf-8")):
        mark = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}.get(encoding, b"")
        (tmp_path / f"{name}.csv").write_bytes(mark + text.encode(encoding))
    with gzip.open(tmp_path / "z.csv.gz", "wb") as f:
        f.write("id,name\n6,é\n".encode())
    (tmp_path / "w.csv").write_text("id," + ",".join(f"column {i}" for i in range(5000)) + ",name\n7," + "," * 5000 + "é\n")
    for lines in (True, False):
        got = sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path), ["id", "name"], encoding=None, multi_line=lines).collect())
        assert got == [(str(i), "é") for i in range(1, 8)]


def test_only_the_beginning_of_a_file_is_read_for_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n" + "1,x\n" * 400_000)
    jobs = spark.sparkContext.statusTracker()
    before = set(jobs.getJobIdsForGroup(None))
    assert list(files.headers(spark, str(tmp_path), None)) == [("UTF-8", "id,name")]
    assert set(jobs.getJobIdsForGroup(None)) == before


def test_xml_feed_and_broken_file(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<F><Match id="1" name="x"/><Match id="2" name="y"></Match></F>')
    (tmp_path / "b.xml").write_text("<F><Mat")
    (tmp_path / "c.xml").write_text('<F>\n<Match\n id="3" name="z">\n</Match><Match id="4" name="a&b"/><Other id="5"/><Match id="6"')
    rows_, bad = files.read_xml(spark, str(tmp_path), "Match", "id int, name string")
    assert sorted(r.id for r in rows_.collect()) == [1, 2, 3]
    assert sorted(r.raw[:13] for r in bad.collect()) == ['<Match id="4"', '<Match id="6"']


def test_large_xml_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.xml").write_text("<F>" + "".join(f'<Match id="{i}" name="{"x" * 90}"/>\n' for i in range(20_000)) + "</F>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        rows_, _ = files.read_xml(spark, str(tmp_path), "Match", "id int, name string")
        assert rows_.rdd.getNumPartitions() >= 4 and sorted(r.id for r in rows_.collect()) == list(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_html_tolerates_unclosed_tags(spark):
    page = '<div class="a b">One <b>two<div class="a">in</div></div><p>x<p class="a">y &amp; z<script>no</script>'
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    got = [r.t for r in df.select(html.element_texts("div", "a")("h").alias("t")).collect()]
    assert got == [["One twoin", "in"], [], []]
    assert df.select(html.first_text("p", "a")(F.col("h")).alias("t")).first().t == "y & z"


def test_gate_holds_between_thresholds(spark):
    df = spark.createDataFrame([(i, "q", n) for i, n in enumerate([5, 30, 20, 11, 10, 29, 31])], "i int, q string, n int")
    assert [r.open for r in df.withColumn("open", flows.gate(F.col("n"), ["i"], "q", 30, 10)).orderBy("i").collect()] == [True, False, False, False, True, True, False]


def test_updates_of_several_micro_batches_are_kept(spark, tmp_path):
    for n, q in enumerate("ab"):
        spark.createDataFrame([(q, n, "start")], "q string, n int, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))

    def flow(e):
        return e.groupBy("q").agg(F.count("*").alias("n"))

    reader = type(spark.readStream)
    plain = reader.parquet
    try:
        reader.parquet = lambda self, path: plain(self.option("maxFilesPerTrigger", 1), path)
        got = flows.drained(spark, str(tmp_path / "e"), flow, "update", ("q",)).collect()
    finally:
        reader.parquet = plain
    assert {r.q for r in got} == {"a", "b"}


def test_csv_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,City\nAna,Porto\n")
    (tmp_path / "b.csv").write_text('City,Name\n"Ly\non",Bo\n')
    (tmp_path / "c.csv").write_text("name\nCy\n")
    (tmp_path / "d.csv").write_text("")
    for lines in (True, False):
        if not lines:
            (tmp_path / "b.csv").write_text("City,Name\nLyon,Bo\n")
        got = sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path), ["name", "city"], multi_line=lines).collect())
        assert got == [("Ana", "Porto"), ("Bo", "Ly\non" if lines else "Lyon"), ("Cy", "")]


def test_fuzzy_names(spark):
    a = spark.createDataFrame([(1, "Ana Maria Lopez"), (2, "Bo"), (3, "")], "a int, n string")
    b = spark.createDataFrame([(7, "lopez ANA"), (8, "Bo Derek"), (9, "Maria Silva")], "b int, m string")
    assert {tuple(r) for r in evidence.fuzzy_names(a, b, "a", "b", "n", "m").collect()} == {(1, 7), (2, 8)}


def test_fuzzy_names_against_all_pairs(spark):
    words = ["de", "la", "ana", "bo", "cruz", "silva"]
    names = [" ".join(words[j] for j in range(6) if i >> j & 1 or j == i % 3) for i in range(64)] + ["de", "", "ana", "7"]
    a = spark.createDataFrame(list(enumerate(names)), "a int, n string")
    b = spark.createDataFrame(list(enumerate(reversed(names))), "b int, m string")
    sets = [{t for t in n.split() if t != "7"} for n in names]
    wanted = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(reversed(sets)) if x and y and (x <= y or y <= x or len(x & y) > 1)}
    got = [tuple(r) for r in evidence.fuzzy_names(a, b, "a", "b", "n", "m").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_pages_end_where_they_should(spark):
    data = [("a", p, k) for p, n in ((0, 2), (1, 2), (2, 1), (3, 2)) for k in range(n)] + [("b", 1, 0), ("b", 2, 1)] + [("c", 0, 0), ("c", 0, 1)]
    df = spark.createDataFrame(data, "s string, p bigint, k int")

    def kept(found):
        return sorted({(r.s, r.p) for r in found.collect()})

    assert kept(pages.until_short(df, "s", "p", 2)) == [("a", 0), ("a", 1), ("a", 2), ("c", 0)]
    assert kept(pages.until_empty(df, "s", "p")) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("c", 0)]
    assert kept(pages.until_nothing_new(df, "s", "p", "k")) == [("a", 0), ("c", 0)]
    assert pages.until_short(df.limit(0), "s", "p", 2).count() == 0
    urls = spark.createDataFrame([("https://A.Example.org:8/x", True), ("http://example.org.evil.com/", False), ("http://u:p@example.org", True), ("ftp://example.org", False), ("http://x@evil.com/example.org", False), (None, False), ("", False)], "u string, w boolean")
    assert all(r.got == r.w for r in urls.withColumn("got", pages.host_allowed(F.col("u"), ("example.org",))).collect())


def test_carried_values_of_a_hot_key(spark):
    rng = random.Random(6)
    data = [("hot" if i % 2 else rng.choice(["a", "b", None]), rng.randrange(500), i, rng.choice([None, None, None, i])) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, t int, id int, v int")
    got = {r.id: r.last for r in rows.carried(df, "k", ["t", "id"], F.col("v"), "last", ranges=9).collect()}
    seen, want = {}, {}
    for k, _, i, v in sorted(data, key=lambda x: x[1:3]):
        seen[k] = v if v is not None else seen.get(k)
        want[i] = seen[k]
    assert got == want and len(got) == len(data)
    assert rows.carried(df.limit(0), "k", ["t", "id"], F.col("v"), "last").count() == 0


def test_windows_are_halved_at_the_cap(spark):
    rng = random.Random(2)
    start = dt.date(2024, 1, 1)
    data = [(start + dt.timedelta(days=int(rng.betavariate(2, 5) * 60)), rng.choice("xy")) for _ in range(300)] + [(start + dt.timedelta(days=9), "z")] * 30 + [(None, "x")]

    def leaves(a, b):
        inside = [r for d, r in data if d and a <= d <= b]
        if len(inside) < 12:
            return [(a, b, "", len(inside), False)]
        if a == b:
            return [(a, b, r, inside.count(r), inside.count(r) >= 12) for r in sorted(set(inside))]
        middle = a + (b - a) // 2
        return leaves(a, middle) + leaves(middle + dt.timedelta(days=1), b)

    days = [d for d, _ in data if d]
    got = windows.bisected(spark.createDataFrame(data, "d date, r string"), "d", "r", 12)
    assert sorted(map(tuple, got.collect())) == sorted(leaves(min(days), max(days)))
    assert windows.bisected(spark.createDataFrame(data, "d date, r string").where("d IS NULL"), "d", "r", 12).count() == 0


def test_order_of_play(spark):
    ties = spark.createDataFrame([(1, "A", "B", "Final", 1), (1, "B", "A", "Semi", 2), (1, "A", "", "x", 3), (1, "A", "A", "x", 4), (2, "A", "B", None, 1)], "draw int, a string, b string, round string, seq int")
    sheets = spark.createDataFrame([(1, "M", " Under  14", None), (2, "", "", "Boys singles")], "draw int, event_code string, age string, event string")
    data = [(1, "B", "A", "M", "UNDER 14", "Girls", "G", "C"), (2, "A", "B", "M", "Under 16", "", "G", "C"), (3, "A", "B", None, None, "BOYS  Singles", "", "C"), (4, "A", "A", "M", "", "", "", ""), (5, "A", "C", "M", "", "", "", ""), (6, "A", "B", "M", None, None, "G", None)]
    scheduled = spark.createDataFrame(data, "id int, a string, b string, event_code string, age string, event string, round_group string, classification string")
    got = sorted(tuple(r) for r in evidence.order_of_play(scheduled, ties, sheets).collect())
    assert got == [(1, 1, "Semi"), (1, 6, "Semi"), (2, 2, "G"), (2, 3, "C"), (2, 6, "G")]


def test_member_ids(spark):
    data = [(" 007 ", "x"), ("007", ""), ("7", "y"), ("", "z"), (None, "z"), ("a\ufffd", "z"), ("9" * 255, "k"), ("9" * 256, "k")]
    got = evidence.merged_members(spark.createDataFrame(data, "id string, v string"), "id", ["v"]).collect()
    assert {r.id: r.v for r in got} == {"007": "x", "7": "y", "9" * 255: "k"}


def test_registry_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Name,id \n1,a,2\n")
    with pytest.raises(ValueError, match="duplicate columns: id"):
        files.read_registry(spark, str(tmp_path / "a.csv"), ["name"])
    (tmp_path / "b.csv").write_text("ID,Name\n1,a\n2\n3,b,c\n004,d\n")
    with pytest.raises(ValueError, match="missing columns: born, club"):
        files.read_registry(spark, str(tmp_path / "b.csv"), ["born", "id", "club"])
    assert sorted(tuple(r) for r in files.read_registry(spark, str(tmp_path / "b.csv"), ["name", "id"]).collect()) == [("a", "1"), ("d", "004")]


def paragraphs(page):
    """Texts of all p elements: a tag that is not closed ends with the one around it. Tags are found by a pattern."""
    page = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b.*?</\1\s*>", "", page or "")
    open_, out, at = [], [], 0
    for m in [*re.finditer(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", page), None]:
        for _, n in open_:
            if n is not None:
                out[n] += page[at : m.start() if m else len(page)]
        if m is None:
            break
        at, tag = m.end(), m[2].lower()
        if m[1]:
            found = [i for i, (t, _) in enumerate(open_) if t == tag]
            if found:
                del open_[found[-1] :]
        elif tag not in ("br", "img", "hr", "meta", "link", "input"):
            if tag == "p":
                out.append("")
            open_.append((tag, len(out) - 1 if tag == "p" else None))
    return [" ".join(unescape(t).split()) for t in out]


def test_paragraphs_of_all_pages(spark):
    pages_ = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = sorted(tuple(r) for r in QUERIES["src20_paragraphs"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted((i, t) for i, page in pages_.items() for t in paragraphs(page)) and len(got) > 50


def test_declarations_are_checked(spark):
    with pytest.raises(ValueError, match="unknown kind"):
        declared.Field("a", "x", "colour")
    with pytest.raises(ValueError, match="declared twice: a"):
        declared.Source("s", (declared.Field("a", "x"), declared.Field("a", "y")))
    with pytest.raises(ValueError, match="lack: b"):
        declared.compiled(declared.Source("s", (declared.Field("b", "id"),)), spark.range(1), ["a"])


def test_declared_run_without_rows_and_with_errors_only(spark):
    field = (declared.Field("a", "id", "date", True),)
    out = declared.run([(declared.Source("none", field), spark.range(0)), (declared.Source("bad", field), spark.range(3)), (declared.Source("left", field, wants="id > 9"), spark.range(3))], ["a", "b"])
    assert sorted(tuple(r) for r in out.counts.collect()) == [("bad", 0, 3, "failed"), ("left", 0, 0, "success"), ("none", 0, 0, "success")]
    assert out.items.count() == 0 and {r.problem for r in out.errors.collect()} == {"a: no date"}
