"""Scans, orders, writes and look-ups of the plainer kind, nested documents, and checks of run parameters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rallyframe.functions import addresses, dates, params
from rallyframe.functions.addresses import edges
from rallyframe.functions.text import header_key, http_or_blank, request_fingerprint
from rallyframe.operators import declared, evidence, guards, pages, rows, windows
from rallyframe.plans.catalog import facts, fields, query, read
from rallyframe.sources import files
from rallyframe.sources.staging import staged
from rallyframe.streaming import flows

# ---- scans and projections


@query("src03_narrow_scan", "SELECT o_orderkey, o_orderstatus FROM orders")
def narrow_scan(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")


@query("src04_local_times_to_utc", "SELECT o_orderkey, o_orderdate - INTERVAL 330 MINUTE AS at FROM orders")
def to_utc(spark, sf_dir):
    """Local times of a zone rewritten to UTC, by a distributed scan."""
    at = F.convert_timezone(F.lit("Asia/Kolkata"), F.lit("UTC"), F.col("o_orderdate").cast("timestamp_ntz"))
    return read(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"))


@query("src27_window_scan", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-02-01'")
def window_scan(spark, sf_dir):
    """A window as a pushed filter; no row is lost to an early stop."""
    return read(spark, sf_dir, "orders").where("o_orderdate BETWEEN TIMESTAMP_NTZ '1997-01-01' AND TIMESTAMP_NTZ '1997-02-01'").select("o_orderkey")


@query("prj01_columns", "SELECT l_orderkey AS run, l_linenumber AS seq, l_returnflag AS level FROM lineitem")
def columns(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("level"))


@query("prj02_flat_column", "SELECT s_name AS name FROM supplier")
def flat_column(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))


SLOTS = range(1, 8)


@query("prj06_positional_row", "SELECT l_orderkey, " + ", ".join(f"min(CASE WHEN l_linenumber = {i} THEN l_partkey END) AS part{i}, max(CASE WHEN l_linenumber = {i} THEN l_quantity END) AS quantity{i}" for i in SLOTS) + " FROM lineitem GROUP BY 1")
def positional_row(spark, sf_dir):
    """One wide row an order, its lines in fixed places."""
    here = {i: F.col("l_linenumber") == i for i in SLOTS}
    cells = [c for i in SLOTS for c in (F.min(F.when(here[i], F.col("l_partkey"))).alias(f"part{i}"), F.max(F.when(here[i], F.col("l_quantity"))).alias(f"quantity{i}"))]
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*cells)


@query("flt13_allowed_categories", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def allowed_categories(spark, sf_dir):
    return read(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


# ---- files


@query("src06_csv_folder", "SELECT CAST(c_nationkey AS string) AS lane, count(*) AS n FROM customer GROUP BY 1")
def csv_folder(spark, sf_dir):
    """A tree of CSV files and what each folder holds."""
    path = staged(spark, "tree")
    read(spark, sf_dir, "customer").select("c_name", F.col("c_nationkey").alias("lane")).write.partitionBy("lane").csv(path, header=True)
    return files.rows_per_folder(spark, path, "lane", "c_name string")


@query("src07_utf16_csv", "SELECT CAST(s_suppkey AS string) AS id, concat('é ', s_name) AS name FROM supplier")
def utf16_csv(spark, sf_dir):
    """Files of two encodings and two headers in one folder; each is read as its byte order mark says."""
    path = staged(spark, "encodings")
    s, name = read(spark, sf_dir, "supplier"), F.concat(F.lit("é "), F.col("s_name"))
    s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("ID"), name.alias("Name")).write.csv(path, header=True, encoding="UTF-16")
    s.where("s_suppkey % 3 = 0").select(name.alias("NAME"), F.col("s_suppkey").alias("id")).write.mode("append").csv(path, header=True)
    return files.read_csv(spark, path, ["id", "name"], encoding=None)


@query("src09_sheet_links", "SELECT n_name AS team, concat('/schedule/', n_nationkey) AS link FROM nation WHERE n_nationkey % 3 <> 0")
def sheet_links(spark, sf_dir):
    """Named columns of a sheet; rows without a link are left out."""
    path = staged(spark, "sheet")
    link = F.when(F.col("n_nationkey") % 3 == 0, "  ").otherwise(F.concat(F.lit("/schedule/"), F.col("n_nationkey")))
    read(spark, sf_dir, "nation").select(F.lit("x").alias("note"), link.alias("Link"), F.col("n_name").alias("Team")).write.csv(path, header=True)
    return files.read_csv(spark, path, ["team", "link"]).where(F.trim("link") != "")


@query("snk02_plain_header", "SELECT CAST(r_regionkey AS string) AS \"R Regionkey\", r_name AS \"R Name\" FROM region")
def plain_header(spark, sf_dir):
    path = staged(spark, "header")
    files.write_csv(read(spark, sf_dir, "region"), path, guard=False)
    return spark.read.csv(path, header=True)


@query("snk04_csv_if_any", "SELECT CAST(s_suppkey AS string) AS id, 1 AS files FROM supplier")
def csv_if_any(spark, sf_dir):
    """Of two exports the one without rows writes nothing."""
    found = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    paths = [p for p in (files.write_csv_if_any(found, staged(spark, "rows")), files.write_csv_if_any(found.where("id < 0"), staged(spark, "rows"))) if p]
    return files.read_csv(spark, paths, ["id"]).select("id", F.lit(len(paths)).alias("files"))


@query("snk18_text_pieces", "SELECT doc_id, i + 1 AS piece, substr(text, i * 4096 + 1, 4096) AS text FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 4096.0) AS BIGINT)))) AS i FROM documents WHERE text IS NOT NULL)")
def text_pieces(spark, sf_dir):
    """Whole texts as numbered pieces of fixed width, for a download in parts."""
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(files.chunks(F.col("text"), 4096)).alias("i", "c")).select("doc_id", (F.col("i") + 1).cast("long").alias("piece"), "c.text")


@query("stg35_header_keys", "SELECT p_partkey AS part_key, p_name AS full_name, p_size AS size FROM part")
def header_keys(spark, sf_dir):
    raw = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("Part-Key"), F.col("p_name").alias(" Full  Name"), F.col("p_size").alias("SIZE"))
    return raw.toDF(*(header_key(c) for c in raw.columns))


# ---- nested documents

facts("src11_list_under_keys", "a string", [('{"results":[{"id":"1"},{"id":"2"}]}', "1,2"), ('{"data":[{"id":"7"}],"total":1}', "7"), ('{"items":[]}', ""), ("{}", ""), (None, "")], lambda a: F.array_join(files.json_list(a, ["results", "data", "items"], "struct<id:string>")["id"], ","))
facts("src15_object_or_list", "a string", [('{"id":"1"}', "1"), ('[{"id":"1"},"x",{"id":"2"},null]', "1,2"), ('"text"', ""), ("", ""), (None, "")], lambda a: F.array_join(files.object_list(a, "struct<id:string>")["id"], ","))
facts("src18_xml_or_json", "a string", [('<P xmlns="urn:x"><DateOfBirth>2001-02-03</DateOfBirth></P>', "2001-02-03"), ("<P><DateOfBirth/></P>", ""), ('{"DateOfBirth":"1999-01-01"}', "1999-01-01"), ("<P><Date", ""), ("{broken", ""), (None, "")], lambda a: files.xml_or_json(a, "DateOfBirth"))
facts("prj09_any_case_key", "a string", [('{"Score":"6-1"}', "6-1"), ('{"SCORE":null,"x":"1"}', ""), ('{"x":"1"}', ""), (None, "")], lambda a: files.any_case(a, "score"))
facts("jsn02_url_choice", "a string", [('{"url":"https://a.b/c"}', "https://a.b/c"), ('{"url":"ftp://x","sheet_url":"http://d.e"}', "http://d.e"), ("{}", None), (None, None)], lambda a: F.coalesce(*(F.nullif(http_or_blank(F.get_json_object(a, f"$.{k}")), F.lit("")) for k in ("url", "sheet_url"))))
facts("src41_input_url_kind", "a string", [(" https://docs.example.com/x ", "sheet"), ("https://a.b/sports/schedule/2026", "list"), ("https://a.b/box/1?u=docs.example.com", "page"), ("", None), (None, None)], lambda a: files.url_kind(a, "docs.example.com", "/schedule"))


@query("src32_keys_in_text", "SELECT DISTINCT doc_id, key FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-f]{32}')) AS key FROM documents)")
def keys_in_text(spark, sf_dir):
    """Every key of 32 hex digits once a text, a row each."""
    keys = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-f]{32}"), F.lit(0)))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(keys).alias("key"))


_GAME = "team array<struct<_id:bigint,player:array<struct<_name:bigint,_place:int>>>>"


@query("src17_xml_hierarchy", "SELECT l_orderkey AS team, l_partkey AS player, l_linenumber AS place FROM lineitem")
def xml_hierarchy(spark, sf_dir):
    """Documents of teams with players, one a group of lines, parsed and flattened."""
    player = F.concat(F.lit('<player name="'), F.col("l_partkey"), F.lit('" place="'), F.col("l_linenumber"), F.lit('"/>'))
    team = F.concat(F.lit('<game><team id="'), F.col("l_orderkey"), F.lit('">'), F.array_join(F.collect_list(player), ""), F.lit("</team></game>"))
    feed = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(team.alias("xml"))
    teams = feed.select(F.explode(F.from_xml("xml", _GAME)["team"]).alias("t"))
    return teams.select(F.col("t._id").alias("team"), F.explode("t.player").alias("p")).select("team", F.col("p._name").alias("player"), F.col("p._place").alias("place"))


_DAYS = "days array<struct<day:string,courts:array<struct<court:string,matches:array<int>>>>>"


@query("jsn06_day_court_match", "SELECT l_orderkey, l_returnflag AS day, l_linestatus AS court, l_linenumber AS match FROM lineitem")
def day_court_match(spark, sf_dir):
    """Days of courts of matches, flattened from their JSON."""
    courts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.collect_list("l_linenumber").alias("matches"))
    days = courts.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.struct(F.col("l_linestatus").alias("court"), "matches")).alias("courts"))
    plan = days.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("l_returnflag").alias("day"), "courts")).alias("days"))).alias("json"))
    day = plan.select("l_orderkey", F.explode(F.from_json("json", _DAYS)["days"]).alias("d"))
    court = day.select("l_orderkey", "d.day", F.explode("d.courts").alias("c"))
    return court.select("l_orderkey", "day", "c.court", F.explode("c.matches").alias("match"))


@query("src38_player_dimension", "SELECT l_suppkey AS player, arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS first_id FROM lineitem GROUP BY 1")
def player_dimension(spark, sf_dir):
    """A registration table as a dimension: the first id of each player wins."""
    found = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("player"), F.col("l_partkey").alias("first_id"))
    return rows.first_seen(found, [F.col("player")], ["l_orderkey", "l_linenumber"]).select("player", "first_id")


# ---- sides of a match


def _sides(p, s):
    people = F.split(p, ",")
    n = F.when(F.size(people) == 4, 2).otherwise(1)
    cells = F.filter(F.split(s, " "), lambda c: c.rlike(r"^[0-9]+:[0-9]+$"))
    return F.struct(
        F.array_join(F.slice(people, 1, n), "/").alias("left"),
        F.array_join(F.slice(people, n + 1, F.size(people)), "/").alias("right"),
        F.when(F.size(cells) > 0, F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit(":"), F.lit("-"))), ";")).alias("sets"),
    )


fields("prj15_sides_by_count", "left right sets", "p string, s string", [("a,b,c,d", "6:1 6:4", "a/b", "c/d", "6-1;6-4"), ("a,b", "7:6 x 10:8", "a", "b", "7-6;10-8"), ("a,b,c", "", "a", "b/c", None), ("a", "w.o.", "a", "", None)], _sides)
facts("flt10_european_inside", "a string, b date, c date", [("18.-20. 4. 2026", dt.date(2026, 4, 18), dt.date(2026, 4, 20), True), ("18.-20. 4. 2026", dt.date(2026, 4, 19), dt.date(2026, 4, 30), False), ("x", dt.date(2026, 1, 1), dt.date(2026, 12, 31), False)], lambda a, b, c: dates.inside(dates.european_range(a)["start"], dates.european_range(a)["end"], b, c))
facts("set05_union_of_tokens", "a string", [("@ana hi @bo", "ana,bo"), ('<i data-username="cy"></i> @ana @cy', "ana,cy"), ("none", ""), (None, "")], lambda a: F.array_join(F.array_sort(F.array_union(F.regexp_extract_all(F.coalesce(a, F.lit("")), F.lit('data-username="([^"]+)"'), F.lit(1)), F.regexp_extract_all(F.coalesce(a, F.lit("")), F.lit("@([a-z]+)"), F.lit(1)))), ","))
query("stg30_request_fingerprint", "SELECT page_id, sha1(concat(coalesce(url, ''), '200', CAST(page_id AS string))) AS mark FROM pages")(lambda spark, sf_dir: read(spark, sf_dir, "pages").select("page_id", request_fingerprint(F.col("url"), F.lit("200"), F.col("page_id").cast("string")).alias("mark")))

# ---- writes


@query("snk12_bulk_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def bulk_update(spark, sf_dir):
    runs = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rows.update_where(runs, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000), o_orderstatus=F.lit("F")).drop("o_totalprice")


@query("snk15_owned_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_custkey % 2 = 0)")
def owned_delete(spark, sf_dir):
    """Listed ids go only where they belong to their owner."""
    notes = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    kept, _ = rows.delete_by_ids(notes, notes.where("o_orderkey % 3 = 0"), "o_orderkey", F.col("o_custkey") % 2 == 0)
    return kept.select("o_orderkey")


@query("snk16_all_read", "SELECT event_id, event_type <> 'error' OR user_id = 8 AS seen FROM events")
def all_read(spark, sf_dir):
    notes = read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") != "error").alias("seen"))
    return rows.update_where(notes, F.col("user_id") == 8, seen=F.lit(True)).select("event_id", "seen")


@query("snk17_fan_out_insert", "SELECT o_orderkey, s_suppkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > 5000 WHERE o_orderpriority = '1-URGENT'")
def fan_out_insert(spark, sf_dir):
    """A note for each event and each person who follows its place: an equality join, places with most events split."""
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    placed = urgent.join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("place")), "c_custkey").drop("c_custkey")
    return rows.fan_out(placed, read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_suppkey", F.col("s_nationkey").alias("place")), "place").select("o_orderkey", "s_suppkey")


# ---- look-ups


@query("jon03_children_counted", "SELECT c_custkey, coalesce(n, 0) AS n, last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def children_counted(spark, sf_dir):
    """Children are aggregated before the join."""
    per = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "last")


@query("jon11_participants_mapped", "SELECT l_orderkey, l_linenumber, role, s_name AS name FROM (SELECT l_orderkey, l_linenumber, 'home' AS role, l_suppkey AS id FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'away', l_partkey FROM lineitem) JOIN supplier ON s_suppkey = id")
def participants_mapped(spark, sf_dir):
    sides = F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("s_suppkey")) for r, c in (("home", "l_suppkey"), ("away", "l_partkey"))))
    people = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.inline(sides))
    return people.join(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name")), "s_suppkey").drop("s_suppkey")


@query("jon14_side_from_table", "SELECT l_orderkey, l_linenumber, coalesce(s_name, '') AS name, coalesce(s_nationkey, -1) AS nation FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey")
def side_from_table(spark, sf_dir):
    known = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    found = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(known, "l_suppkey", "left")
    return found.select("l_orderkey", "l_linenumber", F.coalesce("s_name", F.lit("")).alias("name"), F.coalesce("s_nationkey", F.lit(-1)).alias("nation"))


@query("jon16_code_labels", "SELECT c_custkey, concat(r_name, ' > ', n_name) AS label FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def code_labels(spark, sf_dir):
    """A tree of codes flattened to labels with their parents', then looked up."""
    parents = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    labels = read(spark, sf_dir, "nation").join(parents, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), F.concat("r_name", F.lit(" > "), "n_name").alias("label"))
    return read(spark, sf_dir, "customer").join(labels, "c_nationkey").select("c_custkey", "label")


@query("jon24_child_by_id", "SELECT o_orderkey, min(l_partkey) AS part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 7 + 1 GROUP BY 1")
def child_of_parent(spark, sf_dir):
    """Of a parent's children the one a row names, or null."""
    children = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("part")))).alias("children"))
    chosen = evidence.child_by_id(F.col("children"), "id", F.col("o_orderkey") % 7 + 1)["part"]
    return read(spark, sf_dir, "orders").select("o_orderkey").join(children, "o_orderkey", "left").select("o_orderkey", chosen.alias("part"))


@query("jon27_default_record", "SELECT l_orderkey, l_linenumber, coalesce(p_name, concat('#', l_partkey)) AS name, coalesce(p_size, 0) AS size FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON p_partkey = l_partkey")
def default_record(spark, sf_dir):
    known = read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    found = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(known, "l_partkey", "left")
    return found.select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.concat(F.lit("#"), "l_partkey")).alias("name"), F.coalesce("p_size", F.lit(0)).alias("size"))


@query("jon28_negative_memo", "SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS name, CASE WHEN c_custkey IS NULL THEN 'unseen' WHEN c_acctbal > 0 THEN 'known' ELSE 'absent' END AS state FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey")
def negative_memo(spark, sf_dir):
    cache = read(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 0).alias("known"), F.col("c_name").alias("name"))
    return evidence.resolved(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), cache, "o_custkey", "name", "").drop("o_custkey")


# ---- counts and orders


@query("agg05_comments_per_ticket", "SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def comments_per_ticket(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(per, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg06_usage_count", "SELECT n_nationkey, count(s_suppkey) AS used_by FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def usage_count(spark, sf_dir):
    per = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("used_by"))
    return read(spark, sf_dir, "nation").select("n_nationkey").join(per, "n_nationkey", "left").select("n_nationkey", F.coalesce("used_by", F.lit(0)).alias("used_by"))


_WEEK = "CAST(date_trunc('week', ts) AS date)"


@query("agg23_sketches", f"""SELECT {_WEEK} AS week, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS clickers,
  count(DISTINCT CASE WHEN user_id IN (SELECT b.user_id FROM events b WHERE b.event_type = 'purchase' AND date_trunc('week', b.ts) = date_trunc('week', e.ts)) AND event_type = 'click' THEN user_id END) AS buyers,
  count(DISTINCT CASE WHEN user_id NOT IN (SELECT b.user_id FROM events b WHERE b.event_type = 'purchase' AND date_trunc('week', b.ts) = date_trunc('week', e.ts) AND b.user_id IS NOT NULL) AND event_type = 'click' THEN user_id END) AS only_clicks,
  count(value) AS n, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.9) AS top_tenth FROM events e GROUP BY 1""")
def sketches(spark, sf_dir):
    """Sketches stored a day, merged to weeks: distinct users, set operations on them, quantiles.

    A theta sketch of 2^16 entries is exact up to 65,536 users a week and within 0.8 % beyond (two standard errors); a quantile
    sketch with k = 8192 is exact up to about as many values, and within 0.04 % of the rank beyond.
    """
    e = read(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    users = lambda kind: F.theta_sketch_agg(F.when(F.col("event_type") == kind, F.col("user_id")), 16)
    path = staged(spark, "daily-sketches")
    e.groupBy("day").agg(F.theta_sketch_agg("user_id", 16).alias("users"), users("click").alias("clicks"), users("purchase").alias("buys"), F.kll_sketch_agg_double("value", 8192).alias("amounts")).write.parquet(path)
    weeks = spark.read.parquet(path).groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg(*(F.theta_union_agg(c, 16).alias(c) for c in ("users", "clicks", "buys")), F.kll_merge_agg_double("amounts", 8192).alias("amounts"))
    size = F.theta_sketch_estimate
    return weeks.select(
        "week", size("users").alias("users"), size("clicks").alias("clickers"), size(F.theta_intersection("clicks", "buys")).alias("buyers"), size(F.theta_difference("clicks", "buys")).alias("only_clicks"),
        F.kll_sketch_get_n_double("amounts").alias("n"), F.kll_sketch_get_quantile_double("amounts", F.lit(0.5)).alias("median"), F.kll_sketch_get_quantile_double("amounts", F.lit(0.9)).alias("top_tenth"),
    )


@query("srt01_by_name", "SELECT s_name FROM supplier ORDER BY s_name")
def by_name(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_name").orderBy("s_name")


@query("srt02_latest_then_id", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def latest_then_id(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("srt03_active_first", "SELECT c_name, c_acctbal > 0 AS active FROM customer ORDER BY active DESC, c_name")
def active_first(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_name", (F.col("c_acctbal") > 0).alias("active")).orderBy(F.desc("active"), "c_name")


@query("srt05_default_order", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id")
def default_order(spark, sf_dir):
    """An order a model has by default is stated, as tables have none."""
    return read(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id")


@query("top02_queue_head", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 15")
def queue_head(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(15).select("o_orderkey")


@query("top03_first_row", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def first_row(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey", "o_custkey")


facts("top07_capped_list", "a string, n int", [("c,a,b,c", 2, "c,a"), ("a", 2, "a"), ("", 2, "")], lambda a, n: F.array_join(F.slice(F.array_distinct(F.split(a, ",")), F.lit(1), n), ","))


@query("top09_numeric_text_order", "SELECT id FROM (SELECT CAST(s_suppkey AS string) AS id FROM supplier) ORDER BY CAST(id AS BIGINT) LIMIT 20")
def numeric_text_order(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id")).orderBy(F.col("id").cast("long")).limit(20)


# ---- streams


@query("str04_outcome_log", "SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'started' END AS outcome FROM events WHERE event_type IN ('error', 'signup')")
def outcome_log(spark, sf_dir):
    """Each outcome appended once to a log, by a stream with a checkpoint."""
    outcome = F.when(F.col("event_type") == "error", "failed").otherwise("started")
    return flows.drained(spark, f"{sf_dir}/events.parquet", lambda e: e.where(F.col("event_type").isin("error", "signup")).select("event_id", "user_id", outcome.alias("outcome")), "append")


@query("str06_gate_of_unknown_state", "SELECT event_id, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS open FROM (SELECT *, CASE WHEN event_id % 40 >= 30 THEN false WHEN event_id % 40 <= 10 THEN true END AS d FROM events)")
def gate_of_unknown_state(spark, sf_dir):
    return flows.gated(read(spark, sf_dir, "events").select("event_id", "ts", "user_id"), F.col("event_id") % 40, ["ts", "event_id"], "user_id", 30, 10, known=False).select("event_id", "open")


# ---- run parameters

facts("val03_year", "a string", [(" 2024 ", 2024), ("1999", None), ("2031", None), ("x", None), ("", 2026), (None, 2026)], lambda a: params.year(a, F.lit(2026)))
facts("val04_month", "a string", [("0", 0), ("12", 12), ("13", None), ("-1", None), ("1.5", None), ("", 0), (None, 0)], lambda a: params.month(a, True))
facts("val05_iso_date", "a string", [("2026-02-28", dt.date(2026, 2, 28)), ("2026-02-30", None), ("28/02/2026", None), ("", None), (None, None)], params.iso_date)
facts("val06_window_fits", "a date, b date", [(dt.date(2026, 1, 1), dt.date(2026, 1, 1), True), (dt.date(2026, 1, 2), dt.date(2026, 1, 1), False), (dt.date(2025, 1, 1), dt.date(2026, 2, 5), True), (dt.date(2025, 1, 1), dt.date(2026, 2, 6), False), (None, dt.date(2026, 1, 1), False)], params.window_fits)
facts("val07_rolling_days", "a string", [("1", 1), ("400", 400), ("401", None), ("0", None), ("ten", None), (" ", 15), (None, 15)], params.rolling_days)
facts("val08_choice", "a string", [(" Singles", "singles"), ("", "both"), (None, "both"), ("mixed", None)], lambda a: params.choice(a, ("singles", "doubles", "both"), "both"))
facts("val09_time_of_day", "a string", [("9:05", 32700), ("23:59:59", 86399), ("24:00", 21600), ("9.05", 21600), (None, 21600)], lambda a: params.seconds_of_day(a, F.lit(21600)))


# ---- sources collected page by page, and settings of sources


_STOPS = "SELECT source, min(page) AS stop FROM (SELECT source, page FROM (SELECT DISTINCT source FROM r) AS s, (SELECT unnest(range(0, 100000)) AS page) AS p) LEFT JOIN c USING (source, page) WHERE coalesce(n, 0) < {} GROUP BY 1"


def _paged(spark, sf_dir, kept):
    """Orders as the rows of seven sources in pages of ten, some rows missing."""
    o = read(spark, sf_dir, "orders").where(kept)
    return o.select("o_orderkey", (F.col("o_orderkey") % 7).alias("source"), F.floor(F.col("o_orderkey") / 70).alias("page"), (F.col("o_custkey") % 50).alias("key"))


_PAGES = "WITH r AS (SELECT o_orderkey, o_orderkey % 7 AS source, o_orderkey // 70 AS page, o_custkey % 50 AS key FROM orders WHERE {})"


@query("src36_until_short_page", _PAGES.format("o_orderkey % 997 <> 0") + ", c AS (SELECT source, page, count(*) AS n FROM r GROUP BY 1, 2) SELECT source, o_orderkey FROM r JOIN (" + _STOPS.format(10) + ") USING (source) WHERE page <= stop")
def until_short_page(spark, sf_dir):
    return pages.until_short(_paged(spark, sf_dir, "o_orderkey % 997 <> 0"), "source", "page", 10).select("source", "o_orderkey")


@query("src26_until_empty_page", _PAGES.format("o_orderkey // 70 % 13 <> 12 OR o_orderkey % 7 = 3") + ", c AS (SELECT source, page, count(*) AS n FROM r GROUP BY 1, 2) SELECT source, o_orderkey FROM r JOIN (" + _STOPS.format(1) + ") USING (source) WHERE page <= stop")
def until_empty_page(spark, sf_dir):
    return pages.until_empty(_paged(spark, sf_dir, "floor(o_orderkey / 70) % 13 <> 12 OR o_orderkey % 7 = 3"), "source", "page").select("source", "o_orderkey")


@query("src35_until_nothing_new", _PAGES.format("true") + ", f AS (SELECT source, key, min(page) AS page FROM r GROUP BY 1, 2), c AS (SELECT source, page, count(*) AS n FROM f GROUP BY 1, 2) SELECT source, key, page FROM f JOIN (" + _STOPS.format(1) + ") USING (source) WHERE page <= stop")
def until_nothing_new(spark, sf_dir):
    return pages.until_nothing_new(_paged(spark, sf_dir, "true"), "source", "page", "key").select("source", "key", "page")


@query("val10_host_allowed", r"SELECT page_id, coalesce(host IN ('example.org', 'example.net') OR ends_with(host, '.example.org') OR ends_with(host, '.example.net'), false) AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages)")
def host_allowed(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", pages.host_allowed(F.col("url"), ("example.org", "example.net")).alias("allowed"))


# page_id, url: hosts of the pages' urls replaced by addresses in seven forms or by local names, three of twelve left as they are
_ANY_FORM = """
  SELECT page_id, CASE WHEN form < 9 THEN concat('http://u:p@', CASE form
      WHEN 0 THEN concat(p, '.', q, '.', r, '.', s) WHEN 1 THEN concat(a, '') WHEN 2 THEN concat('0x', lower(hex(a))) WHEN 3 THEN concat('0', p >> 6, (p >> 3) % 8, p % 8, '.0x', lower(hex(q)), '.', r * 256 + s)
      WHEN 4 THEN concat('[::FFFF:', p, '.', q, '.', r, '.', s, ']') WHEN 5 THEN concat('[::ffff:', lower(hex(p * 256 + q)), ':', lower(hex(r * 256 + s)), ']')
      WHEN 6 THEN concat(CASE WHEN n % 2 = 0 THEN '[fe80::' ELSE '[2606:2800::' END, lower(hex(a >> 16)), ':', lower(hex(r * 256 + s)), ']') WHEN 7 THEN 'LocalHost' ELSE 'db.internal' END, ':8080/x?y@z') ELSE url END AS url
  FROM (SELECT *, a >> 24 AS p, (a >> 16) % 256 AS q, (a >> 8) % 256 AS r, a % 256 AS s FROM (SELECT page_id, url, n, (n >> 4) % 12 AS form,
    CASE n % 9 WHEN 0 THEN 167772160 + (n >> 12) WHEN 1 THEN 2130706432 + (n >> 12) WHEN 2 THEN 2886729728 + (n >> 12) WHEN 3 THEN 3232235520 + (n >> 16) WHEN 4 THEN 2851995648 + (n >> 16) WHEN 5 THEN 3758096384 + (n >> 12) ELSE n END AS a
    FROM (SELECT page_id, url, (CAST(page_id AS BIGINT) * 2654435761) % 4294967296 AS n FROM pages) x) y) z
"""
# SQL: addresses are built from the text of each form, and looked up among the ranges' bounds
_PUBLIC_URLS = r"""
WITH hosts AS (
  SELECT page_id, regexp_extract(lower(regexp_extract(url, '^(?i:https?)://([^/?#]*)', 1)), '([^@]*)$', 1) AS rest FROM (ANY_FORM)
), cut AS (
  SELECT page_id, CASE WHEN starts_with(rest, '[') THEN split_part(rest[2:], ']', 1) ELSE split_part(rest, ':', 1) END AS host, starts_with(rest, '[') AS six FROM hosts
), quads AS (
  SELECT *, list_transform(split(regexp_extract(host, '[0-9.]*$'), '.'), lambda x: TRY_CAST(x AS INTEGER)) AS d FROM cut
), wide AS (
  SELECT page_id, CASE WHEN contains(host, '.') THEN regexp_extract(host, '^(.*:)', 1) || printf('%x:%x', d[1] * 256 + d[2], d[3] * 256 + d[4]) ELSE host END AS h FROM quads WHERE six
), sides AS (
  SELECT page_id, list_transform(split(split_part(h, '::', 1), ':'), lambda g: CASE WHEN g = '' THEN '' ELSE lpad(g, 4, '0') END) AS l, list_transform(split(split_part(h, '::', 2), ':'), lambda g: lpad(g, 4, '0')) AS r FROM wide
), parts AS (
  SELECT page_id, list_transform(split(host, '.'), lambda x: CASE
    WHEN starts_with(x, '0x') THEN list_reduce(list_transform(split(x[3:], ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda m, y: m * 16 + y)
    WHEN starts_with(x, '0') THEN list_reduce(list_transform(split(x, ''), lambda c: CAST(c AS BIGINT)), lambda m, y: m * 8 + y) ELSE CAST(x AS BIGINT) END) AS n
  FROM cut WHERE regexp_full_match(host, '[0-9][0-9a-fx.]*')
), numbers AS (
  SELECT page_id, array_to_string(l, '') || repeat('0', 32 - length(array_to_string(l, '')) - length(array_to_string(r, ''))) || array_to_string(r, '') AS address FROM sides
  UNION ALL SELECT page_id, printf('00000000000000000000ffff%08x', n[-1] + coalesce(n[1] * CASE WHEN len(n) > 1 THEN 16777216 ELSE 0 END, 0) + coalesce(n[2] * CASE WHEN len(n) > 2 THEN 65536 ELSE 0 END, 0) + coalesce(n[3] * CASE WHEN len(n) > 3 THEN 256 ELSE 0 END, 0)) FROM parts
), ranges(low, high) AS (VALUES RANGES)
SELECT page_id, address, CASE WHEN coalesce(host, '') = '' THEN 'host' WHEN host = 'localhost' OR ends_with(host, '.local') OR ends_with(host, '.internal') THEN 'name' WHEN within THEN 'address' END AS refused
FROM cut LEFT JOIN (SELECT page_id, address, bool_or(low IS NOT NULL) AS within FROM numbers LEFT JOIN ranges ON address >= low AND address < high GROUP BY ALL) USING (page_id)
"""
_RANGES = ", ".join(f"('{a}', '{b}')" for a, b in zip(edges()[::2], [*edges()[1::2], "g"], strict=False))


@query("flt19_public_urls", _PUBLIC_URLS.replace("ANY_FORM", _ANY_FORM).replace("RANGES", _RANGES))
def public_urls(spark, sf_dir):
    """Urls with addresses in every form: which may be fetched."""
    urls = spark.sql(_ANY_FORM.replace("FROM pages", "FROM {pages}"), pages=read(spark, sf_dir, "pages"))
    return guards.guarded(urls).select("page_id", "address", "refused")


@query(
    "flt19_resolved_names",
    r"""
WITH hosts AS (SELECT page_id, lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN host IS NULL OR host = '' THEN 'host' WHEN length(host) % 4 = 1 THEN 'unresolved' WHEN length(host) % 4 = 2 THEN 'address' END AS refused FROM hosts
""",
)
def resolved_names(spark, sf_dir):
    """Names by the addresses that were collected for them: none, a public one, or one of two that is not."""
    urls = read(spark, sf_dir, "pages").select("page_id", "url")
    names = urls.select(addresses.host(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    found = F.when(F.length("host") % 4 == 2, F.array(F.lit("93.184.216.34"), F.lit("10.0.0.8"))).when(F.length("host") % 4 != 1, F.array(F.lit("2606:2800::1"))).otherwise(F.array().cast("array<string>"))
    return guards.guarded(urls, resolved=names.select("host", F.explode(found).alias("address"))).select("page_id", "refused")


@query("udf03_source_settings", "SELECT c_custkey, coalesce(label, 'other') AS label, CASE WHEN coalesce(upper, false) THEN upper(c_name) ELSE c_name END AS name FROM customer LEFT JOIN (VALUES ('BUILDING', 'b', true, 100.0), ('MACHINERY', 'm', false, NULL)) AS s(c_mktsegment, label, upper, least) USING (c_mktsegment) WHERE c_acctbal >= coalesce(least, -500)")
def source_settings(spark, sf_dir):
    """One flow for all sources, told by a table what holds for each."""
    settings = spark.createDataFrame([("BUILDING", "b", True, 100.0), ("MACHINERY", "m", False, None)], "c_mktsegment string, label string, upper boolean, least double")
    told = rows.with_settings(read(spark, sf_dir, "customer"), settings, "c_mktsegment", label="other", upper=False, least=-500.0)
    return told.where("c_acctbal >= least").select("c_custkey", "label", F.when(F.col("upper"), F.upper("c_name")).otherwise(F.col("c_name")).alias("name"))


_CAP = 8
_DAYS_SQL = "SELECT CAST(o_orderdate AS date) AS day, count(*) AS n FROM orders GROUP BY 1"


@query("src28_bisected_windows", f"""WITH RECURSIVE d AS ({_DAYS_SQL}),
  w AS (SELECT min(day) AS start, max(day) AS stop, sum(n) AS n FROM d UNION ALL
    SELECT s, e, (SELECT coalesce(sum(d.n), 0) FROM d WHERE d.day BETWEEN s AND e) FROM (SELECT unnest([start, CAST(start + CAST((stop - start) // 2 + 1 AS int) AS date)]) AS s, unnest([CAST(start + CAST((stop - start) // 2 AS int) AS date), stop]) AS e FROM w WHERE n >= {_CAP} AND start < stop)),
  leaf AS (SELECT * FROM w WHERE n < {_CAP} OR start = stop)
  SELECT start, stop, '' AS region, CAST(n AS bigint) AS n, false AS capped FROM leaf WHERE n < {_CAP}
  UNION ALL SELECT start, stop, o_orderpriority, count(*), count(*) >= {_CAP} FROM leaf JOIN orders ON CAST(o_orderdate AS date) = start WHERE leaf.n >= {_CAP} GROUP BY ALL""")
def bisected(spark, sf_dir):
    """Windows halved until each has fewer rows than a search may return; days that still have more, by region."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("region"))
    return windows.bisected(o, "day", "region", _CAP)


#: Three sources of unlike shape as declarations of the same rows.
FIELDS = ["key", "day", "winner", "loser", "score", "gender", "round"]
DECLARED = {
    "orders": declared.Source("orders", (declared.Field("key", "o_orderkey", "number", True), declared.Field("day", "CAST(o_orderdate AS date)", "date", True), declared.Field("winner", "concat(' C ', o_custkey, '  x')", required=True), declared.Field("score", "CASE WHEN o_orderkey % 6 = 0 THEN 'w.o.' ELSE concat('6-', o_orderkey % 5) END", "score")), items="o_orderstatus <> 'P'"),
    "lineitem": declared.Source("lineitem", (declared.Field("key", "l_orderkey * 8 + l_linenumber", "number", True), declared.Field("day", "CASE WHEN l_partkey % 10 = 0 THEN 'soon' ELSE date_format(l_shipdate, 'M/d/yyyy') END", "date", True), declared.Field("winner", "CASE WHEN l_suppkey % 20 = 0 THEN ' ' ELSE concat('S', l_suppkey) END", required=True), declared.Field("loser", "concat('P', l_partkey)"), declared.Field("round", "l_returnflag")), wants="l_linenumber < 4"),
    "events": declared.Source("events", (declared.Field("key", "event_id", "number", True), declared.Field("day", "CAST(ts AS date)", "date"), declared.Field("winner", "user_id", required=True), declared.Field("gender", "CASE event_id % 4 WHEN 0 THEN 'Female' WHEN 1 THEN 'm' WHEN 2 THEN '' ELSE '??' END", "gender"))),
}
_DECLARED_SQL = """
  SELECT 'orders' AS source, CAST(o_orderkey AS string) AS key, strftime(o_orderdate, '%Y-%m-%d') AS day, concat('C ', o_custkey, ' x') AS winner, '' AS loser, CASE WHEN o_orderkey % 6 = 0 THEN 'w.o.;' ELSE concat('6-', o_orderkey % 5, ';') END AS score, '' AS gender, '' AS round, [CASE WHEN o_orderkey % 6 = 0 THEN 'score: no score' END] AS p FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT 'lineitem', CAST(l_orderkey * 8 + l_linenumber AS string), CASE WHEN l_partkey % 10 = 0 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d') END, CASE WHEN l_suppkey % 20 = 0 THEN '' ELSE concat('S', l_suppkey) END, concat('P', l_partkey), '', '', l_returnflag, [CASE WHEN l_partkey % 10 = 0 THEN 'day: no date' END, CASE WHEN l_suppkey % 20 = 0 THEN 'winner: missing' END] FROM lineitem WHERE l_linenumber < 4
  UNION ALL SELECT 'events', CAST(event_id AS string), strftime(ts, '%Y-%m-%d'), CAST(user_id AS string), '', '', CASE event_id % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE '' END, '', [CASE WHEN event_id % 4 = 3 THEN 'gender: no gender' END] FROM events"""


def _declared(spark, sf_dir):
    return declared.run([(s, read(spark, sf_dir, name)) for name, s in DECLARED.items()], FIELDS)


@query("udf02_declared_items", f"SELECT * EXCLUDE (p) FROM ({_DECLARED_SQL}) WHERE len(list_filter(p, lambda x: x IS NOT NULL)) = 0")
def declared_items(spark, sf_dir):
    return _declared(spark, sf_dir).items


@query("udf02_declared_errors", f"SELECT source, key, problem FROM (SELECT source, key, unnest(p) AS problem FROM ({_DECLARED_SQL})) WHERE problem IS NOT NULL")
def declared_errors(spark, sf_dir):
    return _declared(spark, sf_dir).errors.select("source", "key", "problem")


@query("udf04_run_counts", f"SELECT source, count(*) FILTER (WHERE n = 0) AS items, count(*) FILTER (WHERE n > 0) AS errors, CASE WHEN count(*) FILTER (WHERE n = 0) > 0 OR count(*) = 0 THEN 'success' ELSE 'failed' END AS status FROM (SELECT source, len(list_filter(p, lambda x: x IS NOT NULL)) AS n FROM ({_DECLARED_SQL})) GROUP BY 1")
def run_counts(spark, sf_dir):
    """What a run of all declared sources counts in the pass that writes its rows."""
    return _declared(spark, sf_dir).counts
