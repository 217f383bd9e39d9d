"""Deduplication by content keys, over match rows derived from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions.text import canonical_url, collapse, tidy
from rallyframe.operators import identity, rows, store
from rallyframe.plans.catalog import ORACLE_SQL, QUERIES, query, read

#: Match-like rows; the text is valid in Spark and in DuckDB.
COLUMNS = {
    "seq": "l_orderkey * 8 + l_linenumber",
    "match_id": "CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('m', CAST(l_orderkey % 700 AS string)) END",
    "url": "concat('https://t.example/', CAST(l_suppkey AS string))",
    "match_url": "concat('https://t.example/m/', CAST(l_orderkey % 1000 AS string))",
    "tournament": "concat('t', CAST(l_suppkey % 20 AS string))",
    "draw": "l_returnflag",
    "draw_id": "concat('d', CAST(l_partkey % 7 AS string))",
    "round": "l_linestatus",
    "day": "CAST(CAST(l_shipdate AS date) AS string)",
    "w1": "concat('Ana  ', CAST(l_partkey % 9 AS string))",
    "w2": "CASE WHEN l_linenumber % 2 = 0 THEN concat('Bo ', CAST(l_suppkey % 5 AS string)) ELSE '' END",
    "l1": "concat('CY ', CAST(l_orderkey % 6 AS string))",
    "l2": "CASE WHEN l_linenumber % 2 = 0 THEN concat('Di ', CAST(l_partkey % 4 AS string)) ELSE '' END",
    "w1_id": "CAST(l_partkey % 30 AS string)",
    "l1_id": "CAST(l_suppkey % 30 AS string)",
    "score": "concat('6-', CAST(l_linenumber % 5 AS string), CASE WHEN l_orderkey % 2 = 0 THEN ';' ELSE '' END)",
    "source": "CASE WHEN l_orderkey % 2 = 0 THEN 'import' ELSE 'feed' END",
    "rank_type": "concat('r', CAST(l_linenumber % 3 AS string))",
}
MATCHES = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items()) + " FROM lineitem"
SHOWN = ["seq", "match_id", "url", "score"]
#: Arrival, and then all other columns: rows of equal number are told apart by what they hold.
ORDER = ", ".join(COLUMNS)
NAMES = ["w1", "w2", "l1", "l2"]


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*(f"{sql} AS {name}" for name, sql in COLUMNS.items()))


def _kept(name: str, keys, sql_key: str) -> None:
    """A query that keeps the first row of each key, with the SQL twin."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows.first_seen(matches(spark, sf_dir), keys(), ["seq"]).select(*SHOWN)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH m AS ({MATCHES}) SELECT {', '.join(SHOWN)} FROM m QUALIFY row_number() OVER (PARTITION BY {sql_key} ORDER BY {ORDER}) = 1"


for _name, _columns in {
    "ded02_tournament_match": ["url", "draw", "round", "day", *NAMES, "score"],
    "ded03_match_page": ["match_url", "draw", "round", "day", *NAMES, "score"],
    "ded07_url_names_score": ["url", *NAMES, "score"],
    "ded08_page_names_score": ["match_url", *NAMES, "score"],
    "ded09_id_names_score": ["match_id", *NAMES, "score"],
    "ded10_id_names_score_of_source": ["source", "match_id", *NAMES, "score"],
    "ded12_url_id_names_score": ["url", "match_id", "draw", "round", "day", *NAMES, "score"],
    "ded17_event_ids_score": ["tournament", "w1_id", "l1_id", "score"],
    "ded18_tie_and_match": ["draw_id", "match_id"],
    "ded20_player_and_rank": ["w1_id", "rank_type"],
    "ded22_id_in_payload": ["url", "match_id"],
    "ded26_work_items": ["match_url"],
    "ded30_draw_of_tournament": ["tournament", "draw"],
    "win07_first_per_key": ["tournament"],
}.items():
    _kept(_name, lambda c=_columns: c, ", ".join(_columns))

for _name, _columns in {
    "ded04_id_or_draw": ["url", "draw", "round", "w1", "l1", "score"],
    "ded05_id_or_source": ["source", *NAMES, "score"],
    "ded06_id_or_url": ["url", *NAMES, "score"],
    "ded11_id_or_day": ["url", "day", "draw", *NAMES, "score"],
    "ded14_id_or_tournament": ["tournament", "draw", "round", "day", *NAMES, "score"],
    "ded15_id_or_ids": ["url", "draw", "round", "w1_id", "l1_id", "score"],
    "ded16_id_or_players": ["day", "w1", "l1", "score"],
}.items():
    _kept(_name, lambda c=_columns: [rows.id_or("match_id", *c)], f"CASE WHEN match_id <> '' THEN [match_id] ELSE ['', {', '.join(_columns)}] END")

_kept("ded19_id_only", lambda: [F.when(F.col("match_id") == "", F.col("seq").cast("string")).otherwise(F.concat(F.lit("id "), "match_id"))], "CASE WHEN match_id = '' THEN CAST(seq AS string) ELSE concat('id ', match_id) END")

_SQL_NORMAL = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


def _sides():
    def side(*names):
        return F.sort_array(F.array(*(F.lower(tidy(F.col(n))) for n in names)))

    return [side("w1", "w2"), side("l1", "l2"), F.col("score")]


_kept("ded13_sides_any_order", _sides, f"list_sort([{_SQL_NORMAL.format('w1')}, {_SQL_NORMAL.format('w2')}]), list_sort([{_SQL_NORMAL.format('l1')}, {_SQL_NORMAL.format('l2')}]), score")

def _sql_side(*names: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_filter([{', '.join(_SQL_NORMAL.format(n) for n in names)}], lambda x: x <> '')), '|'), '')"


#: The nine parts of a match's identity, in SQL, of the columns of a compact row.
_HASH = "sha256(concat_ws(chr(31), " + ", ".join([
    "tournament_date", "lower(substr(trim(draw_gender), 1, 1))", _SQL_NORMAL.format("draw_name"), _SQL_NORMAL.format("draw_team_type"),
    _sql_side("winner_1_name", "winner_2_name"), _sql_side("loser_1_name", "loser_2_name"),
    "lower(rtrim(regexp_replace(score, '\\s', '', 'g'), ';'))", _SQL_NORMAL.format("winner_team"), _SQL_NORMAL.format("loser_team"),
]) + "))"

#: Compact rows as a source gives them; every fifth is seen in all batches.
COMPACT = {
    "seq": "seq",
    "batch": "seq % 3",
    "again": "seq % 5 = 0",
    "tournament_date": "day",
    "tournament_name": "CASE WHEN seq % 11 = 0 THEN concat(tournament, repeat('x', 320)) ELSE tournament END",
    "tournament_url": "url",
    "draw_name": "concat('Draw ', draw)",
    "draw_gender": "CASE WHEN seq % 2 = 0 THEN 'Male' ELSE 'female' END",
    "draw_team_type": "CASE WHEN w2 = '' THEN 'Singles' ELSE 'Doubles' END",
    "winner_1_name": "w1",
    "winner_2_name": "w2",
    "loser_1_name": "l1",
    "loser_2_name": "l2",
    "winner_1_college": "tournament",
    "score": "score",
    "winner_team": "CASE WHEN seq % 13 = 0 THEN repeat('Long Team ', 25) WHEN seq % 7 = 0 THEN concat('Team  ', w1_id, ' ') ELSE concat('Team ', w1_id) END",
    "loser_team": "concat('team ', l1_id)",
    "outcome": "round",
}
_COMPACT = f"SELECT {', '.join(f'{sql} AS {name}' for name, sql in COMPACT.items())} FROM ({MATCHES})"


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).selectExpr(*(f"{sql} AS {name}" for name, sql in COMPACT.items()))


@query("ded01_identity_hash", f"SELECT seq, {_HASH} AS match_hash FROM ({_COMPACT})")
def ded01(spark, sf_dir):
    """The hash of every row."""
    return identity.widened(compact(spark, sf_dir), "seq").select("seq", identity.canonical_hash().alias("match_hash"))


_STORED = f"""SELECT seq, {_HASH} AS match_hash, tournament_date AS date_norm, substr(trim(tournament_name), 1, 300) AS tournament_name, substr(draw_name, 1, 120) AS draw_name, substr(draw_gender, 1, 20) AS draw_gender,
  substr(trim(winner_team), 1, 200) AS winner_team, substr(loser_team, 1, 200) AS loser_team, 'scrape' AS source, 'run-1' AS first_seen_run, batch, again FROM ({_COMPACT})"""


@query("snk06_insert_new", f"WITH m AS ({_STORED}) SELECT * EXCLUDE (batch, again) FROM m WHERE (batch = 1 OR again) AND match_hash NOT IN (SELECT match_hash FROM m WHERE batch = 0) QUALIFY row_number() OVER (PARTITION BY match_hash ORDER BY seq) = 1")
def snk06(spark, sf_dir):
    """What a run adds to an imported store, as it is stored: first seen wins, known hashes are left alone."""
    c = compact(spark, sf_dir)
    new = store.stored_row(identity.widened(c.where("batch = 1 OR again"), "seq"), "scrape", "run-1", "seq").drop("data")
    known = identity.widened(c.where("batch = 0")).select(identity.canonical_hash().alias("match_hash"))
    return rows.only_new(new, known, "match_hash", ["seq"])


@query("snk06_three_batches", f"""WITH m AS ({_STORED}), b AS (SELECT n, m.* FROM m JOIN (VALUES (0), (1), (2)) AS v(n) ON batch = n OR again), f AS (SELECT match_hash, min(n) AS first FROM b GROUP BY 1)
  SELECT CAST(b.n AS int) AS batch, count(DISTINCT match_hash) FILTER (WHERE first = b.n) AS new_rows, count(*) - count(DISTINCT match_hash) FILTER (WHERE first = b.n) AS skipped FROM b JOIN f USING (match_hash) GROUP BY 1""")
def snk06_batches(spark, sf_dir):
    """Three batches into a stored index of hashes: what each adds and how many of its rows were known or repeats."""
    c, kept, outcome = compact(spark, sf_dir), store.HashStore(spark), []
    for n in range(3):
        batch = store.stored_row(identity.widened(c.where((F.col("batch") == n) | F.col("again")), "seq"), "scrape", f"run-{n}", "seq").drop("data")
        _, new, skipped = kept.insert(batch, ["seq"])
        outcome.append((n, new, skipped))
    kept.drop()
    return spark.createDataFrame(outcome, "batch int, new_rows bigint, skipped bigint")


_WIDE = {c: "''" for c in identity.CANONICAL} | {c: f"trim({c})" for c in COMPACT if c in identity.CANONICAL} | {c: f"'{v}'" for c, v in identity.CONSTANTS.items()} | {"date": "tournament_date", "tournament_start_date": "tournament_date", "tournament_end_date": "tournament_date", "draw_type": "draw_team_type"}


@query("prj04_canonical_row", f"SELECT seq, {', '.join(f'{sql} AS {c}' for c, sql in _WIDE.items())} FROM ({_COMPACT})")
def prj04_canonical(spark, sf_dir):
    """All canonical columns of a compact row."""
    return identity.canonical_row(identity.widened(compact(spark, sf_dir), "seq"), identity.CANONICAL, "seq")


@query("jon07_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def jon07(spark, sf_dir):
    """Orders without a returned line."""
    gone = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").join(gone, "o_orderkey", "left_anti").select("o_orderkey")


@query("ded21_whole_rows", f"WITH m AS ({MATCHES}) SELECT DISTINCT tournament, draw, round, score FROM m")
def ded21(spark, sf_dir):
    return matches(spark, sf_dir).select("tournament", "draw", "round", "score").distinct()


@query("ded23_groups_before_knockout", f"WITH m AS ({MATCHES}), u AS (SELECT draw_id, 0 AS part, seq FROM m WHERE round = 'O' UNION ALL SELECT draw_id, 1, seq FROM m WHERE round = 'F') SELECT draw_id, part, seq FROM u QUALIFY row_number() OVER (PARTITION BY draw_id ORDER BY part, seq) = 1")
def ded23(spark, sf_dir):
    """Ties of round-robin groups come before knock-out ones with the same id."""
    m = matches(spark, sf_dir)
    both = m.where("round = 'O'").select("draw_id", F.lit(0).alias("part"), "seq").unionByName(m.where("round = 'F'").select("draw_id", F.lit(1).alias("part"), "seq"))
    return rows.first_seen(both, [F.col("draw_id")], ["part", "seq"])


@query("ded24_ties_across_branches", "SELECT DISTINCT o_custkey, l_partkey % 50 AS tie_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def ded24(spark, sf_dir):
    """Branches of ties, exploded, each tie once."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("ties"))
    return read(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.explode("ties").alias("tie_id")).distinct()


@query("ded25_canonical_pages", r"""SELECT page_id, concat(lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)), lower(regexp_replace(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)?([^?]*)', 1), '/+$', '')),
  CASE WHEN strpos(u, '?') > 0 AND regexp_extract(u, '\?(.*)$', 1) <> '' THEN concat('?', array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '')), '&')) ELSE '' END) AS url
  FROM (SELECT page_id, regexp_replace(trim(coalesce(url, '')), '#.*$', '') AS u FROM pages)""")
def ded25(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("url"))


@query("ded27_ordered_distinct", "SELECT l_orderkey, array_to_string(list(flag ORDER BY first, flag), '') AS flags FROM (SELECT l_orderkey, l_returnflag AS flag, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def ded27(spark, sf_dir):
    """Distinct values of a list in the order of their first appearance."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return lines.select("l_orderkey", F.array_join(F.array_distinct(F.transform("x", lambda x: x["l_returnflag"])), "").alias("flags"))


@query("ded28_conflicts_ignored", "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def ded28(spark, sf_dir):
    """A unique key per customer: taken keys and later claims are ignored."""
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    taken = orders.where("o_orderpriority = '1-URGENT'")
    known = read(spark, sf_dir, "customer").select("c_custkey")
    return rows.only_new(orders.join(known, "c_custkey", "left_semi").select("c_custkey", "o_orderkey"), taken, "c_custkey", ["o_orderkey"])


@query("ded29_sorted_union", "SELECT id, row_number() OVER (ORDER BY CAST(id AS bigint)) AS place FROM (SELECT CAST(l_suppkey AS string) AS id FROM lineitem UNION SELECT CAST(s_suppkey AS string) FROM supplier)")
def ded29(spark, sf_dir):
    """Ids as text, united, in the order of their numbers."""
    ids = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("id")).union(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string"))).distinct()
    return rows.numbered(ids.withColumn("n", F.col("id").cast("long")), "n", [F.col("n")]).select("id", "place")


@query("ded31_players_of_match", f"WITH m AS ({MATCHES}), p AS (SELECT match_url, CASE WHEN round = 'O' THEN w1_id ELSE '' END AS id, w1 AS name, seq FROM m) SELECT match_url, CASE WHEN id <> '' THEN id ELSE name END AS player, min(seq) AS seq FROM p GROUP BY ALL")
def ded31(spark, sf_dir):
    """Players of a match, once by id or else by name."""
    m = matches(spark, sf_dir).withColumn("player", F.when(F.col("round") == "O", identity.first_given(F.col("w1_id"), F.col("w1"))).otherwise(F.col("w1")))
    return m.groupBy("match_url", "player").agg(F.min("seq").alias("seq"))


@query("prj05_canonical_row", f"WITH m AS ({MATCHES}) SELECT CAST(seq AS string) AS seq, trim(concat(' ', w1)) AS w1, '' AS nothing FROM m")
def prj05(spark, sf_dir):
    return identity.canonical_row(matches(spark, sf_dir).withColumn("w1", F.concat(F.lit("\n"), "w1")), ["seq", "w1", "nothing"])


@query("prj13_composite_id", f"WITH m AS ({MATCHES}) SELECT seq, trim(concat(match_id, '-', draw, '-', w2), '-') AS id FROM m")
def prj13(spark, sf_dir):
    return matches(spark, sf_dir).select("seq", identity.composite_id(F.col("match_id"), F.col("draw"), F.col("w2")).alias("id"))


@query("prj14_partner_only", f"WITH m AS ({MATCHES}) SELECT seq, CASE WHEN w2 <> '' THEN source ELSE '' END AS partner_source FROM m")
def prj14(spark, sf_dir):
    return matches(spark, sf_dir).select("seq", identity.partner_only(F.col("w2"), F.col("source")).alias("partner_source"))


@query("prj12_two_slots", f"WITH m AS ({MATCHES}) SELECT seq, w1 AS one, CASE WHEN w2 <> '' THEN w2 ELSE '' END AS two FROM m")
def prj12(spark, sf_dir):
    people = F.filter(F.array("w1", "w2"), lambda x: x != "")
    return matches(spark, sf_dir).withColumn("two_", identity.two_slots(people)).select("seq", F.col("two_")[0].alias("one"), F.col("two_")[1].alias("two"))


@query("prj08_side_field", f"WITH m AS ({MATCHES}) SELECT seq, CASE WHEN draw = 'R' THEN l1 ELSE w1 END AS winner, CASE WHEN draw = 'R' THEN w1 ELSE l1 END AS loser FROM m")
def prj08(spark, sf_dir):
    code = F.when(F.col("draw") == "R", "Team2Win").otherwise("Team1Win")
    return matches(spark, sf_dir).select("seq", identity.side_field(code, F.col("w1"), F.col("l1"), True).alias("winner"), identity.side_field(code, F.col("w1"), F.col("l1"), False).alias("loser"))


@query("prj10_first_given", f"WITH m AS ({MATCHES}) SELECT seq, CASE WHEN match_id <> '' THEN match_id WHEN w2 <> '' THEN w2 ELSE url END AS value FROM m")
def prj10(spark, sf_dir):
    return matches(spark, sf_dir).select("seq", identity.first_given(F.col("match_id"), F.col("w2"), F.col("url")).alias("value"))


@query("prj11_required_fields", f"WITH m AS ({MATCHES}) SELECT seq FROM m WHERE match_id <> '' AND w2 <> '' AND score <> ''")
def prj11(spark, sf_dir):
    return identity.required(matches(spark, sf_dir), ["match_id", "w2", "score"]).select("seq")


@query("prj07_role_columns", f"WITH m AS ({MATCHES}) SELECT seq, w1 AS winner_name, w1_id AS winner_id, l1 AS loser_name, l1_id AS loser_id FROM m")
def prj07(spark, sf_dir):
    m = matches(spark, sf_dir).select("seq", F.struct(F.col("w1").alias("n"), F.col("w1_id").alias("i")).alias("winner"), F.struct(F.col("l1").alias("n"), F.col("l1_id").alias("i")).alias("loser"))
    return m.select("seq", *identity.role_columns(["winner", "loser"], {"name": "n", "id": "i"}))


@query("prj04_widen_row", f"WITH m AS ({MATCHES}) SELECT seq, '' AS ball_type, tournament AS tournament_name, trim(regexp_replace(w1, '\\s+', ' ', 'g')) AS winner_1_name, CASE WHEN w2 = '' THEN 'Singles' ELSE 'Doubles' END AS draw_team_type, tournament AS winner_1_college FROM m")
def prj04(spark, sf_dir):
    """A compact row widened with constants, copies and derived columns."""
    return matches(spark, sf_dir).select("seq", F.lit("").alias("ball_type"), F.col("tournament").alias("tournament_name"), collapse(F.col("w1")).alias("winner_1_name"), F.when(F.col("w2") == "", "Singles").otherwise("Doubles").alias("draw_team_type"), F.col("tournament").alias("winner_1_college"))
