"""Scalar operators over columns of whole tables, with SQL that computes each value; the stated cases stay as tests.

Inputs are texts and numbers made of the tables' own columns, in SQL that both engines read. Every seventh or so is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.plans.catalog import FACTS, ORACLE_SQL, OUTPUTS, QUERIES, read, split_ddl

KEYS = {"part": "p_partkey", "customer": "c_custkey", "orders": "o_orderkey", "pages": "page_id", "documents": "doc_id", "lineitem": "l_orderkey * 8 + l_linenumber", "events": "event_id"}
#: White space of any kind in DuckDB's patterns.
W = r"[\s\v\x{85}\p{Z}]"


def applied(name: str, table: str, inputs: list[str], *sql: str, nested: tuple[str, ...] = ()) -> None:
    """Runs the expression of the stated cases ``name`` over ``inputs`` of a table; ``sql``: each output, of the inputs' names.

    ``nested``: inputs of types that the engines write differently; the SQL has to do without them.
    """
    ddl, _, f = FACTS[name]
    names = [c.split()[0] for c in split_ddl(ddl)]
    assert len(names) == len(inputs), name
    key = f"{KEYS[table]} AS id"
    given = [f"{x} AS {n}" for n, x in zip(names, inputs)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, table).selectExpr(key, *given)
        value = f(*map(F.col, names))
        return rows.select("id", *(c.alias(a) for a, c in (value if isinstance(value, dict) else {"value": value}).items()))

    QUERIES[name] = run
    outs = OUTPUTS.get(name) or ["value"]
    assert len(outs) == len(sql), name
    shown = ", ".join(f'{s} AS "{o}"' for s, o in zip(sql, outs))
    common = [x for x, n in zip(given, names) if n not in nested]
    ORACLE_SQL[name] = f"WITH t AS (SELECT *, {', '.join([key, *common])} FROM {table}) SELECT id, {shown} FROM t"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{W}+|{W}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{W}+', ' ', 'g')")


def some(key: str, x: str, every: int = 7) -> str:
    """``x``, null in one row of ``every``."""
    return f"CASE WHEN {key} % {every} = 3 THEN NULL ELSE {x} END"


def chosen(key: str, *choices: str) -> str:
    """One of several expressions by the key."""
    return f"CASE {key} % {len(choices)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices)) + " END"


TEXT = "text"
NAME = some("p_partkey", "concat(' ', p_name, chr(9), chr(160), upper(p_type), ' ')")
COMMA = chosen("p_partkey", "concat(p_type, ' , ', p_name)", "concat(' ', p_name, chr(160), p_type)", "p_type", "concat(p_type, ',')", "NULL")
WORDS = f"string_split({collapse('a')}, ' ')"
TURNED = f"CASE WHEN len({WORDS}) < 2 THEN {collapse('a')} ELSE concat({WORDS}[-1], ', ', array_to_string({WORDS}[:-2], ' ')) END"
AFTER_COMMA = f"ltrim(substr({collapse('a')}, strpos({collapse('a')}, ',') + 1))"
BEFORE_COMMA = f"rtrim(split_part({collapse('a')}, ',', 1))"

applied("stg01_collapse", "documents", [TEXT], collapse("a"))
applied("stg02_normal", "documents", [TEXT], f"lower({collapse('a')})")
applied("stg03_first_letter", "part", [NAME], f"lower(substr({collapse('a')}, 1, 1))")
applied("stg04_score_key", "lineitem", [some("l_orderkey", "concat(' ', l_linenumber, ' - ', l_suppkey, ', ', l_returnflag, ' ;;')")], "CASE WHEN a IS NULL THEN '' ELSE lower(concat(l_linenumber, '-', l_suppkey, ',', l_returnflag)) END")
applied("stg05_last_first", "part", [COMMA], f"CASE WHEN strpos(a, ',') > 0 THEN concat_ws(', ', {BEFORE_COMMA}, nullif({AFTER_COMMA}, '')) ELSE {TURNED} END")
applied("stg06_last_first_verbatim", "part", [COMMA], f"CASE WHEN strpos(a, ',') > 0 THEN {collapse('a')} ELSE {TURNED} END")
applied("stg07_last_first_always", "part", [COMMA], TURNED)
applied("stg08_name_of_parts", "part", [chosen("p_partkey", "p_type", "'  '", "concat(p_type, ' ')", "NULL"), chosen("p_partkey", "p_name", "p_name", "NULL", "''", "concat(' ', p_name)")], "concat_ws(', ', nullif(trim(a), ''), nullif(trim(b), ''))")
applied("stg09_title_if_capitals", "part", [NAME], f"array_to_string([CASE WHEN w = upper(w) AND w <> lower(w) THEN concat(substr(w, 1, 1), lower(substr(w, 2))) ELSE w END FOR w IN {WORDS}], ' ')")
applied("stg10_title", "documents", [TEXT], r"coalesce(array_to_string([concat(replace(upper(substr(r, 1, 1)), 'ẞ', 'Ss'), lower(substr(r, 2))) FOR r IN regexp_extract_all(a, '\pL+|\PL+')], ''), '')")
applied("stg11_without_seed", "part", [chosen("p_partkey", "concat(p_name, ' [', p_size, '/2] ')", "concat('[', p_size, '] ', p_name)", "concat(' ', p_name, ' ')", "NULL")], "CASE WHEN a IS NULL THEN '' WHEN p_partkey % 4 = 1 THEN trim(a) ELSE p_name END")
applied("stg12_without_parentheses", "documents", [some("doc_id", "concat('(', text, ') ')")], strip("replace(replace(a, '(', ''), ')', '')"))
applied("stg13_without_notes", "part", [chosen("p_partkey", "concat(p_name, ' , ', p_type, ' (Moved up)', ' [', p_size, ']')", "concat(p_name, ' (', p_type, ')')", "NULL")], "CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ', ', p_type) WHEN 1 THEN a ELSE '' END")
applied("stg14_plain", "documents", [TEXT], "lower(strip_accents(coalesce(a, '')))")
applied("stg15_name_key", "documents", [TEXT], collapse("lower(strip_accents(a))"))
applied("stg16_name_tokens", "pages", ["url"], "array_to_string(list_filter(list_filter(regexp_extract_all(lower(url), '[a-z0-9]+'), lambda x, i: list_position(regexp_extract_all(lower(url), '[a-z0-9]+'), x) = i), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+')), '|')")
applied("stg17_split_location", "customer", [chosen("c_custkey", "concat(c_name, ' | ', c_mktsegment, ', N', c_nationkey)", "concat(' ', c_mktsegment, ' ')", "concat(c_mktsegment, ', x, N', c_nationkey)", "NULL")], "CASE c_custkey % 4 WHEN 3 THEN '' ELSE c_mktsegment END", "CASE WHEN c_custkey % 4 IN (0, 2) THEN concat('N', c_nationkey) ELSE '' END")
applied("stg18_suffix_after", "part", ["p_name", chosen("p_partkey", "concat('The ', p_name, ' - ', p_type, ' ')", "concat(p_name, ', ', p_type)", "p_type", "NULL")], "CASE WHEN p_partkey % 4 < 2 THEN p_type ELSE '' END")
applied("stg19_first_named", "part", [chosen("p_partkey", "'Neutral'", "' '", "concat(p_type, ' ')", "NULL"), chosen("p_partkey % 8", "p_name", "p_name", "p_name", "p_name", "' NEUTRAL '", "NULL", "p_brand")], "CASE WHEN p_partkey % 4 = 2 THEN p_type WHEN upper(trim(b)) = 'NEUTRAL' THEN '' ELSE coalesce(b, '') END")
applied("stg20_before_parenthesis", "documents", [some("doc_id", "concat(substr(text, 1, 40), ' (', text)")], strip("split_part(a, '(', 1)"))
applied("stg21_name_and_gender", "part", [chosen("p_partkey", "concat(p_name, ' (W) ', p_type)", "concat(p_name, ' (M)')", "concat(p_name, ' (F)')", "p_name", "NULL")], "CASE WHEN p_partkey % 5 < 3 THEN p_name ELSE '' END", "CASE p_partkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'M' WHEN 2 THEN 'F' ELSE '' END")
PATH = "split_part(split_part(split_part(a, '://', 2), '?', 1), '#', 1)"
applied("stg22_last_segment", "pages", ["url"], f"coalesce(list_filter(string_split({PATH}, '/')[2:], lambda x: x <> '')[-1], '')")
applied("stg23_profile_guid", "pages", [chosen("page_id", "concat('https://a.example/player-profile/', page_id, '/x?id=z')", "concat('https://a.example/Profile/d.aspx?x=1&id=', page_id, '#t')", "url", "NULL")], "CASE WHEN page_id % 4 < 2 THEN CAST(page_id AS string) ELSE '' END")
applied("stg24_absolute_url", "pages", [chosen("page_id", "concat('/t/', page_id, '#x')", "concat('d?e=', page_id)", "'//b.example/k'", "url", "'#top'", "NULL"), "'https://a.example/p/q?z/y'"], "CASE page_id % 6 WHEN 0 THEN concat('https://a.example/t/', page_id) WHEN 1 THEN concat('https://a.example/p/d?e=', page_id) WHEN 2 THEN 'https://b.example/k' WHEN 3 THEN split_part(url, '#', 1) ELSE '' END")
applied("stg25_http_or_blank", "pages", [chosen("page_id", "concat(' ', url, chr(10))", "concat('ftp', url)", "NULL", "upper(url)")], "CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 3 THEN upper(url) ELSE '' END")
applied("stg26_url_by_kind", "customer", [chosen("c_custkey", "'League'", "'CUP'", "c_mktsegment", "NULL"), some("c_custkey", "concat(' ', c_nationkey)", 5)], "CASE WHEN b IS NULL THEN '' WHEN c_custkey % 4 = 0 THEN concat('https://x.example/l/', c_nationkey) WHEN c_custkey % 4 = 1 THEN concat('https://x.example/c/', c_nationkey) ELSE '' END")
applied("stg27_slug_url", "part", [NAME], f"concat('https://x.example/', replace({collapse('a')}, ' ', '-'))")
applied("stg28_local_id", "documents", [TEXT], "concat('local_', CAST(concat('0x', substr(sha256(coalesce(a, '')), 1, 16)) AS UBIGINT))")
applied("stg29_exported_id", "customer", [chosen("c_custkey", "concat('local_', c_custkey)", "c_name", "NULL")], "CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE '' END")
applied("stg31_masked_address", "pages", [chosen("page_id", "replace(url, '://', concat('://u', page_id, ':p', page_id, '@'))", "url", "NULL")], "CASE page_id % 3 WHEN 0 THEN replace(url, '://', concat('://u', page_id, ':****@')) WHEN 1 THEN url ELSE '' END")
applied("stg32_host_only", "pages", [chosen("page_id", "replace(url, '://', concat('://u', page_id, ':p@'))", "url", "NULL")], "CASE WHEN a IS NULL THEN '' ELSE regexp_extract(split_part(url, '://', 2), '^[^/:?#]*') END")
applied("stg33_looks_like_licence", "customer", [chosen("c_custkey", "substr(c_name, 10)", "concat(' ', c_custkey, ' ')", "c_name", "NULL")], "CASE c_custkey % 4 WHEN 0 THEN length(substr(c_name, 10)) >= 6 WHEN 1 THEN c_custkey >= 100000 ELSE false END")
applied("stg34_mentions", "part", [some("p_partkey", "concat('x@no @', replace(p_name, ' ', '.'), ' <a data-username=\"', p_type, '\"> @', p_type)")], "CASE WHEN a IS NULL THEN '' ELSE concat(p_type, '|', replace(p_name, ' ', '.')) END")
applied("stg36_same_text", "part", [NAME, "concat(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_brand END)"], "p_partkey % 7 <> 3 AND p_partkey % 2 = 0")
applied("stg37_country_code", "documents", [TEXT], "replace(upper(substr(coalesce(a, ''), 1, 3)), 'ẞ', 'SS')")
applied("stg38_before_dash", "orders", [some("o_orderkey", "concat(' ', o_orderpriority)")], "CASE WHEN a IS NULL THEN '' ELSE substr(o_orderpriority, 1, strpos(o_orderpriority, '-') - 1) END")
applied("stg39_digits_and_plus", "documents", [some("doc_id", "concat(text, doc_id, '+')")], "regexp_replace(coalesce(a, ''), '[^0-9+]', '', 'g')")
applied("stg40_dual_name", "part", [chosen("p_partkey", "concat(' ', p_name)", "' '", "NULL"), "p_type", some("p_partkey", "p_brand")], "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat('Dual Match: ', b, ' vs ', c) END")
applied("snk03_guarded_cell", "documents", [chosen("doc_id", "concat('=', text)", "text", "concat('@', text)", "concat('-', doc_id)", "NULL")], "CASE WHEN left(a, 1) IN ('=', '+', '-', '@') THEN concat('''', a) ELSE coalesce(a, '') END")
applied("snk05_redacted", "documents", [some("doc_id", "concat(text, ' http://u', doc_id, ':p@h.example/x')")], "coalesce(replace(a, concat('u', doc_id, ':p@'), '***:***@'), '')")
applied("ded25_canonical_url", "pages", ["concat(upper(split_part(split_part(url, '?', 1), '#', 1)), '/?z=1&b=', page_id, '&&a=Q#x')"], "concat(rtrim(lower(split_part(split_part(url, '?', 1), '#', 1)), '/'), '?a=Q&b=', page_id, '&z=1')")

DRAW = chosen("p_partkey", "concat('Girls ', p_name)", "concat(p_type, ' MS', p_size)", "'WD/MD'", "concat('Mixed ', p_name)", "'Mješoviti parovi girls'", "concat('Juniorke ', p_brand)", "'Men and Women'", "concat('Germs ', p_name)", "NULL", "concat('Ladies'' ', p_type)")
applied("cls01_draw_gender", "part", [DRAW], "CASE WHEN p_partkey % 10 IN (0, 5, 9) THEN 'F' WHEN p_partkey % 10 = 1 THEN 'M' ELSE '' END")
applied("cls02_is_mixed_draw", "part", [DRAW], "p_partkey % 10 IN (3, 4)")
SEX = chosen("c_custkey", "' Men '", "'woman'", "'boys'", "'W'", "'GIRL'", "c_mktsegment", "NULL", "'Male'", "'f'", "CAST(c_nationkey AS string)", "'Boys'", "'Girls'")
LOW = "lower(trim(coalesce(a, '')))"
applied("cls03_gender_code", "customer", [SEX], f"CASE WHEN {LOW} IN ('men', 'male') THEN 'M' WHEN {LOW} IN ('woman', 'w', 'f') THEN 'F' ELSE '' END")
applied("cls04_gender_spelt", "customer", [SEX], f"CASE WHEN {LOW} IN ('men', 'boys', 'male') THEN 'Male' WHEN {LOW} IN ('girl', 'girls', 'w', 'f') THEN 'Female' ELSE trim(coalesce(a, '')) END")
applied("cls05_gender_code_or_text", "customer", [SEX], f"CASE WHEN {LOW} IN ('men', 'boys', 'male') THEN 'M' WHEN {LOW} IN ('girl', 'girls', 'w', 'f') THEN 'F' ELSE trim(coalesce(a, '')) END")
applied("cls06_gender_or_number", "customer", [SEX], f"CASE WHEN {LOW} = 'male' THEN 'M' WHEN {LOW} = 'f' THEN 'F' WHEN c_custkey % 12 = 9 THEN a ELSE '' END")
applied("cls07_boys_girls", "customer", [SEX], "CASE WHEN c_custkey % 12 = 10 THEN 'M' WHEN c_custkey % 12 = 11 THEN 'F' ELSE '' END")
applied("cls10_team_type", "part", [chosen("p_partkey", "concat(p_name, ' DOUBLES')", "p_name", "NULL")], "CASE WHEN p_partkey % 3 = 0 THEN 'Doubles' ELSE 'Singles' END")
applied("cls11_any_given", "part", [chosen("p_partkey", "p_name", "' '", "NULL"), chosen("p_partkey % 4", "'x'", "NULL", "''")], "coalesce(trim(a), '') <> '' OR coalesce(b, '') <> ''")
applied("cls12_is_doubles", "part", [chosen("p_partkey", "'doubles'", "p_type", "NULL"), chosen("p_partkey", "NULL", "' '"), chosen("p_partkey", "''", "p_name", "NULL", "' '", "NULL")], "p_partkey % 3 = 0 OR p_partkey % 5 = 1")
applied("cls13_outcome_of", "orders", [chosen("o_orderkey", "'Player retired'", "' '", "NULL", "o_orderpriority"), chosen("o_orderkey", "'ended'", "'walkover'", "'Closed'", "'not_started'", "NULL", "'defaulted'", "concat('late_', o_orderstatus)")], "CASE WHEN o_orderkey % 4 = 0 THEN 'Retired' WHEN o_orderkey % 4 < 3 AND b = 'walkover' THEN 'Walkover' WHEN o_orderkey % 4 < 3 AND b = 'defaulted' THEN 'Defaulted' WHEN b IS NULL OR b IN ('ended', 'Closed') THEN 'Completed' ELSE array_to_string([concat(upper(substr(w, 1, 1)), lower(substr(w, 2))) FOR w IN string_split(b, '_')], ' ') END")
applied("cls14_outcome_in_text", "documents", [chosen("doc_id", "text", "concat(text, ' w.o. ', text)", "concat(text, ' 3-0 ret.')", "concat('Walk over ', text)", "concat(text, ' two ')", "NULL")], r"CASE WHEN regexp_matches(lower(coalesce(a, '')), '\bw\.?\s?o\.?([^a-z]|$)|walk\s?over') THEN 'Walkover' WHEN regexp_matches(lower(coalesce(a, '')), '\bret\b|retired|abandon') THEN 'retired' ELSE 'Completed' END")
applied("cls15_result_sides", "orders", [chosen("o_orderkey", "'Team1Win'", "'TEAM2WIN'", "o_orderstatus", "NULL")], "CASE WHEN o_orderkey % 4 = 1 THEN '2' ELSE '1' END", "CASE WHEN o_orderkey % 4 = 1 THEN '1' ELSE '2' END", "CASE WHEN o_orderkey % 4 < 2 THEN 'Completed' ELSE 'Tie' END")
applied("cls18_labelled_id", "orders", [chosen("o_orderkey", "concat(o_custkey, ' ')", "'NULL'", "' '", "NULL"), some("o_orderkey", "o_orderpriority")], "CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS string) ELSE coalesce(b, '') END", "CASE WHEN o_orderkey % 4 = 0 THEN 'first' WHEN b IS NOT NULL THEN 'second' ELSE '' END")
STATE = chosen("o_custkey", "'success'", "'failed'", "'stopped'", "'partial'", "'queued'", "'running'", "NULL")
applied("cls19_parent_state", "orders", ["o_orderstatus = 'O'", STATE], "CASE WHEN r THEN 'running' WHEN s IN ('failed', 'stopped') THEN s WHEN s IN ('success', 'partial') THEN 'healthy' ELSE 'idle' END")
applied("cls20_job_state", "orders", [STATE], "CASE WHEN s IN ('running', 'queued', 'failed', 'stopped') THEN s ELSE 'healthy' END")
applied("cls21_severity", "customer", [some("c_custkey", "c_acctbal / 100")], "CASE WHEN c_custkey % 7 <> 3 AND c_acctbal / 100 >= 90 THEN 'high' WHEN c_custkey % 7 <> 3 AND c_acctbal / 100 >= 70 THEN 'warn' ELSE 'ok' END")
applied("cls23_cascade", "lineitem", [some("l_orderkey + 2", "l_linenumber", 4), some("l_partkey", "l_linenumber + 10", 4), some("l_suppkey", "l_linenumber + 20")], "ifnull(a, ifnull(b, c))")
applied("cls24_points_winner", "lineitem", ["l_returnflag = 'A' AND l_linenumber = 1", "l_returnflag = 'R' AND l_linenumber = 2", some("l_orderkey", "concat('p ', l_linenumber, ' - ', l_suppkey % 9)")], "CASE WHEN a THEN 0 WHEN b THEN 1 WHEN p IS NULL OR l_linenumber = l_suppkey % 9 THEN NULL WHEN l_linenumber > l_suppkey % 9 THEN 0 ELSE 1 END")
applied("cls25_single_marked", "lineitem", ["l_returnflag = 'A'", "l_linestatus = 'F'"], "CASE WHEN a <> b THEN CASE WHEN a THEN 0 ELSE 1 END END")
applied("cls27_draw_gender_from_winner", "part", [DRAW, chosen("p_size", "'m'", "'F'", "''", "NULL")], "CASE WHEN p_partkey % 10 IN (0, 5, 9) THEN 'Female' WHEN p_partkey % 10 = 1 THEN 'Male' WHEN p_partkey % 10 IN (3, 4) THEN 'Mixed' WHEN b = 'm' THEN 'Male' WHEN b = 'F' THEN 'Female' ELSE '' END")
applied("cls30_outcome_of_codes", "orders", [chosen("o_orderkey", "'wo'", "o_orderstatus", "NULL"), chosen("o_custkey", "concat(' ab', o_custkey)", "o_orderpriority", "NULL", "'Wo '")], "CASE WHEN a = 'wo' OR o_custkey % 4 = 3 THEN 'Walkover' WHEN o_custkey % 4 = 0 THEN 'retired' ELSE 'Completed' END")
applied("cls31_outcome_from_score", "lineitem", [chosen("l_orderkey", "concat(l_linenumber, '/2 W.O.')", "concat(l_linenumber, '/2 ret')", "concat(l_linenumber, '/2')", "NULL")], "CASE l_orderkey % 4 WHEN 0 THEN 'Walkover' WHEN 1 THEN 'retired' ELSE 'Completed' END")
applied("cls32_same_week", "orders", ["date_add(DATE '2026-02-20', CAST(o_orderkey % 30 AS int))"], "o_orderkey % 30 BETWEEN 10 AND 16")


def number(x: str, low: int, n: int) -> str:
    return f"CAST({low} + {x} % {n} AS int)"


D, M, Y = (f"{part}(o_orderdate)" for part in ("day", "month", "year"))
DAY = "CAST(o_orderdate AS date)"
ISO = f"CAST({DAY} AS string)"
NAMES = "CASE month(o_orderdate) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate("January February March April May June July August September October November December".split())) + " END"
SPELT = chosen("o_orderkey", f"concat({Y}, '-', {M}, '-', {D})", f"concat(' ', {M}, '/', {D}, '/', {Y})", f"concat({NAMES}, ' ', {D}, ',  ', {Y})", f"concat(substr({NAMES}, 1, 3), ' ', {D}, ', ', {Y})", "o_orderpriority", "NULL", f"concat({Y}, '-02-30')")
applied("dat01_identity_date", "orders", [SPELT], f"CASE WHEN o_orderkey % 7 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE lower(coalesce(a, '')) END")
applied("dat02_us_date", "orders", [chosen("o_orderkey", f"concat({D}, '/', {M}, '/', {Y})", f"concat({D}, '.', {M}, '.', {Y}, ' ')", "o_orderpriority", "NULL")], "CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE '' END")
applied("dat03_us_date_single", "orders", [chosen("o_orderkey", f"concat({ISO}, 'T10:20:30')", ISO, "NULL")], "CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE '' END")
applied("dat04_us_date_or_text", "orders", [chosen("o_orderkey", f"concat({Y}, '-', {M}, '-', {D})", f"concat({ISO}, 'T10:20:30Z')", "concat(' ', o_orderpriority)", "NULL")], "CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE trim(coalesce(a, '')) END")
applied("dat05_iso_prefix_date", "orders", [chosen("o_orderkey", f"concat(' ', {ISO}, 'T10:20:30.5Z')", ISO, "concat('0001-01-0', 1 + o_orderkey % 9)", f"concat({Y}, '-13-01')", "NULL")], "CASE WHEN o_orderkey % 5 < 2 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE '' END")
applied("dat06_feed_date", "orders", [chosen("o_orderkey", f"concat({M}, '/', {D}, '/', {Y}, ' 1:02:03 PM')", f"concat({M}, '/', {D}, '/', {Y})", f"concat({Y}, '-', {M}, '-', {D})", f"concat({ISO}, 'T1:2:3')", "concat(o_orderpriority, ' ')", "NULL")], "CASE WHEN o_orderkey % 6 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE trim(coalesce(a, '')) END")
applied("dat07_epoch_or_iso", "orders", [chosen("o_orderkey", "concat('/Date(', o_custkey * 86400000, ')/')", f"concat({ISO}, 'T00:00:00')", "o_orderpriority", "NULL")], f"CASE o_orderkey % 4 WHEN 0 THEN DATE '1970-01-01' + CAST(o_custkey AS int) WHEN 1 THEN {DAY} END")
RANGE = chosen("o_orderkey", f"concat({ISO}, ' - ', {ISO})", f"concat({D}, '. ', {M}, '.-1. 1. ', {Y} + 1)", f"concat({D}, '. ', {M}, '. ', {Y}, ' - 2. 1. ', {Y} + 1)", "o_orderpriority", "NULL")
applied("dat08_date_range", "orders", [RANGE], f"CASE o_orderkey % 5 WHEN 0 THEN {DAY} WHEN 1 THEN try_cast(concat({Y} + 1, '-', {M}, '-', {D}) AS date) WHEN 2 THEN {DAY} END", f"CASE o_orderkey % 5 WHEN 0 THEN {DAY} WHEN 1 THEN make_date({Y} + 1, 1, 1) WHEN 2 THEN make_date({Y} + 1, 1, 2) END")
applied("dat09_european_range", "orders", [chosen("o_orderkey", f"concat({D}, '. ', {M}, '.-31. 12. ', {Y})", f"concat({D}, '.-28. ', {M}, '. ', {Y})", f"concat({D}, '. ', {M}, '. ', {Y}, ' ')", f"concat('28. 12.-', {D}, '. 1. ', {Y})", "o_orderpriority", "NULL")], f"CASE o_orderkey % 6 WHEN 0 THEN {DAY} WHEN 1 THEN CASE WHEN {D} > 28 THEN CAST({DAY} - INTERVAL 1 YEAR AS date) ELSE {DAY} END WHEN 2 THEN {DAY} WHEN 3 THEN make_date({Y} - 1, 12, 28) END", f"CASE o_orderkey % 6 WHEN 0 THEN make_date({Y}, 12, 31) WHEN 1 THEN make_date({Y}, {M}, 28) WHEN 2 THEN {DAY} WHEN 3 THEN make_date({Y}, 1, {D}) END")
applied("dat10_dates_in_text", "orders", [chosen("o_orderkey", f"concat('from ', {D}, '/', {M}, '/', {Y}, ' to 2030-02-05 ok')", f"concat('on ', {ISO}, ' 30/30/2020')", "o_orderpriority", "NULL")], f"CASE WHEN o_orderkey % 4 < 2 THEN {DAY} END", f"CASE o_orderkey % 4 WHEN 0 THEN DATE '2030-02-05' WHEN 1 THEN {DAY} END")
applied("dat11_range_with_year", "orders", [chosen("o_orderkey", f"concat({D}, ' ', {NAMES}, ' ', {Y}, ' - 5 June 2030')", f"concat({NAMES}, ' ', {D}, ' ', {Y})", f"concat('3 May to ', {D}, ' ', {NAMES}, ' ', {Y})", "''", "NULL")], f"CASE o_orderkey % 5 WHEN 0 THEN {DAY} WHEN 1 THEN {DAY} WHEN 2 THEN DATE '2026-05-03' END", f"CASE o_orderkey % 5 WHEN 0 THEN DATE '2030-06-05' WHEN 1 THEN {DAY} WHEN 2 THEN {DAY} END")
applied("dat12_range_as_of", "orders", [chosen("o_orderkey", f"concat('1 ', {NAMES}, ' to 2 June')", f"concat(substr({NAMES}, 1, 3), ' ', {D}, ' - Dec 31 ', {Y})", f"concat({D}, ' ', {NAMES}, ' ', {Y})")], f"CASE o_orderkey % 3 WHEN 0 THEN make_date(CASE WHEN {M} > 6 THEN 2025 ELSE 2026 END, {M}, 1) ELSE {DAY} END", f"CASE o_orderkey % 3 WHEN 0 THEN DATE '2026-06-02' WHEN 1 THEN make_date({Y}, 12, 31) ELSE {DAY} END")
applied("dat13_spelt_range_start", "orders", [chosen("o_orderkey", f"concat({D}, ' - 31 ', {NAMES}, ' ', {Y})", f"concat({D}, ' ', {NAMES}, ' - 1 July ', {Y})", f"concat({D}, ' ', {NAMES}, ' July ', {Y})", f"concat(' ', {D}, ' ', {NAMES}, ' ', {Y})", "o_orderpriority", "NULL")], "CASE WHEN o_orderkey % 6 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END")
applied("dat14_past_date", "orders", [chosen("o_orderkey", f"concat({D}, '.0')", f"CAST({D} AS string)", "'31'", "NULL"), f"concat(' ', {M})", chosen("o_custkey", f"CAST({Y} AS string)", "'1899'", "'2030'")], f"CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN o_custkey % 3 = 0 AND o_orderkey % 4 = 2 AND {M} IN (1, 3, 5, 7, 8, 10, 12) THEN concat(lpad(CAST({M} AS string), 2, '0'), '/31/', {Y}) ELSE '' END")
applied("dat15_whole_number", "orders", [chosen("o_orderkey", "concat(' ', o_custkey)", "concat(o_custkey % 200, '.0')", "concat(o_custkey % 100, '.5')", "NULL")], "CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey < 100 THEN o_custkey END WHEN 1 THEN CASE WHEN o_custkey % 200 < 100 THEN o_custkey % 200 END END")
applied("dat16_lenient_int", "orders", [chosen("o_orderkey", "concat(o_custkey, ' ')", "CAST(o_totalprice AS string)", "o_orderpriority", "NULL")], "CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN CAST(floor(o_totalprice) AS bigint) ELSE 0 END")
applied("dat17_lenient_bool", "orders", [chosen("o_custkey", "'TRUE'", "' y'", "'1'", "'no'", "o_orderstatus", "NULL")], "o_custkey % 6 < 3")
applied("dat18_month_end", "orders", [some("o_orderkey", DAY)], "last_day(a)")
applied("dat19_clamp_day", "orders", [some("o_orderkey", DAY), number("o_custkey", 1, 31)], "CAST(least(date_trunc('month', a) + (d - 1) * INTERVAL 1 DAY, last_day(a)) AS date)")
applied("dat20_next_weekday", "orders", [some("o_orderkey", DAY), number("o_custkey", 0, 7)], "CAST(a + ((w - (isodow(a) - 1) + 7) % 7) * INTERVAL 1 DAY AS date)")
applied("dat22_first_anchor", "orders", [number("o_orderkey", 0, 86400), number("o_custkey", 0, 7), "o_orderdate"], "CAST((SELECT min(x) FROM unnest(list_transform(range(15), lambda i: date_trunc('day', t) + i * INTERVAL 1 DAY)) AS u(x) WHERE isodow(x) - 1 = w AND x + s * INTERVAL 1 SECOND > t) AS date)")
applied("dat23_lookback_days", "orders", [some("o_orderkey", "CAST(o_custkey % 60 AS int)")], "CASE WHEN a > 0 AND a < 50 AND a % 5 = 0 THEN a ELSE 15 END")
MS, BYTES = (some("o_orderkey", chosen("o_custkey", "o_custkey", "o_orderkey * 7", "CAST(floor(o_totalprice) AS bigint)", x)) for x in ("o_orderkey * 1000", "o_orderkey * 1048576"))
applied("dat24_duration_label", "orders", [MS], "CASE WHEN a IS NULL THEN '0 ms' WHEN a < 1000 THEN concat(a, ' ms') WHEN a < 60000 THEN concat(printf('%.1f', a / 1000 + 1e-9), 's') ELSE concat(round_even(a / 1000, 0)::BIGINT // 60, 'm ', lpad(CAST(round_even(a / 1000, 0)::BIGINT % 60 AS string), 2, '0'), 's') END")
applied("dat25_size_label", "orders", [BYTES], "CASE WHEN a IS NULL THEN '0 B' WHEN a < 1024 THEN concat(a, ' B') WHEN a < 1048576 THEN concat(printf('%.1f', a / 1024 + 1e-9), ' KB') ELSE concat(printf('%.1f', a / 1048576 + 1e-9), ' MB') END")
applied("dat26_progress_percent", "lineitem", ["l_linenumber", "CAST(l_suppkey % 9 AS int)"], "CASE WHEN b = 0 THEN 0 ELSE least(100, CAST(round_even(a * 100 / b, 0) AS int)) END")
applied("dat27_eta_label", "orders", [some("o_orderkey", chosen("o_custkey", "CAST(o_custkey AS double)", "0e0", "o_totalprice / 10", "CAST(o_custkey % 60 AS double) / 8"))], "CASE WHEN a IS NULL THEN '' WHEN a <= 0 THEN 'finishing…' ELSE (SELECT CASE WHEN s < 60 THEN concat('~', greatest(s, 1), 's left') WHEN s < 3600 THEN concat('~', s // 60, 'm ', lpad(CAST(s % 60 AS string), 2, '0'), 's left') ELSE concat('~', s // 3600, 'h ', lpad(CAST(s // 60 % 60 AS string), 2, '0'), 'm left') END FROM (SELECT CAST(round_even(a, 0) AS bigint) AS s)) END")
applied("dat28_clamped", "orders", [some("o_orderkey", "CAST(o_custkey % 40 - 5 AS int)")], "CASE WHEN a IS NULL OR a = 0 THEN 5 WHEN a < 1 THEN 1 WHEN a > 16 THEN 16 ELSE a END")
applied("dat29_backoff", "lineitem", ["l_linenumber"], "CAST(CASE WHEN a > 5 THEN 30 ELSE 1 << (a - 1) END AS double)")
applied("dat30_percent", "lineitem", ["l_quantity", some("l_orderkey", "CAST(l_suppkey % 64 AS double)")], "CASE WHEN coalesce(b, 0) = 0 THEN 0.0 ELSE round(least(100.0, a * 100.0 / b), 1) END")
applied("dat31_birth_date", "orders", [chosen("o_orderkey", f"concat({D}, '/', {M}, '/', {Y})", "o_orderstatus", "NULL"), chosen("o_custkey", f"concat({Y}, ' ')", "''", "NULL")], f"CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN o_custkey % 3 = 0 THEN concat('1/1/', {Y}) ELSE '' END")
applied("dat32_year_in_text", "orders", [chosen("o_orderkey", f"concat(o_orderpriority, ' b. ', {Y}, '-2050')", "concat(o_orderpriority, ' 1899')", "NULL")], f"CASE WHEN o_orderkey % 3 = 0 THEN concat('1/1/', {Y}) ELSE '' END")
applied("dat33_one_or_two_dates", "orders", [chosen("o_orderkey", f"concat({D}, '/', {M}, '/', {Y}, ' - 07/05/2026')", f"concat('le ', {D}, '/', {M}, '/', {Y})", "o_orderpriority", "NULL")], "CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE '' END", "CASE o_orderkey % 4 WHEN 0 THEN '05/07/2026' WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE '' END")
applied("dat34_default_year", "orders", [chosen("o_orderkey", f"concat('League ', {Y}, ' ', o_orderstatus)", f"concat('x', {Y})", "NULL"), number("o_custkey", 2000, 30)], f"CASE WHEN o_orderkey % 3 = 0 THEN {Y} ELSE b END")
applied("dat35_locale_date", "orders", [chosen("o_orderkey", f"concat({M}, '/', {D}, '/', {Y})", ISO, "o_orderstatus", "NULL")], f"CASE WHEN o_orderkey % 4 < 2 THEN {DAY} END", f"CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN {D} <= 12 THEN make_date({Y}, {D}, {M}) ELSE {DAY} END WHEN 1 THEN {DAY} END")
applied("win09_eta_seconds", "lineitem", ["l_returnflag <> 'A'", "l_linenumber", number("l_suppkey", 0, 9), some("l_orderkey", "l_quantity")], "CASE WHEN r AND t > 0 AND d > 0 AND e > 0 THEN CASE WHEN t <= d THEN 0.0 ELSE (t - d) / (d / e) END END")
applied("agg20_line_count", "documents", [TEXT], "CASE WHEN coalesce(a, '') = '' THEN 0 ELSE len(string_split(CASE WHEN right(a, 1) = chr(10) THEN left(a, length(a) - 1) ELSE a END, chr(10))) - 1 END")
applied("val02_key_batch", "documents", [some("doc_id", "concat(md5(text), ' ', upper(md5(text)), ' ', text, ' ', md5(CAST(doc_id AS string)))")], "CASE WHEN a IS NULL THEN NULL ELSE len(list_distinct(regexp_extract_all(lower(a), '[0-9a-f]{32}'))) END")

G1, G2, G3 = "l_linenumber", "CAST(l_quantity AS int) % 8", "l_suppkey % 7"
H1, H2, H3 = "l_partkey % 7", "l_orderkey % 8", "l_linenumber % 3"
THREE, OTHER = f"concat({G1}, ',', {G2}, ',', {G3})", f"concat({H1}, ',', {H2}, ',', {H3})"
LEFT = chosen("l_orderkey", THREE, f"concat({G1}, ',,', {G3})", "','")
RIGHT = chosen("l_suppkey", f"concat({H1}, ',', {H2})", OTHER, "',,'", f"CAST({H1} AS string)")
A, B = "string_split(a, ',')", "string_split(b, ',')"
OUTCOME = chosen("l_suppkey", "'Completed'", "'Completed'", "'retired'", "'Walkover'")
N = "range(1, {}(len(" + A + "), len(" + B + ")) + 1)"


def closed(x: str, empty: str) -> str:
    return f"CASE WHEN o = 'Walkover' THEN 'W.O.;' WHEN {x} = '' THEN '{empty}' ELSE concat({x}, CASE WHEN o = 'retired' THEN ' ret.' ELSE '' END, ';') END"


def with_mark(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '' ELSE concat({x}, ';') END"


def listed(parts: str) -> str:
    return f"array_to_string({parts}, ', ')"


applied("scr01_zip_scores", "lineitem", [LEFT, RIGHT], with_mark(listed(f"[concat(ifnull(nullif({A}[i], ''), '0'), '-', ifnull(nullif({B}[i], ''), '0')) FOR i IN {N.format('least')} IF {A}[i] <> '' OR {B}[i] <> '']")))
applied("scr04_seven_sets", "lineitem", [THREE, OTHER, "l_returnflag = 'A'", f"concat({H3}, ',0,', {G3})", "'0,7,0'"], listed(f"[concat({A}[i], '-', {B}[i], CASE WHEN t OR string_split(x, ',')[i] <> '0' OR string_split(y, ',')[i] <> '0' THEN concat(' (', string_split(x, ',')[i], '-', string_split(y, ',')[i], ')') ELSE '' END) FOR i IN range(1, 4) IF t OR {A}[i] <> '0' OR {B}[i] <> '0' OR string_split(x, ',')[i] <> '0' OR string_split(y, ',')[i] <> '0']"))
applied("scr05_oriented", "lineitem", [THREE, OTHER, "l_returnflag = 'A'"], f"concat({listed(f'''[concat(CASE WHEN w THEN {A}[i] ELSE {B}[i] END, '-', CASE WHEN w THEN {B}[i] ELSE {A}[i] END) FOR i IN range(1, 4)]''')}, ';')")
applied("scr06_flip_set", "lineitem", [chosen("l_orderkey", f"concat({G1}, '-', {H1})", f"concat({G1}, '-', {H1}, '(', {H3}, ')')", "l_returnflag", f"concat({G1}, '-', {H1}, '-', {H3})", "NULL")], f"CASE l_orderkey % 5 WHEN 0 THEN concat({H1}, '-', {G1}) WHEN 1 THEN concat({H1}, '-', {G1}, '(', {H3}, ')') ELSE coalesce(a, '') END")
applied("scr07_larger_first", "lineitem", [f"CAST({G2} AS int)", some("l_orderkey", f"CAST({H1} AS int)")], "CASE WHEN coalesce(a, 0) = 0 OR coalesce(b, 0) = 0 THEN '' WHEN a > b THEN concat(a, '-', b, ';') ELSE concat(b, '-', a, ';') END")
PAIR = chosen("l_orderkey", f"concat({G2}, '-', {H1})", f"concat(' ', {G2}, ' - ', {H1}, ' ')", f"concat({G2}, '-x')", "NULL")
LARGER = f"concat(greatest({G2}, {H1}), '-', least({G2}, {H1}))"
applied("scr08_larger_first_set", "lineitem", [PAIR], f"CASE WHEN l_orderkey % 4 < 2 THEN {LARGER} ELSE '' END")
applied("scr14_larger_first_team", "lineitem", [PAIR], f"CASE WHEN l_orderkey % 4 < 2 THEN concat({LARGER}, ';') ELSE '' END")
applied("scr09_decorated", "lineitem", [chosen("l_orderkey", THREE, f"concat({G1}, ',7 ', {G2})", "'W.O.'", "''"), chosen("l_orderkey", OTHER, f"concat({H1}, ',6 ', {H2})", "'W.O.'", "''"), OUTCOME], closed(f"CASE l_orderkey % 4 WHEN 0 THEN {listed(f'''[concat({A}[i], '-', {B}[i]) FOR i IN range(1, 4)]''')} WHEN 1 THEN concat({G1}, '-', {H1}, ', 7-6(', {H2}, ')') ELSE '' END", ""))
applied("scr10_without_set_games", "lineitem", [some("l_orderkey", f"concat({G1}, '-', {H1}, ' (', {G2}, '-', {H2}, ', 1-1) (', {H3}, ')')")], f"CASE WHEN a IS NULL THEN ';' ELSE concat({G1}, '-', {H1}, '  (', {H3}, ');') END")
applied("scr11_comma_spaced", "lineitem", [chosen("l_orderkey", f"concat({G1}, '-', {H1}, ',', {G2}, '-', {H2}, ' ;;')", f"concat(' ', {G1}, '-', {H1}, ' , ', {G2}, '-', {H2})", "';'", "NULL")], f"CASE WHEN l_orderkey % 4 < 2 THEN concat({G1}, '-', {H1}, ', ', {G2}, '-', {H2}, ';') ELSE '' END")
applied("scr12_closed", "lineitem", [chosen("l_orderkey", f"concat({G1}, '-', {H1}, '; ')", f"concat({G1}, '-', {H1})", "' '", "NULL")], f"CASE WHEN l_orderkey % 4 < 2 THEN concat({G1}, '-', {H1}, ';') ELSE '' END")
applied("scr13_set_games", "lineitem", [chosen("l_orderkey", f"concat({G1}, '-', {H1})", f"concat(' ', l_suppkey % 90, 'x5')", "l_returnflag", "NULL")], f"CASE l_orderkey % 4 WHEN 0 THEN {G1} WHEN 1 THEN l_suppkey % 90 END")
applied("scr15_dash_zip", "lineitem", [chosen("l_orderkey", f"concat({G1}, '-', {G2}, '-0')", f"concat({G1}, ' -x')", "''", "NULL"), f"concat({H1}, '-', {H2}, '-0')", OUTCOME], closed(f"CASE l_orderkey % 4 WHEN 0 THEN concat({G1}, '-', {H1}, CASE WHEN {G2} + {H2} > 0 THEN concat(', ', {G2}, '-', {H2}) ELSE '' END) WHEN 1 THEN concat({G1}, '-', {H1}) ELSE '' END", ""))
applied("scr16_sets_and_status", "lineitem", [chosen("l_orderkey", THREE, f"concat({G1}, ',scr.')", "'w.o'", "''"), chosen("l_orderkey", OTHER, f"concat({H1}, ',')", "''", "''")], with_mark(f"CASE l_orderkey % 4 WHEN 0 THEN {listed(f'''[concat({A}[i], '-', {B}[i]) FOR i IN range(1, 4)]''')} WHEN 1 THEN concat({G1}, '-', {H1}, ' scr.') ELSE a END"))
applied("scr17_plain_pairs", "lineitem", [chosen("l_orderkey", THREE, f"concat({G1}, ',,', {G3})", "''"), chosen("l_orderkey", OTHER, f"concat({H1}, ',')", "''"), OUTCOME], closed(f"CASE l_orderkey % 3 WHEN 0 THEN {listed(f'''[concat({A}[i], '-', {B}[i]) FOR i IN range(1, 4)]''')} WHEN 1 THEN concat({G1}, '-', {H1}, ', ', {G3}, '-') ELSE '' END", ";"))
applied("scr18_sets_in_text", "lineitem", [chosen("l_orderkey", f"concat('won ', {G1}, '/', {H1}, ' ', {G2}, ' - ', {H2}, ' today')", "l_returnflag", "NULL"), OUTCOME], closed(f"CASE WHEN l_orderkey % 3 = 0 THEN concat({G1}, '-', {H1}, ', ', {G2}, '-', {H2}) ELSE '' END", ";"))
applied("scr19_reordered", "lineitem", [chosen("l_orderkey", f"concat({G1}, ' - ', {H1}, '(', {H3}, '), ,', {G2}, '-', {H2})", "''"), f"CAST({G3} % 2 AS int)"], f"CASE WHEN l_orderkey % 2 = 1 THEN '' WHEN w = 1 THEN concat({H1}, '-', {G1}, '(', {H3}, '), ', {H2}, '-', {G2}, ';') ELSE concat({G1}, ' - ', {H1}, '(', {H3}, '), ', {G2}, '-', {H2}, ';') END")
AHEAD, BEHIND, LEVEL = (f"(CAST({G1} {op} {H1} AS int) + CAST({G2} {op} {H2} AS int) + CAST({G3} {op} {H3} AS int))" for op in (">", "<", "="))
applied("scr20_home_away_sets", "lineitem", [THREE, OTHER], f"{AHEAD} + {LEVEL}", BEHIND)
applied("agg14_side_by_sets", "lineitem", [THREE, OTHER], f"CASE WHEN {AHEAD} > {BEHIND} THEN 'left' ELSE 'right' END")
applied("agg15_index_by_sets", "lineitem", [f"concat({G1}, ',', {G2}, ' 7,', {G3}, 'x')", OTHER], f"CASE WHEN {AHEAD} > {BEHIND} THEN 0 WHEN {AHEAD} < {BEHIND} THEN 1 END")
applied("agg16_index_by_games", "lineitem", [f"concat({G1}, ',,', {G3})", OTHER], f"CASE WHEN {G1} + {G3} >= {H1} + {H2} + {H3} THEN 0 ELSE 1 END")
applied("flt16_valid_sets", "lineitem", [THREE, OTHER], f"array_to_string([concat({A}[i], '-', {B}[i]) FOR i IN range(1, 4) IF {A}[i] <> '0' OR {B}[i] <> '0'], '|')")

applied("cls08_polish_draw", "part", [chosen("p_partkey", "concat(p_name, ' CHŁOPCY')", "concat('Kobiety ', p_type)", "p_name", "NULL")], "CASE p_partkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE '' END", "CASE p_partkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE '' END")
applied("cls09_circuit_gender", "part", [chosen("p_partkey", "' b'", "'G'", "p_brand", "NULL")], "CASE p_partkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE '' END", "CASE p_partkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE '' END")
applied("cls16_winner_index", "lineitem", [chosen("l_orderkey", "concat('s', l_suppkey)", "concat('p', l_partkey)", "''", "'none'"), "concat('s', l_suppkey)", "concat('p', l_partkey)", some("l_partkey", G1), f"CAST({H1} AS int)"], "CASE WHEN w = a THEN 0 WHEN w = b THEN 1 WHEN h > v THEN 0 WHEN v > h THEN 1 END")
applied("cls17_sides_of_users", "lineitem", [chosen("l_orderkey", "concat('p|q', l_suppkey)", "concat('p|q', l_suppkey, '|r|s')", "concat('p|q', l_suppkey, '||')"), chosen("l_partkey", "'p'", "concat('q', l_suppkey)")], "CASE WHEN l_orderkey % 3 = 1 THEN CASE WHEN w = 'p' THEN concat('p|q', l_suppkey) WHEN false THEN '' ELSE concat('p|q', l_suppkey) END ELSE w END", "CASE WHEN l_orderkey % 3 = 1 THEN 'r|s' WHEN w = 'p' THEN concat('q', l_suppkey) ELSE 'p' END")
applied("cls22_image_kind", "documents", [chosen("doc_id", "concat('89504E470D0A1A0A', md5(text))", "concat('FFD8FF', md5(text))", "concat('474946383961', md5(text))", "concat('52494646', substr(md5(text), 1, 8), '57454250')", "concat('00', md5(text))", "NULL")], "CASE doc_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' ELSE '' END")
applied("cls26_czech_gender", "part", [chosen("p_partkey", "'Z'", "' Muži'", "p_brand", "NULL"), chosen("p_size", "'Dorostenky a juniorky'", "concat('žáci ', p_name)", "p_name"), "CAST(p_size AS string)"], "CASE WHEN p_partkey % 4 = 0 THEN 'F' WHEN p_partkey % 4 = 1 THEN 'M' WHEN p_size % 3 = 0 THEN 'F' WHEN p_size % 3 = 1 THEN 'M' WHEN left(c, 1) = '2' THEN 'F' ELSE 'M' END")
applied("cls28_draw_gender_from_players", "lineitem", [f"concat({chosen('l_orderkey', chr(39) + 'M' + chr(39), chr(39) + 'F' + chr(39), chr(39) * 2)}, '|', l_returnflag, '|', {chosen('l_suppkey', chr(39) + 'M' + chr(39), chr(39) * 2)})"], "CASE WHEN strpos(a, 'M') > 0 AND strpos(a, 'F') > 0 THEN 'Mixed' WHEN strpos(a, 'M') > 0 THEN 'Male' WHEN strpos(a, 'F') > 0 THEN 'Female' ELSE '' END")
applied("cls29_french_category", "part", [chosen("p_partkey", "concat('Double  Messieurs ', p_name)", "concat('JF ', p_size)", "concat(p_type, ' Mixte')", "p_name", "NULL")], *(f"CASE p_partkey % 5 WHEN 0 THEN '{m}' WHEN 1 THEN '{f}' WHEN 2 THEN '{x}' ELSE '' END" for m, f, x in (("M", "F", ""), ("Male", "Female", "Mixed"), ("Men''s", "Women''s", "Mixed"))))

applied("src25_file_day", "orders", [chosen("o_orderkey", f"concat('/in/', replace({ISO}, '-', ''), '_', o_orderpriority, '.csv')", "concat('/in/', o_orderpriority, '.csv')", "NULL")], f"CASE WHEN o_orderkey % 3 = 0 THEN {DAY} END")
LATER = f"date_add({DAY}, CAST(o_custkey % 20 - 3 AS int))"
EACH = "list_transform(range(0, CAST(b - a AS bigint) + 1), lambda i: a + CAST(i AS int))"
applied("src29_days", "orders", [DAY, LATER], f"array_to_string([CAST(CAST(d AS date) AS string) FOR d IN {EACH}], '|')")
applied("src30_mondays", "orders", [DAY, f"date_add({DAY}, CAST(o_custkey % 20 AS int))"], f"coalesce(nullif(array_to_string([CAST(CAST(d AS date) AS string) FOR d IN {EACH} IF isodow(CAST(d AS date)) = 1], '|'), ''), CAST(a AS string))")
applied("src31_years", "orders", [DAY, "DATE '2003-04-05'"], "array_to_string(range(year(a), 2004), '|')")
applied("src10_list_of_any_shape", "events", [chosen("event_id", "concat('{\"matches\": [', props, ', ', props, ']}')", "concat('{\"Matches\": ', props, '}')", "props", "event_type", "NULL")], "CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END")
applied("src13_double_encoded", "events", [chosen("event_id", "concat('{\"d\": \"[{', chr(92), '\"id', chr(92), '\": ', user_id, '}]\"}')", "props", "event_type", "NULL")], "CASE WHEN event_id % 4 = 0 THEN user_id END")
applied("src14_json_in_text", "events", [chosen("event_id", "concat('Sure:', chr(10), '```json', chr(10), props, chr(10), '```')", "concat(event_type, ' ', props, ' y')", "props", "event_type", "NULL")], "CASE WHEN event_id % 5 < 3 THEN props END")
applied("src12_script_json", "pages", [chosen("page_id", "concat(html, '<script type=\"application/ld+json\">{\"x\":1}</script><script type=\"application/ld+json\">{\"startDate\":\"', url, chr(10), '\"}</script>')", "html", "NULL")], "CASE WHEN page_id % 3 = 0 THEN concat('{\"startDate\":\"', url, ' \"}') END")
applied("src34_script_variable", "pages", [chosen("page_id", "concat(html, '<script>var DrawList = [{\"id\": ', page_id, '}] ;</script>')", "html", "NULL")], "CASE WHEN page_id % 3 = 0 THEN page_id END")
applied("src39_option_ids", "lineitem", [f"concat(l_orderkey, '|', {G1}, ',', {H1}, ',', {G1}, ',,9')"], f"CASE WHEN {G1} = {H1} THEN concat({G1}, '|9') ELSE concat({G1}, '|', {H1}, '|9') END")
applied("src40_first_pattern", "customer", [chosen("c_custkey", "concat('/tournament/X?id=', c_mktsegment)", "concat('/tournament/', c_mktsegment, '/2')", "c_name", "NULL")], "CASE WHEN c_custkey % 4 < 2 THEN c_mktsegment ELSE '' END")
applied("src37_labelled", "part", [chosen("p_partkey", "'Name|Club|Name'", "'Club'"), "concat(p_type, '|', p_name, '|', p_brand)"], "CASE WHEN p_partkey % 2 = 0 THEN p_brand END")
applied("jsn05_draw_type", "lineitem", [number("l_partkey", 0, 3), number("l_orderkey", 0, 3)], "CASE WHEN a > 1 OR b > 1 THEN 'Doubles' ELSE 'Singles' END")
applied("jsn07_id_set", "lineitem", [chosen("l_orderkey", f"CAST({G1} AS string)", "''"), f"concat({H1}, '|', {H1}, '||x')"], f"CASE WHEN a = '' OR {G1} = {H1} THEN concat({H1}, '|x') ELSE concat(a, '|', {H1}, '|x') END")
applied("jsn08_people", "part", [chosen("p_partkey", "concat(p_name, ' / ', p_type)", "p_name", "concat(p_name, ' / ', p_type, ' / C')")], "CASE WHEN p_partkey % 3 = 1 THEN p_name ELSE concat(p_name, '|', p_type) END")
applied("jsn09_first_group", "part", [some("p_partkey", "concat(p_type, '|', p_name)")], "CASE WHEN a IS NOT NULL THEN p_type END")
applied("jsn04_two_teams", "part", [chosen("p_partkey", "concat('[{\"n\":\"', p_type, '\",\"won\":false},{\"n\":\"', p_name, '\",\"won\":true}]')", "'[]'", "NULL")], "CASE WHEN p_partkey % 3 = 0 THEN p_name END", "CASE WHEN p_partkey % 3 = 0 THEN p_type END")
applied("flt21_without_byes", "part", [chosen("p_partkey", "concat(p_name, '|__BYE__')", "concat(p_name, '|', p_type)", "concat(p_name, '|')")], "p_partkey % 3 = 1")
applied("flt22_any_set", "part", [chosen("p_partkey", "concat('|', p_size)", "'|'", "p_name")], "p_partkey % 3 <> 1")
applied("src11_list_under_keys", "events", [chosen("event_id", "concat('{\"results\":[{\"id\":\"', user_id, '\"},{\"id\":\"', event_id, '\"}]}')", "concat('{\"data\":[{\"id\":\"', user_id, '\"}],\"total\":1}')", "props", "NULL")], "CASE event_id % 4 WHEN 0 THEN concat(user_id, ',', event_id) WHEN 1 THEN CAST(user_id AS string) ELSE '' END")
applied("src15_object_or_list", "events", [chosen("event_id", "concat('{\"id\":\"', user_id, '\"}')", "concat('[{\"id\":\"', user_id, '\"},\"x\",{\"id\":\"', event_id, '\"},null]')", "concat('\"', event_type, '\"')", "NULL")], "CASE event_id % 4 WHEN 0 THEN CAST(user_id AS string) WHEN 1 THEN concat(user_id, ',', event_id) ELSE '' END")
applied("src18_xml_or_json", "orders", [chosen("o_orderkey", f"concat('<P xmlns=\"urn:x\"><DateOfBirth>', {ISO}, '</DateOfBirth></P>')", f"concat('{{\"DateOfBirth\":\"', {ISO}, '\"}}')", "concat('<P><Date', o_orderpriority)", "concat('{', o_orderpriority)", "NULL")], f"CASE WHEN o_orderkey % 5 < 2 THEN {ISO} ELSE '' END")
applied("prj09_any_case_key", "events", [chosen("event_id", "concat('{\"SCORE\":\"', user_id, '\"}')", "concat('{\"Score\":null,\"x\":\"', user_id, '\"}')", "props", "NULL")], "CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS string) ELSE '' END")
applied("jsn02_url_choice", "pages", [chosen("page_id", "concat('{\"url\":\"', url, '\"}')", "concat('{\"url\":\"ftp://x\",\"sheet_url\":\"', url, '\"}')", "'{}'", "NULL")], "CASE WHEN page_id % 4 < 2 THEN url END")
applied("src41_input_url_kind", "pages", [chosen("page_id", "concat(' https://docs.example.com/', page_id, ' ')", "concat('https://a.b/sports/schedule/', page_id)", "url", "NULL")], "CASE page_id % 4 WHEN 0 THEN 'sheet' WHEN 1 THEN 'list' WHEN 2 THEN 'page' END")
applied("prj15_sides_by_count", "part", [chosen("p_partkey", "concat(p_name, ',b,', p_type, ',d')", "concat(p_name, ',', p_type)", "concat(p_name, ',b,', p_type)"), chosen("p_size", "concat('6:', p_size, ' x 10:8')", "'w.o.'")], "CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, '/b') ELSE p_name END", "CASE p_partkey % 3 WHEN 0 THEN concat(p_type, '/d') WHEN 1 THEN p_type ELSE concat('b/', p_type) END", "CASE WHEN p_size % 2 = 0 THEN concat('6-', p_size, ';10-8') END")
applied("flt10_european_inside", "orders", [chosen("o_orderkey", f"concat({D}, '. ', {M}, '.-31. 12. ', {Y})", "o_orderpriority", "NULL"), "DATE '1995-03-01'", "DATE '1998-12-31'"], f"CASE WHEN o_orderkey % 3 = 0 THEN {DAY} >= b AND {Y} <= 1998 ELSE false END")
applied("set05_union_of_tokens", "part", [some("p_partkey", "concat('<i data-username=\"', lower(p_type), '\"></i> @', lower(p_brand), ' @', lower(p_type))")], "CASE WHEN a IS NULL THEN '' ELSE array_to_string(list_sort([lower(p_type), split_part(lower(p_brand), '#', 1)]), ',') END")
applied("top07_capped_list", "lineitem", [f"concat({G1}, ',', {H1}, ',', {G1}, ',z')", number("l_suppkey", 1, 3)], f"array_to_string((CASE WHEN {G1} = {H1} THEN [CAST({G1} AS string), 'z'] ELSE [CAST({G1} AS string), CAST({H1} AS string), 'z'] END)[:n], ',')")
applied("val03_year", "orders", [chosen("o_orderkey", "concat(' ', 1990 + o_custkey % 50, ' ')", "o_orderpriority", "' '", "NULL")], "CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 50 BETWEEN 10 AND 40 THEN 1990 + o_custkey % 50 END WHEN 1 THEN NULL ELSE 2026 END")
applied("val04_month", "orders", [chosen("o_orderkey", "CAST(o_custkey % 15 AS string)", "concat('-', 1 + o_custkey % 9)", "concat(o_custkey % 9, '.5')", "NULL")], "CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 15 < 13 THEN o_custkey % 15 END WHEN 3 THEN 0 END")
applied("val05_iso_date", "orders", [chosen("o_orderkey", ISO, f"concat({Y}, '-02-30')", f"concat({D}, '/', {M}, '/', {Y})", "NULL")], f"CASE WHEN o_orderkey % 4 = 0 THEN {DAY} END")
applied("val06_window_fits", "orders", [some("o_orderkey", DAY), "DATE '1998-01-01'"], "CASE WHEN a IS NULL THEN false ELSE b >= a AND b - a <= 400 END")
applied("val07_rolling_days", "orders", [chosen("o_orderkey", "CAST(o_custkey % 500 AS string)", "o_orderpriority", "' '", "NULL")], "CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 500 BETWEEN 1 AND 400 THEN o_custkey % 500 END WHEN 1 THEN NULL ELSE 15 END")
applied("val08_choice", "orders", [chosen("o_orderkey", "' Singles'", "'DOUBLES '", "o_orderpriority", "''", "NULL")], "CASE o_orderkey % 5 WHEN 0 THEN 'singles' WHEN 1 THEN 'doubles' WHEN 2 THEN NULL ELSE 'both' END")
applied("val09_time_of_day", "orders", [chosen("o_orderkey", "concat(o_custkey % 30, ':', CASE WHEN o_orderkey % 2 = 0 THEN '05' ELSE '59' END)", "concat(o_custkey % 24, '.05')", "o_orderpriority", "NULL")], "CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 30 < 24 THEN o_custkey % 30 * 3600 + 300 ELSE 21600 END")

PERIOD = "named_struct('number', {}, 'home', {}, 'away', {}, 'home_tb', {}, 'away_tb', {})"
PERIODS = "array({})".format(", ".join(PERIOD.format(i, *(f"CAST({x} AS int)" for x in xs)) for i, xs in ((2, (G2, H2, G3, H1)), (1, (G1, some("l_orderkey", H1), "NULL", "NULL")))))
NONE = "CAST(array() AS array<struct<number:int,home:int,away:int,home_tb:int,away_tb:int>>)"


def oriented_pair(a: str, b: str) -> str:
    return f"CASE WHEN w THEN concat({b}, '-', {a}) ELSE concat({a}, '-', {b}) END"


applied("scr02_period_score", "lineitem", [f"CASE WHEN l_suppkey % 3 = 0 THEN {NONE} ELSE {PERIODS} END", f"CAST({G1} AS int)", some("l_orderkey", f"CAST({H1} AS int)"), "l_returnflag = 'A'"], f"CASE WHEN l_suppkey % 3 = 0 THEN CASE WHEN v IS NULL THEN '' ELSE concat({oriented_pair('h', 'v')}, ';') END ELSE concat(CASE WHEN v IS NULL THEN '' ELSE concat({oriented_pair(G1, H1)}, ', ') END, {oriented_pair(G2, H2)}, CASE WHEN {G2} > {H2} THEN concat('(', {H1}, ')') WHEN {H2} > {G2} THEN concat('(', {G3}, ')') ELSE '' END, ';') END", nested=("p",))

ANCHORED = "(CAST(coalesce(a, t) AS date) + CAST((w - (isodow(CAST(coalesce(a, t) AS date)) - 1) + 7) % 7 AS int))"
MONTHS = "list_transform(range(0, 2), lambda i: least(CAST(CAST(date_trunc('month', t) + i * INTERVAL 1 MONTH AS date) + (d - 1) AS date), last_day(CAST(date_trunc('month', t) + i * INTERVAL 1 MONTH AS date))))"
DUE = f"CASE f WHEN 'daily' THEN list_transform(range(0, 2), lambda i: CAST(t AS date) + CAST(i AS int)) WHEN 'weekly' THEN list_filter(list_transform(range(0, 15), lambda i: CAST(t AS date) + CAST(i AS int)), lambda x: isodow(x) - 1 = w) WHEN 'biweekly' THEN list_transform(range(0, 6), lambda i: {ANCHORED} + CAST(14 * i AS int)) ELSE {MONTHS} END"
applied("dat21_next_run", "orders", [chosen("o_custkey", "'daily'", "'weekly'", "'biweekly'", "'monthly'"), number("o_orderkey", 0, 86400), number("o_orderkey", 0, 7), number("o_custkey", 1, 31), some("o_orderkey", f"date_add({DAY}, CAST(o_custkey % 60 - 30 AS int))"), "CAST(o_orderdate AS timestamp)"], f"list_min(list_filter(list_transform({DUE}, lambda x: CAST(x AS timestamp) + s * INTERVAL 1 SECOND), lambda x: x > t))")
