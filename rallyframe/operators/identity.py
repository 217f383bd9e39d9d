"""The order-independent identity of a match and the shaping of rows around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.dates import identity_date
from rallyframe.functions.text import WHITE, blank, first_letter, score_key, strip, tidy

SEPARATOR, PARTNERS = "\x1f", "|"

# The columns of a canonical match row, in the order of its export.
CANONICAL = """
match_id ball_type draw_bracket_value draw_name draw_team_type tournament_name date score
winner_1_name winner_1_gender winner_1_third_party_id winner_1_city winner_1_country winner_1_state
winner_2_name winner_2_gender winner_2_third_party_id winner_2_city winner_2_state
loser_1_name loser_1_gender loser_1_third_party_id loser_1_city loser_1_state loser_1_country
loser_2_name loser_2_gender loser_2_third_party_id loser_2_city loser_2_state
outcome id_type draw_gender draw_bracket_type draw_type tournament_city tournament_state tournament_country_code
tournament_host tournament_location_type tournament_surface tournament_event_category tournament_event_grade tournament_import_source
tournament_sanction_body winner_2_country winner_2_college loser_2_country loser_2_college tournament_event_type
winner_1_college loser_1_college tournament_url winner_1_dob winner_2_dob loser_1_dob loser_2_dob
tournament_country tournament_start_date tournament_end_date winner_team loser_team team_score winner_team_type loser_team_type
""".split()
#: What a widened row has under another name than the compact one, and what it always holds.
COPIES = {"date": "tournament_date", "tournament_start_date": "tournament_date", "tournament_end_date": "tournament_date", "draw_type": "draw_team_type"}
CONSTANTS = {"ball_type": "Yellow", "tournament_event_type": "Dual Match", "winner_team_type": "College", "loser_team_type": "College"}


def identity_hash(date: Column, gender: Column, draw: Column, kind: Column, winners: list[Column], losers: list[Column], score: Column, winner_team: Column, loser_team: Column) -> Column:
    """SHA-256 over nine normalised parts: date, gender's first letter, draw, kind, winners, losers, score, both teams.

    Partners of a side may come in any order; the sides may not be swapped. Blank names are left out of a side, and every part is
    blank rather than null.
    """

    def side(names: list[Column]) -> Column:
        return F.array_join(F.sort_array(F.array_remove(F.array(*(F.lower(tidy(c)) for c in names)), "")), PARTNERS)

    texts = [F.lower(tidy(c)) for c in (draw, kind, winner_team, loser_team)]
    return F.sha2(F.concat_ws(SEPARATOR, identity_date(date), first_letter(gender), *texts[:2], side(winners), side(losers), score_key(score), *texts[2:]), 256)


def canonical_hash() -> Column:
    """The identity of a canonical row, or of a widened one: line breaks and ends of texts do not count."""
    c = F.col
    return identity_hash(c("date"), c("draw_gender"), c("draw_name"), c("draw_team_type"), [c("winner_1_name"), c("winner_2_name")], [c("loser_1_name"), c("loser_2_name")], c("score"), c("winner_team"), c("loser_team"))


def widened(df: DataFrame, *keep: str) -> DataFrame:
    """Compact match rows with all canonical columns: constants and copies filled in, the draw's gender from the tournament's
    where it is blank, every other column that the rows lack blank. Texts are as given (see ``canonical_row``).
    ``keep``: columns to carry along."""
    have = set(df.columns)
    source = {c: s for c in CANONICAL if c not in CONSTANTS and c != "draw_gender" and (s := COPIES.get(c, c)) in have}
    gender = first_given(*(F.col(c) for c in ("draw_gender", "tournament_gender") if c in have))
    # copies name one column, so that what is done to them later is done once
    texts = df.select(*keep, gender.alias("_draw_gender"), *(blank(F.col(s)).alias(f"_{s}") for s in dict.fromkeys(source.values())))
    source["draw_gender"] = "draw_gender"
    return texts.select(*keep, *((F.col(f"_{source[c]}") if c in source else F.lit(CONSTANTS.get(c, ""))).alias(c) for c in CANONICAL))


def canonical_row(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """All ``columns`` as trimmed text, each line break a space; missing ones and nulls are blank. ``keep``: columns left as they are."""
    have = set(df.columns)

    def line(c: Column) -> Column:
        # A row's generated method must stay below 8000 bytes, or the JVM interprets it. Most texts are visible ASCII and spaces.
        text = blank(c)
        flat = F.replace(F.replace(text, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
        return F.when(text.rlike("[^ -~]"), F.btrim(flat, F.lit(WHITE))).otherwise(F.trim(text))

    return df.select(*keep, *(line(F.col(c)).alias(c) if c in have else F.lit("").alias(c) for c in columns))


def first_given(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(blank(c), F.lit("")) for c in columns), F.lit(""))


def side_field(result: Column, first: Column, second: Column, winner: bool) -> Column:
    """A field of the winning (or losing) side, by a result code."""
    two = F.upper(blank(result)) == "TEAM2WIN"
    return F.when(two if winner else ~two, second).otherwise(first)


def two_slots(people: Column) -> Column:
    """Exactly two entries, blank where fewer are given."""
    return F.slice(F.concat(F.coalesce(people, F.array().cast("array<string>")), F.array(F.lit(""), F.lit(""))), 1, 2)


def composite_id(*parts: Column) -> Column:
    """Parts joined by dashes, blanks kept inside and dashes cut off at the ends."""
    return F.regexp_replace(F.concat_ws("-", *(blank(p) for p in parts)), "^-+|-+$", "")


def partner_only(name: Column, attribute: Column) -> Column:
    return F.when(strip(name) != "", blank(attribute)).otherwise("")


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is blank."""
    for c in columns:
        df = df.where(strip(F.col(c)) != "")
    return df


def role_columns(roles: list[str], fields: dict[str, str]) -> list[Column]:
    """Columns ``role_field`` from nested structs, one family a role."""
    return [blank(F.col(f"{r}.{f}")).alias(f"{r}_{name}") for r in roles for name, f in fields.items()]
