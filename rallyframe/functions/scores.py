"""Score expressions over arrays of sets. Undecided and unreadable give null or the empty string, as each says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyframe.functions.text import blank, strip


def leading_number(c: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(blank(c), r"^\s*(\d{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int")


def joined(parts: Column, end: str = ";", empty: str = "") -> Column:
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ", "), F.lit(end))).otherwise(empty)


def zip_scores(winner: Column, loser: Column) -> Column:
    """``6-3, 6-4;`` of two int arrays up to the shorter; a pair of nulls is left out, one null counts 0."""
    n = F.least(F.size(winner), F.size(loser))
    pairs = F.slice(F.arrays_zip(winner.alias("w"), loser.alias("l")), F.lit(1), F.greatest(n, F.lit(0)))
    pairs = F.filter(pairs, lambda p: p["w"].isNotNull() | p["l"].isNotNull())
    return joined(F.transform(pairs, lambda p: F.concat(F.coalesce(p["w"], F.lit(0)).cast("string"), F.lit("-"), F.coalesce(p["l"], F.lit(0)).cast("string"))))


def period_score(periods: Column, home: Column, away: Column, away_won: Column) -> Column:
    """Periods (struct number, home, away, home_tb, away_tb) by number, winner's side first, the loser's tiebreak in parentheses.

    Without periods the final score stands alone.
    """
    known = F.filter(F.array_sort(periods, lambda a, b: F.coalesce(a["number"], F.lit(0)) - F.coalesce(b["number"], F.lit(0))), lambda p: p["home"].isNotNull() & p["away"].isNotNull())

    def shown(h, a, tie):
        pair = F.when(away_won, F.concat_ws("-", a.cast("string"), h.cast("string"))).otherwise(F.concat_ws("-", h.cast("string"), a.cast("string")))
        return F.concat(pair, F.when(tie.isNotNull(), F.concat(F.lit("("), tie.cast("string"), F.lit(")"))).otherwise(""))

    parts = F.transform(known, lambda p: shown(p["home"], p["away"], F.when(p["home"] > p["away"], p["away_tb"]).when(p["away"] > p["home"], p["home_tb"])))
    final = F.when(home.isNotNull() & away.isNotNull(), F.concat(shown(home, away, F.lit(None).cast("int")), F.lit(";"))).otherwise("")
    return F.when(F.size(parts) > 0, joined(parts)).otherwise(final)


def seven_sets(first: Column, second: Column, tied: Column, first_tb: Column, second_tb: Column) -> Column:
    """Sets (int arrays and a flag array) with anything in them; tiebreaks as ``7-6 (7-3)``, no closing mark."""
    sets = F.arrays_zip(first, second, tied, first_tb, second_tb)
    some = F.filter(sets, lambda s: (s["0"] != 0) | (s["1"] != 0) | s["2"] | (s["3"] != 0) | (s["4"] != 0))
    return F.array_join(F.transform(some, lambda s: F.concat(s["0"].cast("string"), F.lit("-"), s["1"].cast("string"), F.when(s["2"] | (s["3"] != 0) | (s["4"] != 0), F.concat(F.lit(" ("), s["3"].cast("string"), F.lit("-"), s["4"].cast("string"), F.lit(")"))).otherwise(""))), ", ")


def oriented(left: Column, right: Column, left_won: Column) -> Column:
    a, b = F.when(left_won, left).otherwise(right), F.when(left_won, right).otherwise(left)
    return F.concat(F.array_join(F.zip_with(a, b, lambda x, y: F.concat(x.cast("string"), F.lit("-"), y.cast("string"))), ", "), F.lit(";"))


def flip_set(c: Column) -> Column:
    """``a-b(t)`` as ``b-a(t)``; other text stays."""
    return F.regexp_replace(blank(c), r"^([^-]*)-([^-(]*)(\(\d+\))?$", "$2-$1$3")


def larger_first(a: Column, b: Column) -> Column:
    """``4-3;``; blank where either side is zero or missing."""
    ok = (F.coalesce(a, F.lit(0)) != 0) & (F.coalesce(b, F.lit(0)) != 0)
    return F.when(ok, F.concat(F.greatest(a, b).cast("string"), F.lit("-"), F.least(a, b).cast("string"), F.lit(";"))).otherwise("")


def larger_first_set(c: Column) -> Column:
    """``max-min`` of ``a-b``; blank for anything else."""
    pair = r"^\s*(\d{1,9})\s*-\s*(\d{1,9})\s*$"
    a, b = leading_number(F.regexp_extract(blank(c), pair, 1)), leading_number(F.regexp_extract(blank(c), pair, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.greatest(a, b).cast("string"), F.lit("-"), F.least(a, b).cast("string"))).otherwise("")


def larger_first_team(c: Column) -> Column:
    return F.when(larger_first_set(c) != "", F.concat(larger_first_set(c), F.lit(";"))).otherwise("")


def _pairs(winner: Column, loser: Column) -> Column:
    """Pairs of set texts up to the longer array, blank and walkover ones left out."""
    both = F.zip_with(winner, loser, lambda w, x: F.struct(F.coalesce(w, F.lit("")).alias("w"), F.coalesce(x, F.lit("")).alias("l")))
    return F.filter(both, lambda p: ((p["w"] != "") | (p["l"] != "")) & (p["w"] != "W.O.") & (p["l"] != "W.O."))


def _closed(score: Column, outcome: Column, empty: str) -> Column:
    done = F.when((outcome == "retired") & (score != ""), F.concat(score, F.lit(" ret."))).otherwise(score)
    return F.when(outcome == "Walkover", "W.O.;").when(done != "", F.concat(done, F.lit(";"))).otherwise(empty)


def decorated(winner: Column, loser: Column, outcome: Column) -> Column:
    """Set texts ``6`` or ``7 8`` (games and tiebreak) as ``6-3, 7-6(8) ret.;``; a walkover is ``W.O.;``."""

    def shown(p):
        w, x = F.split(strip(p["w"]), r"\s+"), F.split(strip(p["l"]), r"\s+")
        tie = F.coalesce(F.try_element_at(x, F.lit(2)), F.try_element_at(w, F.lit(2)), F.lit(""))
        return F.concat(w[0], F.lit("-"), x[0], F.when(tie != "", F.concat(F.lit("("), tie, F.lit(")"))).otherwise(""))

    return _closed(F.array_join(F.transform(_pairs(winner, loser), shown), ", "), outcome, "")


def plain_pairs(winner: Column, loser: Column, outcome: Column) -> Column:
    """As ``decorated`` for plain set texts; an empty score is ``;``."""
    return _closed(F.array_join(F.transform(_pairs(winner, loser), lambda p: F.concat(p["w"], F.lit("-"), p["l"])), ", "), outcome, ";")


def without_set_games(c: Column) -> Column:
    """Parentheses that hold a dash removed, tiebreaks kept, one closing mark."""
    return F.concat(strip(F.regexp_replace(blank(c), r"\([^)]*-[^)]*\)", "")), F.lit(";"))


def comma_spaced(c: Column) -> Column:
    """Comma spacing made even, exactly one closing mark; blank stays blank."""
    raw = strip(F.regexp_replace(strip(c), r";+$", ""))
    return F.when(raw == "", "").otherwise(F.concat(F.array_join(F.transform(F.split(raw, ","), strip), ", "), F.lit(";")))


def closed(c: Column) -> Column:
    s = strip(c)
    return F.when((s == "") | s.endswith(";"), s).otherwise(F.concat(s, F.lit(";")))


def set_games(c: Column) -> Column:
    return leading_number(F.regexp_extract(blank(c), r"^\s*(\d{1,2})", 1))


def dash_zip(winner: Column, loser: Column, outcome: Column) -> Column:
    """Sets of two dash-joined texts; only pairs of digits, and not 0-0."""
    pairs = F.zip_with(F.split(blank(winner), "-"), F.split(blank(loser), "-"), lambda a, b: F.struct(strip(a).alias("w"), strip(b).alias("l")))
    good = F.filter(pairs, lambda p: p["w"].rlike(r"^\d+$") & p["l"].rlike(r"^\d+$") & ~((p["w"] == "0") & (p["l"] == "0")))
    return _closed(F.array_join(F.transform(good, lambda p: F.concat_ws("-", p["w"], p["l"])), ", "), outcome, "")


def sets_and_status(winner: Column, loser: Column) -> Column:
    """Completed sets, then the last status token among the cells that are not numbers."""
    n = F.least(F.size(winner), F.size(loser))
    pairs = F.slice(F.zip_with(winner, loser, lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("w"), F.coalesce(b, F.lit("")).alias("l"))), F.lit(1), n)
    whole = F.filter(pairs, lambda p: p["w"].rlike(r"^\d+$") & p["l"].rlike(r"^\d+$"))
    tokens = F.filter(F.flatten(F.transform(F.filter(pairs, lambda p: ~(p["w"].rlike(r"^\d+$") & p["l"].rlike(r"^\d+$"))), lambda p: F.slice(F.filter(F.array(p["w"], p["l"]), lambda t: (t != "") & ~t.rlike(r"^\d+$")), 1, 1))), lambda t: t != "")
    score = strip(F.concat_ws(" ", F.array_join(F.transform(whole, lambda p: F.concat_ws("-", p["w"], p["l"])), ", "), F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))))
    return closed(score)


def sets_in_text(c: Column, outcome: Column) -> Column:
    """Every ``a-b`` or ``a/b`` in a text; an empty score is ``;``."""
    found = F.transform(F.regexp_extract_all(blank(c), F.lit(r"\d{1,2}\s*[-/]\s*\d{1,2}"), F.lit(0)), lambda s: F.regexp_replace(s, r"^(\d+)\s*[-/]\s*(\d+)$", "$1-$2"))
    return _closed(F.array_join(found, ", "), outcome, ";")


def reordered(sets: Column, winner_side: Column) -> Column:
    """Sets read from side 1 when it won, what follows each kept."""
    given = F.filter(F.transform(sets, strip), lambda s: s != "")
    return joined(F.transform(given, lambda s: F.when(winner_side == 1, F.regexp_replace(s, r"^(\d+)\s*-\s*(\d+)(.*)$", "$2-$1$3")).otherwise(s)))


def sets_won(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x > y, F.lit(False))), lambda x: x))


def side_by_sets(a: Column, b: Column) -> Column:
    """left or right by sets won; a tie goes right."""
    return F.when(sets_won(a, b) > sets_won(b, a), "left").otherwise("right")


def index_by_sets(a: Column, b: Column) -> Column:
    """0 or 1 by sets won over texts that begin with a number; null when equal."""
    x, y = F.transform(a, leading_number), F.transform(b, leading_number)
    return F.when(sets_won(x, y) > sets_won(y, x), 0).when(sets_won(x, y) < sets_won(y, x), 1)


def index_by_games(a: Column, b: Column) -> Column:
    """0 or 1 by the sum of games; a tie goes to 0."""

    def total(c):
        return F.aggregate(c, F.lit(0), lambda acc, v: acc + F.coalesce(v, F.lit(0)))

    return F.when(total(a) >= total(b), 0).otherwise(1)


def home_away_sets(home: Column, away: Column) -> Column:
    """struct(home, away) sets won, equal sets counted for home."""
    h = F.size(F.filter(F.zip_with(home, away, lambda x, y: x >= y), lambda x: x))
    return F.struct(h.alias("home"), (F.size(home) - h).alias("away"))


def valid_sets(a: Column, b: Column) -> Column:
    """Pairs ``a-b`` with a game on either side."""
    return F.transform(F.filter(F.arrays_zip(a, b), lambda s: (s["0"] > 0) | (s["1"] > 0)), lambda s: F.concat(s["0"].cast("string"), F.lit("-"), s["1"].cast("string")))
