"""Classifiers over text: gender and kind of a draw, outcomes, states. Unknown is the empty string unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyframe.functions.text import blank, normal, plain, strip

# The words and codes that name a draw's gender.
MIXED = ("mixed", "xd", "mixto", "mixta", "mista", "mistas", r"mjesovit\w*", r"mijesan\w*", r"mjesan\w*")
FEMALE = ("girl", "girls", "women", "womens", "ladies", "female", "djevojcice", "djevojke", "juniorke", "seniorke", "zenski", "zenska", "zensko", "zene", "feminino", "feminina", "femenino")
MALE = ("boy", "boys", "men", "mens", "gentlemen", "male", "djecaci", "juniori", "seniori", "seniorska", "seniorski", "seniorsko", "muski", "muska", "musko", "muskarci", "masculino", "masculina")
FEMALE_CODES, MALE_CODES = ("gs", "gd", "ws", "wd", "ls", "ld"), ("bs", "bd", "ms", "md")
CZECH_FEMALE = r"(?iu)\bžen\w*|žákyn\w*|dorostenk\w*|juniork\w*|dívk\w*|\bwom[ae]n\b|\bgirls?\b|\bladies\b|\bfemale\b"
CZECH_MALE = r"(?iu)\bmuž\w*|\bžác\w*|\bžák(?!yn)\w*|dorostenc\w*|junioř\w*|junior(?!k)\w*|chlapc\w*|\bm[ae]n\b|\bboys?\b|\bmale\b"


def _word(words: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def _code(codes: tuple[str, ...]) -> str:
    return r"(?<!\w)(?:" + "|".join(codes) + r")(?=\d|\W|$)"


def either(female: Column, male: Column) -> Column:
    """F or M where exactly one holds, else null."""
    return F.when(female & ~male, "F").when(male & ~female, "M")


def is_mixed_draw(c: Column) -> Column:
    return plain(c).rlike(_word(MIXED))


def draw_gender(c: Column) -> Column:
    low = plain(c)
    by_code = either(low.rlike(_code(FEMALE_CODES)), low.rlike(_code(MALE_CODES)))
    by_word = either(low.rlike(_word(FEMALE)), low.rlike(_word(MALE)))
    return F.when(low.rlike(_word(MIXED)), "").otherwise(F.coalesce(by_code, by_word, F.lit("")))


def by_words(c: Column, groups: dict[str, tuple[str, ...]], otherwise: Column | None = None) -> Column:
    """The key of the group of words the trimmed, lower-cased text is in."""
    low = F.lower(strip(c))
    found = F.lit("") if otherwise is None else otherwise
    for key, words in reversed(groups.items()):
        found = F.when(low.isin(*words), key).otherwise(found)
    return found


_BOTH = {"M": ("m", "male", "men", "boy", "boys"), "F": ("f", "female", "w", "women", "girl", "girls")}


def gender_code(c: Column) -> Column:
    return by_words(c, {"M": ("m", "men", "man", "male"), "F": ("f", "w", "women", "woman", "female")})


def gender_spelt(c: Column) -> Column:
    return by_words(c, {"Male": _BOTH["M"], "Female": _BOTH["F"]}, strip(c))


def gender_code_or_text(c: Column) -> Column:
    return by_words(c, _BOTH, strip(c))


def gender_or_number(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(r"^\d+$"), s).otherwise(by_words(c, {"M": ("m", "male"), "F": ("f", "female")}))


def boys_girls(c: Column) -> Column:
    return F.when(c == "Boys", "M").when(c == "Girls", "F").otherwise("")


def polish_draw(c: Column) -> Column:
    """struct(long, short) from Polish words for boys and girls, men and women."""
    low = F.lower(blank(c))
    male = low.contains("chłopcy") | low.contains("mężczyźni") | low.contains("chlopcy") | low.contains("mezczyzni")
    female = low.contains("dziewczęta") | low.contains("kobiety") | low.contains("dziewczeta")
    return F.struct(F.when(male, "Male").when(female, "Female").otherwise("").alias("long"), F.when(male, "M").when(female, "F").otherwise("").alias("short"))


def circuit_gender(kind: Column, rules: dict[str, tuple[str, str]]) -> Column:
    """struct(draw, player) gender by a circuit's player-type code."""
    draw, player = F.lit(""), F.lit("")
    for code, (d, p) in rules.items():
        draw, player = F.when(F.upper(strip(kind)) == code, d).otherwise(draw), F.when(F.upper(strip(kind)) == code, p).otherwise(player)
    return F.struct(draw.alias("draw"), player.alias("player"))


def team_type(c: Column) -> Column:
    return F.when(F.lower(blank(c)).contains("double"), "Doubles").otherwise("Singles")


def any_given(*columns: Column) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | (strip(c) != "")
    return found


def is_doubles(kind: Column, *partners: Column) -> Column:
    return (F.upper(blank(kind)) == "DOUBLES") | any_given(*partners)


def outcome_of(reason: Column, status: Column) -> Column:
    from rallyframe.functions.text import title

    state = F.lower(strip(status))
    said = F.when(F.lower(strip(reason)) != "", F.lower(strip(reason))).otherwise(state)
    other = F.when(state == "", "Completed").when(state.isin("ended", "closed"), "Completed").otherwise(title(F.replace(state, F.lit("_"), F.lit(" "))))
    return F.when(said.contains("retire"), "Retired").when(said.contains("walkover"), "Walkover").when(said.contains("default"), "Defaulted").otherwise(other)


def outcome_in_text(c: Column) -> Column:
    low = F.lower(blank(c))
    return F.when(low.rlike(r"\bw\.?\s?o\.?(?![a-z])|walk\s?over"), "Walkover").when(low.rlike(r"\bret\b|retired|abandon"), "retired").otherwise("Completed")


def outcome_of_codes(a: Column, b: Column) -> Column:
    x, y = F.upper(strip(a)), F.upper(strip(b))
    return F.when((x == "WO") | (y == "WO"), "Walkover").when(x.startswith("AB") | y.startswith("AB"), "retired").otherwise("Completed")


def result_sides(c: Column) -> Column:
    """struct(winner, loser, outcome) of a result code."""
    r = F.upper(blank(c))
    second = r == "TEAM2WIN"
    return F.struct(F.when(second, "2").otherwise("1").alias("winner"), F.when(second, "1").otherwise("2").alias("loser"), F.when(r.isin("TEAM1WIN", "TEAM2WIN"), "Completed").otherwise("Tie").alias("outcome"))


def winner_index(winner_id: Column, ids: Column, home: Column, away: Column) -> Column:
    """0 or 1: the side whose id set (array of two arrays) holds the winner, else the higher score; null if neither tells."""
    by_id = F.when(winner_id != "", F.when(F.array_contains(ids[0], winner_id), 0).when(F.array_contains(ids[1], winner_id), 1))
    by_score = F.when(home > away, 0).when(away > home, 1)
    return F.coalesce(by_id, by_score)


def sides_of_users(users: Column, winner: Column) -> Column:
    """struct(winners, losers): the first and third against the second and fourth user; two users without partners."""
    four = (F.size(users) >= 4) & (F.coalesce(F.try_element_at(users, F.lit(3)), F.lit("")) != "") & (F.coalesce(F.try_element_at(users, F.lit(4)), F.lit("")) != "")
    one = F.when(four, F.array(F.try_element_at(users, F.lit(1)), F.try_element_at(users, F.lit(2)))).otherwise(F.array(F.try_element_at(users, F.lit(1))))
    two = F.when(four, F.array(F.try_element_at(users, F.lit(3)), F.try_element_at(users, F.lit(4)))).otherwise(F.array(F.try_element_at(users, F.lit(2))))
    first = F.array_contains(one, winner)
    return F.struct(F.when(first, one).otherwise(two).alias("winners"), F.when(first, two).otherwise(one).alias("losers"))


def labelled_id(first: Column, second: Column, labels: tuple[str, str]) -> Column:
    """struct(given, label): the first id given, with its label."""
    a, b = (F.when(F.lower(strip(c)) == "null", "").otherwise(strip(c)) for c in (first, second))
    return F.struct(F.when(a != "", a).otherwise(b).alias("given"), F.when(a != "", labels[0]).when(b != "", labels[1]).otherwise("").alias("label"))


def parent_state(running: Column, latest: Column) -> Column:
    return F.when(running, "running").when(latest == "failed", "failed").when(latest == "stopped", "stopped").when(latest.isin("success", "partial"), "healthy").otherwise("idle")


def job_state(status: Column) -> Column:
    return F.when(status.isin("running", "queued", "failed", "stopped"), status).otherwise("healthy")


def severity(percent: Column, warn: float = 70, high: float = 90) -> Column:
    return F.when(percent >= high, "high").when(percent >= warn, "warn").otherwise("ok")


def image_kind(data: Column) -> Column:
    """Kind of an image by its first bytes."""
    h = F.hex(F.substring(data, 1, 12))
    return F.when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp").otherwise("")


def cascade(*choices: Column) -> Column:
    """The first candidate that is not null."""
    return F.coalesce(*choices)


def points_winner(left_strong: Column, right_strong: Column, points: Column) -> Column:
    a, b = (F.try_to_number(F.nullif(F.regexp_extract(blank(points), r"(\d+)\s*-\s*(\d+)", i), F.lit("")), F.lit("999999")) for i in (1, 2))
    return F.when(left_strong, 0).when(right_strong, 1).when(a > b, 0).when(b > a, 1)


def single_marked(rows: Column) -> Column:
    """Index of the one marked row of an array of booleans; null unless exactly one is marked."""
    n = F.size(F.filter(rows, lambda r: r))
    return F.when(n == 1, F.array_position(rows, True) - 1)


def czech_gender(label: Column, page: Column, key: Column) -> Column:
    u = F.upper(strip(label))
    listed = F.when(u.isin("F", "W", "Z", "Ž", "ZENY", "ŽENY", "WOMEN"), "F").when(u.isin("M", "MUZI", "MUŽI", "MEN"), "M")
    words = [either(blank(c).rlike(CZECH_FEMALE), blank(c).rlike(CZECH_MALE)) for c in (label, page)]
    return F.coalesce(listed, *words, F.when(blank(key).startswith("2"), "F").otherwise("M"))


def draw_gender_from_winner(name: Column, winner: Column) -> Column:
    code = F.when(draw_gender(name) != "", draw_gender(name)).when(is_mixed_draw(name), "X").otherwise(F.upper(strip(winner)))
    return F.when(code == "M", "Male").when(code == "F", "Female").when(code == "X", "Mixed").otherwise("")


def draw_gender_from_players(genders: Column) -> Column:
    known = F.array_distinct(F.filter(genders, lambda g: g.isin("M", "F")))
    return F.when(F.size(known) > 1, "Mixed").when(F.array_contains(known, "M"), "Male").when(F.array_contains(known, "F"), "Female").otherwise("")


def french_category(c: Column) -> Column:
    """struct(code, long, label) of a French category name."""
    v = normal(c)
    male = v.contains("messieur") | v.contains("garçon") | v.rlike(r"\bjg\b")
    female = v.contains("dame") | v.contains("fille") | v.rlike(r"\bjf\b")
    mixed = v.contains("mixte") | v.contains("mixed")

    def of(m, f, x):
        return F.when(male, m).when(female, f).when(mixed, x).otherwise("")

    return F.struct(of("M", "F", "").alias("code"), of("Male", "Female", "Mixed").alias("long"), of("Men's", "Women's", "Mixed").alias("label"))


def same_week(d: Column, as_of: Column) -> Column:
    return F.date_trunc("week", d) == F.date_trunc("week", as_of)
