"""Evidence from many rows: agreeing values, majorities with a margin, look-ups with fallbacks, fuzzy names, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.classify import draw_gender, is_mixed_draw
from rallyframe.functions.text import blank, ends, name_tokens, names_match, normal, strip


def agreeing(c: Column) -> Column:
    """Aggregate: the one value all non-blank rows share, else blank. Two extremes tell it; no set is gathered."""
    v = F.nullif(F.coalesce(c.cast("string"), F.lit("")), F.lit(""))
    return F.when(F.min(v) == F.max(v), F.max(v)).otherwise("")


#: The longest id a member may have.
LONGEST_ID = 255


def merged_members(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row a trimmed id with each field's agreed value; ids that are blank, too long or damaged are left out.

    Ids are texts: leading zeros count.
    """
    own = strip(F.col(key))
    fit = (own != "") & (F.char_length(own) <= LONGEST_ID) & ~own.contains("\ufffd")
    return rows.withColumn(key, own).where(fit).groupBy(key).agg(*(agreeing(F.col(f)).alias(f) for f in fields))


def order_of_play(scheduled: DataFrame, ties: DataFrame, sheets: DataFrame) -> DataFrame:
    """(draw, id, round) of scheduled matches whose two nations have a tie on a draw sheet.

    ``ties`` (draw, a, b, round, seq): of a pair the last one of a draw counts, if it has two different nations. A sheet's event
    code must be the match's; its age and event count, in any spelling, only where both have one. The round is the
    tie's, else the match's group, else its classification, else blank.
    """
    codes = lambda a, b: F.array_sort(F.array_distinct(F.filter(F.array(a, b), lambda c: c.isNotNull() & (c != ""))))
    pairs = ties.withColumn("pair", codes(F.col("a"), F.col("b"))).where(F.size("pair") == 2).groupBy("draw", "pair").agg(F.max_by("round", "seq").alias("tie_round"))
    played = scheduled.withColumn("pair", codes(F.col("a"), F.col("b"))).where(F.size("pair") == 2)
    s = sheets.select("draw", F.col("event_code").alias("_code"), F.col("age").alias("_age"), F.col("event").alias("_event"))
    agree = lambda mine, theirs: (blank(mine) == "") | (blank(theirs) == "") | (normal(mine) == normal(theirs))
    met = played.join(pairs, "pair").join(s, "draw").where((blank(F.col("_code")) == "") | F.col("_code").eqNullSafe(F.col("event_code")))
    met = met.where(agree(F.col("_age"), F.col("age")) & agree(F.col("_event"), F.col("event")))
    return met.select("draw", "id", F.coalesce(*(F.nullif(blank(F.col(c)), F.lit("")) for c in ("tie_round", "round_group", "classification")), F.lit("")).alias("round"))


def single_valued(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) of the keys that only ever show one non-blank value."""
    return rows.groupBy(*keys).agg(agreeing(F.col(value)).alias(value)).where(F.col(value) != "")


def decided(na: Column, nb: Column, choices: tuple[str, str], margin: int = 2) -> Column:
    """The choice that has votes alone, else the one that leads by ``margin``, else blank."""
    a, b = choices
    return F.when((na > 0) & (nb == 0), a).when((nb > 0) & (na == 0), b).when(na - nb >= margin, a).when(nb - na >= margin, b).otherwise("")


def majority(rows: DataFrame, group: list[str], member: str, value: str, choices: tuple[str, str], margin: int = 2) -> DataFrame:
    """(group, verdict): members that only ever show one of the two values vote, each once; see ``decided``."""
    a, b = choices
    # two flags a member, which a hash aggregation combines without a sort; least and greatest texts it could not
    seen = rows.where(F.col(value).isin(*choices)).groupBy(*group, member).agg(F.bool_or(F.col(value) == a).alias("_a"), F.bool_or(F.col(value) == b).alias("_b"))
    votes = seen.where("_a <> _b").groupBy(*group).agg(F.count_if("_a").alias("na"), F.count_if("_b").alias("nb"))
    return votes.select(*group, decided(F.col("na"), F.col("nb"), choices, margin).alias("verdict"))


#: What makes a draw: its players' genders tell the draw's where no name does.
DRAW_KEY = ["tournament_url", "tournament_name", "draw_name", "draw_team_type"]
SLOTS = ["winner_1", "winner_2", "loser_1", "loser_2"]


def back_fill_genders(rows: DataFrame) -> DataFrame:
    """Match rows with ``draw_gender`` and the gender of every named player overwritten by their draw's majority.

    Rows whose draw name (or, where it says nothing, tournament name) tells a gender or a mixed draw are left alone, and so are
    draws without a verdict. ``changed`` counts the fields that differ from before.
    """
    draw, tournament = F.col("draw_name"), F.col("tournament_name")
    silent = ~((draw_gender(draw) != "") | is_mixed_draw(draw) | (draw_gender(tournament) != "") | is_mixed_draw(tournament))
    marked = rows.withColumns({c: blank(F.col(c)) for c in DRAW_KEY})
    players = F.inline(F.array(*(F.struct(ends(F.col(f"{s}_name")).alias("_name"), ends(F.col(f"{s}_gender")).alias("_gender")) for s in SLOTS)))
    named = marked.select(*DRAW_KEY, players).where("_name <> ''")
    # the names of a draw are read once a draw that has a verdict, not once a row
    told = F.when(F.coalesce(silent, F.lit(True)), F.nullif("verdict", F.lit("")))
    verdicts = majority(named, DRAW_KEY, "_name", "_gender", ("M", "F")).withColumn("verdict", told).where("verdict IS NOT NULL")
    joined = marked.join(verdicts, DRAW_KEY, "left")
    told, spelt = F.col("verdict").isNotNull(), F.when(F.col("verdict") == "M", "Male").otherwise("Female")
    after = {"draw_gender": F.when(told, spelt).otherwise(F.col("draw_gender"))}
    after |= {f"{s}_gender": F.when(told & (blank(F.col(f"{s}_name")) != ""), F.col("verdict")).otherwise(F.col(f"{s}_gender")) for s in SLOTS}
    changed = sum((F.when(v.eqNullSafe(F.col(c)), 0).otherwise(1) for c, v in after.items()), F.lit(0))
    return joined.withColumn("changed", changed).withColumns(after).select(*rows.columns, "changed")


def looked_up(rows: DataFrame, table: DataFrame, key: str, to: str, fallback: Column) -> DataFrame:
    """``rows`` with ``to`` from a table of one row a key where it is given there, else the fallback."""
    found = table.select(F.col(key).alias("_key"), F.col(to).alias("_found"))
    return rows.join(found, F.col(key) == F.col("_key"), "left").withColumn(to, F.coalesce(F.nullif("_found", F.lit("")), fallback)).drop("_key", "_found")


def fuzzy_names(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_name: str, right_name: str) -> DataFrame:
    """Pairs of ids whose names match by tokens (one within the other, or two in common).

    Two names with two tokens in common also share one that is not the most frequent token of either, so names of several
    tokens meet on those; a name of one token meets every name that holds it, and each such meeting is a pair. A token that
    most names hold thus joins only where the result asks for it. Equal names are one row each while they meet; the pairs of
    ids come back by their membership.
    """
    a = left.select(F.array_sort(name_tokens(F.col(left_name))).alias("ta"), left_id).where(F.size("ta") > 0)
    b = right.select(F.array_sort(name_tokens(F.col(right_name))).alias("tb"), right_id).where(F.size("tb") > 0)
    da, db = a.select("ta").distinct(), b.select("tb").distinct()
    ea, eb = da.withColumn("t", F.explode("ta")), db.withColumn("t", F.explode("tb"))
    often = ea.select("t").unionByName(eb.select("t")).groupBy("t").agg(F.count("*").alias("n"))

    def rarer(names: DataFrame, tokens: str) -> DataFrame:
        """Names of several tokens by each but the most frequent; of equal counts the order of the tokens tells."""
        counted = names.where(F.size(tokens) > 1).join(often, "t").groupBy(tokens).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("by_count"))
        return counted.select(tokens, F.explode(F.slice("by_count", F.lit(1), F.size("by_count") - 1)["t"]).alias("t"))

    several = rarer(ea, "ta").join(rarer(eb, "tb"), "t").select("ta", "tb").distinct().where(names_match(F.col("ta"), F.col("tb")))
    one_left = ea.where(F.size("ta") == 1).join(eb, "t").select("ta", "tb")
    one_right = ea.where(F.size("ta") > 1).join(eb.where(F.size("tb") == 1), "t").select("ta", "tb")
    met = several.unionByName(one_left).unionByName(one_right)
    return met.join(a, "ta").join(b, "tb").select(left_id, right_id)


def alias_ids(rows: DataFrame, id_col: str, name: str, order: str, synthetic: Column) -> DataFrame:
    """Synthetic ids replaced by the first real id that bears the same name."""
    real = rows.where(~synthetic & (F.col(name) != "")).groupBy(name).agg(F.min_by(id_col, order).alias("_real"))
    return rows.join(real, name, "left").withColumn(id_col, F.when(synthetic, F.coalesce("_real", id_col)).otherwise(F.col(id_col))).drop("_real").select(*rows.columns)


def pair_key(a: Column, b: Column) -> Column:
    """A key in which the order of two codes does not count."""
    return F.array_sort(F.array(a, b))


def resolved(rows: DataFrame, cache: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """``rows`` with ``value`` and ``state`` from a cache of (key, known, value).

    A cached failure to find anything counts as an answer (``absent``, the default value); what the cache lacks is
    ``unseen`` and left to be fetched.
    """
    hit = rows.join(cache.select(key, F.col("known").alias("_known"), F.col(value).alias("_value")), key, "left")
    state = F.when(F.col("_known").isNull(), "unseen").when(F.col("_known"), "known").otherwise("absent")
    return hit.select(*rows.columns, F.when(F.col("_known"), F.col("_value")).otherwise(default).alias(value), state.alias("state"))


def child_by_id(children: Column, field: str, wanted: Column) -> Column:
    """The first element of an array of structs whose field equals ``wanted``, or null."""
    return F.try_element_at(F.filter(children, lambda c: c[field] == wanted), F.lit(1))
