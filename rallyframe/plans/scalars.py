"""Scalar operators: each case states its inputs and the value they must give; ``whole`` applies them to tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rallyframe.functions import classify as C
from rallyframe.functions import dates as D
from rallyframe.functions import scores as S
from rallyframe.functions import text as T
from rallyframe.plans.catalog import facts, fields

NBSP = " "

facts("stg01_collapse", "a string", [("  Ana \t Bo ", "Ana Bo"), (f"x{NBSP}{NBSP}y\n", "x y"), (None, ""), ("", "")], T.collapse)
facts("stg02_normal", "a string", [("  Ana \t BO ", "ana bo"), (f"ÉVA{NBSP}Z", "éva z"), (None, "")], T.normal)
facts("stg03_first_letter", "a string", [(" Female", "f"), ("M", "m"), ("", ""), (None, "")], T.first_letter)
facts("stg04_score_key", "a string", [("6-3, 6-4;", "6-3,6-4"), (" 7-6 (5) ;; ", "7-6(5)"), ("RET;", "ret"), (None, "")], T.score_key)
facts("stg05_last_first", "a string", [("Ana Maria Lopez", "Lopez, Ana Maria"), ("Lopez ,  Ana", "Lopez, Ana"), ("Lopez,", "Lopez"), ("Cher", "Cher"), (f" Jo{NBSP}Ann  Lee ", "Lee, Jo Ann"), (None, ""), ("O'Neil-Smith, Al B", "O'Neil-Smith, Al B")], T.last_first)
facts("stg06_last_first_verbatim", "a string", [("Ana Lopez", "Lopez, Ana"), ("Lopez ,Ana", "Lopez ,Ana"), ("Cher", "Cher"), (None, "")], T.last_first_verbatim)
facts("stg07_last_first_always", "a string", [("Ana M Lopez", "Lopez, Ana M"), ("Lopez, Ana", "Ana, Lopez,"), ("", "")], T.last_first_always)
facts("stg08_name_of_parts", "a string, b string", [("Lopez", "Ana", "Lopez, Ana"), (" ", "Ana", "Ana"), ("Lopez ", None, "Lopez"), (None, "", "")], T.name_of_parts)
facts("stg09_title_if_capitals", "a string", [("ANA lopez", "Ana lopez"), ("McDonald JR", "McDonald Jr"), ("O'NEIL-SMITH", "O'Neil-Smith"), ("12 A1", "12 A1"), (None, "")], T.title_if_capitals)
facts("stg10_title", "a string", [("o'neil mc-donald", "O'Neil Mc-Donald"), ("ÉVA x1y", "Éva X1Y"), ("ßa", "Ssa"), ("", "")], T.title)
facts("stg11_without_seed", "a string", [("Ana Lopez [3/4]", "Ana Lopez"), ("Ana [1] Lopez", "Ana [1] Lopez"), (" Ana [WC] ", "Ana"), (None, "")], T.without_seed)
facts("stg12_without_parentheses", "a string", [("(12345678)", "12345678"), (" a(b)c ", "abc"), (None, "")], T.without_parentheses)
facts("stg13_without_notes", "a string", [("Lopez , Ana [2]", "Lopez, Ana"), ("Lopez, Ana (Moved up to next)", "Lopez, Ana"), ("Lopez, Ana (x)", "Lopez, Ana (x)"), (None, "")], lambda a: T.without_notes(a, ("moved",)))
facts("stg14_plain", "a string", [("Mješovito PAROVI", "mjesovito parovi"), ("Müller Ñandú", "muller nandu"), ("éa", "ea"), (None, "")], T.plain)
facts("stg15_name_key", "a string", [("  José   Núñez ", "jose nunez"), (None, "")], T.name_key)
facts("stg16_name_tokens", "a string", [("José de la Cruz 12 x", "jose|de|la|cruz"), ("Ana ANA", "ana"), (None, "")], lambda a: F.array_join(T.name_tokens(a), "|"))
fields("stg17_split_location", "city country", "a string", [("Centre Court | Split, Croatia", "Split", "Croatia"), ("Zagreb", "Zagreb", ""), ("a | b, c, d", "b", "d"), (None, "", "")], T.split_location)
facts("stg18_suffix_after", "a string, b string", [("Open", "Open, Men Singles", "Men Singles"), ("Open", "The Open - Final", "Final"), ("Cup", "Open", ""), ("", "x", "")], T.suffix_after)
facts("stg19_first_named", "a string, b string", [("Neutral", "Spain", "Spain"), (" ", None, ""), ("France", "Spain", "France")], T.first_named)
facts("stg20_before_parenthesis", "a string", [("State College (W) x", "State College"), ("Plain", "Plain"), (None, "")], T.before_parenthesis)
fields("stg21_name_and_gender", "name gender", "a string", [("North College (W)", "North College", "F"), ("South (M)", "South", "M"), ("None", "", ""), (None, "", "")], T.name_and_gender)
facts("stg22_last_segment", "a string", [("https://a.example/players/p77/", "p77"), ("https://a.example/x/y?q=1", "y"), ("https://a.example", ""), (None, "")], T.last_segment)
facts("stg23_profile_guid", "a string", [("/player-profile/AB-12/x", "AB-12"), ("https://a.example/profile/default.aspx?id=Z9&x=1", "Z9"), ("https://a.example/sport/player.aspx?id=T1", ""), (None, "")], T.profile_guid)
facts("stg24_absolute_url", "a string, b string", [("/t/1#x", "https://a.example/p/q?z", "https://a.example/t/1"), ("d?e=1", "https://a.example/p/q", "https://a.example/p/d?e=1"), ("//b.example/k", "https://a.example/", "https://b.example/k"), ("http://c.example/", "https://a.example/", "http://c.example/"), ("#top", "https://a.example/", ""), ("x", "https://a.example", "https://a.example/x")], T.absolute_url)
facts("stg25_http_or_blank", "a string", [(" https://a.example/x ", "https://a.example/x"), ("ftp://a.example", ""), ("http://", ""), ("javascript:alert(1)", ""), (None, "")], T.http_or_blank)
facts("stg26_url_by_kind", "a string, b string", [("League", "5", "https://x.example/l/5"), ("cup", "6", "https://x.example/c/6"), ("other", "7", ""), ("league", " ", "")], lambda a, b: T.url_by_kind(a, b, {"league": "https://x.example/l/", "cup": "https://x.example/c/"}))
facts("stg27_slug_url", "a string", [(" Spring  Open ", "https://x.example/Spring-Open"), ("", "https://x.example/")], lambda a: T.slug_url("https://x.example/", a))
facts("stg28_local_id", "a string", [("abc", "local_13436514500253700074"), ("", "local_16406829232824261652")], T.local_id)
facts("stg29_exported_id", "a string", [("local_123", ""), ("123", "123"), (None, "")], T.exported_id)
facts("stg31_masked_address", "a string", [("http://u:pw@h.example:80", "http://u:****@h.example:80"), ("u:pw@h", "u:****@h"), ("h.example:80", "h.example:80"), (None, "")], T.masked_address)
facts("stg32_host_only", "a string", [("http://u:pw@h.example:80/x", "h.example"), ("h.example:80", "h.example"), ("", "")], T.host_only)
facts("stg33_looks_like_licence", "a string", [("123456", True), ("12345", False), (" 99887766 ", True), ("12a456", False), (None, False)], T.looks_like_licence)
facts("stg34_mentions", "a string", [('hi @ana and @bo.c, x@y <a data-username="eve">', "eve|ana|bo.c,"[:-1]), ("none", ""), (None, "")], lambda a: F.array_join(T.mentions(a), "|"))
facts("stg36_same_text", "a string, b string", [(" Ana  B", "ana b", True), ("Ana", "Anb", False), (None, "", True)], T.same_text)
facts("stg37_country_code", "a string", [("Croatia", "CRO"), ("uk", "UK"), (None, "")], T.country_code)
facts("stg38_before_dash", "a string", [("Porto - PT", "Porto"), ("Lisbon", "Lisbon"), (None, "")], T.before_dash)
facts("stg39_digits_and_plus", "a string", [("T12", "12"), ("1,500+", "1500+"), (None, "")], T.digits_and_plus)
facts("stg40_dual_name", "a string, b string, c string", [("Cup Day", "A", "B", "Cup Day"), (" ", "A", "B", "Dual Match: A vs B"), (None, "A", None, "Dual Match: A vs ")], T.dual_name)
facts("snk03_guarded_cell", "a string", [("=1+1", "'=1+1"), ("-5", "'-5"), ("@x", "'@x"), ("a=b", "a=b"), (None, "")], T.guarded_cell)
facts("snk05_redacted", "a string", [("see https://u:p@h.example/x", "see https://***:***@h.example/x"), ("https://h.example/u:p@x", "https://h.example/u:p@x"), (None, "")], T.redacted)
facts("ded25_canonical_url", "a string", [("HTTPS://A.Example/Draw/?b=2&a=1#x", "https://a.example/draw?a=1&b=2"), ("https://a.example/X/", "https://a.example/x"), (None, "")], T.canonical_url)

DRAWS = [("Girls Singles U14", "F"), ("MS 4", "M"), ("BS2", "M"), ("WD/MD", ""), ("Mixed Doubles", ""), ("Mješoviti parovi girls", ""), ("Juniorke", "F"), ("Men and Women", ""), ("Germs", ""), (None, ""), ("Ladies' Plate", "F"), ("Masculino B", "M")]
facts("cls01_draw_gender", "a string", DRAWS, C.draw_gender)
facts("cls02_is_mixed_draw", "a string", [("XD A", True), ("Mješovito", True), ("mixedness", False), ("Men", False), (None, False)], C.is_mixed_draw)
facts("cls03_gender_code", "a string", [(" Men ", "M"), ("woman", "F"), ("boys", ""), (None, "")], C.gender_code)
facts("cls04_gender_spelt", "a string", [("boy", "Male"), ("W", "Female"), ("Coed", "Coed"), (None, "")], C.gender_spelt)
facts("cls05_gender_code_or_text", "a string", [("GIRLS", "F"), ("Men", "M"), ("Coed", "Coed"), (None, "")], C.gender_code_or_text)
facts("cls06_gender_or_number", "a string", [("Male", "M"), ("f", "F"), ("2", "2"), ("null", ""), ("x", ""), (None, "")], C.gender_or_number)
facts("cls07_boys_girls", "a string", [("Boys", "M"), ("Girls", "F"), ("boys", ""), (None, "")], C.boys_girls)
fields("cls08_polish_draw", "long short", "a string", [("Gra pojedyncza CHŁOPCY", "Male", "M"), ("Kobiety", "Female", "F"), ("Open", "", "")], C.polish_draw)
fields("cls09_circuit_gender", "draw player", "a string", [("b", "Male", "M"), ("G", "Female", "F"), ("X", "", "")], lambda a: C.circuit_gender(a, {"B": ("Male", "M"), "G": ("Female", "F")}))
facts("cls10_team_type", "a string", [("Mixed DOUBLES", "Doubles"), ("singles", "Singles"), (None, "Singles")], C.team_type)
facts("cls11_any_given", "a string, b string", [(" ", None, False), ("x", "", True), (None, "y", True)], C.any_given)
facts("cls12_is_doubles", "a string, b string, c string", [("doubles", "", "", True), ("SINGLES", "", "Bo", True), ("", None, " ", False)], C.is_doubles)
facts("cls13_outcome_of", "a string, b string", [("Player retired", "ended", "Retired"), ("", "walkover", "Walkover"), ("defaulted", "", "Defaulted"), ("", "closed", "Completed"), (None, "not_started", "Not Started"), ("", "", "Completed"), ("", "abandoned_late", "Abandoned Late")], C.outcome_of)
facts("cls14_outcome_in_text", "a string", [("A d. B w.o.", "Walkover"), ("6-1 3-0 ret.", "retired"), ("6-1 6-2", "Completed"), ("Walkover", "Walkover"), (None, "Completed")], C.outcome_in_text)
fields("cls15_result_sides", "winner loser outcome", "a string", [("Team1Win", "1", "2", "Completed"), ("TEAM2WIN", "2", "1", "Completed"), ("DRAW", "1", "2", "Tie"), (None, "1", "2", "Tie")], C.result_sides)
facts("cls16_winner_index", "w string, a string, b string, h int, v int", [("x2", "x1", "x2", 0, 0, 1), ("", "x1", "x2", 3, 1, 0), ("zz", "x1", "x2", 1, 2, 1), ("", "x1", "x2", 1, 1, None), ("", "x1", "x2", None, 1, None)], lambda w, a, b, h, v: C.winner_index(w, F.array(F.array(a), F.array(b)), h, v))
fields("cls17_sides_of_users", "winners losers", "a string, w string", [("p|q", "q", "q", "p"), ("p|q|r|s", "r", "r|s", "p|q"), ("p|q||", "p", "p", "q")], lambda a, w: F.struct(*(F.array_join(C.sides_of_users(F.split(a, r"\|"), w)[x], "|").alias(x) for x in ("winners", "losers"))))
fields("cls18_labelled_id", "given label", "a string, b string", [("7", "8", "7", "first"), ("null", "8", "8", "second"), (None, "", "", "")], lambda a, b: C.labelled_id(a, b, ("first", "second")))
facts("cls19_parent_state", "r boolean, s string", [(True, "failed", "running"), (False, "failed", "failed"), (False, "partial", "healthy"), (False, "stopped", "stopped"), (False, None, "idle"), (False, "queued", "idle")], C.parent_state)
facts("cls20_job_state", "s string", [("running", "running"), ("partial", "healthy"), ("queued", "queued"), ("success", "healthy")], C.job_state)
facts("cls21_severity", "p double", [(95.0, "high"), (70.0, "warn"), (10.0, "ok")], C.severity)
facts("cls22_image_kind", "h string", [("89504E470D0A1A0A00", "image/png"), ("FFD8FFE0", "image/jpeg"), ("474946383961FF", "image/gif"), ("524946460000000057454250", "image/webp"), ("524946460000000041564920", ""), ("00", "")], lambda h: C.image_kind(F.unhex(h)))
facts("cls23_cascade", "a int, b int, c int", [(None, None, 1, 1), (0, 1, 1, 0), (None, None, None, None)], C.cascade)
facts("cls24_points_winner", "a boolean, b boolean, p string", [(True, False, "1-2", 0), (False, True, "", 1), (False, False, "10 - 8", 0), (False, False, "3-5", 1), (False, False, "4-4", None), (False, False, None, None)], C.points_winner)
facts("cls25_single_marked", "a boolean, b boolean", [(True, False, 0), (False, True, 1), (True, True, None), (False, False, None)], lambda a, b: C.single_marked(F.array(a, b)).cast("int"))
facts("cls26_czech_gender", "a string, b string, c string", [("Z", "", "1", "F"), ("Muži", "", "2", "M"), ("", "Dorostenky a juniorky", "1", "F"), ("", "žáci", "2", "M"), ("", "", "21", "F"), ("", "", "1", "M"), ("", "žákyně", "1", "F")], C.czech_gender)
facts("cls27_draw_gender_from_winner", "a string, b string", [("Girls U12", "M", "Female"), ("Group A", "m", "Male"), ("Mixed A", "F", "Mixed"), ("Group A", "", "")], C.draw_gender_from_winner)
facts("cls28_draw_gender_from_players", "a string", [("M|M||", "Male"), ("F", "Female"), ("M|F", "Mixed"), ("|", "")], lambda a: C.draw_gender_from_players(F.split(a, r"\|")))
fields("cls29_french_category", "code long label", "a string", [("Double Messieurs", "M", "Male", "Men's"), ("JF 13", "F", "Female", "Women's"), ("Double Mixte", "", "Mixed", "Mixed"), ("Libre", "", "", "")], C.french_category)
facts("cls30_outcome_of_codes", "a string, b string", [("wo", "", "Walkover"), ("", "AB1", "retired"), ("", None, "Completed")], C.outcome_of_codes)
facts("cls31_outcome_from_score", "a string", [("6/2 W.O.", "Walkover"), ("6/2 ret", "retired"), ("6/2", "Completed")], C.outcome_in_text)
facts("cls32_same_week", "a date", [(dt.date(2026, 3, 2), True), (dt.date(2026, 3, 8), True), (dt.date(2026, 3, 9), False)], lambda a: C.same_week(a, F.lit(dt.date(2026, 3, 4))))


def _ints(c):
    """``6,4`` as an int array; a blank entry is null."""
    return F.transform(F.split(c, ","), lambda x: F.nullif(x, F.lit("")).cast("int"))


def _texts(c):
    return F.split(c, ",")


facts("scr01_zip_scores", "a string, b string", [("6,6", "3,4", "6-3, 6-4;"), ("6,,7", "3,,", "6-3, 7-0;"), (",", ",", ""), ("6,1", "4", "6-4;")], lambda a, b: S.zip_scores(_ints(a), _ints(b)))
_PERIODS = "array<struct<number:int,home:int,away:int,home_tb:int,away_tb:int>>"
facts("scr02_period_score", f"p {_PERIODS}, h int, v int, w boolean", [([(2, 6, 7, 4, 7), (1, 6, 3, None, None)], 1, 1, False, "6-3, 6-7(4);"), ([(1, 7, 6, 7, 5)], 1, 0, True, "6-7(5);"), ([], 2, 1, True, "1-2;"), ([(1, None, 3, None, None)], None, None, False, "")], S.period_score)
facts("scr04_seven_sets", "a string, b string, t boolean, x string, y string", [("6,7,0", "3,6,0", False, "0,7,0", "0,3,0", "6-3, 7-6 (7-3)"), ("0", "0", False, "0", "0", ""), ("1", "0", True, "0", "0", "1-0 (0-0)")], lambda a, b, t, x, y: S.seven_sets(_ints(a), _ints(b), F.transform(_ints(a), lambda _: t), _ints(x), _ints(y)))
facts("scr05_oriented", "a string, b string, w boolean", [("6,6", "3,2", True, "6-3, 6-2;"), ("6,6", "3,2", False, "3-6, 2-6;")], lambda a, b, w: S.oriented(_ints(a), _ints(b), w))
facts("scr06_flip_set", "a string", [("6-7(5)", "7-6(5)"), ("6-3", "3-6"), ("ret", "ret"), ("1-2-3", "1-2-3")], S.flip_set)
facts("scr07_larger_first", "a int, b int", [(3, 4, "4-3;"), (5, 0, ""), (None, 2, "")], S.larger_first)
facts("scr08_larger_first_set", "a string", [("3-6", "6-3"), ("6 - 2", "6-2"), ("x-1", ""), (None, "")], S.larger_first_set)
facts("scr09_decorated", "a string, b string, o string", [("6,7 8", "3,6 6", "Completed", "6-3, 7-6(6);"), ("6,1", "3,0", "retired", "6-3, 1-0 ret.;"), ("6", "", "Walkover", "W.O.;"), ("", "", "Completed", ""), ("W.O.", "", "Completed", "")], lambda a, b, o: S.decorated(_texts(a), _texts(b), o))
facts("scr10_without_set_games", "a string", [("2-1 (6-3, 4-6) (5)", "2-1  (5);"), ("6-4", "6-4;"), (None, ";")], S.without_set_games)
facts("scr11_comma_spaced", "a string", [("6-3,6-4 ;;", "6-3, 6-4;"), (" 6-3 , 6-4", "6-3, 6-4;"), (";", ""), (None, "")], S.comma_spaced)
facts("scr12_closed", "a string", [("6-3", "6-3;"), ("6-3;", "6-3;"), (" ", "")], S.closed)
facts("scr13_set_games", "a string", [("6-3", 6), (" 7x5", 7), ("ab", None), (None, None)], S.set_games)
facts("scr14_larger_first_team", "a string", [("3 - 4", "4-3;"), ("5-2", "5-2;"), ("", "")], S.larger_first_team)
facts("scr15_dash_zip", "a string, b string, o string", [("6-6-0", "3-4-0", "Completed", "6-3, 6-4;"), ("6-x", "1-2", "retired", "6-1 ret.;"), ("6", "0", "Walkover", "W.O.;"), ("", "", "Completed", "")], S.dash_zip)
facts("scr16_sets_and_status", "a string, b string", [("6,6", "1,4", "6-1, 6-4;"), ("6,scr.", "1,", "6-1 scr.;"), ("w.o", "", "w.o;"), ("", "", "")], lambda a, b: S.sets_and_status(_texts(a), _texts(b)))
facts("scr17_plain_pairs", "a string, b string, o string", [("6,6", "1,4", "Completed", "6-1, 6-4;"), ("", "", "Completed", ";"), ("6", "2", "retired", "6-2 ret.;")], lambda a, b, o: S.plain_pairs(_texts(a), _texts(b), o))
facts("scr18_sets_in_text", "a string, o string", [("won 6/3 6-4 today", "Completed", "6-3, 6-4;"), ("", "Completed", ";"), ("6/1", "Walkover", "W.O.;")], S.sets_in_text)
facts("scr19_reordered", "a string, w int", [("3 - 6(2),4-6", 1, "6-3(2), 6-4;"), ("6-3, ,7-5", 0, "6-3, 7-5;"), ("", 1, "")], lambda a, w: S.reordered(_texts(a), w))
fields("scr20_home_away_sets", "home away", "a string, b string", [("6,4,6", "3,6,6", 2, 1), ("1", "6", 0, 1)], lambda a, b: S.home_away_sets(_ints(a), _ints(b)))
facts("agg14_side_by_sets", "a string, b string", [("6,6", "1,4", "left"), ("6,1", "1,6", "right")], lambda a, b: S.side_by_sets(_ints(a), _ints(b)))
facts("agg15_index_by_sets", "a string, b string", [("6,7 8", "3,6 6", 0), ("1,2", "6,6", 1), ("6,1", "1,6", None), ("x", "6", None)], lambda a, b: S.index_by_sets(_texts(a), _texts(b)))
facts("agg16_index_by_games", "a string, b string", [("6,6", "3,4", 0), ("1,", "6,6", 1), ("6", "6", 0)], lambda a, b: S.index_by_games(_ints(a), _ints(b)))
facts("flt16_valid_sets", "a string, b string", [("6,0,1", "3,0,0", "6-3|1-0"), ("0", "0", "")], lambda a, b: F.array_join(S.valid_sets(_ints(a), _ints(b)), "|"))

facts("dat01_identity_date", "a string", [("2026-5-4", "2026-05-04"), ("05/24/2026", "2026-05-24"), ("5/4/26", "2026-05-04"), ("5/4/99", "1999-05-04"), ("2/29/72", "1972-02-29"), ("1/1/68", "2068-01-01"), ("1/1/69", "1969-01-01"), ("May 4, 2026", "2026-05-04"), ("Sept 4", "sept 4"), ("2026-02-30", "2026-02-30"), (None, "")], D.identity_date)
facts("dat02_us_date", "a string", [("24/05/2026", "05/24/2026"), ("4.5.2026", "05/04/2026"), ("junk", ""), (None, "")], lambda a: D.us_date(a, ("d/M/yyyy", "d.M.yyyy")))
facts("dat03_us_date_single", "a string", [("2001-02-03T00:00:00", "02/03/2001"), ("x", "")], lambda a: D.us_date(a, ("yyyy-MM-dd'T'HH:mm:ss",)))
facts("dat04_us_date_or_text", "a string", [("2026-05-04", "05/04/2026"), ("2026-05-04T10:00:00Z", "05/04/2026"), ("soon", "soon"), (None, "")], lambda a: D.us_date(a, ("yyyy-M-d", "yyyy-M-d'T'H:m:sXXX"), None))
facts("dat05_iso_prefix_date", "a string", [("2026-05-04T10:11:12.5Z", "05/04/2026"), ("0001-01-01", ""), ("2026-13-01", ""), ("null", ""), (None, "")], D.iso_prefix_date)
facts("dat06_feed_date", "a string", [("3/7/2026 1:02:03 PM", "2026-03-07"), ("3/7/26", "2026-03-07"), ("3/7/99", "1999-03-07"), ("2026-03-07", "2026-03-07"), ("tbd", "tbd"), (None, "")], D.feed_date)
facts("dat07_epoch_or_iso", "a string", [("/Date(86400000)/", dt.date(1970, 1, 2)), ("2001-02-03T00:00:00", dt.date(2001, 2, 3)), ("x", None)], D.epoch_or_iso)
fields("dat08_date_range", "start end", "a string", [("2024-04-21 - 2024-04-22", dt.date(2024, 4, 21), dt.date(2024, 4, 22)), ("28. 11.-2. 12. 2025", dt.date(2025, 11, 28), dt.date(2025, 12, 2)), ("28. 11. 2025 - 2. 12. 2025", dt.date(2025, 11, 28), dt.date(2025, 12, 2)), ("x", None, None)], D.date_range)
fields("dat09_european_range", "start end", "a string", [("28. 12.-2. 1. 2026", dt.date(2025, 12, 28), dt.date(2026, 1, 2)), ("18.-20. 4. 2026", dt.date(2026, 4, 18), dt.date(2026, 4, 20)), ("18. 7. 2026", dt.date(2026, 7, 18), dt.date(2026, 7, 18)), ("x", None, None)], D.european_range)
fields("dat10_dates_in_text", "first last", "a string", [("from 1/2/2026 to 2026-02-05 ok", dt.date(2026, 2, 1), dt.date(2026, 2, 5)), ("on 3/2/2026", dt.date(2026, 2, 3), dt.date(2026, 2, 3)), ("none", None, None)], D.dates_in_text)
fields("dat11_range_with_year", "start end", "a string", [("3 May - 5 June", dt.date(2026, 5, 3), dt.date(2026, 6, 5)), ("3 May 2025", dt.date(2025, 5, 3), dt.date(2025, 5, 3)), ("", None, None)], lambda a: D.range_with_year(a, F.lit(2026)))
fields("dat12_range_as_of", "start end", "a string", [("Dec 28 to Jan 2", dt.date(2025, 12, 28), dt.date(2026, 1, 2)), ("May 3 - May 5", dt.date(2026, 5, 3), dt.date(2026, 5, 5)), ("3 Dec to 4 Jan 2025", dt.date(2024, 12, 3), dt.date(2025, 1, 4)), ("4 May", dt.date(2026, 5, 4), dt.date(2026, 5, 4))], lambda a: D.range_as_of(a, F.lit(dt.date(2026, 6, 1))))
facts("dat13_spelt_range_start", "a string", [("16 - 21 June 2025", "2025-06-16"), ("31 January - 28 February 2025", "2025-01-31"), ("31 January February 2025", "2025-01-31"), ("4 July 2025", "2025-07-04"), ("soon", ""), (None, "")], D.spelt_range_start)
facts("dat14_past_date", "a string, b string, c string", [("7", "4.0", "1990", "04/07/1990"), ("30", "2", "1990", ""), ("1", "1", "1899", ""), ("1", "1", "2030", ""), (None, "1", "1990", "")], lambda a, b, c: D.past_date(a, b, c, F.lit(dt.date(2026, 1, 1))))
facts("dat15_whole_number", "a string", [("7.0", 7), (" 12 ", 12), ("123", None), ("7.5", None), (None, None)], lambda a: D.whole_number(a, 2))
facts("dat16_lenient_int", "a string", [("12", 12), ("3.7", 3), ("x", 0), (None, 0)], D.lenient_int)
facts("dat17_lenient_bool", "a string", [("TRUE", True), ("1", True), ("no", False), (None, False)], D.lenient_bool)
facts("dat18_month_end", "a date", [(dt.date(2024, 2, 3), dt.date(2024, 2, 29)), (dt.date(2026, 12, 1), dt.date(2026, 12, 31))], F.last_day)
facts("dat19_clamp_day", "a date, d int", [(dt.date(2026, 2, 10), 31, dt.date(2026, 2, 28)), (dt.date(2026, 3, 1), 15, dt.date(2026, 3, 15))], D.clamp_day)
facts("dat20_next_weekday", "a date, w int", [(dt.date(2026, 3, 4), 2, dt.date(2026, 3, 4)), (dt.date(2026, 3, 4), 0, dt.date(2026, 3, 9)), (dt.date(2026, 3, 8), 6, dt.date(2026, 3, 8))], D.next_weekday)
_T = dt.datetime
facts(
    "dat21_next_run",
    "f string, s int, w int, d int, a date, t timestamp",
    [
        ("daily", 36000, 0, 1, None, _T(2026, 3, 4, 9), _T(2026, 3, 4, 10)),
        ("daily", 36000, 0, 1, None, _T(2026, 3, 4, 10), _T(2026, 3, 5, 10)),
        ("weekly", 36000, 2, 1, None, _T(2026, 3, 4, 11), _T(2026, 3, 11, 10)),
        ("biweekly", 36000, 2, 1, dt.date(2026, 2, 25), _T(2026, 3, 4, 11), _T(2026, 3, 11, 10)),
        ("biweekly", 36000, 2, 1, dt.date(2026, 3, 10), _T(2026, 3, 4, 11), _T(2026, 3, 11, 10)),
        ("monthly", 36000, 0, 31, None, _T(2026, 1, 31, 11), _T(2026, 2, 28, 10)),
        ("other", 0, 0, 5, None, _T(2026, 12, 6), _T(2027, 1, 5)),
    ],
    D.next_run,
)
facts("dat22_first_anchor", "s int, w int, t timestamp", [(36000, 2, _T(2026, 3, 4, 9), dt.date(2026, 3, 4)), (36000, 2, _T(2026, 3, 4, 10), dt.date(2026, 3, 11))], D.first_anchor)
facts("dat23_lookback_days", "a int", [(5, 5), (45, 45), (7, 15), (None, 15), (50, 15)], D.lookback_days)
facts("dat24_duration_label", "a bigint", [(999, "999 ms"), (1500, "1.5s"), (61500, "1m 02s"), (None, "0 ms"), (3600000, "60m 00s")], D.duration_label)
facts("dat25_size_label", "a bigint", [(100, "100 B"), (2048, "2.0 KB"), (3145728, "3.0 MB"), (None, "0 B")], D.size_label)
facts("dat26_progress_percent", "a int, b int", [(1, 8, 12), (3, 8, 38), (9, 8, 100), (1, 0, 0)], D.progress_percent)
facts("dat27_eta_label", "a double", [(None, ""), (0.0, "finishing…"), (0.2, "~1s left"), (75.0, "~1m 15s left"), (7260.0, "~2h 01m left")], D.eta_label)
facts("dat28_clamped", "a int", [(0, 5), (40, 16), (None, 5), (3, 3), (-2, 1)], lambda a: D.clamped(a, 1, 16, 5))
facts("dat29_backoff", "a int", [(1, 1.0), (4, 8.0), (9, 30.0)], lambda a: D.backoff(a, 1.0, 30.0))
facts("dat30_percent", "a double, b double", [(1.0, 3.0, 33.3), (5.0, 0.0, 0.0), (9.0, 3.0, 100.0)], D.percent)
facts("dat31_birth_date", "a string, b string", [("3/4/2001", "", "04/03/2001"), ("", "1999", "1/1/1999"), (None, None, "")], D.birth_date)
facts("dat32_year_in_text", "a string", [("Born 2009-ish", "1/1/2009"), ("1899", ""), (None, "")], D.year_in_text)
fields("dat33_one_or_two_dates", "start end", "a string", [("03/05/2026 - 07/05/2026", "05/03/2026", "05/07/2026"), ("le 3/5/2026", "05/03/2026", "05/03/2026"), ("", "", "")], D.one_or_two_dates)
facts("dat34_default_year", "a string, b int", [("League 2024 A", 2026, 2024), ("League", 2026, 2026)], D.default_year)
fields("dat35_locale_date", "us eu", "a string", [("3/4/2026", dt.date(2026, 3, 4), dt.date(2026, 4, 3)), ("13/4/2026", dt.date(2026, 4, 13), dt.date(2026, 4, 13)), ("x", None, None)], lambda a: F.struct(D.locale_date(a, False).alias("us"), D.locale_date(a, True).alias("eu")))
facts("win09_eta_seconds", "r boolean, d int, t int, e double", [(True, 5, 10, 50.0, 50.0), (True, 10, 10, 50.0, 0.0), (False, 5, 10, 50.0, None), (True, 0, 10, 50.0, None)], D.eta_seconds)
facts("agg20_line_count", "a string", [("h\na\nb\n", 2), ("h\na", 1), ("", 0), ("h", 0)], D.line_count)
facts("val02_key_batch", "a string", [("x 0123456789abcdef0123456789ABCDEF y 0123456789abcdef0123456789abcdef", 1), ("none", 0)], lambda a: F.size(F.slice(F.array_distinct(F.regexp_extract_all(F.lower(a), F.lit("[0-9a-f]{32}"), F.lit(0))), 1, 2000)))
