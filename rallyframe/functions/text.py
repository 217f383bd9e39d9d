"""Text and identifier expressions. Missing text is the empty string, in and out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and their plain forms, as compatibility decomposition gives them.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżžÀÁÂÃÄÅĀĂĄÇĆĈĊČĎÈÉÊËĒĔĖĘĚĜĞĠĢĤÌÍÎÏĨĪĬĮİĴĶĹĻĽÑŃŅŇÒÓÔÕÖŌŎŐŔŖŘŚŜŞŠŢŤÙÚÛÜŨŪŬŮŰŲŴÝŸŶŹŻŽ"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzzAAAAAAAAACCCCCDEEEEEEEEEGGGGHIIIIIIIIIJKLLLNNNNOOOOOOOORRRSSSSTTUUUUUUUUUUWYYYZZZ"

#: White space of any kind, as ``(?U)\\s`` has it.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(blank(c), r"(?U)^\s+|\s+$", "")


def visible_ends(c: Column) -> Column:
    """Whether the first and the last character are visible ASCII, so that there is nothing to strip; told without a pattern."""
    return F.ascii(c).between(33, 126) & F.ascii(F.substring(c, -1, 1)).between(33, 126)


def ends(c: Column) -> Column:
    """As ``strip`` for a plain column: a text with visible ends is taken as it is."""
    return F.when(visible_ends(c), c.cast("string")).otherwise(strip(c))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(blank(c), r"(?U)\s+", " "))


def tidy(c: Column) -> Column:
    """As ``collapse`` for a plain column: a text that has only single spaces inside is taken as it is."""
    return F.when(blank(c).rlike(r"[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  |^ | $"), collapse(c)).otherwise(blank(c))


def normal(c: Column) -> Column:
    return F.lower(collapse(c))


def first_letter(c: Column) -> Column:
    return F.substring(normal(c), 1, 1)


def score_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(blank(c), r"(?U)\s+", ""), ";+$", ""))


def last_first(c: Column) -> Column:
    """``Ann Lee`` to ``Lee, Ann``; a name with a comma keeps its order."""
    name = collapse(c)
    comma = F.regexp_replace(F.regexp_replace(name, r"\s*,\s*$", ""), r"^\s*([^,]*?)\s*,\s*", "$1, ")
    turned = F.regexp_replace(name, r"^(.*) (\S+)$", "$2, $1")
    return F.when(name.contains(","), comma).otherwise(turned)


def last_first_verbatim(c: Column) -> Column:
    """As ``last_first``, but text with a comma stays as it is."""
    name = collapse(c)
    return F.when(name.contains(","), name).otherwise(F.regexp_replace(name, r"^(.*) (\S+)$", "$2, $1"))


def last_first_always(c: Column) -> Column:
    return F.regexp_replace(collapse(c), r"^(.*) (\S+)$", "$2, $1")


def name_of_parts(last: Column, first: Column) -> Column:
    return F.concat_ws(", ", F.nullif(strip(last), F.lit("")), F.nullif(strip(first), F.lit("")))


def title_if_capitals(c: Column) -> Column:
    """Tokens written in capitals only get a capital first letter; others stay."""
    tokens = F.split(collapse(c), " ")
    return F.array_join(F.transform(tokens, lambda t: F.when((t == F.upper(t)) & (t != F.lower(t)), title(t)).otherwise(t)), " ")


def title(c: Column) -> Column:
    """Each run of letters capitalised, wherever it begins (``o'neil-smith`` to ``O'Neil-Smith``); a sharp s there is ``Ss``."""
    runs = F.regexp_extract_all(blank(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))

    def capital(r: Column) -> Column:
        first = F.upper(F.substring(r, 1, 1))
        return F.concat(F.substring(first, 1, 1), F.lower(F.concat(F.substring(first, F.lit(2), F.char_length(first)), F.substring(r, F.lit(2), F.char_length(r)))))

    return F.array_join(F.transform(runs, capital), "")


def without_seed(c: Column) -> Column:
    return strip(F.regexp_replace(blank(c), r"\s*\[[^\]]+\]\s*$", ""))


def without_parentheses(c: Column) -> Column:
    return strip(F.regexp_replace(blank(c), r"[()]", ""))


def without_notes(c: Column, words: tuple[str, ...]) -> Column:
    """Seed and parenthesised notes that hold one of ``words`` removed, no space before commas."""
    note = r"(?iu)\s*\([^)]*(?:" + "|".join(words) + r")[^)]*\)"
    return strip(F.regexp_replace(F.regexp_replace(without_seed(c), note, ""), r"\s+,", ","))


def plain(c: Column) -> Column:
    """Lower case without marks on letters."""
    return F.lower(F.regexp_replace(F.translate(blank(c), MARKED, PLAIN), r"\p{M}+", ""))


def name_key(c: Column) -> Column:
    return collapse(plain(c))


def name_tokens(c: Column) -> Column:
    """Distinct tokens of two or more characters that are not numbers."""
    found = F.regexp_extract_all(plain(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.char_length(t) >= 2) & ~t.rlike("^[0-9]+$")))


def names_match(a: Column, b: Column) -> Column:
    """Token arrays alike: one within the other, or two tokens in common; empty ones never."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return some & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0) | (F.size(F.array_intersect(a, b)) >= 2))


def split_location(c: Column) -> Column:
    """struct(city, country) of ``venue | city, country``."""
    tail = strip(F.element_at(F.split(blank(c), r"\|"), -1))
    parts = F.split(tail, ",")
    return F.struct(strip(parts[0]).alias("city"), F.when(F.size(parts) > 1, strip(F.element_at(parts, -1))).otherwise("").alias("country"))


def suffix_after(parent: Column, child: Column) -> Column:
    p, c = strip(parent), strip(child)
    at = F.instr(c, p)
    rest = F.substring(c, at + F.char_length(p), F.char_length(c))
    return F.when((p == "") | (at == 0), F.lit("")).otherwise(strip(F.regexp_replace(rest, r"^[ \t,\-:]+", "")))


def first_named(*columns: Column, besides: str = "neutral") -> Column:
    """The first text that is neither blank nor the word ``besides``."""
    return F.coalesce(*[F.when((strip(c) != "") & (F.lower(strip(c)) != besides), strip(c)) for c in columns], F.lit(""))


def before_parenthesis(c: Column) -> Column:
    return strip(F.regexp_replace(blank(c), r"(?s)\(.*", ""))


def name_and_gender(c: Column) -> Column:
    """struct(name, gender) of ``Name (M|W|F)``."""
    pattern = r"^(.+?) \((M|W|F)\)"
    code = F.regexp_extract(blank(c), pattern, 2)
    return F.struct(before_parenthesis(F.regexp_extract(blank(c), pattern, 1)).alias("name"), F.when(code == "W", "F").otherwise(code).alias("gender"))


def last_segment(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(blank(url), r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def profile_guid(url: Column) -> Column:
    """The id in a profile's path, or in its query where the path says profile."""
    u = blank(url)
    path, query = F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.regexp_extract(u, r"\?([^#]*)", 1)
    own = F.regexp_extract(path, "/player-profile/([^/]*)", 1)
    asked = F.regexp_extract(query, "(?:^|&)id=([^&]*)", 1)
    return F.when(path.contains("/player-profile/"), own).when(F.lower(path).contains("profile"), asked).otherwise("")


def absolute_url(href: Column, page: Column) -> Column:
    """A link made absolute against its page (scheme, host or folder relative), without fragment."""
    h, p = F.regexp_replace(strip(href), "#.*$", ""), blank(page)
    scheme, origin = F.regexp_extract(p, "^([a-zA-Z]+):", 1), F.regexp_extract(p, "^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(p, "[?#].*$", ""), "^([a-zA-Z]+://.*/)[^/]*$", 1)
    folder = F.when(F.char_length(folder) <= F.char_length(origin), F.concat(origin, F.lit("/"))).otherwise(folder)
    return F.when(h == "", "").when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, F.lit(":"), h)).when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(folder, h))


def http_or_blank(url: Column) -> Column:
    u = strip(url)
    return F.when(u.rlike(r"^(?i:https?)://[^/?#]+"), u).otherwise("")


def url_by_kind(kind: Column, key: Column, bases: dict[str, str]) -> Column:
    k = strip(key)
    found = F.lit("")
    for name, base in bases.items():
        found = F.when(F.lower(blank(kind)) == name, F.concat(F.lit(base), k)).otherwise(found)
    return F.when(k == "", "").otherwise(found)


def slug_url(base: str, name: Column) -> Column:
    return F.concat(F.lit(base), F.regexp_replace(collapse(name), " ", "-"))


def local_id(c: Column) -> Column:
    """``local_`` and the first 8 digest bytes as an unsigned number."""
    return F.concat(F.lit("local_"), F.conv(F.substring(F.sha2(blank(c), 256), 1, 16), 16, 10))


def exported_id(c: Column) -> Column:
    return F.when(blank(c).startswith("local_"), "").otherwise(blank(c))


def request_fingerprint(url: Column, status: Column, size: Column) -> Column:
    return F.sha1(F.concat(blank(url), blank(status), blank(size)))


def masked_address(c: Column) -> Column:
    """Passwords in ``user:password@host`` masked."""
    return F.regexp_replace(blank(c), r"^((?:[a-zA-Z]+://)?[^:@/]+):[^@/]+@", "$1:****@")


def host_only(c: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(strip(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"^[^@/]*@", "")
    return F.regexp_extract(rest, r"^([^:/?#]*)", 1)


def looks_like_licence(c: Column) -> Column:
    return strip(c).rlike(r"^\d{6,}$")


def mentions(c: Column) -> Column:
    """Names of both forms of mention: ``@name`` and ``data-username="name"``."""
    return F.array_union(F.regexp_extract_all(blank(c), F.lit(r'data-username="([^"]+)"'), F.lit(1)), F.regexp_extract_all(blank(c), F.lit(r"(?<![\w@])@([\w.+-]+)"), F.lit(1)))


def header_key(name: str) -> str:
    """A CSV header as a column key: lower case, runs of spaces and dashes as underscores."""
    import re

    return re.sub(r"[\s\-]+", "_", name.replace("﻿", "").strip().lower())


def same_text(a: Column, b: Column) -> Column:
    return normal(a) == normal(b)


def country_code(c: Column) -> Column:
    return F.upper(F.substring(blank(c), 1, 3))


def before_dash(c: Column) -> Column:
    return strip(F.split_part(blank(c), F.lit("-"), F.lit(1)))


def digits_and_plus(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"[^\d+]", "")


def dual_name(name: Column, home: Column, away: Column) -> Column:
    return F.when(strip(name) != "", strip(name)).otherwise(F.concat(F.lit("Dual Match: "), blank(home), F.lit(" vs "), blank(away)))


def guarded_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(blank(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), blank(c))).otherwise(blank(c))


def redacted(c: Column) -> Column:
    """Credentials inside URLs masked."""
    return F.regexp_replace(blank(c), r"(?i)([a-z][a-z0-9+.\-]*://)[^/\s:@]+:[^/\s@]+@", "$1***:***@")


def canonical_url(c: Column) -> Column:
    """Scheme and host lower-cased, path lower-cased without end slash, query parameters sorted, no fragment."""
    u = F.regexp_replace(strip(c), "#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1))
    path = F.lower(F.regexp_replace(F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)?([^?]*)", 1), "/+$", ""))
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: q != "")), "&")
    return F.concat(head, path, F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(""))


def header_label(key: str) -> str:
    """A column key as a display header."""
    special = {"id": "ID", "dob": "DOB", "url": "URL"}
    return " ".join(special.get(w, w.capitalize()) for w in key.split("_"))
