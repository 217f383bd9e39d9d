"""Secret scans with multipart credential linking, in DataFrame functions only.

Spans of the base kinds (assign, access, hex) are found by pattern. A linker then looks for the parts of one credential:
access identifiers, secrets and endpoints. Weak candidates - long mixed tokens without a key word - count only when
complementary parts lie close by: the interval join keeps those with an identifier or endpoint within ``scope`` code
points. All parts of a credential lie in one document, so the join runs inside the row and nothing is shuffled: starts and
ends are sorted once and each span looks up its neighbours by binary search.

Positions come from the gaps between matches (a split at the same pattern), since SQL gives matches without places. They
are summed in blocks of BLOCK matches, so that a text of very many matches costs little more than in proportion.

Defined cases: null and empty texts have no spans; a text is read whole; equal rows are judged each on its own; null ids
are kept; columns other than id, text and ``keep`` are not read, so their names don't matter; a name in ``keep`` that is
also an output is refused; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.columns import given, up_to

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
#: Parts that only matter together.
WEAK = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])"
IDENTIFIER = r"(?i:\b(?:client_?id|access_?key_?id|account|user(?:name)?|login)\b)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}"
ENDPOINT = r"(?i:\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{4,})"
SCOPE = 200
BLOCK = 128
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _blocks(items: Column) -> Column:
    """A non-empty array in pieces of BLOCK members."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda j: F.slice(items, j * BLOCK + 1, F.lit(BLOCK)))


def _before(values: Column, initial: int, step: Callable[[Column, Column], Column]) -> Column:
    """For each member of an array what ``step`` has made of those before it."""
    empty = F.struct(F.lit(initial).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, empty, lambda a, v: F.struct(step(a["at"], v).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])


def spans_of(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """array<struct<start, rank, kind, end>> of the leftmost, non-overlapping matches; places in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    lengths = F.transform(found, lambda m: F.char_length(m))
    pairs = F.filter(F.zip_with(gaps, lengths, lambda g, n: F.struct(g.alias("g"), n.alias("n"))), lambda p: p["n"].isNotNull())
    kind_, none = F.lit(kind), F.array().cast(_SPANS)

    def step(acc, p):
        start = acc["at"] + p["g"]
        end = start + p["n"]
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), F.lit(rank).alias("rank"), kind_.alias("kind"), end.alias("end"))).alias("spans"))

    def walked(blocks):
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, p: a + p["g"] + p["n"]))
        return F.flatten(F.zip_with(blocks, _before(sums, 0, lambda at, n: at + n), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])))

    return F.when(text.rlike(pattern), given(pairs, lambda p: given(_blocks(p), walked))).otherwise(none)


def _kept_assign(text: Column) -> Column:
    """Assign spans whose value has 12 characters or more; the pattern itself runs free so that a short value is passed over."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    spans = F.zip_with(spans_of(text, ASSIGN, "assign", 0), values, lambda s, v: F.struct(s.alias("s"), F.char_length(v).alias("n")))
    none = F.array().cast(_SPANS)
    return F.when(text.rlike(ASSIGN), F.transform(F.filter(spans, lambda x: x["n"] >= 12), lambda x: x["s"])).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sorted(spans: Column, end: str) -> Column:
    return F.sort_array(F.transform(spans, lambda s: s[end]))


def _near(spans: Column, others: Column, scope: int) -> Column:
    """The spans with another one of ``others``, not overlapping, at most ``scope`` code points away."""

    def kept(starts, ends):
        back = lambda s: s["start"] - F.get(ends, up_to(ends, s["start"]) - 1)
        ahead = lambda s: F.get(starts, up_to(starts, s["end"] - 1)) - s["end"]
        return F.filter(spans, lambda s: F.coalesce(back(s) <= scope, F.lit(False)) | F.coalesce(ahead(s) <= scope, F.lit(False)))

    return given(_sorted(others, "start"), lambda starts: given(_sorted(others, "end"), lambda ends: kept(starts, ends)))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of ``others``: as many of these begin before a span's end as end before its start."""
    return given(_sorted(others, "start"), lambda starts: given(_sorted(others, "end"), lambda ends: F.filter(spans, lambda s: up_to(starts, s["end"] - 1) == up_to(ends, s["start"]))))


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), scope: int = SCOPE) -> DataFrame:
    """id, ``keep``, ``base`` and ``linked`` spans and ``all_spans`` (sorted), one row a document.

    ``linked``: weak secrets (kind ``weak``) with an identifier or endpoint in scope, and the identifiers and endpoints
    (kinds ``identifier``, ``endpoint``) that have a secret of any kind in scope.
    """
    if taken := {"base", "linked", "all_spans", "n_assign", "n_access", "n_hex"} & {id_col, *keep}:
        raise ValueError(f"output names asked for as input columns: {sorted(taken)}")
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(_SPANS)
    names = list(dict.fromkeys([id_col, *keep]))
    held = [f"_held_{i}" for i in range(len(names))]
    rows = docs.select(*(F.col(c).alias(h) for c, h in zip(names, held, strict=True)), t.alias("_t"))
    rows = rows.select(*held, "_t", _kept_assign(F.col("_t")).alias("_a"), spans_of(F.col("_t"), ACCESS, "access", 1).alias("_k"), spans_of(F.col("_t"), HEX, "hex", 2).alias("_h"))
    rows = rows.withColumn("_i", spans_of(F.col("_t"), IDENTIFIER, "identifier", 3)).withColumn("_e", spans_of(F.col("_t"), ENDPOINT, "endpoint", 4))
    parts = F.concat("_k", "_i", "_e")
    rows = rows.withColumn("_w", F.when(F.size(parts) > 0, spans_of(F.col("_t"), WEAK, "weak", 5)).otherwise(none))
    rows = rows.withColumn("_w", F.when(F.size("_w") > 0, _apart(_near(F.col("_w"), parts, scope), F.concat("_a", "_k", "_h"))).otherwise(none))
    ends = F.concat("_i", "_e")
    linked = F.when(F.size(ends) + F.size("_w") > 0, F.array_sort(F.concat("_w", _near(ends, F.concat("_a", "_h", "_w"), scope)))).otherwise(none)
    rows = rows.withColumn("linked", linked).withColumn("base", F.array_sort(F.concat("_a", "_k", "_h")))
    return rows.select(*(F.col(h).alias(c) for h, c in zip(held, names, strict=True)), "base", "linked", F.array_sort(F.concat("base", "linked")).alias("all_spans"), F.size("_a").cast("long").alias("n_assign"), F.size("_k").cast("long").alias("n_access"), F.size("_h").cast("long").alias("n_hex"))


def secrets(spans: Column) -> Column:
    """Of all spans those of secrets, without the identifiers and endpoints they belong to."""
    return F.filter(spans, lambda s: ~s["kind"].isin("identifier", "endpoint"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with the stretches that spans cover, overlaps merged, replaced by a mark."""

    def blotted(block, at):
        """A block's stretch of text, cut out once, since each cut counts code points from its beginning."""
        last = F.aggregate(block, at, lambda a, s: F.greatest(a, s["end"]))

        def step(acc, s, piece):
            gap = F.substring(piece, acc["at"] - at + 1, s["start"] - acc["at"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

        start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))
        return given(F.substring(text, at + 1, last - at), lambda piece: F.aggregate(block, start, lambda acc, s: step(acc, s, piece), lambda acc: F.array_join(acc["out"], "")))

    def whole(blocks):
        ends = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, s: F.greatest(a, s["end"])))
        done = F.zip_with(blocks, _before(ends, 0, lambda at, e: F.greatest(at, e)), blotted)
        return F.concat(F.array_join(done, ""), F.substring(text, F.array_max(ends) + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, given(_blocks(spans), whole)).otherwise(text)
