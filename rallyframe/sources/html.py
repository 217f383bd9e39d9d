"""Pages of HTML: anchors and noise by patterns in the JVM; elements by a tolerant parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Pages that a task's Python holds at once, and their bytes.
BATCH_PAGES, BATCH_BYTES = 500, 8 << 20


def bounded_pages(spark: SparkSession) -> None:
    """Batches of pages for Python stay small, whatever a task reads."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_PAGES))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def anchors(html: Column) -> Column:
    """Targets of links, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)<a\b[^>]*?href="([^"]*)"'), F.lit(1))


def without_noise(html: Column) -> Column:
    """Scripts, styles and comments removed, runs of white space squeezed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def preferred_anchors(html: Column, labels: list[str]) -> Column:
    """Distinct targets of the links that bear the first of ``labels`` found on the page."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)<a\b[^>]*?href="[^"]*"[^>]*>[^<]*'), F.lit(0))
    pairs = F.transform(links, lambda x: F.struct(F.regexp_extract(x, 'href="([^"]*)"', 1).alias("to"), F.lower(F.trim(F.regexp_extract(x, ">([^<]*)$", 1))).alias("label")))

    def bearing(word: str) -> Column:
        return F.array_distinct(F.transform(F.filter(pairs, lambda p: p["label"] == word.lower()), lambda p: p["to"]))

    ranked = [bearing(w) for w in labels]
    found = F.array().cast("array<string>")
    for r in reversed(ranked):
        found = F.when(F.size(r) > 0, r).otherwise(found)
    return found


class _Texts(HTMLParser):
    """Texts of the elements with a tag (and class); what is never closed ends with its parent or the page."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, tag: str, mark: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.mark = tag, mark
        self.open: list[tuple[str, int]] = []
        self.texts: list[list[str]] = []
        self.mute = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute += 1
        wanted = tag == self.tag and (not self.mark or self.mark in (dict(attrs).get("class") or "").split())
        if wanted:
            self.texts.append([])
        if tag not in self.VOID:
            self.open.append((tag, len(self.texts) - 1 if wanted else -1))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not self.mute:
            for _, at in self.open:
                if at >= 0:
                    self.texts[at].append(data)


_REFERENCE = re.compile(r"&(?:(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)?")


def ended_only(page: str) -> str:
    """``page`` with each ampersand spelt out that begins no reference ended by a semicolon, so that a parser keeps it as it is."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or f"{m[1]};" in html5) else f"&amp;{m[0][1:]}", page)


def element_texts(tag: str, mark: str = "", ended: bool = False):
    """A pandas function: texts of all elements with a tag (and class), white space collapsed, in page order.

    ``ended``: character references count only with their semicolon; otherwise some old ones do without it, as in browsers.
    """

    @F.pandas_udf("array<string>")
    def found(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            out = []
            for page in batch:
                parser = _Texts(tag, mark)
                parser.feed(ended_only(page or "") if ended else page or "")
                parser.close()
                out.append([" ".join("".join(t).split()) for t in parser.texts])
            yield pd.Series(out)

    return found


def first_text(tag: str, mark: str = "", ended: bool = False):
    """The first element's text, or blank."""
    texts = element_texts(tag, mark, ended)
    return lambda c: F.coalesce(F.try_element_at(texts(c), F.lit(1)), F.lit(""))


def labelled(terms: Column, values: Column) -> Column:
    """A map of definition lists (labels and texts side by side); of equal labels the last counts."""
    pairs = F.zip_with(terms, values, lambda t, v: F.struct(F.coalesce(t, F.lit("")).alias("k"), F.coalesce(v, F.lit("")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))
