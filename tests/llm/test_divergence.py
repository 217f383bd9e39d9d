"""Source divergences against plain Python, on the awkward documents."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import documents, empty

from rallyframe.llm import divergence
from rallyframe.llm.common import text_bytes


def terms(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def audit(rows, least=3, ranks=200):
    """rows: (lang, source, text)."""
    rows = [(a or "", b or "", terms(t)) for a, b, t in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in rows:
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = {}
    for lang in {r[0] for r in rows}:
        kept = [w for w, n in docs[lang].items() if n >= least]
        sources = sorted({r[1] for r in rows if r[0] == lang})
        shares, v = {}, len(kept)
        whole = sum((counts[lang, s] for s in sources), Counter())
        for key, c in [*((s, counts[lang, s]) for s in sources), (None, whole)]:
            n = sum(c[w] for w in kept)
            shares[key] = {w: 1 + 1_000_000_000 * (c[w] + 1) // (n + v) for w in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = sorted((-sum(f(shares[s][w], shares[o][w]) for w in kept), o.encode()) for o in sources if o != s)
            best = sorted((-f(shares[s][w], shares[None][w]), w.encode()) for w in kept if counts[lang, s][w] and shares[s][w] > shares[None][w])
            for part, found in (("pair", pairs), ("term", best[:ranks])):
                for i, (value, item) in enumerate(found, 1):
                    out[lang, s, part, item.decode()] = (-value, i)
    return out


def table(spark, rows):
    from pyspark.sql import functions as F

    base = spark.createDataFrame(rows, "lang string, source string, text string")
    return base.withColumns({"term": F.lit("x"), "n": F.lit(1), "rank": F.lit(2), "block": F.lit(3), "docs": F.lit("y")})


def awkward(spark):
    _, rows = documents(spark)
    found = [(lang, f"s{i % 5}" if i % 3 else None, text) for i, (_, text, lang, _, _) in enumerate(rows)]
    return [*found, *found[:20], ("xx", "only", "no term here is kept"), ("xx", "other", None), ("yy", "", ""), ("de", "s1", "ÄÖ Zug zug ZUG ★"), ("de", "s2", "ÄÖ zug"), ("de", "s3", "zug ÄÖ")]


@pytest.mark.parametrize("block", [1 << 15, 8])
def test_audit_against_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "MOST_BLOCK", max(block, 64))
    rows = awkward(spark)
    got = divergence.audit(table(spark, rows)).collect()
    assert {(r.lang, r.source, r.part, r["item"]): (r.value, r["rank"]) for r in got} == audit(rows)
    assert len(got) == len(audit(rows))


def test_ranks_are_cut_with_ties(spark, monkeypatch):
    monkeypatch.setattr(divergence, "RANKS", 4)
    rows = awkward(spark)
    got = divergence.audit(table(spark, rows)).collect()
    assert {(r.lang, r.source, r.part, r["item"]): (r.value, r["rank"]) for r in got} == audit(rows, ranks=4)


def test_hash_is_xxh64_of_every_length():
    raw, offsets = text_bytes(pa.array(["".join(chr(33 + (i * 7 + n) % 90) for i in range(n)) for n in range(90)] * 2))
    got = divergence.xxh64(raw, offsets[:-1], offsets[1:])
    data = raw.tobytes()
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def test_slices_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(divergence, "xxh64", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    raw, offsets = text_bytes(pa.array(["ab", "cd", "ab", "abc"]))
    first, number = divergence.numbered_slices(raw, offsets[:-1], offsets[1:])
    assert number.tolist() == [0, 1, 0, 2] and first.tolist() == [0, 1, 3]


def test_shares_do_not_overflow():
    count, total, kept = 10**13, 3 * 10**13, 10**9
    assert int(divergence.share(np.array([count]), np.array([total]), kept)[0]) == 1 + 10**9 * (count + 1) // (total + kept)


def test_empty(spark):
    assert divergence.audit(empty(spark)).count() == 0
