"""Removals in all orders against applying the filters one after another, and the polynomial against its definition."""

import itertools
import random
import re
from collections import Counter

from fixtures import documents, empty
from pyspark.sql import functions as F

from rallyframe.llm import filter_audit


def failing(rows):
    """(part, failed letters, id) of (id, text, part) rows."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, part in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        rules = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        yield part or "", {k for k, v in rules.items() if v}, i


def audit(rows, good, toxic):
    found, out = list(failing(rows)), {}
    for part in {p for p, _, _ in found}:
        own = [(f, i) for p, f, i in found if p == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [x for x in left if k in x[0]]
                left = [x for x in left if k not in x[0]]
                total[k] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(k in f for f, _ in own) - len(gone), sum(f == {k} for f, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
        for key in [x for x in out if x[0] == part]:
            out[key].append(total[key[1][key[2] - 1]])
    return out


def test_audit_against_filters_one_after_another(spark):
    rng = random.Random(5)
    more = [" ".join(rng.choice(["Aa", "bb", "cc%", "dd", "ee", f"w{rng.randrange(99)}"]) for _ in range(rng.randrange(20, 90))) for _ in range(60)]
    _, rows = documents(spark, extra=[*more, *more[:20], "LOUD " * 70, "a|b"])
    rows = [(i, t, f"p{k % 3}" if k % 7 else None) for k, (i, t, *_) in enumerate(rows)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"id": F.lit(1), "part": F.lit("x"), "mask": F.lit(2), "digest": F.lit(3), "words": F.lit(4)})
    ids = [i for i, _, _ in rows if i is not None]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in ids[::2]] + [(ids[0], 0, 1), (None, 1, 1), (-5, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q and i is not None}, {i for i, _, x in labels if x and i is not None}
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    want = audit(rows, good, toxic)
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COLUMNS] for r in got} == want


def test_polynomial():
    rng = random.Random(3)
    counts = {m: rng.randrange(100) for m in range(32)}
    p = filter_audit.RemovalPolynomial(counts)
    for applied in range(32):
        assert p.corner(applied) == sum(n for m, n in counts.items() if m & applied)
    assert sum(p.share(i) for i in range(5)) == p.corner(31)
    assert [int(120 * p.share(i)) for i in range(5)] == [sum(120 * n // m.bit_count() for m, n in counts.items() if m >> i & 1) for i in range(5)]


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(empty(spark), labels).count() == 0
