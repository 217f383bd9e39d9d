"""The backoff model against plain Python: every score, and sums of probabilities."""

import math
import re
import zlib
from collections import Counter

import pytest
from fixtures import documents, empty
from pyspark.sql import functions as F

from rallyframe.llm import katz, queries


def discounts(often):
    for k in range(5, 0, -1):
        if min(often[r] for r in range(1, k + 2)) <= 0:
            continue
        beyond = (k + 1) * often[k + 1] / often[1]
        d = {r: ((r + 1) * often[r + 1] / (r * often[r]) - beyond) / (1 - beyond) if beyond != 1 else 1.0 for r in range(1, k + 1)}
        if all(0 < x < 1 for x in d.values()):
            return d
    return {}


class Plain:
    """A model of (trained, text) rows, in dictionaries."""

    def __init__(self, rows):
        trained = [self.tokens(t) for own, t in rows if own]
        self.c = Counter(x for t in trained for x in t)
        self.n, v = sum(self.c.values()), len(self.c)
        self.d = discounts(Counter(self.c.values()))
        taken = sum(r * (1 - self.d.get(r, 1)) for r in self.c.values())
        self.below = self.n if taken > 0 else self.n + 1
        self.rest = (taken or 1) / self.below
        self.pairs = Counter(p for t in trained for p in zip(["<begin>", *t], t))
        self.d2 = discounts(Counter(self.pairs.values()))
        self.base_below = self.n + v + 1
        self.contexts, after = {}, {}
        for (a, b), r in self.pairs.items():
            after.setdefault(a, []).append((b, r))
        for a, found in after.items():
            taken = sum(r * (1 - self.d2.get(r, 1)) for _, r in found)
            below = sum(r for _, r in found) + (0 if taken > 0 else 1)
            self.contexts[a] = (below, (taken or 1) / below / (1 - sum(self.single(b) for b, _ in found)))

    @staticmethod
    def tokens(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [w for w in re.split("[\x20\x09-\x0d]+", text) if w] + [" "]

    def single(self, w):
        return self.c[w] * self.d.get(self.c[w], 1) / self.below if w in self.c else self.rest

    def probability(self, a, b):
        if r := self.pairs.get((a, b)):
            return r * self.d2.get(r, 1) / self.contexts[a][0]
        return self.contexts.get(a, (0, 1))[1] * self.single(b)

    def row(self, text):
        t = self.tokens(text)
        base = sum(math.log10((self.c[x] + 1) / self.base_below) for x in t)
        return len(t), sum(x in self.c for x in t), self.n, base, sum(math.log10(self.probability(a, b)) for a, b in zip(["<begin>", *t], t))


def same(got, want):
    return tuple(got[:3]) == want[:3] and all(math.isclose(a, b, abs_tol=1e-6, rel_tol=1e-9) for a, b in zip(got[3:], want[3:], strict=True))


def small_pieces(monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 2000)
    monkeypatch.setattr(katz, "CHUNK_BLOCKS", 2)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(katz, "NUMBERED", 50)


@pytest.mark.parametrize("small", [False, True])
def test_scores_against_plain_python(spark, monkeypatch, small):
    """The whole op12 query; in small pieces too, where contexts are split over buckets and blocks over chunks."""
    if small:
        small_pieces(monkeypatch)
    docs = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()}
    trained = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in docs}
    model = Plain([(trained[i], t) for i, t in docs.items()])
    rows = queries.op12_katz(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out != trained[r.doc_id]
        assert same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), model.row(docs[r.doc_id]))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("all_train", [True, False])
def test_awkward_documents(spark, monkeypatch, all_train):
    small_pieces(monkeypatch)
    df, rows = documents(spark, extra=["the " * 9000, "the", "THE the"])
    df = df.withColumns({"id": F.lit(1), "train": F.lit("x"), "block": F.lit(3), "word": F.lit("y")})
    own = F.lit(True) if all_train else F.col("doc_id") % 2 == 0
    model = Plain([(all_train or (i is not None and i % 2 == 0), t) for i, t, *_ in rows])
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score(df, own).collect())
    want = sorted((str(i), *model.row(t)) for i, t, *_ in rows)
    assert len(got) == len(want) and all(a[0] == b[0] and same(a[1:], b[1:]) for a, b in zip(got, want, strict=True))


def test_probabilities_sum_to_one():
    text = "a b a c a b d e f a b g a h i j k l a m n a o b a a b c"
    model = Plain([(True, text), (True, "a b c"), (True, "x y z a b"), (True, "b c a a b c d")])
    for context in [*model.contexts, "unknown"]:
        assert math.isclose(sum(model.probability(context, w) for w in [*model.c, "never seen"]), 1, rel_tol=1e-9)


@pytest.mark.parametrize("often", [[0] * 7, [0, 9, 5, 3, 2, 1, 1], [0, 100, 40, 20, 10, 6, 4], [0, 10, 0, 3, 0, 0, 1], [0, 5, 9, 30, 1, 1, 1]])
def test_discounts(often):
    want = discounts(Counter(dict(enumerate(often))))
    assert katz.discounts(often).tolist() == [1.0, *(want.get(r, 1.0) for r in range(1, 6))]


def test_no_training_text_and_no_text(spark):
    rows = katz.score(documents(spark)[0], F.lit(False)).collect()
    assert len(rows) == len(documents(spark)[1]) and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in rows)
    assert katz.score(empty(spark), F.lit(True)).count() == 0
