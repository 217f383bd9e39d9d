import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import documents, empty, words

from rallyframe.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def judge(text, items):
    w = split(text)
    hit, ids = [False] * len(w), set()
    for item, t in items:
        i = split(t)
        n = min(13, len(i))
        for k in range(len(i) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == i[k : k + n]:
                    ids.add(item)
                    hit[j : j + n] = [True] * n
    s = sum(hit)
    return len(w), s, len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), s > 0 and 20 * s >= len(w)


def judge_by_windows(items):
    """As ``judge``, for whole tables: all windows of the items in one dictionary."""
    windows = {}
    for item, t in items:
        i = split(t)
        n = min(13, len(i))
        for k in range(len(i) - n + 1 if n else 0):
            windows.setdefault(tuple(i[k : k + n]), set()).add(item)
    sizes = sorted({len(w) for w in windows})

    def judged(text):
        w = split(text)
        hit, ids = [False] * len(w), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    ids |= found
                    hit[j : j + n] = [True] * n
        s = sum(hit)
        return len(w), s, len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), s > 0 and 20 * s >= len(w)

    return judged


def test_the_two_judges_agree(spark):
    _, rows, items, _ = setup(spark)
    judged = judge_by_windows(items)
    assert [judged(r[1]) for r in rows] == [judge(r[1], items) for r in rows]


def setup(spark):
    rng = random.Random(4)
    items = [(i, words(rng, n)) for i, n in enumerate([40, 13, 14, 12, 3, 1, 30])] + [(90, ""), (91, None), (92, "Same Words, same words. SAME words"), (93, words(rng, 20, 2))]
    extra = [items[0][1], "before " + items[0][1].upper().replace(" ", ", ") + " after", "a " + " ".join(items[0][1].split()[:12]), items[4][1], items[5][1] + " " + items[5][1], words(rng, 500) + " " + " ".join(items[6][1].split()[5:20]), items[3][1] + " x", "same words same words same words same words", words(rng, 400, 2)]
    docs, rows = documents(spark, extra=extra)
    return docs, rows, items, spark.createDataFrame(items, "item_id bigint, text string")


def test_against_brute_force(spark):
    docs, rows, items, bench = setup(spark)
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:6]) for r in got) == sorted((str(r[0]), *judge(r[1], items)) for r in rows)
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.longest > 0) == (r.n_hit > 0)
        if r.longest and [x[0] for x in rows].count(r.doc_id) == 1:
            w, i = split(by_id[r.doc_id]), split(dict((str(k), t) for k, t in items)[r.longest_item])
            assert r.longest == max(common(w[a:], split(t)[b:]) for a in range(len(w)) for _, t in items for b in range(len(split(t))))
            assert w[r.longest_word :][: r.longest] == i[r.longest_item_word :][: r.longest]


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_blocks_of_items_agree(spark, monkeypatch):
    docs, rows, items, bench = setup(spark)
    whole = {(str(r.doc_id), *tuple(r)[1:7]) for r in decontaminate.contamination(docs, bench).collect()}
    cut = decontaminate.item_blocks
    monkeypatch.setattr(decontaminate, "item_blocks", lambda b, t, i: cut(b, t, i, 200))
    assert len(decontaminate.item_blocks(bench, "text", "item_id")) > 2
    got = decontaminate.contamination(docs, bench, keep=("lang",)).drop("lang").collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:6]) for r in got) == sorted((str(r[0]), *judge(r[1], items)) for r in rows)
    assert {(str(r.doc_id), *tuple(r)[1:7]) for r in got} == whole
    located = {(r.item_id, r.item_word, r.n_words) for r in decontaminate.match_locations(docs, bench, least=1).collect()}
    monkeypatch.setattr(decontaminate, "item_blocks", cut)
    assert located == {(r.item_id, r.item_word, r.n_words) for r in decontaminate.match_locations(docs, bench, least=1).collect()}


@pytest.mark.parametrize("cycle", [1, 2, 7])
def test_words_that_repeat_without_end(cycle):
    import time

    item, text = (" ".join(f"w{i % cycle}" for i in range(n)) for n in (1000, 5000))
    items = decontaminate.TestItems([("a", item), ("b", item), ("c", "w0")])
    raw = np.frombuffer(f"{text} other {text}".encode(), np.uint8)
    began = time.perf_counter()
    shard = decontaminate.Shard(raw, np.array([0, len(raw)]), items)
    (runs, ids, best), = shard.hits().values()
    assert time.perf_counter() - began < 1
    assert runs.tolist() == [0, 5000, 5001, 10001] and ids == ["a", "b", "c"] and best[0] == 1000


def test_random_repeats_against_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        vocabulary = [f"v{i}" for i in range(rng.choice([1, 2, 3, 40]))]
        items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))) for i in range(rng.randrange(0, 6))]
        texts = [" ".join(rng.choices([*vocabulary, "zz"], k=rng.randrange(0, 70))) for _ in range(4)]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        shard = decontaminate.Shard(raw, np.cumsum([0, *map(len, texts)]), decontaminate.TestItems(items))
        hits = shard.hits() if shard.some else {}
        for d, t in enumerate(texts):
            assert decontaminate.verdict(int(shard.n[d]), [hits[d]] if d in hits else [])[:5] == judge(t, items)


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id bigint, text string, _text int, item_id int")
    bench = spark.createDataFrame([(1, "b", "x")], "item_id bigint, text string, doc_id string")
    r = decontaminate.contamination(docs, bench, keep=("_text", "item_id", "text")).first()
    assert (r.doc_id, r._text, r.item_id, r.text, r.n_hit) == (1, 5, 6, "a b", 1)
    with pytest.raises(ValueError, match="longest"):
        decontaminate.contamination(docs.withColumn("longest", docs._text), bench, keep=("longest",))


def test_longest_matches(spark):
    docs, rows, items, bench = setup(spark)
    got = {(r.item_id, r.item_word): r.n_words for r in decontaminate.match_locations(docs, bench, least=1).collect()}
    for item, t in items:
        i = split(t)
        for k in range(len(i)):
            best = 0
            for r in rows:
                w = split(r[1])
                for j in range(len(w)):
                    n = 0
                    while k + n < len(i) and j + n < len(w) and w[j + n] == i[k + n]:
                        n += 1
                    best = max(best, n)
            assert got.get((str(item), k), 0) == best


def test_empty_tables(spark):
    docs, _, _, bench = setup(spark)
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    none = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.contaminated or r.n_hit for r in none)
