import itertools
import random

import corpus_pipeline
from fixtures import SCHEMA, documents, empty, words

from rallyframe.llm import near_copies


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    """The smallest (id, nulls last) of each component, by all pairs of rows."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or (sets[i] | sets[j] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])):
            root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted((min(g, key=lambda x: (x is None, x or 0)) for g in groups.values()), key=str)


def edited(seed=4):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        base = [rng.choice("abcdefghij") + str(rng.randrange(5000)) for _ in range(rng.randrange(60, 400))]
        out.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            t = list(base)
            for i in rng.sample(range(len(t)), max(1, int(share * len(t)))):
                t[i] = "x" + str(rng.randrange(10**6))
            out.append(" ".join(t))
    return out


def test_stage_against_brute_force(spark):
    docs, rows = documents(spark, extra=edited())
    rows = [*rows, *rows[40:60], (rows[3][0], rows[70][1], "en", "s", 1), (None, rows[60][1], "en", "s", 1), (9000, "", "en", "s", 0), (9001, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id for r in kept), key=str) == expected(rows)
    assert {tuple(r) for r in kept} <= set(rows)
    assert corpus_pipeline.drop_near_copies(spark, empty(spark), "").count() == 0


def test_chunks_of_a_large_group(spark):
    rng = random.Random(5)
    base = words(rng, 150).split()
    rows = []
    for i in range(90):
        t = list(base)
        t[rng.randrange(len(t))] = f"x{i}"
        rows.append((i, " ".join(t), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    sketches = near_copies.written(near_copies.sketched(docs, corpus_pipeline.COLUMNS), "t")
    distinct = sketches.selectExpr("_set", "_fp", "_bytes", "_bands", "_row AS _first")
    found = near_copies.links(sketches, distinct, chunk=20)
    roots = {r.root for r in near_copies.components(near_copies.written(found, "t")).collect()}
    assert len(expected(rows)) == len(roots) == 1
