import itertools
import re

import numpy as np
import xxhash
from fixtures import documents, empty

from rallyframe.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(fps, most=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= most:
            root[find(a)] = find(b)
    return {f: find(f) for f in root}


def expected(rows):
    fp = [fingerprint(r[1]) for r in rows]
    root = brute(set(fp))
    low = {}
    for r, f in zip(rows, fp, strict=True):
        if r[0] is not None:
            low[root[f]] = min(low.get(root[f], r[0]), r[0])
    return sorted(((r[0], f"{f:016x}", low.get(root[f])) for r, f in zip(rows, fp, strict=True)), key=str)


def test_against_brute_force(spark):
    docs, rows = documents(spark)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == expected(rows)


def test_empty_table_and_clashing_columns(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    docs, _ = documents(spark)
    more = docs.selectExpr("*", "1 AS fp", "2 AS root", "3 AS component_id")
    assert simhash.near_duplicates(more).count() == docs.count()


def test_many_near_fingerprints_and_small_chunks(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(p) for p in rng.choice(20, rng.integers(0, 6), replace=False)) for b in base for _ in range(300)}
    fps |= {int(x) for x in rng.integers(0, 2**63, 400, dtype=np.uint64)}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    roots = {r.fp: r.root for r in simhash.components(simhash.links(df, chunk=32)).collect()}
    want, got = {}, {}
    for f, r in brute(fps).items():
        want.setdefault(r, set()).add(f)
    for f in fps:
        s = int(np.uint64(f).view(np.int64))
        got.setdefault(roots.get(s, s), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_thresholds_satisfy_pigeonhole_and_avoid_a_hot_partition():
    both = np.eye(64) * 500 + 250
    groups = simhash.group_bits(1000, both)
    assert sorted(b for g in groups for b in g) == list(range(64))
    even = (np.arange(65536), np.ones(65536))
    hot = (np.array([7]), np.array([100_000_000.0]))
    parts = simhash.plan(100_000, both, {0: hot, 1: even, 2: even, 3: even}, groups, 3)
    assert sum(t + 1 for _, t in parts) == 4
    assert len(parts) >= 1 and not any(set(places) == set(groups[0]) and t >= 0 for places, t in parts)


def test_majority_bits_over_many_hashes():
    rng = np.random.default_rng(5)
    counts = np.array([0, 1, 2, 255, 256, 700])
    h = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    at, got = 0, simhash.majority_bits(h, counts)
    for n, g in zip(counts, got, strict=True):
        own = h[at : at + n]
        at += n
        assert int(g) == (sum(1 << b for b in range(64) if 2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > n) if n else 0)
