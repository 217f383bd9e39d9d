"""Small documents with the awkward cases: null, empty, very long, repeated, tied, odd characters."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=60):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.choice('xyz')}{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = words(rng, 120)
    out = [base, base, base.upper(), base + " extra words here", base.replace(" ", "  \n\t"), None, "", " \n", "one", "two words", "Ünïcode ★ ☃ text 日本語 emoji 😀 end", "x" * 3000, words(rng, 6000)]
    for _ in range(25):
        parts = base.split()
        parts[rng.randrange(len(parts))] = "changed"
        out.append(" ".join(parts))
    out += [words(rng, rng.randrange(1, 80)) for _ in range(40)]
    return out


def documents(spark, seed=1, extra=()):
    """Ids out of order, one null id and one id twice."""
    t = [*texts(seed), *extra]
    ids = [3 * i + 1 for i in range(len(t))]
    random.Random(2).shuffle(ids)
    rows = [(i, x, "en", "s", len(x) if x is not None else None) for i, x in zip(ids, t, strict=True)]
    rows += [(None, "null id text that stands alone", None, None, None), (ids[0], t[9], "de", "s", 3), (ids[7], "another text of the same id", "de", "s", 3)]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
