"""op3 on a whole small table against plain loops over words: mined words, votes, posteriors, features and scores."""

import math
import re

import numpy as np
import pyarrow as pa

from rallyframe.llm import queries, toxicity
from rallyframe.llm.common import mixed, word_hashes

SF = "/root/testdata/sf0.01"


def one_hash(word, most=None):
    raw = np.frombuffer(word, np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(word)]), most)[0])


def begin_hash(word):
    return int(mixed(np.array([one_hash(word, toxicity.BEGINNING) ^ 7], np.uint64))[0]) if len(word) > toxicity.BEGINNING else 0


def words_of(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[0-9a-z\x80-\xff]+", low)


def plain_mined(labelled, hashes, least=3, ratio=12.0):
    bad, good = sum(y == 1 for _, y in labelled), sum(y == 0 for _, y in labelled)
    count = {}
    for words, y in labelled:
        for h in {hashes[w] for w in words} - {0}:
            count.setdefault(h, [0, 0])[y] += 1
    return {h for h, (g, b) in count.items() if b >= least and (b / bad) / ((g + 0.5) / (good + 1)) >= ratio}


def plain_votes(words, h, b, mined_words, mined_begins):
    lexicons = {k: {w.encode() for w in v} for k, v in toxicity.LEXICONS.items()}
    strong = {w for k, v in lexicons.items() if k not in toxicity.MILD for w in v}
    second = {w.encode() for w in toxicity.SECOND_PERSON}
    out = [len(lexicons[k] & set(words)) >= (2 if k in toxicity.MILD else 1) for k in lexicons]
    for found, mined in ((h, mined_words), (b, mined_begins)):
        hit = {found[w] for w in words} & mined
        out += [any(x % toxicity.MINED_VOTERS == i for x in hit) for i in range(toxicity.MINED_VOTERS)]
    insult = [i for i, w in enumerate(words) if w in strong or h[w] in mined_words or b[w] in mined_begins]
    out += [len(insult) >= 2, bool(insult) and 40 * len(insult) >= len(words)]
    return [*out, any(0 <= i + d < len(words) and words[i + d] in second for i in insult for d in (-2, -1, 1, 2))]


def plain_posterior(model, votes):
    z = math.log(model.prior / (1 - model.prior))
    for j, on in enumerate(votes):
        one, zero = model.rate[1][j], model.rate[0][j]
        z += model.weight[j] * (math.log(one / zero) if on else math.log((1 - one) / (1 - zero)))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_op3_against_plain_loops(spark):
    docs = {r.doc_id: words_of(r.text) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()}
    vocabulary = {w for x in docs.values() for w in x}
    h, b = {w: one_hash(w) for w in vocabulary}, {w: begin_hash(w) for w in vocabulary}
    known = queries.table(spark, SF, "labels").where(queries.fold(5) != 0).select("doc_id", "toxic").collect()
    labelled = [(docs[r.doc_id], r.toxic) for r in known if r.doc_id in docs and r.toxic is not None]
    mined_words, mined_begins = plain_mined(labelled, h), plain_mined(labelled, b)
    votes = {i: plain_votes(w, h, b, mined_words, mined_begins) for i, w in docs.items()}

    voters, model, linear = queries.toxicity_model(spark, SF, queries.table(spark, SF, "documents").select("doc_id", "text"))
    assert set(voters.mined_words.tolist()) == mined_words and set(voters.mined_begins.tolist()) == mined_begins and mined_words
    assert len(voters.names) == len(next(iter(votes.values())))
    own = np.array(list(votes.values()))
    patterns, counts = np.unique(own, axis=0, return_counts=True)
    again = toxicity.fit_label_model(patterns, counts.astype(float))
    assert np.allclose(again.rate, model.rate) and np.allclose(again.weight, model.weight) and math.isclose(again.prior, model.prior)
    posterior = [plain_posterior(model, v) for v in votes.values()]
    assert np.allclose(posterior, model.posterior(own))

    # every distinct text lies in the classifier's sample here
    features = {i: sorted({h[x] % toxicity.DIMENSIONS for x in w} | {b[x] % toxicity.DIMENSIONS for x in w if b[x]}) for i, w in docs.items()}
    distinct = {(tuple(features[i]), tuple(votes[i])): p for i, p in zip(docs, posterior, strict=True)}
    fitted = toxicity.fit_linear([np.array(f, np.int64) for f, _ in distinct], np.array([v for _, v in distinct]), np.array(list(distinct.values())))
    assert np.allclose(fitted.voters, linear.voters, atol=1e-6) and np.allclose(fitted.hashed, linear.hashed, atol=1e-6)
    got = {r.doc_id: r.score for r in queries.op3_toxicity(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i in docs:
        z = linear.bias + sum(linear.voters[j] for j, on in enumerate(votes[i]) if on) + sum(linear.hashed[d] for d in features[i])
        assert math.isclose(got[i], 1 / (1 + math.exp(-max(-30, min(30, z)))), abs_tol=1e-9), i


def test_votes_do_not_cross_texts():
    voters = toxicity.Voters()
    texts = pa.array(["you", "idiot", "you are an idiot", "a b c idiot d e you", None, "idiot you"])
    addressed = voters.votes(*toxicity.features(texts))[:, voters.names.index("addressed")].tolist()
    assert addressed == [False, False, False, False, False, True]
