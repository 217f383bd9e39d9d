import math
import random

import numpy as np
import pytest
from fixtures import documents, empty, words

from rallyframe.llm import lattice_sample, quality_cnn, toxicity
from rallyframe.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def labelled(spark, bad, n=300, seed=8):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        y = int(i % 4 == 0)
        t = words(rng, rng.randrange(5, 120)).split()
        if y:
            for _ in range(rng.randrange(1, 4)):
                t.insert(rng.randrange(len(t)), bad(rng))
        rows.append((i, " ".join(t)))
        labels.append((i, y))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), labels


def test_toxicity_learns_listed_and_unlisted_words(spark):
    docs, labels = labelled(spark, lambda r: r.choice(["idiot", "grumwort", "grumwister", "moron", "zogblat"]))
    train = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id bigint, label int")
    voters, model, linear = toxicity.fit(docs, train)
    got = {r.doc_id: r.score for r in toxicity.score(docs, voters, linear).collect()}
    held = [(got[i], y) for i, y in labels if i % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95
    assert 0 < model.prior <= 0.5 and (model.weight <= 1).all()


def test_toxicity_edge_cases(spark):
    docs, rows = documents(spark, extra=["you idiot", "stupid moron, worthless"])
    none = spark.createDataFrame([], "doc_id bigint, label int")
    voters, _, linear = toxicity.fit(docs, none)
    got = toxicity.score(docs, voters, linear, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())
    voters, _, linear = toxicity.fit(empty(spark), none)
    assert toxicity.score(empty(spark), voters, linear).count() == 0


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.2
    a = np.where(y, rng.random(20000) < 0.7, rng.random(20000) < 0.02)
    b = np.where(y, rng.random(20000) < 0.6, rng.random(20000) < 0.02)
    votes = np.stack([a, a, a, b], 1)
    keys, n = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.fit_label_model(keys, n.astype(float))
    assert model.correlation[0, 1] > 0.5 and model.weight[3] > 2 * model.weight[0]


def test_quality_network(spark):
    docs, labels = labelled(spark, lambda r: "%%%*** ###&&&", seed=9)
    train = spark.createDataFrame([(i, 1 - y) for i, y in labels if i % 3 != 1], "doc_id bigint, label int")
    net = quality_cnn.fit(docs, train)
    got = {r.doc_id: r.score for r in quality_cnn.score(docs, net).collect()}
    assert np.mean([(got[i] >= 0.5) != bool(y) for i, y in labels if i % 3 == 1]) > 0.95


def test_network_pooling_against_a_plain_loop():
    rng = np.random.default_rng(2)
    net = quality_cnn.Network(rng.normal(size=(5, 256, 16)).astype(np.float32), rng.normal(size=16).astype(np.float32), np.zeros(32, np.float32), 0.0)
    texts = [b"", b"a", rng.bytes(127), rng.bytes(128), rng.bytes(513), rng.bytes(2000)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    got = quality_cnn.document_features(net, raw, np.cumsum([0, *map(len, texts)]), 512)
    assert not got[0].any()
    blocks = [max(1, -(-len(t) // 128)) for t in texts]
    flat = np.frombuffer(b"".join(t.ljust(128 * b, b"\0") for t, b in zip(texts[1:], blocks[1:], strict=True)) + b"\0" * 4, np.uint8)
    r = sum(net.tables[j][flat[j : len(flat) - 4 + j]] for j in range(5)).reshape(-1, 128, 16)
    r[np.cumsum(blocks[1:]) - 1, 124:] = -np.inf  # a text's last block has no window that runs past it
    r = r.max(1)
    at = 0
    for i in range(1, len(texts)):
        own, at = r[at : at + blocks[i]], at + blocks[i]
        n = max(0, -(-(len(own) - 4) // 3)) + 1
        chunks = np.maximum(np.array([own[3 * c : 3 * c + 4].max(0) for c in range(n)]) + net.offset, 0)
        assert np.allclose(got[i, :16], chunks.mean(0), atol=1e-4) and np.allclose(got[i, 16:], chunks.max(0), atol=1e-4)


def test_quality_edge_cases(spark):
    docs, rows = documents(spark)
    net = quality_cnn.fit(docs, spark.createDataFrame([], "doc_id bigint, label int"))
    got = quality_cnn.score(docs, net).collect()
    assert len(got) == len(rows) and {round(r.score, 6) for r in got} == {0.5}
    assert quality_cnn.score(empty(spark), net).count() == 0


def test_a_text_scores_alike_beside_any_other():
    rng = np.random.default_rng(3)
    net = quality_cnn.Network(rng.normal(size=(5, 256, 16)).astype(np.float32), rng.normal(size=16).astype(np.float32), rng.normal(size=32).astype(np.float32), 0.1)
    text = rng.bytes(256)
    seen = {float(quality_cnn.predict(net, np.frombuffer(text + other, np.uint8), np.array([0, 256, 256 + len(other)]))[0]) for other in (b"", b"\xff" * 9, rng.bytes(700))}
    assert len(seen) == 1


def test_long_labelled_texts_are_learned_from(spark):
    """All labelled texts are of over 32 KB, two of a megabyte and more."""
    rng = random.Random(4)
    base = words(rng, 8000)
    kinds = "%%%*** ###&&& ", "calm words here "
    rows = [(i, words(rng, 40) + base + kinds[i % 2] * (1000 if i > 1 else 60_000)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    net = quality_cnn.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id bigint, label int"))
    got = {r.doc_id: r.score for r in quality_cnn.score(docs, net).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(150, 200))
    assert all(len(quality_cnn.chunks_of(t.encode())) <= quality_cnn.EPOCHS * quality_cnn.TRAIN_CHUNKS for _, t in rows[:2])


def test_epochs_draw_on_the_whole_text():
    text = b"".join(b"%07d " % i for i in range(1 << 17))  # 1 MB, every place told by its number
    chunks = quality_cnn.chunks_of(text)
    at = [int(c[:7]) for e in range(quality_cnn.EPOCHS) for c in quality_cnn.chunks_of_epoch(chunks, e)]
    assert len(at) == quality_cnn.EPOCHS * quality_cnn.TRAIN_CHUNKS and chunks == quality_cnn.chunks_of(text)
    assert {a * 8 // (1 << 17) for a in at} == set(range(8)) and len({tuple(at[i : i + 8]) for i in range(0, len(at), 8)}) == quality_cnn.EPOCHS
    short = quality_cnn.chunks_of(text[:2000])
    assert all(quality_cnn.chunks_of_epoch(short, e) == short for e in range(quality_cnn.EPOCHS)) and short[-1] == text[:2000][(len(short) - 1) * 384 :]


def test_kept_columns_may_clash_with_inner_names_not_with_outputs(spark):
    docs = spark.createDataFrame([(1, "you idiot", 5, 6, "y"), (None, None, None, 7, "z")], "doc_id bigint, text string, score int, _y int, label string")
    none = spark.createDataFrame([], "doc_id bigint, label int")
    voters, _, linear = toxicity.fit(docs, none)
    net = quality_cnn.fit(docs, none)
    for score in (lambda keep: toxicity.score(docs, voters, linear, keep=keep), lambda keep: quality_cnn.score(docs, net, keep=keep)):
        assert {(r.doc_id, r._y, r.label) for r in score(("doc_id", "_y", "label")).collect()} == {(1, 6, "y"), (None, 7, "z")}
        with pytest.raises(ValueError, match="score"):
            score(("doc_id", "score"))


def segmentations(lattice, text):
    if not text:
        return {(): 0.0}
    out = {}
    for n in range(1, len(text) + 1):
        p = lattice.pieces.get(text[:n])
        if p:
            for rest, w in segmentations(lattice, text[n:]).items():
                out[(p[0], *rest)] = w + p[1]
    return out


def test_samples_follow_the_lattice_distribution():
    lattice, n = lattice_sample.Lattice(MODEL), 20000
    rows = lattice_sample.sample_batch(lattice, ["the cat"] * n, lattice_sample.mixed(np.arange(n, dtype=np.uint64)), 3)
    first, second = segmentations(lattice, "▁the"), segmentations(lattice, "▁cat")
    every = {a + b: v + w for a, v in first.items() for b, w in second.items()}
    total = math.log(sum(map(math.exp, every.values())))
    every = {k: v - total for k, v in every.items()}
    by, share = {}, {}
    for d, r, ids, logp, value, inclusion in rows:
        k = tuple(ids.tolist())
        assert abs(logp - every[k]) < 1e-9 and inclusion <= 1e-12
        by.setdefault(d, []).append((value, k))
        if r == 1:
            share[k] = share.get(k, 0) + 1 / n
    assert all(len({k for _, k in v}) == 3 and v == sorted(v, reverse=True) for v in by.values())
    assert max(abs(share.get(k, 0) - math.exp(p)) for k, p in every.items()) < 0.02
    # inclusion scores make the sum over a sample of probability / inclusion an unbiased estimate of one
    estimate = sum(math.exp(r[3] - r[5]) for r in rows) / n
    assert abs(estimate - 1) < 0.03


def test_sampling_and_decoding(spark):
    docs, rows = documents(spark, extra=["a ▁ b", "\n\n", "  two  spaces "])
    one = lattice_sample.sample_segmentations(docs, MODEL, k=3)
    got = one.collect()
    assert all(r.round_trip for r in got)
    again = {(r.doc_id, r.sample, r.ids_xxh64) for r in lattice_sample.sample_segmentations(docs.repartition(3), MODEL, k=3).collect()}
    assert {(r.doc_id, r.sample, r.ids_xxh64) for r in got} == again
    text = {r[1] or "" for r in rows}
    back = lattice_sample.decode_segmentations(one, MODEL).collect()
    assert {r.text for r in back} == {t.replace("▁", " ") for t in text}
    assert lattice_sample.sample_segmentations(empty(spark), MODEL).count() == 0
