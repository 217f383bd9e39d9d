import math

import numpy as np

from rallyframe.llm import lattice_sample
from rallyframe.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def seeds(n):
    return lattice_sample.mixed(np.arange(n, dtype=np.uint64))


def log_total(lattice, text):
    """Log of the summed weights of all segmentations of a text, by places over the whole text, without units."""
    total = [0.0] * (len(text) + 1)
    for i in range(len(text) - 1, -1, -1):
        ways = [lattice.pieces[text[i:j]][1] + total[j] for j in range(i + 1, min(len(text), i + lattice.longest) + 1) if text[i:j] in lattice.pieces]
        if text[i] not in lattice.pieces:
            ways.append(lattice.byte_weight * len(text[i].encode()) + total[i + 1])
        top = max(ways)
        total[i] = top + math.log(sum(math.exp(w - top) for w in ways))
    return total[0]


def log_weight(lattice, ids):
    by = {i: w for i, w in lattice.pieces.values()}
    return sum(by.get(int(i), lattice.byte_weight) for i in ids)


def test_log_probabilities_over_runs_of_spaces_and_long_words():
    lattice = lattice_sample.Lattice(MODEL)
    texts = ["a   b", "a" + " " * 40 + "b", "  a", "x  ", "a" * 70, "-" * 200, "QUJDREVGR0hJSktMTU5P" * 30, "漢字仮名" * 20, "中͸é" * 300, "a\n\n  b", "the cat"]
    rows = lattice_sample.sample_batch(lattice, texts, seeds(len(texts)), 2)
    assert {r[0] for r in rows} == set(range(len(texts)))
    for d, _, ids, logp, *_ in rows:
        want = log_weight(lattice, ids) - log_total(lattice, ("▁" + texts[d]).replace(" ", "▁"))
        assert abs(logp - want) < 1e-6 * max(1, abs(want)), texts[d][:20]
        assert lattice_sample.decode(lattice, ids).tobytes().decode() == " " + texts[d]


def test_pieces_of_spaces_and_across_the_33rd_character_are_sampled():
    lattice, n = lattice_sample.Lattice(MODEL), 3000
    for text, crosses in (("a   b", "▁▁▁"), ("a" * 40, None)):
        seen, across = set(), False
        for _, _, ids, *_ in lattice_sample.sample_batch(lattice, [text] * n, seeds(n), 1):
            names = [lattice.names[i] for i in ids]
            seen |= set(names)
            at = np.cumsum([len(x) for x in names])
            across |= 33 not in at
        assert crosses in seen if crosses else across


def test_query_and_stage_give_ids_that_decode_to_the_text(spark, tmp_path):
    import corpus_pipeline
    from fixtures import documents

    from rallyframe.llm import queries

    docs, rows = documents(spark, extra=["a ▁ b", "\n\n", "  two  spaces "])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = {t or "" for _, t, *_ in rows}
    for out in (queries.op5_sentencepiece(spark, str(tmp_path)), corpus_pipeline.encode(spark, docs, str(tmp_path))):
        assert "ids" in out.columns
        got = out.collect()
        assert all(r.round_trip and len(r.ids) == r.n_pieces for r in got)
        lattice = lattice_sample.Lattice(MODEL)
        assert {lattice_sample.decode(lattice, np.array(r.ids, np.int64)).tobytes().decode()[1:] for r in got} == {t.replace("▁", " ") for t in text}
