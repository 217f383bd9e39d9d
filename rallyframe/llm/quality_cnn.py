"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over the bytes of overlapping chunks that together cover the whole document. Each filter's largest
response in a chunk is kept; over the chunks their mean and their maximum make the document's features, and one logistic
unit turns these into a probability. A filter over bytes is a sum of table rows (one table a position), so a pass over the
text is a handful of look-ups and additions, and training follows the gradient through each chunk's strongest place only.

The training rows are a bounded sample of labelled rows the caller allows, of texts of any length. A step of training sees
at most TRAIN_CHUNKS chunks of a text; each epoch's are drawn anew from all chunks of the whole text, in the task that holds it.
Ids, language and source are never inputs.

Defined cases: null and empty texts have no chunk: their features are zero and their score is the bias's; short texts are one
padded chunk; one label only or none gives the share of ones (0.5 without labels); equal texts score alike beside any others;
null ids keep their row and match no label; other columns are not read, and a name in ``keep`` that is also the output's is
refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import bounded_batches, refuse_clashes, slices, text_bytes

FILTERS, WIDTH = 16, 5
#: Chunks of 4 blocks of 128 bytes; each begins 3 blocks after the one before, so that they overlap by one.
BLOCK, PER_CHUNK, STRIDE = 128, 4, 3
MOST_LABELLED = 3000
EPOCHS, GROUP, TRAIN_CHUNKS = 6, 32, 8


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    offset: np.ndarray
    out: np.ndarray  # 2 * FILTERS: weights of the mean and of the maximum over chunks
    bias: float


def responses(net: Network, raw: np.ndarray) -> np.ndarray:
    """Filter responses at every place of some bytes (without the last WIDTH - 1)."""
    n, at = len(raw) - WIDTH + 1, raw.astype(np.intp)
    acc = np.take(net.tables[0], at[:n], axis=0, mode="clip")
    more = np.empty_like(acc)
    for j in range(1, WIDTH):
        acc += np.take(net.tables[j], at[j : j + n], axis=0, mode="clip", out=more)
    return acc


def document_features(net: Network, raw: np.ndarray, offsets: np.ndarray, step: int = 1 << 13) -> np.ndarray:
    """Mean and maximum over chunks of the max-pooled responses, for each text of a batch; zeros for empty texts.

    Texts lie in padded blocks, so pooling is a maximum over fixed runs. A block reads a few bytes of the one after it; a
    text's last block has no such places.
    """
    n = np.diff(offsets)
    blocks = np.where(n > 0, np.maximum((n + BLOCK - 1) // BLOCK, 1), 0)
    first = np.concatenate(([0], np.cumsum(blocks)))
    last = np.zeros(int(first[-1]), bool)
    last[first[1:][blocks > 0] - 1] = True
    padded = np.zeros(int(first[-1]) * BLOCK + WIDTH - 1, np.uint8)
    to = np.repeat(first[:-1] * BLOCK - offsets[:-1], n) + np.arange(len(raw))
    padded[to] = raw
    pooled = np.empty((int(first[-1]), FILTERS), np.float32)
    for a in range(0, len(pooled), step // BLOCK):
        b = min(len(pooled), a + step // BLOCK)
        found = responses(net, padded[a * BLOCK : b * BLOCK + WIDTH - 1]).reshape(b - a, BLOCK, FILTERS)
        found[last[a:b], BLOCK - WIDTH + 1 :] = -np.inf
        pooled[a:b] = found.max(1)
    out = np.zeros((len(n), 2 * FILTERS), np.float32)
    full = np.flatnonzero(blocks)
    if not len(full):
        return out
    chunks = np.maximum((blocks[full] - PER_CHUNK + STRIDE - 1) // STRIDE, 0) + 1
    begin = np.cumsum(chunks) - chunks
    owner = np.repeat(np.arange(len(full)), chunks)
    at = first[full][owner] + STRIDE * (np.arange(len(owner)) - begin[owner])
    end = first[full + 1][owner] - 1
    chunk = pooled[at]
    for k in range(1, PER_CHUNK):
        np.maximum(chunk, pooled[np.minimum(at + k, end)], out=chunk)
    chunk = np.maximum(chunk + net.offset, 0)
    out[full, :FILTERS] = np.add.reduceat(chunk, begin, axis=0) / chunks[:, None]
    out[full, FILTERS:] = np.maximum.reduceat(chunk, begin, axis=0)
    return out


def predict(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    z = document_features(net, raw, offsets) @ net.out + net.bias
    return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def chunks_of(text: bytes) -> list[bytes]:
    """A text's chunks for training: all where a step takes all, else each epoch's in turn, drawn from the whole text.

    The draw follows from a hash of the text, so a task that runs again draws the same.
    """
    if not text:
        return []
    count = max(1, -(-(len(text) - BLOCK * PER_CHUNK) // (BLOCK * STRIDE)) + 1)
    which = np.arange(count)
    if count > TRAIN_CHUNKS:
        rng = np.random.default_rng(xxhash.xxh64_intdigest(text))
        which = np.concatenate([rng.choice(count, TRAIN_CHUNKS, replace=False) for _ in range(EPOCHS)])
    return [text[c * BLOCK * STRIDE : c * BLOCK * STRIDE + BLOCK * PER_CHUNK] for c in which.tolist()]


def chunks_of_epoch(chunks: list[bytes], epoch: int) -> list[bytes]:
    return chunks if len(chunks) <= TRAIN_CHUNKS else chunks[epoch * TRAIN_CHUNKS : (epoch + 1) * TRAIN_CHUNKS]


def train(texts: list[list[bytes]], labels: np.ndarray, seed: int = 11) -> Network:
    """Adam on the logistic loss, classes weighted to equal shares. ``texts``: what ``chunks_of`` gives of each."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    texts, labels = [t for t in texts if t], np.array([y for t, y in zip(texts, labels, strict=True) if t], float)
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        net.out[:] = 0
        net.bias = float(np.log((share * len(labels) + 0.5) / ((1 - share) * len(labels) + 0.5)))
        return net
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    size = BLOCK * PER_CHUNK
    params = [net.tables, net.offset, net.out, np.zeros(1, np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t, steps = 0, EPOCHS * ((len(texts) + GROUP - 1) // GROUP)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), GROUP):
            ids = order[a : a + GROUP]
            parts, owner = [], []
            for k, i in enumerate(ids):
                for c in chunks_of_epoch(texts[i], epoch):
                    parts.append(np.frombuffer(c.ljust(size, b"\0"), np.uint8))
                    owner.append(k)
            x, owner = np.stack(parts), np.array(owner)
            flat = np.concatenate((x.reshape(-1), np.zeros(WIDTH - 1, np.uint8)))
            acc = responses(net, flat).reshape(len(x), size, FILTERS)
            acc[:, size - WIDTH + 1 :] = -np.inf
            place = acc.argmax(1)
            top = np.take_along_axis(acc, place[:, None], 1)[:, 0] + net.offset
            pooled = np.maximum(top, 0)
            count = np.bincount(owner)
            begin = np.cumsum(count) - count
            mean = np.add.reduceat(pooled, begin, axis=0) / count[:, None]
            most = np.maximum.reduceat(pooled, begin, axis=0)
            z = mean @ params[2][:FILTERS] + most @ params[2][FILTERS:] + params[3][0]
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[ids]) * cost[ids] / len(ids)).astype(np.float32)
            g_out = np.concatenate((err @ mean, err @ most)) + 1e-4 * params[2]
            g = err[owner, None] * params[2][:FILTERS] / count[owner, None]
            g += np.where(pooled == most[owner], err[owner, None] * params[2][FILTERS:], 0)
            g = np.where(top > 0, g, 0).astype(np.float32)
            g_tab = np.zeros_like(net.tables)
            f = np.broadcast_to(np.arange(FILTERS), place.shape)
            row = np.arange(len(x))[:, None]
            for j in range(WIDTH):
                np.add.at(g_tab[j], (x[row, np.minimum(place + j, size - 1)], f), g)
            t += 1
            rate = 0.02 * min(1.0, t / 10) * (1 - 0.9 * t / steps)
            for p, d, mm, vv in zip(params, (g_tab, g.sum(0), g_out, np.array([err.sum()])), m, v, strict=True):
                mm += 0.1 * (d - mm)
                vv += 0.01 * (d * d - vv)
                p -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.99**t)) + 1e-7)
    net.bias = float(params[3][0])
    return net


def fit(docs: DataFrame, training: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "label", most: int = MOST_LABELLED) -> Network:
    """Trains on at most ``most`` labelled rows: those of smallest id hash; each sends the chunks that its epochs draw."""
    bounded_batches(docs.sparkSession)
    sample = training.where(F.col(label).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_y").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id").select("_text", F.xxhash64("_text").alias("_h"), "_y")

    def cut(batches):
        for b in batches:
            chunks = [chunks_of((t or "").encode()) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.list_(pa.binary())), b.column("_h"), b.column("_y")], ["chunks", "h", "y"])

    found = rows.mapInArrow(cut, "chunks array<binary>, h bigint, y int").orderBy("h", "y").limit(most).toArrow()
    return train(found.column("chunks").to_pylist(), np.array(found.column("y").to_pylist(), float))


def score(docs: DataFrame, net: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score``, one row a document."""
    refuse_clashes(keep, ("score",))
    bounded_batches(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast(net)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        model = send.value
        for whole in batches:
            for b in slices(whole, "_text"):
                s = predict(model, *text_bytes(b.column("_text")))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], [*keep, "score"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, score double")
