"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, whole texts scored.

A token's probability after the token before it is its discounted relative frequency where the pair was seen in training, else
the context's backoff weight times the token's own (discounted) probability. What discounting leaves of the single tokens
goes to one unknown word, so that every context's probabilities over the known tokens and the unknown one sum to 1.

1. Texts are read once and written as blocks: a block's distinct words, and its token stream as numbers into them.
2. Words are counted by their own strings and numbered by descending count, so that a number tells its count: the counts are a
   step function with at most sqrt(2 N) steps, N the tokens of the training texts. That is all that tasks are sent.
3. Each block's distinct pairs of tokens with their training counts go to buckets by context and are merged there: a row of
   the n-gram table holds a bucket's pairs. A context of more than half a bucket is split over buckets by the second token, and
   what its weight needs is summed over them.
4. Each block's pairs go to the buckets again, with the documents that hold them, and meet the n-gram table and the weights of
   split contexts; many blocks are dealt to several chunks of a bucket. A document's partial sums meet by its block.

Blocks and buckets are rows of compressed integers, so Spark shuffles few large rows. Nothing but the counts' steps is sent to
all tasks.

Defined cases: null and empty texts are one end token; the first token follows a begin mark; without training texts every
token is unknown, with probability 1; where counts of counts give no discount below 1, contexts without any discounted
successor (and the single tokens likewise) keep 1 / (n + 1) for the rest; null ids keep their row; repeated rows score alike,
up to rounding in sums; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rallyframe.llm.common import BATCH_ROWS, LOWER, NOT_SPACE, bounded_batches, discard, mixed, record, same_words, slices, text_bytes, word_hashes, word_spans, written
from rallyframe.llm.divergence import gathered

#: Counts up to this are discounted.
MOST_DISCOUNTED = 5
#: Bytes of text and documents of a block, tokens of a bucket, blocks whose documents meet a bucket in one task.
BLOCK_BYTES, BLOCK_DOCS, BUCKET_TOKENS, CHUNK_BLOCKS = 32 << 20, 1 << 16, 3 << 19, 2048
#: Tokens of a block whose pairs are sorted at a time.
SORTED_TOKENS = 1 << 19
#: Words of equal count are numbered in this many parts where the count is at most ``FEW``, and words of a part.
FEW, NUMBERED = 64, 1 << 18
END = " "  # no word holds a space
BEGIN = -1


def packed(values: np.ndarray) -> bytes:
    """Integers as byte planes of the narrowest type, compressed."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64)


# ------------------------------------------------------------------------------------------------ blocks of encoded texts


def encode_slice(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words with the end mark, tokens as places among them, tokens of each text)."""
    raw, offsets = text_bytes(texts)
    raw = LOWER[raw]
    starts, ends, edges = word_spans(raw, offsets, NOT_SPACE)
    _, first, number = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    number = number.reshape(-1)
    if len(starts) and not same_words(raw, starts, ends, raw, starts[first[number]], ends[first[number]]).all():  # hashes met
        data, seen = raw.tobytes(), {}
        number = np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.unique(number, return_index=True)[1]
    words = pa.concat_arrays([gathered(raw, starts[first], ends[first]), pa.array([END])])
    return words, np.insert(number, edges[1:], len(first)).astype(np.int32), np.diff(edges) + 1


class Block:
    """Slices of texts on their way to one row of encoded texts."""

    def __init__(self):
        self.slices, self.parts, self.size, self.docs = [], [], 0, 0

    def add(self, b: pa.RecordBatch) -> None:
        self.parts.append(b.select(["id", "train"]))
        self.slices.append(encode_slice(b.column("text")))
        self.size += int(text_bytes(b.column("text"))[1][-1])
        self.docs += b.num_rows

    def row(self, block: int) -> pa.RecordBatch:
        """Words are told apart by their strings, and placed by how often they occur."""
        own = pa.Table.from_batches(self.parts).combine_chunks()
        whole = pa.concat_arrays([w for w, _, _ in self.slices]).dictionary_encode()
        places, at = whole.indices.to_numpy(), 0
        streams = []
        for words, tokens, _ in self.slices:
            streams.append(places[at : at + len(words)][tokens])
            at += len(words)
        tokens, sizes = np.concatenate(streams), np.concatenate([n for _, _, n in self.slices])
        order = np.argsort(-np.bincount(tokens, minlength=len(whole.dictionary)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        tokens = rank[tokens]
        train = own["train"].to_numpy()
        counts = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(order))
        lists = [own["id"].combine_chunks(), own["train"].combine_chunks(), pa.array(sizes), whole.dictionary.take(pa.array(order)), pa.array(counts)]
        return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists), pa.array([packed(tokens)])], ["block", "ids", "train", "sizes", "words", "counts", "tokens"])


def encoded(docs: DataFrame) -> DataFrame:
    """Blocks of (id, train, text)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 20, Block()
        for whole in batches:
            for b in slices(whole, "text"):
                block.add(b)
                if block.size >= BLOCK_BYTES or block.docs >= BLOCK_DOCS - BATCH_ROWS:
                    yield block.row(number)
                    number, block = number + 1, Block()
        if block.docs:
            yield block.row(number)

    return docs.mapInArrow(run, f"block bigint, ids array<{kind}>, train array<boolean>, sizes array<bigint>, words array<string>, counts array<bigint>, tokens binary")


# ------------------------------------------------------------------------------------------------ counts and discounts


def discounts(often: list[int]) -> np.ndarray:
    """Good-Turing discount of counts 0 to MOST_DISCOUNTED; ``often[r]``: how many have count r, up to MOST_DISCOUNTED + 1.

    Counts up to the greatest k are discounted for which all discounts lie between 0 and 1, so that what is taken from them
    together is the Good-Turing share of count 1.
    """
    for k in range(MOST_DISCOUNTED, 0, -1):
        if min(often[1 : k + 2]) <= 0:
            continue
        beyond = (k + 1) * often[k + 1] / often[1]
        d = np.array([((r + 1) * often[r + 1] / (r * often[r]) - beyond) / (1 - beyond) if beyond != 1 else 1.0 for r in range(1, k + 1)])
        if ((d > 0) & (d < 1)).all():
            return np.concatenate(([1.0], d, np.ones(MOST_DISCOUNTED - k)))
    return np.ones(MOST_DISCOUNTED + 1)


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= MOST_DISCOUNTED, d[np.minimum(counts, MOST_DISCOUNTED)], 1.0)


@dataclass
class Singles:
    """The model of single tokens. Numbers from ``kinds`` on are unknown; ``begins`` and ``count``: the steps of the counts."""

    begins: np.ndarray
    count: np.ndarray
    kinds: int
    total: int
    d: np.ndarray = field(init=False)

    def __post_init__(self):
        sizes = np.diff(np.append(self.begins, self.kinds))
        often = [int(sizes[self.count == r].sum()) for r in range(MOST_DISCOUNTED + 2)]
        self.d = discounts(often)
        taken = sum(often[r] * r * (1 - self.d[r]) for r in range(1, MOST_DISCOUNTED + 1))
        self.below = float(self.total) if taken > 0 else self.total + 1.0
        self.rest = (taken or 1.0) / self.below

    def counts(self, number: np.ndarray) -> np.ndarray:
        if not len(self.begins):
            return np.zeros(len(number), np.int64)
        return np.where(number < self.kinds, self.count[np.maximum(np.searchsorted(self.begins, number, "right") - 1, 0)], 0)

    def probability(self, number: np.ndarray) -> np.ndarray:
        return np.where(number < self.kinds, discounted(self.counts(number), self.d) / self.below, self.rest)

    def base(self, number: np.ndarray) -> np.ndarray:
        """log10 of the add-one estimate."""
        return np.log10((self.counts(number) + 1) / (self.total + self.kinds + 1))

    def split(self, limit: float) -> int:
        """Numbers below this have more than ``limit`` tokens."""
        return int(np.append(self.begins, self.kinds)[np.searchsorted(-self.count, -limit, "left")])


def numbered_words(blocks: DataFrame) -> tuple[DataFrame, Singles]:
    """(word, number) of all words with a training count, by descending count, and their model."""
    each = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).where("w.counts > 0")
    counts = written(each.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n")), "words")
    parts = counts.count() // NUMBERED + 1
    part = F.when(F.col("n") <= FEW, F.pmod(F.xxhash64("word"), F.lit(parts))).otherwise(0).alias("part")
    parted = counts.select("word", "n", part)
    steps = sorted(((-r.n, r.part, r.size) for r in parted.groupBy("n", "part").agg(F.count("*").alias("size")).collect()))
    sizes = np.array([s for _, _, s in steps], np.int64)
    before = np.cumsum(sizes) - sizes
    shifts = counts.sparkSession.createDataFrame([(-n, p, int(b)) for (n, p, _), b in zip(steps, before, strict=True)], "n bigint, part bigint, before bigint")
    place = F.row_number().over(Window.partitionBy("n", "part").orderBy("word"))
    numbers = parted.withColumn("place", place).join(shifts, ["n", "part"]).select("word", (F.col("before") + F.col("place") - 1).alias("number"))
    n = np.array([-s[0] for s in steps], np.int64)
    heads = np.flatnonzero(np.diff(n, prepend=-1))
    return numbers, Singles(before[heads], n[heads], int(sizes.sum()), int((n * sizes).sum()))


# ------------------------------------------------------------------------------------------------ pairs by bucket


@dataclass
class Buckets:
    """Where pairs go: contexts below ``split`` by the second token too, over ``ways`` of their size."""

    singles: Singles
    tokens: int  # of all texts
    number: int = field(init=False)
    split: int = field(init=False)

    def __post_init__(self):
        self.number = self.tokens // BUCKET_TOKENS + 1
        self.share = max(self.tokens, 1) / max(self.singles.total, 1)
        self.split = self.singles.split(BUCKET_TOKENS / 2 / self.share)

    def ways(self, first: np.ndarray) -> np.ndarray:
        """Over how many places a context's pairs are dealt."""
        wanted = np.ceil(self.singles.counts(first) * self.share * 4 / BUCKET_TOKENS)
        return np.clip(np.where(first == BEGIN, self.number, wanted), 1, self.number).astype(np.uint64)

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key, n = mixed(first.astype(np.uint64) + np.uint64(1)), np.uint64(self.number)
        way = mixed(second.astype(np.uint64) + np.uint64(1)) % self.ways(first)
        return (np.where(first < self.split, mixed(key + way), key) % n).astype(np.int64)

    def places(self, first: int) -> list[int]:
        """The buckets of a split context."""
        if first == BEGIN:
            return list(range(self.number))
        key = mixed(np.array([first + 1], np.uint64))
        return np.unique(mixed(key + np.arange(self.ways(np.array([first]))[0], dtype=np.uint64)) % np.uint64(self.number)).tolist()


def joined_tokens(sizes: np.ndarray, numbers: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, context) of each token of a block."""
    own = numbers[tokens]
    context = np.append(BEGIN, own[:-1])
    context[np.cumsum(sizes) - sizes] = BEGIN
    return np.repeat(np.arange(len(sizes)), sizes), context


def direct_scores(sizes: np.ndarray, numbers: np.ndarray, tokens: np.ndarray, singles: Singles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document: known tokens, base score, and the score of tokens behind an unknown one, whose weight is 1."""
    doc, context = joined_tokens(sizes, numbers, tokens)
    own = numbers[tokens]
    lone = context >= singles.kinds
    known = np.bincount(doc, own < singles.kinds, len(sizes)).astype(np.int64)
    return known, np.bincount(doc, singles.base(own), len(sizes)), np.bincount(doc[lone], np.log10(singles.probability(own[lone])), len(sizes))


def block_pairs(before: int, sizes: np.ndarray, train: np.ndarray, numbers: np.ndarray, tokens: np.ndarray, buckets: Buckets, with_docs: bool):
    """Rows (bucket, first, second, count, docs_of, doc, n) of a run of documents, packed; pairs in the order of their numbers.

    ``before``: the block's documents before the run; ``numbers``: of each of the block's words. Without documents only pairs with a training count are given, and three empty columns.
    """
    order = np.argsort(numbers, kind="stable")  # places in the order of the numbers: what is sorted by place is sorted by number
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    unknown = int(np.searchsorted(numbers[order], buckets.singles.kinds))
    place = np.minimum(place, unknown)  # unknown words are one
    doc, context = joined_tokens(sizes, numbers, tokens)
    after = np.append(-1, place[tokens[:-1]])
    after[context == BEGIN] = -1
    use = (after < unknown) & (train[doc] if not with_docs else True)
    pair = (after[use] + 1) * (len(order) + 1) + place[tokens[use]]
    if with_docs:
        in_doc, n = np.unique(pair * len(sizes) + doc[use], return_counts=True)
        pair, doc = in_doc // len(sizes), in_doc % len(sizes)
        cut = np.flatnonzero(np.diff(pair, prepend=-1))
        distinct, docs_of = pair[cut], np.diff(np.append(cut, len(pair)))
    else:
        distinct, count = np.unique(pair, return_counts=True)
    a, b = distinct // (len(order) + 1) - 1, distinct % (len(order) + 1)
    named = np.append(numbers[order], buckets.singles.kinds)
    named[unknown] = buckets.singles.kinds
    first, second = np.where(a >= 0, named[a], BEGIN), named[b]
    bucket = buckets.of(first, second)
    by = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[by], np.arange(buckets.number + 1))
    if with_docs:
        by_doc = np.argsort(np.repeat(bucket, docs_of), kind="stable")
        doc_ends = np.append(0, np.cumsum(np.bincount(bucket, docs_of, buckets.number))).astype(np.int64)
    for k in np.flatnonzero(np.diff(ends)).tolist():
        at = by[ends[k] : ends[k + 1]]
        row = [k, packed(np.diff(first[at] + 1, prepend=0)), packed(second[at])]
        if with_docs:
            docs = by_doc[doc_ends[k] : doc_ends[k + 1]]
            yield [*row, b"", packed(docs_of[at]), packed(before + doc[docs]), packed(n[docs])]
        else:
            yield [*row, packed(count[at]), b"", b"", b""]


PAIRS = "bucket int, block long, first binary, second binary, count binary, docs_of binary, doc binary, n binary"


CODED = "block bigint, ids array<{}>, train array<boolean>, sizes array<bigint>, tokens binary, numbers binary"


def coded_block(block: pa.Table, told: pa.Table, unknown: int) -> pa.Table:
    """A block with the numbers of its words instead of the words; words that were not told are unknown."""
    numbers = np.full(block["n_words"][0].as_py(), unknown, np.int64)
    numbers[told["at"].to_numpy()] = told["number"].to_numpy()
    return block.select(["block", "ids", "train", "sizes", "tokens"]).append_column("numbers", pa.array([packed(numbers)]))


def block_row(b: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, sizes, train, numbers, tokens) of a coded block."""
    r = {c: b.column(c)[i] for c in ("block", "sizes", "train", "numbers", "tokens")}
    return r["block"].as_py(), r["sizes"].values.to_numpy(), r["train"].values.to_numpy(zero_copy_only=False), unpacked(r["numbers"].as_py()), unpacked(r["tokens"].as_py()).astype(np.int32)


def document_runs(sizes: np.ndarray, most: int):
    """(first document, last + 1, first token, last + 1) of runs of whole documents of up to ``most`` tokens, or of one document."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        begin = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + most, "right")))
        yield at, to, begin, int(ends[to - 1])
        at = to


def pairs_of(coded: DataFrame, buckets: Buckets, with_docs: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                block, sizes, train, numbers, tokens = block_row(b, i)
                for one, last, begin, end in document_runs(sizes, SORTED_TOKENS):
                    rows = [(k, block, *row) for k, *row in block_pairs(one, sizes[one:last], train[one:last], numbers, tokens[begin:end], buckets, with_docs)]
                    for at in range(0, len(rows), 16):
                        yield batch(PAIRS, rows[at : at + 16])

    return coded.mapInArrow(run, PAIRS)


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    return record(schema, [list(c) for c in zip(*rows, strict=True)])


def merged(rows: list[dict], kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count) of a bucket's rows, sorted, each pair once."""
    parts = [(np.cumsum(unpacked(r["first"])) - 1, unpacked(r["second"]), unpacked(r["count"])) for r in rows]
    first, second, count = (np.concatenate(c) for c in zip(*parts, strict=True))
    contexts, place = np.unique(first, return_inverse=True)
    key = place.reshape(-1) * (kinds + 1) + second
    order = np.argsort(key)
    key = key[order]
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    return contexts[key[cut] // (kinds + 1)], key[cut] % (kinds + 1), np.add.reduceat(count[order], cut)


TABLE = "bucket int, first binary, second binary, count binary, often array<bigint>, split_first array<bigint>, split_total array<double>, split_counts array<array<double>>, split_lower array<double>"


def context_sums(first: np.ndarray, second: np.ndarray, count: np.ndarray, singles: Singles):
    """(context, tokens, pairs of count 0 to MOST_DISCOUNTED, lower-order share of the seen) of sorted pairs, and each pair's context."""
    begins = np.flatnonzero(np.diff(first, prepend=-2))
    context = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(first))))
    wide = MOST_DISCOUNTED + 1
    small = np.where(count <= MOST_DISCOUNTED, count, 0)
    by_count = np.bincount(context * wide + small, minlength=len(begins) * wide).reshape(-1, wide).astype(float)
    return first[begins], np.bincount(context, count, len(begins)), by_count, np.bincount(context, singles.probability(second), len(begins)), context


def table_row(rows: pa.Table, buckets: Buckets) -> pa.Table:
    """A bucket of the n-gram table, with counts of counts and the sums of contexts that are split."""
    first, second, count = merged(rows.select(["first", "second", "count"]).to_pylist(), buckets.singles.kinds)
    often = np.bincount(np.minimum(count, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[: MOST_DISCOUNTED + 2]
    at = first < buckets.split
    own, total, by_count, lower, _ = context_sums(first[at], second[at], count[at], buckets.singles)
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), longs, longs, doubles, pa.list_(doubles), doubles]
    values = [rows["bucket"][0].as_py(), packed(np.diff(first + 1, prepend=0)), packed(second), packed(count), often.tolist(), own.tolist(), total.tolist(), by_count.tolist(), lower.tolist()]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in TABLE.split(", ")])


# ------------------------------------------------------------------------------------------------ probabilities


def context_weights(total: np.ndarray, by_count: np.ndarray, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what counts are divided by, backoff weight) of contexts, so that their probabilities sum to 1."""
    taken = (by_count[:, 1:] * np.arange(1, MOST_DISCOUNTED + 1) * (1 - d[1:])).sum(1)
    below = np.where(taken > 0, total, total + 1.0)
    return below, np.where(taken > 0, taken, 1.0) / below / np.maximum(1 - lower, 1e-300)


def pair_logs(asked: tuple[np.ndarray, np.ndarray], model: tuple[np.ndarray, np.ndarray, np.ndarray], split: dict[int, tuple], singles: Singles, d: np.ndarray) -> np.ndarray:
    """log10 probabilities of the asked (context, token).

    ``model``: the bucket's pairs; ``split``: the sums of contexts of which other buckets have pairs too. A context that is in
    neither has no training pair, and weight 1.
    """
    own, total, by_count, lower, context = context_sums(*model, singles)
    more = np.setdiff1d(np.fromiter(split, np.int64, len(split)), own)
    own = np.concatenate((own, more, [-2]))
    total, lower = np.append(total, np.zeros(len(more) + 1)), np.append(lower, np.zeros(len(more) + 1))
    by_count = np.concatenate((by_count, np.zeros((len(more) + 1, MOST_DISCOUNTED + 1))))
    for i in np.flatnonzero(np.isin(own, np.fromiter(split, np.int64, len(split)))).tolist():
        total[i], by_count[i], lower[i] = split[int(own[i])]
    below, weight = context_weights(total, by_count, lower, d)
    weight[-1] = 1.0
    order = np.argsort(own)
    at = order[np.minimum(np.searchsorted(own[order], asked[0]), len(own) - 1)]
    at = np.where(own[at] == asked[0], at, len(own) - 1)
    keys = context * (singles.kinds + 1) + model[1]  # ascending
    wanted = at * (singles.kinds + 1) + asked[1]
    place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    found = keys[place] == wanted if len(keys) else np.zeros(len(wanted), bool)
    r = np.where(found, model[2][place] if len(keys) else 0, 0)
    return np.log10(np.where(found, discounted(r, d) / below[at], weight[at] * singles.probability(asked[1])))


PART = "block bigint, doc binary, score binary"


def bucket_scores(asked: pa.Table, model: pa.Table, singles: Singles, d: np.ndarray) -> pa.Table:
    """Partial scores of the documents of each block of a bucket's chunk."""
    out = []
    if asked.num_rows:
        known = (np.zeros(0, np.int64),) * 3
        row = model.select(["first", "second", "count", "split"]).to_pylist()[0] if model.num_rows else {"first": None, "split": None}
        if row["first"] is not None:
            known = (np.cumsum(unpacked(row["first"])) - 1, unpacked(row["second"]), unpacked(row["count"]))
        split = {s["first"]: (s["total"], s["counts"], s["lower"]) for s in row["split"] or []}
        rows = asked.select(["block", "first", "second", "docs_of", "doc", "n"]).to_pylist()
        pairs = [(np.cumsum(unpacked(r["first"])) - 1, unpacked(r["second"])) for r in rows]
        logs = pair_logs(tuple(np.concatenate(c) for c in zip(*pairs, strict=True)), known, split, singles, d)
        at = 0
        for r, (first, _) in zip(rows, pairs, strict=True):
            each = np.repeat(logs[at : at + len(first)], unpacked(r["docs_of"])) * unpacked(r["n"])
            at += len(first)
            doc = unpacked(r["doc"])
            there = np.flatnonzero(np.bincount(doc))
            out.append((r["block"], packed(np.diff(there, prepend=0)), np.bincount(doc, each)[there].tobytes()))
    blocks, docs, scores = zip(*out, strict=True) if out else ([], [], [])
    return pa.table({"block": pa.array(blocks, pa.int64()), "doc": pa.array(docs, pa.binary()), "score": pa.array(scores, pa.binary())})


SPLIT = "bucket int, first bigint, total double, counts array<double>, lower double"


def spread(sums: DataFrame, buckets: Buckets) -> DataFrame:
    """The sums of split contexts, once for each bucket that may be asked for one of their pairs."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                each = pa.array(buckets.places(r["first"]), pa.int32())
                values = [pa.array([r[c]] * len(each), k) for c, k in (("first", pa.int64()), ("total", pa.float64()), ("counts", pa.list_(pa.float64())), ("lower", pa.float64()))]
                yield pa.RecordBatch.from_arrays([each, *values], ["bucket", "first", "total", "counts", "lower"])

    return sums.mapInArrow(run, SPLIT)


SINGLE = "known array<bigint>, base array<double>, direct array<double>"


def direct_of(coded: DataFrame, singles: Singles, kind: str) -> DataFrame:
    """(block, ids, train, sizes, known, base, direct): what a block's documents have without pairs."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, sizes, _, numbers, tokens = block_row(b, i)
                one = [pa.array([x], pa.list_(k)) for x, k in zip(direct_scores(sizes, numbers, tokens, singles), (pa.int64(), pa.float64(), pa.float64()), strict=True)]
                same = b.slice(i, 1).select(["block", "ids", "train", "sizes"])
                yield pa.RecordBatch.from_arrays([*same.columns, *one], [*same.schema.names, "known", "base", "direct"])

    return coded.mapInArrow(run, f"block bigint, ids array<{kind}>, train array<boolean>, sizes array<bigint>, {SINGLE}")


def block_results(own: pa.Table, parts: pa.Table, total: int) -> pa.Table:
    out = []
    for b in own.to_batches():
        for i in range(b.num_rows):  # one row a block
            r = {c: b.column(c)[i].values for c in ("ids", "train", "sizes", "known", "base", "direct")}
            score = r["direct"].to_numpy().copy()
            for doc, s in zip(parts["doc"], parts["score"], strict=True):
                score[np.cumsum(unpacked(doc.as_py()))] += np.frombuffer(s.as_py())
            out.append(pa.table({"id": r["ids"], "train": r["train"], "n_tokens": r["sizes"], "n_known": r["known"], "train_tokens": pa.array(np.full(len(score), total)), "base_score": r["base"], "score": pa.array(score)}))
    return pa.concat_tables(out)


def score(docs: DataFrame, train: Column, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score), one row a document; it learns where ``train`` holds."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    blocks = written(encoded(own), "blocks")
    numbers, singles = numbered_words(blocks)
    told = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("at", "word")).join(numbers, "word").select("of", "at", "number")
    bare = blocks.select("block", "ids", "train", "sizes", "tokens", F.size("words").alias("n_words"))
    coded = written(bare.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(lambda b, t: coded_block(b, t, singles.kinds), CODED.format(kind)), "coded")
    discard(blocks)
    size = coded.agg(F.count("*").alias("blocks"), F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("tokens")).first()
    buckets = Buckets(singles, size.tokens or 0)

    table = written(pairs_of(coded, buckets, False).select("bucket", "first", "second", "count").groupBy("bucket").applyInArrow(lambda t: table_row(t, buckets), TABLE), "ngrams")
    often = table.select(F.posexplode("often").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
    d = discounts([{x.r: x.n for x in often}.get(r, 0) for r in range(MOST_DISCOUNTED + 2)])
    parts = table.select(F.explode(F.arrays_zip("split_first", "split_total", "split_counts", "split_lower")).alias("s")).groupBy(F.col("s.split_first").alias("first"))
    by_count = F.array(*(F.sum(F.col("s.split_counts")[r]) for r in range(MOST_DISCOUNTED + 1))).alias("counts")
    sums = parts.agg(F.sum("s.split_total").alias("total"), by_count, F.sum("s.split_lower").alias("lower"))
    wide = spread(sums, buckets).groupBy("bucket").agg(F.collect_list(F.struct("first", "total", "counts", "lower")).alias("split"))
    chunks = size.blocks // CHUNK_BLOCKS + 1
    model = table.select("bucket", "first", "second", "count").join(wide, "bucket", "full_outer").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = pairs_of(coded, buckets, True).drop("count").withColumn("chunk", F.pmod(F.hash("block"), F.lit(chunks)).cast("int"))
    partial = asked.groupBy("bucket", "chunk").cogroup(model.groupBy("bucket", "chunk")).applyInArrow(lambda a, m: bucket_scores(a, m, singles, d), PART)

    result = f"id {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    each = direct_of(coded, singles, kind).groupBy("block").cogroup(partial.groupBy("block")).applyInArrow(lambda a, m: block_results(a, m, singles.total), result)
    return each.withColumnRenamed("id", id_col)
