"""SimHash near duplicates by the generalised pigeonhole principle.

64-bit fingerprints of word 3-gram hashes are linked when they differ in few bits. The 64 bit places are grouped so that
correlated ones share a partition; a dynamic program hands each partition its own threshold (possibly none) such that
the thresholds' sum still guarantees every link, choosing the cheapest by estimated candidate counts. Each fingerprint is
filed under every partition value within its threshold, equal values meet, and all meetings are verified on the 64 bits.

Only distinct fingerprints are compared, so groups of copies cost nothing. Of the links in one bucket a spanning forest is
emitted (same components, at most one link a member), large buckets are dealt out as pairs of chunks, and components come
from repeated minima in tables, never on the driver.

Defined cases: a null or empty text and one without words has fingerprint 0 and links like any other; equal texts
share everything; null ids keep their row, and a component of only null ids has a null component_id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import bounded_batches, discard, record, slices, text_bytes, written

GROUPS, WIDTH = 4, 16
CHUNK = 2048
SMALL = 32
#: What a filed row and a verified pair cost, relative to each other.
ROW_COST, PAIR_COST = 1.0, 0.02


def shingle_hashes(text: bytes, size: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``size`` words (A-Z lower-cased, words split at ASCII white space), repeats included."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: -size])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the bits set in over half of them.

    Eight bits are counted at once in the bytes of a word, in blocks of up to 255 hashes so that no byte overflows.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begins = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
    blocks = (counts[full] + 254) // 255
    owner = np.repeat(np.arange(len(full)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    cut = begins[owner] + nth * 255
    first = np.cumsum(blocks) - blocks
    half = counts[full][:, None]
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & np.uint64(0x0101010101010101), cut)
        bits = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * bits > half).astype(np.uint64)
        for byte in range(8):
            out[full] |= over[:, byte] << np.uint64(8 * byte + j)
    return out


def fingerprints(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """``keys`` and ``fp``, the 64-bit SimHash as a signed long, one row a document."""
    bounded_batches(docs.sparkSession)
    source = docs.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join([*(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys), "fp bigint"])

    def run(batches):
        for whole in batches:
            for b in slices(whole, "_text"):
                raw, offsets = text_bytes(b.column("_text"))
                data = raw.tobytes()
                each = [shingle_hashes(data[s:e], shingle) for s, e in itertools.pairwise(offsets.tolist())]
                counts = np.array([len(x) for x in each], np.int64)
                hashes = np.fromiter(itertools.chain.from_iterable(each), np.uint64, int(counts.sum()))
                fp = majority_bits(hashes, counts).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(fp)], [*keys, "fp"])

    return source.mapInArrow(run, schema)


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Count of fingerprints and the 64 x 64 counts of bits set together, summed in Spark: always 65 rows at the driver."""

    def run(batches):
        total, both = 0, np.zeros((64, 64))
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            bits = ((fp[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            both += bits.T @ bits
            total += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(64)], pa.int32()), pa.array([[float(total)], *both.tolist()])], ["bit", "counts"])

    summed = fps.select("fp").mapInArrow(run, "bit int, counts array<double>").select("bit", F.posexplode("counts").alias("other", "n")).groupBy("bit", "other").agg(F.sum("n").alias("n")).collect()
    both, total = np.zeros((64, 64)), 0
    for r in summed:
        if r.bit < 0:
            total = int(r.n)
        else:
            both[r.bit, r.other] = r.n
    return total, both


def group_bits(total: int, both: np.ndarray) -> list[list[int]]:
    """Four groups of 16 bit places; each is filled greedily with the places most correlated with those it has."""
    n = max(total, 1)
    mean = both.diagonal() / n
    cov = both / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(cov.diagonal(), 1e-9))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    while left:
        rest = sorted(left)
        own = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        left.discard(own[0])
        while len(own) < WIDTH:
            best = max(sorted(left), key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            left.discard(best)
        groups.append(sorted(own))
    return groups


def distance_shares(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Share of ordered pairs at distance 0..most within a 16-bit group, by a Walsh-Hadamard self-correlation."""
    x = np.zeros(1 << WIDTH)
    x[values] = counts
    total = x.sum() or 1.0

    def transform(a):
        h = 1
        while h < len(a):
            a = a.reshape(-1, 2, h)
            a = np.concatenate((a[:, :1] + a[:, 1:], a[:, :1] - a[:, 1:]), axis=1).reshape(-1)
            h *= 2
        return a

    auto = transform(transform(x / total) ** 2) / len(x)
    weight = np.bitwise_count(np.arange(len(x), dtype=np.uint32))
    return np.array([max(auto[weight == d].sum(), 0.0) for d in range(most + 1)])


def allocate(total: int, widths: list[int], shares: list[np.ndarray], most: int) -> tuple[float, list[int]]:
    """Thresholds t (-1: partition unused) with sum(t + 1) = most + 1 of least estimated cost, by dynamic programming.

    By the pigeonhole principle two fingerprints within ``most`` bits are then within t of some partition.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, share in zip(widths, shares, strict=True):
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, most - used + 1):
                if t > width:
                    continue
                ball = sum(comb(width, d) for d in range(t + 1))
                own = 0.0 if t < 0 else ROW_COST * total * ball + PAIR_COST * float(total) ** 2 * float(share[: t + 1].sum()) * (2 if t else 0.5)
                if used + t + 1 not in after or cost + own < after[used + t + 1][0]:
                    after[used + t + 1] = (cost + own, [*chosen, t])
        best = after
    return best[most + 1]


def plan(total: int, both: np.ndarray, histograms: dict[int, tuple[np.ndarray, np.ndarray]], groups: list[list[int]], most: int) -> list[tuple[list[int], int]]:
    """(bit places, threshold) of each partition in use, over layouts of four 16-bit or two 32-bit partitions."""
    shares = [distance_shares(*histograms.get(i, (np.zeros(0, int), np.zeros(0))), most) for i in range(GROUPS)]
    layouts = [[[i] for i in range(GROUPS)], *([[a, b], [c, d]] for a, b, c, d in ((0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2)))]
    found = []
    for layout in layouts:
        joint = [np.convolve(shares[x[0]], shares[x[1]])[: most + 1] if len(x) == 2 else shares[x[0]] for x in layout]
        cost, t = allocate(total, [WIDTH * len(x) for x in layout], joint, most)
        found.append((cost, [(sorted(b for i in x for b in groups[i]), k) for x, k in zip(layout, t, strict=True) if k >= 0]))
    return min(found, key=lambda x: x[0])[1]


def gather_bits(fp: np.ndarray, places: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(places):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def ball_masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for d in range(radius + 1) for c in itertools.combinations(range(width), d)], np.uint64)


def filed(fps: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp): each fingerprint under every value it must be met at."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for i, (places, t) in enumerate(partitions):
                masks = ball_masks(len(places), t)
                own = gather_bits(fp, places)
                step = max(1, (1 << 20) // len(masks))
                for a in range(0, len(fp), step):
                    value = (own[a : a + step, None] ^ masks).reshape(-1)
                    yield record("part int, value long, fp long", [np.full(len(value), i, np.int32), value.view(np.int64), np.repeat(fp[a : a + step], len(masks)).view(np.int64)])

    return fps.select("fp").mapInArrow(run, "part int, value bigint, fp bigint")


def forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the members of one bucket that are within ``most`` bits of each other."""
    left, out = np.unique(fp), []
    queue: list[np.uint64] = []
    while len(left):
        if queue:
            x = queue.pop()
        else:
            x, left = left[0], left[1:]
        near = np.bitwise_count(left ^ x) <= most
        if near.any():
            out += [(int(x), int(y)) for y in left[near]]
            queue += list(left[near])
            left = left[~near]
    return out


def bucket_links(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted). Small runs: all verified pairs; others: a spanning forest."""
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(cut)
    of = np.repeat(sizes, sizes)
    left, right = [], []
    for d in range(1, int(min(SMALL, sizes.max(initial=1)))):
        i = np.flatnonzero((key[:-d] == key[d:]) & (of[:-d] <= SMALL))
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= most]
        left.append(fp[i])
        right.append(fp[i + d])
    for g in np.flatnonzero(sizes > SMALL):
        if pairs := forest(fp[cut[g] : cut[g + 1]], most):
            a, b = np.array(pairs, np.uint64).T
            left.append(a)
            right.append(b)
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
    a, b = np.minimum(a, b), np.maximum(a, b)
    keep = a != b
    return a[keep], b[keep]


def links(fps: DataFrame, most: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(a, b), a < b: enough verified links between distinct fingerprints to connect all that are linked.

    A bucket with more than ``chunk`` members is met in pairs of chunks, each pair a bucket of its own in some task.
    """
    total, both = bit_moments(fps)
    groups = group_bits(total, both)
    counts = filed(fps, [(g, 0) for g in groups]).groupBy("part", "value").count().toPandas()  # at most 4 x 65,536 rows
    histograms = {int(i): (x["value"].to_numpy(np.int64), x["count"].to_numpy(float)) for i, x in counts.groupby("part")}
    partitions = plan(total, both, histograms, groups, most)
    rows = filed(fps, partitions)
    sizes = rows.groupBy("part", "value").agg(F.count("*").alias("n")).where("n > 1")
    many = rows.join(sizes, ["part", "value"])
    k = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64("fp"), k).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda d: F.least(own, d) * k + F.greatest(own, d))
    key = F.xxhash64("part", "value", "pair")
    dealt = many.select("part", "value", "fp", F.explode(pairs).alias("pair")).select(key.alias("key"), "fp")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "fp")

    def run(batches):
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in itertools.chain(batches, [None]):
            if b is None:
                key, fp, end = held_key, held_fp, len(held_key)
            else:
                key = np.concatenate((held_key, b.column("key").to_numpy()))
                fp = np.concatenate((held_fp, b.column("fp").to_numpy().view(np.uint64)))
                end = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if end:
                x, y = bucket_links(key[:end], fp[:end], most)
                yield record("a long, b long", [x, y])
            held_key, held_fp = key[end:], fp[end:]

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint reachable from each end of a link.

    Minima of neighbours and then of the minima's own root, until nothing changes; each round is a written table.
    """
    sides = edges.select(F.col("a").alias("fp"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a")))
    sides = written(sides, "simhash-links")
    table = written(sides.groupBy("fp").agg(F.min("other").alias("m")).select("fp", F.least("fp", "m").alias("root")), "simhash-roots")
    roots = table
    while True:
        near = sides.join(roots.select(F.col("fp").alias("other"), "root"), "other").groupBy("fp").agg(F.min("root").alias("m"))
        step = roots.join(near, "fp").select("fp", "root", F.least("root", "m").alias("low"))
        jump = roots.select(F.col("fp").alias("low"), F.col("root").alias("far"))
        after = written(step.join(jump, "low").select("fp", F.least("low", "far").alias("root"), (F.least("low", "far") < F.col("root")).alias("moved")), "simhash-roots")
        moved = after.where("moved").limit(1).count()
        discard(table)
        table, roots = after, after.select("fp", "root")
        if not moved:
            discard(sides)
            return roots


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", most: int = 3) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the smallest id reachable over links), one row a document."""
    fps = written(fingerprints(docs, text, (id_col,)), "simhash-fps")
    groups = written(fps.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-distinct")
    roots = components(links(groups, most))
    rooted = groups.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(member, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
