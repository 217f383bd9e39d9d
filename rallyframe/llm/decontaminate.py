"""Benchmark decontamination with suffix arrays over the training text.

Each task builds a suffix array over the words of a shard of documents, and every suffix of every test item is
binary-searched in it. Suffixes are compared word by word up to the first word that no test item has, since no test
suffix can agree any further; such a word ends a document's stretch just as the document's end does. So the array is
exact for longest matches while words foreign to the tests are not sorted at all.

The place of each test suffix in that order gives its longest verbatim match, and the windows that occur: a window's
occurrences are one stretch of the order, looked up once for all items that share it, and stretches of different windows are
disjoint. So work and memory follow the shard and the items also where words repeat without end. Words are confirmed on their
bytes before they are numbered.

Test items are a stated query set of a size that is read first: they go to the tasks in blocks of at most BLOCK_BYTES, one at
a time. One block (the usual case) needs no shuffle; more are one pass each, whose hits meet by row.

Defined cases: null and empty texts, and texts without words, have no words and no matches; repeated rows are judged
each on its own; items without words match nothing; an item of fewer words than the window is one window; null ids are
kept as they are; null item ids read as empty strings in digests; empty tables give empty results; columns other than id,
text and ``keep`` are not read, and a name in ``keep`` that is also an output is refused.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import ALNUM, LOWER, bounded_batches, refuse_clashes, same_words, slices, text_bytes, word_hashes, word_spans, written

WINDOW = 13
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
OUTPUTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_item", "longest_item_word", "longest_word")


class TestItems:
    """The words of a block of test items as numbers 1.., and where each item's words lie; 0 stands for any other word."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        raw, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        self.raw = LOWER[raw]
        starts, ends, self.first = word_spans(self.raw, offsets, ALNUM)
        for self.seed in itertools.count():  # a seed with which no two words of the items share a key
            self.vocabulary, lead, number = np.unique(word_hashes(self.raw, starts, ends, seed=self.seed), return_index=True, return_inverse=True)
            self.starts, self.ends = starts[lead], ends[lead]
            if same_words(self.raw, starts, ends, self.raw, self.starts[number], self.ends[number]).all():
                break
        self.words = number.astype(np.int64) + 1
        self.ids = [i for i, _ in items]
        self.bits, self.depth = packing(len(self.vocabulary))
        # every suffix, and the suffixes in their order
        self.start = np.arange(len(self.words))
        self.item = np.searchsorted(self.first, self.start, "right") - 1
        self.length = self.first[self.item + 1] - self.start
        apart = np.zeros(len(self.words) + len(items), np.int64)
        apart[self.start + self.item] = self.words
        own = SuffixArray(apart, self.bits, self.depth)
        self.packed = own.packed[self.start + self.item]
        self.order = own.order - (np.searchsorted(self.first[:-1] + np.arange(len(items)), own.order, "right") - 1)
        self._windows(window)

    def _windows(self, size: int) -> None:
        """Distinct windows: a place of each, its length, and the items that hold it (``holds``, cut at ``held``), with equal sets of
        items numbered alike (``team``)."""
        width = np.minimum(np.diff(self.first), size)[self.item]
        at = np.flatnonzero(self.length >= width)
        rows = np.zeros((len(at), size + 1), np.int64)
        rows[:, size] = width[at]
        for k in range(size):
            inside = width[at] > k
            rows[inside, k] = self.words[at[inside] + k]
        _, lead, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        self.window, self.width = at[lead], width[at[lead]]
        pairs = np.unique(which.reshape(-1) * (len(self.ids) + 1) + self.item[at])
        which, item = pairs // (len(self.ids) + 1), pairs % (len(self.ids) + 1)
        cut = np.searchsorted(which, np.arange(len(lead) + 1))
        teams: dict[bytes, int] = {}
        self.team = np.array([teams.setdefault(item[a:b].tobytes(), len(teams)) for a, b in itertools.pairwise(cut.tolist())], np.int64)
        self.teams = [np.frombuffer(t, item.dtype) for t in teams]


def packing(words: int) -> tuple[int, int]:
    """Bits of a word number and how many of them fit into 62."""
    bits = max(1, int(words).bit_length())
    return bits, 62 // bits


class SuffixArray:
    """Positions of a shard's words in the order of the suffixes that begin there, read up to the next 0."""

    def __init__(self, words: np.ndarray, bits: int, depth: int):
        """The first sort reads ``depth`` words of ``bits`` bits each, later ones double the depth and touch only suffixes that
        still tie with another."""
        self.words, self.bits, self.depth = np.concatenate((words, [0])), bits, depth
        size = len(self.words)
        at = np.flatnonzero(words)
        where = np.where(self.words == 0, np.arange(size, dtype=np.int64), size)
        stop = np.minimum.accumulate(where[::-1])[::-1]
        h = depth
        key, alive = words[at].copy(), np.ones(len(at), bool)
        for k in range(1, h):
            alive &= at + k < stop[at]
            key = (key << bits) | np.where(alive, self.words[np.minimum(at + k, size - 1)], 0)
        self.packed = np.zeros(size, np.int64)
        self.packed[at] = key
        sort = np.argsort(key)
        self.order = at[sort]
        rank = np.zeros(size, np.int64)
        begin = self._begins(key[sort])
        rank[self.order] = begin + 1
        slots = self._tied(begin)
        while len(slots):
            todo = self.order[slots]
            ahead = np.where(todo + h < stop[todo], rank[np.minimum(todo + h, size - 1)], 0)
            begin = rank[todo]
            sort = np.lexsort((ahead, begin))
            self.order[slots] = todo = todo[sort]
            ahead, begin = ahead[sort], begin[sort]
            new = np.concatenate(([True], (np.diff(begin) != 0) | (np.diff(ahead) != 0)))
            first = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            # texts that tie to their very end (ahead 0) are equal: no further round tells them apart
            open_ = ahead > 0
            rank[todo] = first + 1
            keep = self._tied(first) if len(first) else first
            keep = keep[open_[keep]]
            slots = slots[keep]
            h *= 2

    @staticmethod
    def _begins(key: np.ndarray) -> np.ndarray:
        """For sorted keys the place at which each run of equal ones begins."""
        if not len(key):
            return np.zeros(0, np.int64)
        return np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(key)), 0))

    @staticmethod
    def _tied(begin: np.ndarray) -> np.ndarray:
        """Places whose run has more than one member."""
        if not len(begin):
            return np.zeros(0, np.int64)
        same = begin[1:] == begin[:-1]
        return np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))

    def compare(self, at: np.ndarray, test: TestItems, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common words of suffixes ``at`` with test stretches, and whether the suffix sorts before (stretch not exhausted)."""
        same, before = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        live, k = np.flatnonzero(length > 0), 0
        while len(live):
            left = np.minimum(length[live] - k, self.depth)
            a = self.packed[np.minimum(at[live] + k, len(self.words) - 1)]
            b = test.packed[start[live] + k]
            over = (self.depth - left) * self.bits  # words behind the stretch do not count
            a, b = a >> over, b >> over
            equal = a == b
            same[live[equal]] += left[equal]
            apart = np.flatnonzero(~equal)
            before[live[apart]] = a[apart] < b[apart]
            differ, least = a[apart] ^ b[apart], left[apart]
            for j in range(1, self.depth):  # words before the first that differs
                same[live[apart]] += (j < least) & (differ >> np.maximum((least - j) * self.bits, 0) == 0)
            k += self.depth
            live = live[equal]
            live = live[length[live] > k]
        return same, before

    def search(self, test: TestItems, start: np.ndarray, length: np.ndarray, upper: bool = False) -> np.ndarray:
        """For each test stretch the first place in ``order`` not before it (``upper``: the first after all that begin with it)."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.order), np.int64)
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live]) // 2
            same, before = self.compare(self.order[mid], test, start[live], length[live])
            go = before | (upper & (same == length[live]))
            low[live[go]] = mid[go] + 1
            high[live[~go]] = mid[~go]
        return low


class Shard:
    """A shard's words as the items' numbers with a 0 after each document, its suffix array, and where the test suffixes lie in it.

    ``n``: words of each document; ``base``: place of its first; ``low``: place of each test suffix in the array, and ``longest``
    and ``where`` its longest match.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, items: TestItems):
        self.items = items
        starts, ends, first = word_spans(raw, offsets, ALNUM)
        self.n = np.diff(first)
        self.base = first[:-1] + np.arange(len(self.n))
        words = np.zeros(len(starts) + len(self.n), np.int64)
        if len(items.vocabulary):
            keys = word_hashes(raw, starts, ends, seed=items.seed)
            found = np.searchsorted(items.vocabulary, keys)
            found[found == len(items.vocabulary)] = 0
            known = np.flatnonzero(items.vocabulary[found] == keys)
            found = found[known]
            sure = same_words(raw, starts[known], ends[known], items.raw, items.starts[found], items.ends[found])
            doc = np.repeat(np.arange(len(self.n)), self.n)
            words[known[sure] + doc[known[sure]]] = found[sure] + 1
        self.some = bool(words.any())
        if not self.some:
            return
        self.array = SuffixArray(words, items.bits, items.depth)
        # suffixes in their order: neighbouring searches read neighbouring places
        self.low = np.zeros(len(items.words), np.int64)
        self.low[items.order] = self.array.search(items, items.order, items.length[items.order])
        self.longest, self.where = np.zeros(len(self.low), np.int64), np.zeros(len(self.low), np.int64)
        for side in (self.low - 1, self.low):
            ok = np.flatnonzero((side >= 0) & (side < len(self.array.order)))
            same, _ = self.array.compare(self.array.order[side[ok]], items, items.start[ok], items.length[ok])
            better = same > self.longest[ok]
            self.longest[ok[better]], self.where[ok[better]] = same[better], self.array.order[side[ok[better]]]

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, place, "right") - 1

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Window and place of every occurrence of a window whose suffix has a match that long."""
        items = self.items
        which = np.flatnonzero(self.longest[items.window] >= items.width) if self.some else np.zeros(0, np.int64)
        start, width = items.window[which], items.width[which]
        low, high = (self.array.search(items, start, width, upper) for upper in (False, True)) if len(which) else (which, which)
        count = high - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.repeat(which, count), self.array.order[at] if len(which) else at

    def longest_at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the longest match of the suffixes at some places with any test suffix, and that suffix.

        In the common order of all suffixes it is one of the two test suffixes next to the place.
        """
        items = self.items
        rank = np.zeros(len(self.array.words), np.int64)
        rank[self.array.order] = np.arange(len(self.array.order))
        after = np.searchsorted(self.low[items.order], rank[place], "right")
        best, which = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for side in (after - 1, after):
            ok = np.flatnonzero((side >= 0) & (side < len(items.order)))
            test = items.order[side[ok]]
            same, _ = self.array.compare(place[ok], items, test, items.length[test])
            better = same > best[ok]
            best[ok[better]], which[ok[better]] = same[better], test[better]
        return best, which

    def hits(self) -> dict[int, tuple[np.ndarray, list[str], tuple[int, str, int, int]]]:
        """Of each document with an occurring window: runs of hit words (begin, end, begin, ...), ids of the items, longest match."""
        which, place = self.windows()
        if not len(place):
            return {}
        items, doc = self.items, self.document(place)
        edge = np.zeros(len(self.array.words) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + items.width[which], -1)
        inside = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
        flips = np.flatnonzero(inside[1:] != inside[:-1])
        owner = self.document(flips[::2])
        runs = (flips.reshape(-1, 2) - self.base[owner][:, None]).reshape(-1)
        team = np.unique(np.stack((doc, items.team[which])), axis=1)
        first = np.unique(place)
        best, test = self.longest_at(first)
        of = self.document(first)
        order = np.lexsort((first, -best, of))
        lead = order[np.concatenate(([True], of[order][1:] != of[order][:-1]))]
        found = {}
        cut, at = np.searchsorted(owner, of[lead]), np.searchsorted(owner, of[lead], "right")
        begin, end = np.searchsorted(team[0], of[lead]), np.searchsorted(team[0], of[lead], "right")
        for i, j in enumerate(lead.tolist()):
            t = int(test[j])
            ids = {items.ids[x] for k in team[1, begin[i] : end[i]] for x in items.teams[k]}
            found[int(of[j])] = runs[2 * cut[i] : 2 * at[i]], sorted(ids), (int(best[j]), items.ids[items.item[t]], t - int(items.first[items.item[t]]), int(first[j] - self.base[of[j]]))
        return found


def item_blocks(benchmark: DataFrame, text: str, id_col: str, most: int = BLOCK_BYTES) -> list[DataFrame]:
    """The test set (i, t) in blocks of about ``most`` bytes; its size is read before any of it is fetched."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    k = size // most + 1
    return [rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(k)) == j) for j in range(k)] if k > 1 else [rows]


def fetched(block: DataFrame, window: int) -> TestItems:
    return TestItems(sorted((r.i, r.t) for r in block.collect()), window)


def verdict(n: int, found: list[tuple]) -> tuple:
    """The computed columns of a document of n words from its hits in each block of items."""
    if not found:
        return n, 0, 0, hashlib.sha256(b"").hexdigest(), False, 0, None, None, None
    n_hit, upto = 0, 0
    for a, b in sorted((int(r[i]), int(r[i + 1])) for r, *_ in found for i in range(0, len(r), 2)):
        n_hit += max(0, b - max(a, upto))
        upto = max(upto, b)
    ids = sorted({i for _, x, _ in found for i in x})
    best = min((x for *_, x in found), key=lambda x: (-x[0], x[3], x[1], x[2]))
    return n, n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), 20 * n_hit >= n, *best


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = (), item_text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row a document: id, ``keep``, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_item, longest_item_word, longest_word.

    Hit is every word inside an occurrence of a window (``window`` consecutive words of an item, or a whole shorter item);
    contaminated means at least one hit and hits making up a twentieth of the words or more. ``longest``: words of the longest
    verbatim match with one item that begins where a window occurs (0: no window), the item, its word and the document's word there.
    """
    names = list(dict.fromkeys([id_col, *keep]))
    refuse_clashes((id_col, *keep), OUTPUTS)
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = item_blocks(benchmark, item_text, item_id)
    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)])
    computed = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest bigint, longest_item string, longest_item_word bigint, longest_word bigint"
    held = [f"_held_{i}" for i in range(len(names))]
    rows = docs.select(*(F.col(c).alias(h) for c, h in zip(names, held, strict=True)), F.col(text).alias("_text"))
    if len(blocks) == 1:
        send = spark.sparkContext.broadcast(fetched(blocks[0], window))

        def run(batches):
            for whole in batches:
                for b in slices(whole, "_text", SHARD_BYTES):
                    raw, offsets = text_bytes(b.column("_text"))
                    shard = Shard(LOWER[raw], offsets, send.value)
                    hits = shard.hits()
                    out = [verdict(int(n), [hits[d]] if d in hits else []) for d, n in enumerate(shard.n)]
                    yield pa.RecordBatch.from_arrays([*(b.column(h) for h in held), *_columns(out)], [*names, *OUTPUTS])

        return rows.mapInArrow(run, f"{kinds}, {computed}")

    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "contamination-rows")
    parts = []
    for block in blocks:
        send = spark.sparkContext.broadcast(fetched(block, window))

        def found(batches, send=send):
            for whole in batches:
                for b in slices(whole, "_text", SHARD_BYTES):
                    raw, offsets = text_bytes(b.column("_text"))
                    hits = Shard(LOWER[raw], offsets, send.value).hits()
                    row = b.column("_row").to_numpy()
                    yield pa.RecordBatch.from_pylist([{"_row": int(row[d]), "runs": r.tolist(), "ids": ids, "best": dict(zip("nipw", best, strict=True))} for d, (r, ids, best) in hits.items()], FOUND)

        parts.append(written(rows.select("_row", "_text").mapInArrow(found, "_row bigint, runs array<bigint>, ids array<string>, best struct<n:bigint,i:string,p:bigint,w:bigint>"), "contamination-hits"))
        send.unpersist()
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    gathered = hits.groupBy("_row").agg(F.collect_list(F.struct("runs", "ids", "best")).alias("_hits"))  # one entry a block at most

    def judged(batches):
        for whole in batches:
            for b in slices(whole, "_text", SHARD_BYTES):
                n = np.diff(word_spans(*text_bytes(b.column("_text")), ALNUM)[2])
                out = [verdict(int(k), [(x["runs"], x["ids"], tuple(x["best"].values())) for x in found or []]) for k, found in zip(n, b.column("_hits").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(h) for h in held), *_columns(out)], [*names, *OUTPUTS])

    return rows.join(gathered, "_row", "left").select(*held, "_text", "_hits").mapInArrow(judged, f"{kinds}, {computed}")


FOUND = pa.schema([("_row", pa.int64()), ("runs", pa.list_(pa.int64())), ("ids", pa.list_(pa.string())), ("best", pa.struct([("n", pa.int64()), ("i", pa.string()), ("p", pa.int64()), ("w", pa.int64())]))])


def match_locations(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", least: int = WINDOW) -> DataFrame:
    """(item_id, item_word, n_words, id, word): longest verbatim match of each test suffix over all shards, from ``least`` words on."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    parts = []
    for block in item_blocks(benchmark, item_text, item_id):
        send = spark.sparkContext.broadcast(fetched(block, WINDOW))

        def run(batches, send=send):
            items = send.value
            for whole in batches:
                for b in slices(whole, "_text", SHARD_BYTES):
                    raw, offsets = text_bytes(b.column("_text"))
                    shard = Shard(LOWER[raw], offsets, items)
                    if not shard.some:
                        continue
                    s = np.flatnonzero(shard.longest >= max(least, 1))
                    doc = shard.document(shard.where[s])
                    yield pa.RecordBatch.from_arrays([pa.array([items.ids[i] for i in items.item[s]], pa.string()), pa.array(s - items.first[items.item[s]]), pa.array(shard.longest[s]), b.column("_id").take(pa.array(doc)), pa.array(shard.where[s] - shard.base[doc])], ["item_id", "item_word", "n_words", id_col, "word"])

        found = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"item_id string, item_word bigint, n_words bigint, `{id_col}` {kind}, word bigint")
        parts.append(found.groupBy("item_id", "item_word").agg(F.max(F.struct("n_words", (-F.col("word")).alias("back"), id_col)).alias("best")))
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    best = best.groupBy("item_id", "item_word").agg(F.max("best").alias("best"))
    return best.select("item_id", "item_word", "best.n_words", f"best.{id_col}", (-F.col("best.back")).alias("word"))
