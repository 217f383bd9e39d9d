"""How the sources of a language differ in their words: divergences of smoothed term shares, in exact integers.

Texts become slices of one UTF-8 buffer; a byte table finds the terms' boundaries, XXH64 of the slices groups them, and every
slice is compared byte by byte with its group's first. Counts by language, source and term are combined in each task before
they are shuffled by language and term. A language keeps the terms of at least ``LEAST_DOCS`` documents. Blocks of kept terms
are CSR matrices (a row a source); divergences of all pairs of sources are summed by ``reduceat`` over the rows, where terms
that a source lacks enter by their number, not one by one. Nothing is broadcast: each block meets its language's totals in
a cogroup.

Defined cases: null text, language and source are empty strings; a group without terms, or of a language that keeps none,
has every pair at 0; repeated rows are documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.llm.common import LOWER, bounded_batches, byte_table, same_words, slices, text_bytes, word_spans, written

#: [^\x00-\x40\x5B-\x60\x7B-\x7F], as bytes of UTF-8.
LETTERS = byte_table([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
LEAST_DOCS, SCALE, RANKS = 3, 1_000_000_000, 200
#: Bytes of text whose counts are combined before they leave a task, and least and most entries of a block of terms.
COMBINED_BYTES = 32 << 20
BLOCK, MOST_BLOCK = 1 << 15, 1 << 20

# The five constants of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each slice: slices under 32 bytes in numpy, those of one length together; longer ones by the library."""
    out, size = np.zeros(len(starts), np.uint64), ends - starts
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(raw) + 1, "<u4", padded, strides=(1,))
    order = np.argsort(np.minimum(size, 32).astype(np.uint8), kind="stable")
    cuts = np.searchsorted(np.minimum(size, 32)[order], np.arange(34))
    for n in range(32):
        at = order[cuts[n] : cuts[n + 1]]
        if not len(at):
            continue
        s, x, k = starts[at], np.full(len(at), P5 + np.uint64(n)), 0
        while k + 8 <= n:
            x = _rotated(x ^ _rotated(eight[s + k] * P2, 31) * P1, 27) * P1 + P4
            k += 8
        if k + 4 <= n:
            x = _rotated(x ^ four[s + k].astype(np.uint64) * P1, 23) * P2 + P3
            k += 4
        while k < n:
            x = _rotated(x ^ raw[s + k].astype(np.uint64) * P5, 11) * P1
            k += 1
        x = (x ^ (x >> np.uint64(33))) * P2
        x = (x ^ (x >> np.uint64(29))) * P3
        out[at] = x ^ (x >> np.uint64(32))
    long = order[cuts[32] :]
    data = raw.tobytes() if len(long) else b""
    out[long] = [xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def numbered_slices(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number): distinct slices by the index of a first one, and each slice's place among them, verified byte by byte."""
    _, first, number = np.unique(xxh64(raw, starts, ends), return_index=True, return_inverse=True)
    number = number.reshape(-1)
    like = first[number]
    if not same_words(raw, starts, ends, raw, starts[like], ends[like]).all():  # two slices of one hash: by the bytes alone
        data, seen = raw.tobytes(), {}
        number = np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.unique(number, return_index=True)[1]
    return first, number


def gathered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices as a string array."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[at].tobytes())).cast(pa.string())


COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def _combined(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(pieces).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return whole.rename_columns(["lang", "source", "term", "n", "docs"]).combine_chunks().to_batches()[0]


def count_slice(b: pa.RecordBatch) -> pa.RecordBatch | None:
    """(lang, source, term, n, docs) of a batch of documents."""
    raw, offsets = text_bytes(b.column("text"))
    raw = LOWER[raw]
    starts, ends, edges = word_spans(raw, offsets, LETTERS)
    if not len(starts):
        return None
    first, number = numbered_slices(raw, starts, ends)
    pairs = pa.Table.from_batches([b.select(["lang", "source"])])
    names = pairs.group_by(["lang", "source"]).aggregate([])
    place = {k: i for i, k in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist(), strict=True))}
    group = np.array([place[k] for k in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)], np.int64)
    doc = np.repeat(np.arange(b.num_rows), np.diff(edges))
    in_doc, n = np.unique(number * b.num_rows + doc, return_counts=True)
    of, key = in_doc % b.num_rows, in_doc // b.num_rows
    key = key * len(place) + group[of]
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    of, term = key[cut] % len(place), key[cut] // len(place)
    words = gathered(raw, starts[first], ends[first])
    return pa.RecordBatch.from_arrays([names["lang"].combine_chunks().take(pa.array(of)), names["source"].combine_chunks().take(pa.array(of)), words.take(pa.array(term)), pa.array(np.add.reduceat(n, cut)), pa.array(np.diff(np.append(cut, len(key))))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over whole texts, combined in each task but not across tasks."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        held, size = [], 0
        for whole in batches:
            for b in slices(whole, "text"):
                if (found := count_slice(b)) is not None:
                    held.append(found)
                size += int(text_bytes(b.column("text"))[1][-1])
                if size >= COMBINED_BYTES:
                    if held:
                        yield _combined(held)
                    held, size = [], 0
        if held:
            yield _combined(held)

    return docs.mapInArrow(run, COUNTED)


def share(count: np.ndarray, total, kept) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / (total + kept)), in two divisions so that nothing overflows below 2.9e14."""
    below = total + kept
    whole, rest = np.divmod((count + 1) * 31_250, below)
    return 1 + whole * 32_000 + rest * 32_000 // below


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, width: int, totals: np.ndarray, kept: int) -> np.ndarray:
    """sums[a, b]: divergence of source a from b over a block of ``width`` terms, from the entries of a CSR matrix.

    For each a: its terms' values stand in a dense row, other terms have the value of count 0. Terms that b has are its
    entries, summed by row; for those it lacks its value is one number, so they enter by a's distinct values.
    """
    size = len(totals)
    p = share(counts, totals[rows], kept)
    none = share(np.zeros(size, np.int64), totals, kept)
    begins = np.searchsorted(rows, np.arange(size + 1))
    full = np.flatnonzero(np.diff(begins))
    sums = np.zeros((size, size), np.int64)
    for a in range(size):
        own = slice(begins[a], begins[a + 1])
        dense = np.full(width, none[a])
        dense[cols[own]] = p[own]
        values, often = np.unique(p[own], return_counts=True)
        line = (divergence(values[:, None], none[None, :]) * often[:, None]).sum(0) + (width - int(often.sum())) * divergence(none[a], none)
        if len(full):
            there = dense[cols]
            line[full] += np.add.reduceat(divergence(there, p) - divergence(there, none[rows]), begins[full])
        sums[a] = line
    return sums


PARTIAL = "lang string, source string, part string, item string, value bigint"


def block_divergences(totals: pa.Table, terms: pa.Table) -> pa.Table:
    """Partial sums of pairs and the best terms of each source, of one block of one language."""
    sources = totals["source"].to_pylist()
    place = {s: i for i, s in enumerate(sources)}
    size = len(sources)
    n = totals["n"].to_numpy()
    lang, kept, of_lang = totals["lang"][0].as_py(), totals["kept"][0].as_py(), totals["of_lang"][0].as_py()
    width = terms.num_rows
    lists = terms["by_source"].combine_chunks() if width else None
    entries = lists.flatten() if width else None
    if entries is not None and len(entries):
        cols = np.repeat(np.arange(width), np.diff(lists.offsets.to_numpy()))
        names = entries.field("source").dictionary_encode()
        rows = np.array([place[s] for s in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
        counts = entries.field("n").to_numpy()
        order = np.argsort(rows, kind="stable")
        rows, cols, counts = rows[order], cols[order], counts[order]
    else:
        rows = cols = counts = np.zeros(0, np.int64)
    sums = pair_sums(rows, cols, counts, width, n, kept) if width else np.zeros((size, size), np.int64)
    a, b = np.nonzero(~np.eye(size, dtype=bool))
    names = pa.array(sources, pa.string())
    out = [pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": names.take(pa.array(a)), "part": pa.array(["pair"] * len(a), pa.string()), "item": names.take(pa.array(b)), "value": pa.array(sums[a, b])})]
    if len(rows):
        p, q = share(counts, n[rows], kept), share(terms["total"].to_numpy()[cols], of_lang, kept)
        f = divergence(p, q)
        own = terms["term"].combine_chunks()
        begins = np.searchsorted(rows, np.arange(size + 1))
        for r in range(size):
            at = begins[r] + np.flatnonzero((p > q)[begins[r] : begins[r + 1]])
            if len(at) > RANKS:  # of the last value all are kept: the order of equal ones is told by their names
                at = at[f[at] >= np.partition(f[at], len(at) - RANKS)[len(at) - RANKS]]
            out.append(pa.table({"lang": pa.array([lang] * len(at), pa.string()), "source": pa.array([sources[r]] * len(at), pa.string()), "part": pa.array(["term"] * len(at), pa.string()), "item": own.take(pa.array(cols[at])), "value": pa.array(f[at])}))
    return pa.concat_tables(out)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its divergence from each other one (``pair``) and
    the ``RANKS`` terms it prefers most against the whole language (``term``)."""
    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    # one shuffle: both groupings below are within (lang, term)
    each = term_counts(own).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = written(terms.where(F.col("docs") >= LEAST_DOCS).drop("docs"), "terms")

    by_source = kept.select("lang", F.explode("by_source").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("of_lang"))
    groups = own.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = written(groups.na.fill(0, ["n", "kept", "of_lang"]), "groups")
    size = groups.groupBy("lang").agg(F.count("*").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0
    entries = kept.agg(F.sum(F.size("by_source"))).first()[0] or 0
    blocks = int(entries // min(max(BLOCK, size), MOST_BLOCK)) + 1

    placed = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    met = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    partial = met.groupBy("lang", "block").cogroup(placed.groupBy("lang", "block")).applyInArrow(block_divergences, PARTIAL)
    summed = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= RANKS))
