"""Removal of near copies: SimHash and MinHash bands propose, the sets of 5-word shingles decide.

SimHash near-dedup as a stage of a pipeline, where a link is a Jaccard similarity of LEAST or more. Distinct shingle sets get a
64-bit fingerprint; ``simhash.links`` joins those within MOST bits by the generalised pigeonhole principle. Sets of similarity
0.8 lie 9 bits apart at the median, too far for any partition to tell them from the rest, so each set also gets BANDS keys of
ROWS minima; sets that share a key are joined through the key's smallest set. Every pair of sets in a group so proposed is then
judged on the shingles themselves: what is linked has the similarity asked for, and a pair that shares no key but a group is
found as well. A large group is dealt out as pairs of chunks. Only distinct sets are compared, so exact copies cost nothing;
components come from tables.

A pair of similarity s shares a key with probability 1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8, 0.99999 at 0.85.

Defined cases: a text of one to four words is one shingle; null and empty texts and those without words have the empty set
and form one group; words are split at ASCII white space and A-Z lower-cased; sets are told apart by a 64-bit digest.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import bounded_batches, discard, mixed, record, slices, text_bytes, written
from rallyframe.llm.simhash import components, majority_bits, shingle_hashes
from rallyframe.llm.simhash import links as close_fingerprints

SHINGLE, BANDS, ROWS = 5, 24, 6
MOST = 3
#: Similarity asked for, as a fraction of whole numbers.
LEAST = (4, 5)
CHUNK, CHUNK_BYTES = 2048, 16 << 20
SLICE = 1 << 20
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND = mixed(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys for each set, none of which may be empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.tile(_BAND, (len(sets), 1))
    for i, factor in enumerate(_FACTORS):
        out[:, i // ROWS] = mixed(out[:, i // ROWS] ^ np.minimum.reduceat(flat * factor, at))
    return out.view(np.int64)


def sketched(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep``, _row (a number of its own), _set (digest of the shingle set), _fp (its SimHash), _bytes and _bands, one row a document."""
    bounded_batches(docs.sparkSession)
    source = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for whole in batches:
            for b in slices(whole, "_text", SLICE):
                raw, offsets = text_bytes(b.column("_text"))
                data = raw.tobytes()
                sets = [shingle_set(data[s:e]) for s, e in itertools.pairwise(offsets.tolist())]
                digest = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                size = np.array([len(x) for x in sets], np.int64)
                fp = majority_bits(np.concatenate([np.zeros(0, np.uint64), *sets]), size).view(np.int64)
                full = np.flatnonzero(size).tolist()
                keys = np.zeros((len(full), BANDS), np.int64)
                if full:
                    keys = band_keys([sets[i] for i in full])
                at = np.cumsum([0, *(BANDS if len(x) else 0 for x in sets)])
                bands = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("_row"), pa.array(digest), pa.array(fp), pa.array(np.diff(offsets)), bands], [*keep, "_row", "_set", "_fp", "_bytes", "_bands"])

    return source.mapInArrow(run, f"{kinds}, _row bigint, _set bigint, _fp bigint, _bytes bigint, _bands array<bigint>")


def verified(sets: list[np.ndarray], names: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest over sets of similarity LEAST or more, all pairs considered."""
    size = np.array([len(x) for x in sets])
    if not len(sets):
        return []
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    own = np.repeat(np.arange(len(sets)), size)
    left, out, queue = np.ones(len(sets), bool), [], []
    hit = np.zeros(len(values), bool)
    rest_flat, rest_own = flat, own
    for i in range(len(sets)):
        if not left[i]:
            continue
        left[i] = False
        queue.append(i)
        while queue and left.any():
            x = queue.pop()
            ids = flat[begin[x] : begin[x] + size[x]]
            hit[ids] = True
            both = np.bincount(rest_own[hit[rest_flat]], minlength=len(sets))
            hit[ids] = False
            near = np.flatnonzero(left & (LEAST[1] * both >= LEAST[0] * (size + size[x] - both)))
            if len(near):
                out += [(int(names[x]), int(names[y])) for y in near]
                left[near] = False
                queue += near.tolist()
            keep = left[rest_own]
            if 2 * keep.sum() < len(keep):
                rest_flat, rest_own = rest_flat[keep], rest_own[keep]
        queue.clear()
    return out


def among(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose _row is among those of ``chosen``, by bitmaps of 32,768 rows each: an eighth of a byte a row is sent in place of
    the texts. Where the bitmaps are too many to broadcast, Spark joins them by their number."""
    at = F.col("_row") + 1
    bits = chosen.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).join(written(bits, "copies-bitmaps"), "_bucket")
    return held.where(F.getbit(byte.cast("long"), (place % 8).cast("int")) == 1).drop("_bucket", "_bits")


def contracted(edges: DataFrame) -> DataFrame:
    """Links (a, b), a < b, with the components of ``edges``, mostly far fewer: each b keeps its smallest a, which its other a join."""
    low = edges.groupBy("b").agg(F.min("a").alias("low"))
    met = edges.join(low, "b")
    return met.select(F.col("low").alias("a"), "b").unionByName(met.where("low < a").select(F.col("low").alias("a"), F.col("a").alias("b"))).distinct()


def links(sketches: DataFrame, distinct: DataFrame, text: str = "text", chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(a, b), a < b: verified links between sets, enough to connect all that are linked within a candidate group.

    ``distinct``: _set, _fp, _bands, _bytes and the row ``_first`` whose text stands for the set.
    """
    by_fp = written(distinct.groupBy(F.col("_fp").alias("fp")).agg(F.min("_set").alias("low")), "copies-fingerprints")
    close = close_fingerprints(by_fp.select("fp"), MOST).join(by_fp.select(F.col("fp").alias("a"), F.col("low").alias("sa")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("low").alias("sb")), "b")
    close = close.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))
    equal = distinct.join(by_fp, F.col("_fp") == F.col("fp")).where("low < _set").select(F.col("low").alias("a"), F.col("_set").alias("b"))
    keys = distinct.select("_set", F.explode("_bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("_set").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low")
    met = keys.join(shared, "key").where("low < _set").select(F.col("low").alias("a"), F.col("_set").alias("b"))
    met = written(met.unionByName(close).unionByName(equal).distinct(), "copies-met")
    few = written(contracted(met), "copies-few")
    groups = components(few).select(F.col("fp").alias("_set"), "root")
    members = written(groups.join(distinct.select("_set", "_first", "_bytes"), "_set"), "copies-members")
    discard(met, few, by_fp)
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(chunk)), F.ceil(F.sum("_bytes") / F.lit(chunk_bytes)), F.lit(1)).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("_set"), F.col("k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda d: F.least(own, d) * F.col("k") + F.greatest(own, d))
    texts = among(sketches.select("_row", F.col(text).alias("_text")), members.select(F.col("_first").alias("_row")))
    dealt = members.join(sizes, "root").join(texts.withColumnRenamed("_row", "_first"), "_first")
    dealt = dealt.select("root", "_set", "_text", F.explode(pairs).alias("pair")).select(F.xxhash64("root", "pair").alias("key"), "_set", "_text")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "_set")

    def run(batches):
        key, sets, names = None, [], []
        for b in batches:
            raw, offsets = text_bytes(b.column("_text"))
            for k, name, s, e in zip(b.column("key").to_pylist(), b.column("_set").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                if k != key:
                    if len(sets) > 1 and (found := verified(sets, np.array(names))):
                        yield record("a long, b long", list(np.sort(np.array(found, np.int64), axis=1).T))
                    key, sets, names = k, [], []
                sets.append(shingle_set(raw[s:e].tobytes()))
                names.append(name)
        if len(sets) > 1 and (found := verified(sets, np.array(names))):
            yield record("a long, b long", list(np.sort(np.array(found, np.int64), axis=1).T))

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def one_of_each(docs: DataFrame, columns: tuple[str, ...], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``columns`` of one row a component of near copies: that of smallest id (null ids last), of equal ids any one by a hash of the row."""
    sketches = written(sketched(docs, columns, text), "copies-sketches")
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(*columns).alias("hash"), F.col("_row").alias("row"))
    best = sketches.groupBy("_set").agg(F.min(rank).alias("best"), F.max("_bytes").alias("_bytes"), F.first("_fp").alias("_fp"), F.first("_bands").alias("_bands"))
    distinct = written(best.withColumn("_first", F.col("best.row")), "copies-distinct")
    roots = components(written(links(sketches, distinct, text), "copies-links")).select(F.col("fp").alias("_set"), "root")
    kept = distinct.select("_set", "best").join(roots, "_set", "left").groupBy(F.coalesce("root", "_set").alias("root")).agg(F.min("best").alias("best"))
    return among(sketches.select("_row", *columns), kept.select(F.col("best.row").alias("_row"))).select(*columns)
