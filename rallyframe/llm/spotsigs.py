"""SpotSigs document fingerprints: chains of content words that follow common-word anchors.

A signature is an anchor and the next two content words. Anchors are common words of four languages; content words are all
others. A document's fingerprint is its set of 32-bit signature hashes, sorted. In a document without a chain (other
languages, tables) every word is an anchor; one with words but without a chain even so has one signature, of its whole word
sequence. Likeness is the Jaccard coefficient; two empty fingerprints are alike (1.0).

Comparison: ``jaccard`` counts common members of many pairs of sets at once and skips pairs whose set lengths alone rule
the threshold out. ``near_pairs`` joins a whole table: sets are filed by length partition and by the signatures in their
prefix, so only sets of lengths that can reach the threshold and that share a prefix signature are compared.

Defined cases: null reads as empty; equal texts have equal fingerprints; ids are whole numbers (others are refused); repeated
and null ids are kept, each row its own document, rows of null id after all others and ties in the order of their texts'
hashes; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.columns import up_to
from rallyframe.llm.common import ALNUM, LOWER, SLICE_BYTES, bounded_batches, mixed, text_bytes, word_hashes, word_spans, written

# Common words of English, French, German and Spanish.
COMMON = {
    "en": "a an and are as at be by for from has have he in is it its not of on or that the they this to was were which will with you".split(),
    "fr": "au aux avec ce dans de des du elle en est et il la le les mais ne nous on ou par pas pour que qui se sur un une vous".split(),
    "de": "als an auf aus bei das dem den der des die ein eine er es für im in ist mit nicht sich sie sind und von war wie zu zum".split(),
    "es": "a al como con de del el en es esta ha la las lo los más no o para pero por que se ser su sus un una y".split(),
}
CHAIN = 2
#: Of a range of ids, and of what a task reads of them.
BUCKET_BYTES, TASK_BYTES, MOST_BUCKETS = 2 << 20, 64 << 20, 100_000


def _hashes_of(words: list[str]) -> np.ndarray:
    raw, offsets = text_bytes(pa.array(words))
    return np.unique(word_hashes(raw, *word_spans(raw, offsets, ALNUM)[:2]))


_COMMON = _hashes_of(sorted({w for words in COMMON.values() for w in words}))


def signature_keys(texts: pa.Array) -> np.ndarray:
    """Sorted distinct ``row << 32 | signature`` over a batch of texts."""
    raw, offsets = text_bytes(texts)
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, offsets, ALNUM)
    h = word_hashes(raw, starts, ends)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    if not len(h):
        return np.zeros(0, np.uint64)
    at = np.searchsorted(_COMMON, h)
    at[at == len(_COMMON)] = 0
    common = _COMMON[at] == h
    content, behind = np.flatnonzero(~common), np.cumsum(~common)

    def chains(anchor):
        follow = behind[anchor]  # place in ``content`` of the first content word after the anchor
        whole = follow + CHAIN - 1 < len(content)
        anchor, follow = anchor[whole], follow[whole]
        whole = content[follow + CHAIN - 1] < first[1:][row[anchor]]
        anchor, follow = anchor[whole], follow[whole]
        sig = h[anchor]
        for k in range(CHAIN):
            sig = mixed(sig ^ h[content[follow + k]])
        return sig, row[anchor]

    sig, rows = chains(np.flatnonzero(common))
    without = n > 0
    without[rows] = False
    more, more_rows = chains(np.flatnonzero(without[row]))
    sig, rows = np.concatenate((sig, more)), np.concatenate((rows, more_rows))
    without[more_rows] = False
    bare = np.flatnonzero(without)
    if len(bare):
        order = mixed(np.arange(len(h), dtype=np.uint64) - first[:-1][row].astype(np.uint64) ^ h)
        total = np.add.reduceat(order, first[:-1][n > 0])
        place = np.searchsorted(np.flatnonzero(n), bare)
        sig, rows = np.concatenate((sig, mixed(total[place]))), np.concatenate((rows, bare))
    keys = np.sort((rows.astype(np.uint64) << np.uint64(32)) | (sig >> np.uint64(32)))
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))]


def jaccard(a: np.ndarray, b: np.ndarray, n: int, least: float = 0.0) -> np.ndarray:
    """Jaccard coefficients of n pairs of sets, given as sorted keys; pairs that cannot reach ``least`` are skipped and read 0."""
    size_a, size_b = (np.bincount((x >> np.uint64(32)).astype(np.int64), minlength=n)[:n] for x in (a, b))
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    fits = low >= least * high
    if not fits.all():
        a, b = (x[fits[(x >> np.uint64(32)).astype(np.int64)]] for x in (a, b))
    common = np.bincount((np.intersect1d(a, b, assume_unique=True) >> np.uint64(32)).astype(np.int64), minlength=n)[:n]
    union = size_a + size_b - common
    return np.where(fits, np.where(union == 0, 1.0, common / np.maximum(union, 1)), 0.0)


def fingerprint_strings(keys: np.ndarray, n: int) -> list[str]:
    """The signatures of each row, 8 hex digits each, in rising order."""
    cut = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32)).tolist()
    data = (keys & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
    return [data[8 * a : 8 * b] for a, b in zip(cut, cut[1:], strict=False)]


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _longs(values: list[int]) -> Column:
    """A constant array; read from one text, since thousands of single constants make a slow plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _ranges(rows: DataFrame, bucket_bytes: int, most_buckets: int) -> tuple[DataFrame, int]:
    """Rows with _bucket, which rises with the order of rows, and the table's bytes.

    Ids are cut at approximate quantiles. An id that fills ranges of its own, and null ids, are cut by the hash of their texts.
    """
    size = rows.agg(F.sum(F.octet_length("_text")).alias("all"), F.sum(F.when(F.col("_id").isNull(), F.octet_length("_text"))).alias("none")).first()
    total = size["all"] or 0
    k = int(min(most_buckets, total // bucket_bytes + 1))
    cuts = rows.agg(F.percentile_approx("_id", [(i + 1) / k for i in range(k - 1)], max(10_000, 4 * k)).alias("c")).first().c if k > 1 else None
    distinct, times = np.unique(np.array(cuts or [0], np.int64), return_counts=True)
    share = F.shiftright("_h", 32)  # 31 bits
    for_none = F.shiftright(share * F.lit(int(min(most_buckets, (size["none"] or 0) // bucket_bytes + 1))), 31)
    at = up_to(_longs(distinct.tolist()), F.col("_id"))
    hot = F.get(_longs(distinct.tolist()), at - 1) == F.col("_id")
    inside = F.when(hot, 1 + F.shiftright(share * F.get(_longs(times.tolist()), at - 1), 31)).otherwise(0)
    step = 2 * most_buckets
    bucket = F.when(F.col("_id").isNull(), (len(distinct) + 1) * step + for_none).otherwise((len(distinct) - at) * step + inside)
    return rows.withColumn("_bucket", bucket.cast("long")), total


def fingerprint_with_next(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, and the likeness to the next document.

    The next document is the next smaller id (after the last: the first). Ids are cut into ranges of similar size; each
    range also receives the one document that follows it, so a range is read in order by one task and every document
    crosses the network once.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} is not a whole number")
    bounded_batches(spark)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), whole.alias("_text"), F.shiftrightunsigned(F.xxhash64(whole), 1).alias("_h"))
    rows, total = _ranges(rows, bucket_bytes, most_buckets)
    # the first document of each range follows the last of the range before; only the ranges' numbers reach the driver
    order = F.struct(F.col("_id").isNull().alias("none"), F.bitwise_not(F.coalesce("_id", F.lit(0))).alias("down"), F.col("_h").alias("h"), F.col("_text").alias("text"))
    heads = written(rows.groupBy("_bucket").agg(F.min(order).alias("o")), "spotsigs-heads")
    numbers = sorted(r._bucket for r in heads.select("_bucket").collect())
    before = spark.createDataFrame(list(zip(numbers, [*numbers[-1:], *numbers[:-1]], strict=True)), "_bucket long, _before long")
    tails = heads.join(F.broadcast(before), "_bucket").select(F.col("_before").alias("_bucket"), F.lit(1).alias("_role"), F.when(~F.col("o.none"), F.bitwise_not("o.down")).alias("_id"), F.col("o.h").alias("_h"), F.col("o.text").alias("_text"))
    parts = rows.select("_bucket", F.lit(0).alias("_role"), "_id", "_h", "_text").unionByName(tails)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)
    parts = parts.repartition(tasks, "_bucket").sortWithinPartitions("_bucket", "_role", F.col("_id").desc_nulls_last(), "_h", "_text").drop("_h")
    names = [id_col, *COMPUTED]

    def run(batches):
        for columns in _pairs_in_order(batches):
            yield pa.RecordBatch.from_arrays(columns, names)

    return parts.mapInArrow(run, f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures bigint")


COMPUTED = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures")


def _pairs_in_order(batches):
    held = None
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            _, offsets = text_bytes(whole.column("_text"))
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            part = pa.Table.from_batches([whole.slice(at, to - at)])
            at = to
            if held is not None:
                part = pa.concat_tables([held, part]).combine_chunks()
            held = part.slice(part.num_rows - 1)
            if part.num_rows > 1:
                yield _compared(part)


def _compared(part: pa.Table) -> list[pa.Array]:
    """All rows but the last and the end marks of ranges, each compared with the row after it."""
    texts = part.column("_text").to_pylist()
    own = np.flatnonzero(part.column("_role").to_numpy()[:-1] == 0)
    n = len(texts)
    changed = [edited(texts[i], texts[i + 1]) for i in own.tolist()]
    keys = signature_keys(part.column("_text").combine_chunks())
    row = (keys >> np.uint64(32)).astype(np.int64)
    new = signature_keys(pa.array(changed, pa.large_string()))
    place = np.full(n + 1, -1)
    place[own] = np.arange(len(own))
    low = np.uint64(0xFFFFFFFF)

    def renumbered(shift: int) -> np.ndarray:
        to = place[row - shift] if shift else place[row]
        ok = (to >= 0) & (row >= shift)
        return (to[ok].astype(np.uint64) << np.uint64(32)) | (keys[ok] & low)

    mine, following = renumbered(0), renumbered(1)
    return [
        part.column("_id").combine_chunks().take(pa.array(own)),
        pa.array([len(texts[i]) for i in own.tolist()], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
        pa.array(fingerprint_strings(mine, len(own)), pa.string()),
        pa.array(fingerprint_strings(new, len(own)), pa.string()),
        pa.array(jaccard(mine, new, len(own))),
        pa.array(jaccard(mine, following, len(own))),
        pa.array(np.bincount((mine >> np.uint64(32)).astype(np.int64), minlength=len(own))[: len(own)].astype(np.int64)),
    ]


def signature_sets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, signatures array<bigint>, sorted), one row a document."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            keys = signature_keys(b.column("_text"))
            cut = np.searchsorted(keys, np.arange(b.num_rows + 1, dtype=np.uint64) << np.uint64(32))
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)))], [id_col, "signatures"])

    return docs.select(id_col, F.col(text).alias("_text")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, signatures array<bigint>")


def near_pairs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (id, class_id) and pairs (a, b, likeness) of class ids, a < b, with likeness ``least`` or more.

    Documents with equal fingerprints are one class, named by the smallest id, so copies are compared once. A set of n
    signatures is filed under the first n - ceil(least * n) + 1 of them, rarest first, within its length partition.
    """
    sets = signature_sets(docs, text, id_col)
    classes = sets.groupBy("signatures").agg(F.min(id_col).alias("class_id"))
    members = sets.join(classes, "signatures").select(id_col, "class_id")
    rare = classes.select(F.explode("signatures").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    base = math.log(1 / least)
    sized = classes.where(F.size("signatures") > 0).withColumn("n", F.size("signatures")).withColumn("part", F.floor(F.log(F.col("n").cast("double")) / base + 1e-9).cast("int"))
    ranked = sized.select("class_id", "n", "part", F.explode("signatures").alias("s")).join(rare, "s").groupBy("class_id", "n", "part").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("by"))
    prefix = ranked.select("class_id", "n", "part", F.explode(F.slice("by", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("x")).select("class_id", "n", "part", F.col("x.s").alias("s"))
    a = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    b = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "s", "part")
    met = a.join(b, ["s", "part"]).where(((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= F.col("nb") * least - 1e-9))
    met = met.select("a", "b").distinct()
    held = sized.select("class_id", "signatures")
    both = met.join(held.select(F.col("class_id").alias("a"), F.col("signatures").alias("sa")), "a").join(held.select(F.col("class_id").alias("b"), F.col("signatures").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    likeness = (common / (F.size("sa") + F.size("sb") - common)).cast("double")
    return members, both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness.alias("likeness")).where(F.col("likeness") >= least)
