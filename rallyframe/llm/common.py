"""What the text operators share: bounded Arrow batches, byte-level words, written intermediate tables."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
SLICE_BYTES = 4 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The low 0 to 8 bytes of a little-endian word of eight.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches for Python stay small also where every document is long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share; a temporary one only where the session names none (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = tempfile.mkdtemp(prefix="rallyframe-")
    return base.rstrip("/")


_SCRATCH: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at the end: what is to stay must be written with ``stays`` and be complete by then."""
    _SCRATCH.append(f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, _SCRATCH.pop())


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark) if stays or not _SCRATCH else _SCRATCH[-1]}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t.written_path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def refuse_clashes(inputs: tuple[str, ...], outputs: tuple[str, ...]) -> None:
    """Columns to keep may not have the name of a computed one: the result would have two of one name."""
    if taken := sorted(set(inputs) & set(outputs)):
        raise ValueError(f"output names asked for as input columns: {taken}")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array as one uint8 array, and n + 1 offsets into it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Pieces of a batch with at most ``limit`` bytes of text each, or one row."""
    _, offsets = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: A-Z lower-cased, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D] and [^\x00-\x2F\x3A-\x60\x7B-\x7F], as bytes of UTF-8 (all bytes from 0x80 on are word bytes).
NOT_SPACE = ~byte_table([(9, 13), (32, 32)])
ALNUM = byte_table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a batch of texts, and for each text the index of its first word (n + 1)."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = table[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    stops = np.zeros(len(raw) + 1, bool)
    stops[1:] = inside[:-1] & ~inside[1:]
    stops[edges] = inside[edges - 1]
    return starts, np.flatnonzero(stops), np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int | None = None, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word (of its first ``most`` bytes), eight bytes at a time, all words at once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    left = (ends - starts) if most is None else np.minimum(ends - starts, most)
    out = mixed(left.astype(np.uint64) + _STEP + np.uint64(seed << 40))
    out = mixed(out ^ (eight[starts] & _MASKS[np.minimum(left, 8)]))
    more, k = np.flatnonzero(left > 8), 8
    while len(more):
        out[more] = mixed(out[more] * _STEP ^ (eight[starts[more] + k] & _MASKS[np.minimum(left[more] - k, 8)]))
        k += 8
        more = more[left[more] > k]
    return out


def same_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether words, pair by pair, have the same bytes."""
    one, two = (np.ndarray(len(x) + 1, "<u8", np.concatenate((x, np.zeros(8, np.uint8))), strides=(1,)) for x in (raw, other))
    same, k = ends - starts == other_ends - other_starts, 0
    more = np.flatnonzero(same & (ends > starts))
    while len(more):
        mask = _MASKS[np.minimum(ends[more] - starts[more] - k, 8)]
        equal = (one[starts[more] + k] & mask) == (two[other_starts[more] + k] & mask)
        same[more[~equal]] = False
        k += 8
        more = more[equal]
        more = more[ends[more] - starts[more] > k]
    return same


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit keys stirred (a public finaliser with two multiplications)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def arrow_type(name: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[name]


def record(schema: str, columns: list) -> pa.RecordBatch:
    """A batch from columns in the order of a DDL schema of simple types."""
    fields = [f.split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, arrow_type(kind)) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])
