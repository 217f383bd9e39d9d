"""URL filter over a memory-mapped sorted array of 64-bit digests.

Rules (host, path, action) are stored as sorted XXH64 keys of host + path beside their full strings. Every machine maps the
same file; a url's candidates (its host and parent domains, times the rule path lengths in use) are hashed, found by one
vectorised binary search a batch, and confirmed against the stored string, so colliding keys cannot decide.

The list's size is read before it is fetched. A list over ``most_bytes`` becomes several files, each built and sent on its
own, and the urls look each of them up within the same pass.

Defined cases: a null url and one without ``://`` have empty host and path; a rule fits its host and all subdomains where
the url's path starts with the rule's path; the longest host + path wins, then block over allow; urls without a rule get
the default verdict; repeated rows are judged each on its own; an empty rule list fits nothing; ids are kept as they are, null
ones too; an empty page table gives an empty result; a url is read whole, however long; columns of the pages other than id
and url are not read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.common import bounded_batches

MOST_BYTES = 64 << 20


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def write_index(rules: list[tuple[str, str, str]], folder: str) -> str:
    """The sorted digest array of some rules as one file; its name carries a digest of its content."""
    best: dict[bytes, tuple[int, int]] = {}
    for host, path, action in rules:
        key = host.encode() + b"\0" + path.encode()
        best[key] = max(best.get(key, (0, 0)), (int(action == "block"), 0))
    rows = sorted((xxhash.xxh64_intdigest(k), k, b[0]) for k, b in best.items())
    keys = np.array([r[0] for r in rows], np.uint64)
    ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int64)
    labels = np.array([max((r[1].count(b".", 0, r[1].index(b"\0")) + 1 for r in rows), default=0)], np.int64)
    lengths = np.unique([len(r[1]) - r[1].index(b"\0") - 1 for r in rows]).astype(np.int64)
    head = np.array([len(keys), len(lengths)], np.int64)
    data = b"".join(x.tobytes() for x in (head, labels, lengths, keys, ends)) + b"".join(r[1] for r in rows) + bytes(r[2] for r in rows)
    path = os.path.join(folder, f"url-digests-{hashlib.sha256(data).hexdigest()[:24]}.bin")
    if not os.path.exists(path):
        with open(path, "wb") as f:
            f.write(data)
    return path


class DigestArray:
    """A mapped index file."""

    def __init__(self, path: str):
        self.map = np.memmap(path, np.uint8, "r")
        n, k = self.map[:16].view(np.int64).tolist()
        self.labels = int(self.map[16:24].view(np.int64)[0])
        at = 24 + 8 * k
        self.lengths = self.map[24:at].view(np.int64).tolist()
        self.keys = self.map[at : at + 8 * n].view(np.uint64)
        self.ends = self.map[at + 8 * n : at + 16 * n + 8].view(np.int64)
        self.blob = self.map[at + 16 * n + 8 :]
        self.blocks = self.blob[int(self.ends[-1]) :]

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """The place of each string, or -1."""
        out = np.full(len(wanted), -1)
        if not wanted or not len(self.keys):
            return out
        probe = np.array([xxhash.xxh64_intdigest(w) for w in wanted], np.uint64)
        low, high = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        for i in np.flatnonzero(low < high):
            for j in range(low[i], high[i]):
                if self.blob[self.ends[j] : self.ends[j + 1]].tobytes() == wanted[i]:
                    out[i] = j
        return out

    def candidates(self, host: str, path: str) -> list[bytes]:
        """host + path strings of rules that would fit."""
        labels = host.split(".") if host else []
        hosts = [".".join(labels[i:]) for i in range(max(0, len(labels) - self.labels), len(labels))]
        data = path.encode()
        starts = [data[:n] for n in self.lengths if n <= len(data)]
        return [h.encode() + b"\0" + p for h in hosts for p in starts]


def judge(urls: list[str | None], arrays: list[DigestArray], default: str) -> tuple[list[str], list[str], list[str | None], list[str]]:
    parts = [url_parts(u) for u in urls]
    best: list[tuple[int, int, str] | None] = [None] * len(urls)
    for array in arrays:
        each = [array.candidates(*p) for p in parts]
        found = array.find([c for x in each for c in x])
        owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
        for i, j in zip(owner[found >= 0].tolist(), found[found >= 0].tolist(), strict=True):
            text = array.blob[array.ends[j] : array.ends[j + 1]].tobytes().replace(b"\0", b"").decode()
            own = (len(text), int(array.blocks[j]), text)
            if best[i] is None or own > best[i]:
                best[i] = own
    return [h for h, _ in parts], [p for _, p in parts], [b and b[2] for b in best], [default if b is None else ("allow", "block")[b[1]] for b in best]


def index_folder() -> str:
    """The driver's folder for index files: one a process, since Spark takes a file of one name from one place only."""
    if not hasattr(index_folder, "own"):
        index_folder.own = tempfile.mkdtemp(prefix="url-digests-")
    return index_folder.own


def send_rules(spark: SparkSession, rules: DataFrame, most_bytes: int = MOST_BYTES) -> list[str]:
    """Index files of a rule list (host, path, action) on every machine, each of at most about ``most_bytes``; their names."""
    rows = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    size = rows.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 18)).first()[0] or 0
    k, names = size // most_bytes + 1, []
    folder = index_folder()
    for i in range(k):
        part = rows.where(F.pmod(F.xxhash64("host", "path"), F.lit(k)) == i) if k > 1 else rows
        path = write_index([tuple(r) for r in part.collect()], folder)
        if os.path.basename(path) not in names:
            spark.sparkContext.addFile(path)
            names.append(os.path.basename(path))
    return names


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", id_col: str = "page_id", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict), one row a page."""
    bounded_batches(pages.sparkSession)
    names = send_rules(pages.sparkSession, rules, most_bytes)

    def run(batches):
        arrays = [DigestArray(SparkFiles.get(n)) for n in names]
        for b in batches:
            host, path, rule, verdict = judge(b.column(url).to_pylist(), arrays, default)
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))], [id_col, "host", "path", "rule", "verdict"])

    return pages.select(id_col, url).mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string")
