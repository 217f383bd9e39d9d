"""Token counts of whole texts: batch encoding inside Arrow functions, of which only the lengths come back.

Texts are split where the tokenizer splits anyway: before a space that follows a character which is not white space. The
distinct pieces of a batch that are not yet counted are encoded in one call of the library, longest first in batches of
similar bytes; counts of short pieces are kept in a bounded table, so a piece that occurs a million times is encoded once.
Texts with unusual white space are only split between a letter or digit, one space, and another letter or digit.

Defined cases: null and empty texts have 0 bytes and 0 tokens; strings of special tokens inside texts are handled as the
library does by default; a long run without a place to split is encoded whole; null ids keep their row;
repeated rows are counted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rallyframe.llm.common import bounded_batches, slices, text_bytes

#: Most pieces kept in a worker's table, and the longest that is kept.
KEPT, KEPT_CHARS = 400_000, 48
CALL_BYTES = 1 << 20
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_UNUSUAL = re.compile("[\\x00-\\x09\\x0b-\\x1f\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff]")
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def plain(text: str) -> bool:
    """Whether every space follows a character that is not white space."""
    return "  " not in text and "\n " not in text and text[:1] != " " and not _UNUSUAL.search(text)


def careful_pieces(text: str) -> list[str]:
    """Pieces of any text, with their white space."""
    if not _UNUSUAL.search(text):
        return _PIECE.findall(text)
    cuts = [m.start() for m in _SAFE.finditer(text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if a < b]


class Table(dict):
    """Token counts of pieces; a piece that has none yet counts 0 and is noted in ``new``."""

    def __init__(self, lead: str):
        super().__init__()
        self.lead, self.new = lead, {}

    def __missing__(self, piece: str) -> int:
        self.new[piece] = None
        return 0


class Counter:
    """Counts tokens of pieces with one tokenizer; encodes what it has not seen, in calls of similar bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.after_space, self.whole = Table(" "), Table("")

    def learn(self, table: Table) -> None:
        """Counts of a table's new pieces. Long ones are used for this batch only (see ``count``)."""
        call, size = [], 0
        todo = sorted(table.new, key=len, reverse=True)
        for i, p in enumerate(todo):
            call.append(p)
            size += len(p) + 1
            if size >= CALL_BYTES or i == len(todo) - 1:
                table.update(zip(call, (len(e) for e in self.tokenizer.encode_batch_fast([table.lead + x for x in call], add_special_tokens=False)), strict=True))
                call, size = [], 0

    def count(self, texts: list[str]) -> list[int]:
        split, n, again = [], [], []
        for i, t in enumerate(texts):
            if plain(t):
                p = t.split(" ")
                head, rest = (p[:1] if p[0] else []), p[1:]
            else:
                head, rest = careful_pieces(t), []
            split.append((head, rest))
            n.append(sum(map(self.whole.__getitem__, head)) + sum(map(self.after_space.__getitem__, rest)))
            # a piece noted earlier in this batch still counts 0
            if self.after_space.new or self.whole.new:
                again.append(i)
        if not again:
            return n
        long = []
        for table in (self.whole, self.after_space):
            self.learn(table)
            long += [(table, p) for p in table.new if len(p) > KEPT_CHARS]
            table.new = {}
        for i in again:
            head, rest = split[i]
            n[i] = sum(map(self.whole.__getitem__, head)) + sum(map(self.after_space.__getitem__, rest))
        for table, p in long:
            del table[p]
        for table in (self.whole, self.after_space):
            if len(table) > KEPT:
                table.clear()
        return n


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row a document. ``tokenizer``: the path of a tokenizer file on every machine."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _COUNTERS.get(tokenizer) or _COUNTERS.setdefault(tokenizer, Counter(tokenizer))
        for whole in batches:
            for b in slices(whole, text):
                n_bytes = np.diff(text_bytes(b.column(text))[1])
                n = counter.count([t or "" for t in b.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n_bytes), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
