"""SentencePiece sampling: distinct segmentations by Gumbel top-k, without replacement, and decoding.

A text's segmentations form a lattice over the model's pieces; one has probability proportional to the product of its
pieces' weights. The k largest of independently perturbed log-probabilities are a sample without replacement, found
top-down by a best-first (A-star) search: a node's bound is the exact perturbed maximum of all segmentations below it, so
expanding the best open node leads straight to the next sample, and its siblings wait with bounds of their own, drawn
conditionally on their parent's. Noise is a hash of row key, sample, step and child: the same row gives the same samples.

No piece holds a space after another character, so the lattice is a chain of units: a run of spaces with the word behind it,
of any length. (A model with such pieces has whole texts as units.) Each distinct unit of a batch is laid out once over an
array of characters: a trie gives the pieces that begin at each, sums from the ends of units backward, held as logarithms so
that length needs no cut, give each piece's conditional probability. A text walks the stretches of its units. Below a prefix of log-probability -45 no sibling can reach the k best (its share
is lost in double precision), so none are kept there.

``log_inclusion`` is the log-probability that a segmentation's own noise exceeds the (k+1)-th largest value.

Defined cases: null and empty texts have one empty segmentation (inclusion 1); a text with fewer than k segmentations gives
all of them; equal keys and texts give equal samples; characters without
a piece are spelt in byte pieces; U+2581 reads as a space, as in the library; other columns are not read, so their
names don't matter; null keys share one seed, so equal texts under them give equal samples; an empty table gives an empty
result.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import bounded_batches, mixed, slices

SAMPLES, ALPHA = 2, 0.5
FLOOR = -45.0
SLICE = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _LINE = 0x2581, 0x0A


class Lattice:
    """A model's pieces with their weights, as a trie over code points in a hash table that arrays of keys can probe."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        byte = [sp.is_byte(i) for i in range(n)]
        usable = [i for i in range(n) if not (byte[i] or sp.is_control(i) or sp.is_unknown(i))]
        # weights fall with a piece's rank in the model, as word frequencies do
        ranked = {i: r for r, i in enumerate(sorted(usable, key=lambda i: (-scores[i], i)))}
        self.pieces = {self.names[i]: (i, -alpha * float(np.log(2 + r))) for i, r in ranked.items()}
        #: Whether units can begin at spaces and at line feeds: no piece runs across such a place.
        self.space_begins = not any("▁" in p.lstrip("▁") for p in self.pieces)
        self.line_begins = not any("\n" in p and p != "\n" for p in self.pieces)
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if byte[i]:
                self.byte_id[int(self.names[i][3:5], 16)] = i
        self.byte_weight = -alpha * float(np.log(2 + n))
        text = [bytes([int(self.names[i][3:5], 16)]) if byte[i] else self.names[i].replace("▁", " ").encode() for i in range(n)]
        self.text_size = np.array([len(t) for t in text])
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self.text_bytes = np.frombuffer(b"".join(text), np.uint8)
        self._trie()

    def _trie(self) -> None:
        node: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for name, end in self.pieces.items():
            at = 0
            for c in name:
                at = node.setdefault((at, ord(c)), len(node) + 1)
            ends[at] = end
        self.longest = max(map(len, self.pieces))
        self.piece = np.full(len(node) + 1, -1)
        self.weight = np.zeros(len(node) + 1)
        for at, (i, w) in ends.items():
            self.piece[at], self.weight[at] = i, w
        self.shift = np.uint64(64 - (4 * len(node)).bit_length())
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.slot_key, self.slot_node = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int64)
        for (at, c), to in node.items():
            key = (at << 21 | c) + 1
            slot = (key * int(_ODD) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            while self.slot_key[slot]:
                slot = slot + 1 & self.mask
            self.slot_key[slot], self.slot_node[slot] = key, to
        self.first = np.zeros(0x110000, np.int64)
        for (at, c), to in node.items():
            if not at:
                self.first[c] = to

    def walk(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie's next nodes; 0 where there is none."""
        key = ((node.astype(np.uint64) << np.uint64(21)) | char.astype(np.uint64)) + np.uint64(1)
        slot = ((key * _ODD) >> self.shift).astype(np.int64)
        out = np.zeros(len(key), np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            seen = self.slot_key[slot[open_]]
            same = seen == key[open_]
            out[open_[same]] = self.slot_node[slot[open_[same]]]
            open_ = open_[~same & (seen != 0)]
            slot[open_] = (slot[open_] + 1) & self.mask
        return out


class Net:
    """The pieces (edges) that begin at each place of some units laid out one after another, with their shares.

    ``size``: places of each unit, in the order of ``chars``. An edge's ``below`` is the sum of shares up to and with it.
    """

    def __init__(self, lattice: Lattice, chars: np.ndarray, size: np.ndarray):
        n = len(chars)
        place = np.arange(n)
        end = np.repeat(np.cumsum(size), size)
        # pieces by length; a place's pieces come in order of length
        node, at, found = lattice.first[chars], place, []
        self.count = np.ones(n, np.int64)
        piece = lattice.piece[node]
        found.append((at, 1, piece, np.where(piece >= 0, lattice.weight[node], lattice.byte_weight * _spelt(chars))))
        keep = np.flatnonzero((node > 0) & (at + 1 < end))
        at, node = at[keep], node[keep]
        for length in range(2, lattice.longest + 1):
            if not len(at):
                break
            node = lattice.walk(node, chars[at + length - 1])
            on = np.flatnonzero(node)
            at, node = at[on], node[on]
            piece = lattice.piece[node]
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], length, piece[hit], lattice.weight[node[hit]]))
            self.count[at[hit]] += 1
            keep = np.flatnonzero(at + length < end[at])
            at, node = at[keep], node[keep]
        self.edge0 = np.cumsum(self.count) - self.count
        m = int(self.count.sum())
        self.to, self.piece, weights = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m)
        nth = self.edge0.copy()
        for at, length, piece, weight in found:
            slot = nth[at]
            nth[at] += 1
            self.to[slot], self.piece[slot] = at + length, piece
            weights[slot] = weight
        self.owner = np.repeat(place, self.count)
        # sums backward from the ends of units, all units at once
        left = end - place
        most = int(left.max(initial=0))
        order = np.argsort(left.astype(np.min_scalar_type(most))[self.owner], kind="stable")
        w, to, own = weights[order], self.to[order], self.owner[order]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(left[own], minlength=most + 1))))
        total = np.zeros(n + 1)
        shares, logp = np.empty(m), np.empty(m)
        closes = to == end[own]
        for d in range(1, most + 1):
            a, b = int(cuts[d]), int(cuts[d + 1])
            if a < b:
                part = w[a:b] + np.where(closes[a:b], 0.0, total[to[a:b]])
                o = own[a:b]
                lead = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
                many = np.diff(np.append(lead, b - a))
                top = np.maximum.reduceat(part, lead)
                part -= np.repeat(top, many)
                ratio = np.exp(part)
                over = np.add.reduceat(ratio, lead)
                shares[a:b] = ratio / np.repeat(over, many)
                over = np.log(over)
                logp[a:b] = part - np.repeat(over, many)
                total[o[lead]] = top + over
        share, self.logp = np.empty(m), np.empty(m)
        share[order], self.logp[order] = shares, logp
        upto = np.cumsum(share)
        self.below = upto - np.concatenate(([0.0], upto))[self.edge0][self.owner]

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each place the edge that its number in (0, 1) falls on."""
        edge, last = self.edge0[place], self.edge0[place] + self.count[place] - 1
        on = np.flatnonzero((self.below[edge] < u) & (edge < last))
        while len(on):
            edge[on] += 1
            on = on[(self.below[edge[on]] < u[on]) & (edge[on] < last[on])]
        return edge


class Chain:
    """The lattice of a batch of texts: a chain of units, each of them a stretch of the net that equal units share.

    ``unit``: per unit its first place in the texts; ``shift``: what its places in the texts are ahead of those in the net.
    """

    def __init__(self, lattice: Lattice, texts: list[str]):
        data = "".join(" " + t if t else "" for t in texts)
        self.chars = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.chars[self.chars == 32] = _SPACE
        n = len(self.chars)
        self.first = np.concatenate(([0], np.cumsum([len(t) + 1 if t else 0 for t in texts]))).astype(np.int64)
        if not n:
            return
        begins = np.zeros(n, bool)
        if lattice.space_begins:
            begins[1:] = (self.chars[1:] == _SPACE) & (self.chars[:-1] != _SPACE)
        if lattice.line_begins:
            begins |= self.chars == _LINE
            begins[1:] |= self.chars[:-1] == _LINE
        begins[self.first[:-1][np.diff(self.first) > 0]] = True
        self.unit = np.flatnonzero(begins)
        size = np.diff(np.append(self.unit, n))
        self.doc = np.searchsorted(self.first, self.unit, "right") - 1
        within = np.arange(n) - np.repeat(self.unit, size)
        key = np.add.reduceat(mixed(self.chars.astype(np.uint64) + within.astype(np.uint64) * _ODD), self.unit)
        _, lead, same = np.unique(key, return_index=True, return_inverse=True)
        if (size[lead][same] != size).any() or (self.chars[np.repeat(self.unit[lead][same], size) + within] != self.chars).any():
            lead = same = np.arange(len(size))  # two different units of one key: all are built
        take = np.repeat(self.unit[lead] - (np.cumsum(size[lead]) - size[lead]), size[lead])
        self.net = Net(lattice, self.chars[take + np.arange(len(take))], size[lead])
        home = (np.cumsum(size[lead]) - size[lead])[same]
        self.shift, self.end = self.unit - home, home + size


def _spelt(char: np.ndarray) -> np.ndarray:
    """Bytes of each character in UTF-8."""
    return np.where(char < 0x80, 1, np.where(char < 0x800, 2, np.where(char < 0x10000, 3, 4)))


def uniform(seed: np.ndarray, a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """Numbers in (0, 1) that are a function of the arguments."""
    x = mixed(seed ^ mixed(a.astype(np.uint64) * _ODD + np.asarray(b).astype(np.uint64)))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Search:
    """The best-first search over all texts of a batch at once.

    ``results``: for each sample number the texts, the edges of each text's path, their places in the texts, log-probabilities
    and perturbed values.
    """

    def __init__(self, chain: Chain, seeds: np.ndarray, k: int):
        self.c, self.seeds, self.k = chain, seeds, k
        n = len(seeds)
        self.pool = {c: np.zeros(0, d) for c, d in (("doc", np.int64), ("bound", float), ("parent", np.int64), ("place", np.int64), ("edge", np.int64))}
        self.choices: list[np.ndarray] = []
        self.results: list[tuple[np.ndarray, ...]] = []
        self.threshold = np.full(n, -np.inf)
        docs = np.flatnonzero(np.diff(chain.first) > 0)
        start = {"doc": docs, "bound": -np.log(-np.log(uniform(seeds[docs], docs * 0, 1))), "parent": np.full(len(docs), -1), "place": np.full(len(docs), -1), "edge": np.full(len(docs), -1)}
        for r in range(k):
            if not len(start["doc"]):
                break
            self._expand(r, start)
            start = self._pop()
        # the best open bound after k samples is the (k+1)-th largest value
        self.threshold[start["doc"]] = start["bound"]

    def _pop(self) -> dict[str, np.ndarray]:
        """Takes the best open node of each text out of the pool."""
        p = self.pool
        order = np.lexsort((-p["bound"], p["doc"]))
        doc = p["doc"][order]
        if not len(doc):
            return {c: x[:0] for c, x in p.items()}
        lead = np.concatenate(([True], doc[1:] != doc[:-1]))
        place = np.arange(len(doc)) - np.maximum.accumulate(np.where(lead, np.arange(len(doc)), 0))
        rest = order[~lead & (place <= self.k)]  # more nodes of one text can't be needed
        self.pool = {c: x[rest] for c, x in p.items()}
        return {c: x[order[lead]] for c, x in p.items()}

    def _expand(self, r: int, start: dict[str, np.ndarray]) -> None:
        """Follows the best child from each start node to the end of its text; siblings on the way go to the pool.

        Which child holds its parent's value is drawn by the children's shares; the others' values then are Gumbel values
        cut off at the parent's. Up to its start node a sample goes with the one it branches off from.
        """
        c, net, doc = self.c, self.c.net, start["doc"]
        n = len(self.seeds)
        branch = np.full(n, len(c.chars))  # texts that have all their samples get no more
        branch[doc] = start["place"]
        choice = np.full(len(c.chars), -1)
        if r:
            chars = np.diff(c.first)
            parent = np.full(n, -1)
            parent[doc] = start["parent"]
            before = np.arange(len(choice)) < np.repeat(np.where(parent < 0, -1, branch), chars)
            for q in range(r):
                own = np.flatnonzero(before & np.repeat(parent == q, chars))
                choice[own] = self.choices[q][own]
            choice[start["place"]] = start["edge"]
        fresh = np.flatnonzero(c.unit > branch[c.doc])
        unit, place = fresh, c.unit[fresh] - c.shift[fresh]
        if r:
            inside = np.searchsorted(c.unit, start["place"], "right") - 1
            goes = net.to[start["edge"]] < c.end[inside]
            unit, place = np.concatenate((unit, inside[goes])), np.concatenate((place, net.to[start["edge"]][goes]))
        keys = mixed(self.seeds + np.full(n, 2 * r + 1, np.uint64) * _ODD)
        while len(unit):
            at = place + c.shift[unit]
            own = c.doc[unit]
            edge = net.draw(place, uniform(keys[own], at - c.first[own], 1))
            choice[at] = edge
            place = net.to[edge]
            on = np.flatnonzero(place < c.end[unit])
            unit, place = unit[on], place[on]
        self.choices.append(choice)
        at = np.flatnonzero(choice >= 0)
        path = choice[at]
        size = np.searchsorted(at, c.first[1:]) - np.searchsorted(at, c.first[:-1])
        of = np.repeat(np.arange(n), size)
        logp = net.logp[path]
        upto = np.concatenate(([0.0], np.cumsum(logp)))
        phi = upto[:-1] - upto[np.cumsum(size) - size][of]
        value = np.full(n, np.nan)
        value[doc] = start["bound"]
        order = np.sort(doc)
        self.results.append((order, size[order], path, at, np.bincount(of, logp, minlength=n)[order], value[order]))
        first, count = net.edge0[net.owner[path]], net.count[net.owner[path]]
        open_ = np.flatnonzero((phi > FLOOR) & (at > branch[of]) & (count > 1))
        count = count[open_]
        owner = np.repeat(open_, count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        kid = first[owner] + nth
        side = np.flatnonzero(kid != path[owner])
        kid, owner, nth = kid[side], owner[side], nth[side]
        own, here = of[owner], at[owner]
        noise = uniform(self.seeds[own], (here - c.first[own] << 6) + nth, 2 + r)
        loc = phi[owner] + net.logp[kid]
        bound = loc - np.log(np.exp(np.minimum(loc - value[own], 700.0)) - np.log(noise))
        found = {"doc": own, "bound": bound, "parent": np.full(len(kid), r), "place": here, "edge": kid}
        self.pool = {x: np.concatenate((self.pool[x], found[x])) for x in self.pool}


def piece_ids(lattice: Lattice, piece: np.ndarray, char: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids along paths and the offsets of each path's; characters without a piece (-1) are spelt in bytes."""
    spelt = np.flatnonzero(piece < 0)
    n = np.ones(len(piece), np.int64)
    n[spelt] = _spelt(char[spelt])
    to = np.cumsum(n) - n
    out = np.repeat(piece, n)
    for length in range(1, 5):
        at = spelt[n[spelt] == length]
        for i in range(length):
            if length == 1:
                byte = char[at]
            else:
                tail = (char[at] >> (6 * (length - 1 - i))) & 0x3F
                byte = np.where(i > 0, 0x80 | tail, (0xF00 >> length & 0xFF) | (char[at] >> (6 * (length - 1))))
            out[to[at] + i] = lattice.byte_id[byte]
    offsets = np.append(to, len(out))[np.concatenate(([0], np.cumsum(size)))]
    return out.astype(np.int32), offsets


def decode(lattice: Lattice, ids: np.ndarray) -> np.ndarray:
    """Bytes of a run of piece ids (with the space in front of a text)."""
    n = lattice.text_size[ids]
    at = np.repeat(lattice.text_at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return lattice.text_bytes[at]


_LATTICES: dict[tuple[str, float], Lattice] = {}


@dataclass
class Samples:
    """One entry a sample: text, sample number from 1, log probability, perturbed value, log inclusion, and where its ids end.

    ``same``: whether the text decoded from the ids is the sampled one.
    """

    doc: np.ndarray
    number: np.ndarray
    logp: np.ndarray
    value: np.ndarray
    inclusion: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    same: np.ndarray


def sampled(lattice: Lattice, texts: list[str], seeds: np.ndarray, k: int) -> Samples:
    """Up to k segmentations a text."""
    chain = Chain(lattice, texts)
    bare = np.array([d for d, t in enumerate(texts) if not t], np.int64)
    zeros = np.zeros(len(bare))
    parts = [(bare, zeros.astype(np.int64), np.zeros(0, np.int32), zeros, zeros, zeros, zeros == 0)]
    numbers = [np.ones(len(bare), np.int32)]
    if len(chain.chars):
        search = Search(chain, seeds, k)
        source = np.frombuffer("".join(" " + t.replace("▁", " ") if t else "" for t in texts).encode(), np.uint8)
        begins = np.cumsum(np.concatenate(([0], _spelt(np.where(chain.chars == _SPACE, 32, chain.chars)))))[chain.first]
        for r, (doc, size, path, at, logp, value) in enumerate(search.results):
            ids, offsets = piece_ids(lattice, chain.net.piece[path], chain.chars[at], size)
            x = np.minimum(logp - search.threshold[doc], 700.0)
            with np.errstate(divide="ignore", over="ignore"):
                inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(x))))
            # one text after the other, read back at once
            back = decode(lattice, ids)
            ends = np.concatenate(([0], np.cumsum(lattice.text_size[ids])))[offsets]
            same = np.diff(ends) == begins[doc + 1] - begins[doc]
            if same.all():
                wanted = source if len(back) == len(source) else source[np.repeat(begins[doc] - ends[:-1], np.diff(ends)) + np.arange(len(back))]
                same = np.logical_and.reduceat(back == wanted, ends[:-1])
            else:
                same &= np.array([back[a:b].tobytes() == source[begins[d] : begins[d + 1]].tobytes() for a, b, d in zip(ends, ends[1:], doc, strict=False)], bool)
            parts.append((doc, np.diff(offsets), ids, logp, value, inclusion, same))
            numbers.append(np.full(len(doc), r + 1, np.int32))
    doc, size, ids, logp, value, inclusion, same = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Samples(doc, np.concatenate(numbers), logp, value, inclusion, np.concatenate(([0], np.cumsum(size))), ids, same)


def sample_batch(lattice: Lattice, texts: list[str], seeds: np.ndarray, k: int) -> list[tuple[int, int, np.ndarray, float, float, float]]:
    """(text, sample number from 1, piece ids, log probability, perturbed value, log inclusion) of up to k segmentations a text."""
    s = sampled(lattice, texts, seeds, k)
    return [(int(d), int(s.number[i]), s.ids[s.offsets[i] : s.offsets[i + 1]], float(s.logp[i]), float(s.value[i]), float(s.inclusion[i])) for i, d in enumerate(s.doc)]


def sample_segmentations(docs: DataFrame, model: str, text: str = "text", id_col: str = "doc_id", k: int = SAMPLES, alpha: float = ALPHA, with_ids: bool = True, key: Column | None = None) -> DataFrame:
    """One row a sample: id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids_xxh64, round_trip and, ``with_ids``, ids.

    ``model``: the path of a model file on every machine. ``key``: what seeds a row's noise (its id by default).
    ``round_trip``: the text decoded from the ids is the document's (U+2581 read as a space).
    """
    bounded_batches(docs.sparkSession)
    seed = F.xxhash64(F.coalesce((key if key is not None else F.col(id_col)).cast("string"), F.lit("")))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_xxh64", "round_trip", *["ids"] * with_ids]

    def run(batches):
        lattice = _LATTICES.get((model, alpha)) or _LATTICES.setdefault((model, alpha), Lattice(model, alpha))
        for whole in batches:
            for b in slices(whole, "_text", SLICE):
                s = sampled(lattice, [t or "" for t in b.column("_text").to_pylist()], b.column("_seed").to_numpy().view(np.uint64), k)
                flat = s.ids.astype("<i4", copy=False)
                digests = [xxhash.xxh64_hexdigest(flat[a:z].tobytes()) for a, z in itertools.pairwise(s.offsets.tolist())]
                columns = [b.column("_id").take(pa.array(s.doc)), *(pa.array(x) for x in (s.number, np.diff(s.offsets), s.logp, s.value, s.inclusion)), pa.array(digests, pa.string()), pa.array(s.same)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(s.offsets, pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, sample int, n_pieces bigint, log_prob double, perturbed double, log_inclusion double, ids_xxh64 string, round_trip boolean"
    return docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), seed.alias("_seed")).mapInArrow(run, schema + ", ids array<int>" * with_ids)


def decode_segmentations(samples: DataFrame, model: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id", "sample")) -> DataFrame:
    """``keep`` and ``text`` read back from piece ids."""
    bounded_batches(samples.sparkSession)
    kinds = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        lattice = _LATTICES.get((model, ALPHA)) or _LATTICES.setdefault((model, ALPHA), Lattice(model, ALPHA))
        for b in batches:
            step = max(1, int(SLICE * b.num_rows // max(1, pc.sum(pc.list_value_length(b.column("_ids"))).as_py() or 0)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                texts = [decode(lattice, x.values.to_numpy().astype(np.int64) if x.is_valid else np.zeros(0, np.int64)).tobytes().decode("utf-8", "replace")[1:] for x in part.column("_ids")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return samples.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, f"{kinds}, text string")
