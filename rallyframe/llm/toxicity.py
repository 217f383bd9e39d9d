"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

Voters fire on whole texts: hand-written lexicons by theme and language, patterns (an insult beside a second-person word,
repeated insults, high density), and lexicons and word beginnings mined from labelled training rows, dealt over several
voters. The label model estimates each voter's rates of firing in either class by expectation maximisation over the counts
of vote patterns of all documents, and, from what the classes leave unexplained, the voters' correlations; the vote of a
correlated group counts about once. A logistic classifier over hashed words, word beginnings and the voters is trained on
posterior labels of a bounded sample and gives the score.

Labels enter only through rows the caller marks as training rows; ids, language and source are never inputs.

Defined cases: null and empty texts have no words and get the classifier's score of a text without any; texts are read
whole; without labels only the hand-written voters vote; without documents the result is empty; repeated rows score alike;
null ids keep their row and match no label; other columns are not read, and a name in ``keep`` that is also the output's is
refused.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import ALNUM, LOWER, bounded_batches, mixed, refuse_clashes, slices, text_bytes, word_hashes, word_spans, written

# Insulting words by theme (English) and language.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons moronic stupid dumb imbecile fool braindead".split(),
    "worth": "loser losers worthless useless pathetic trash garbage scum scumbag".split(),
    "disgust": "disgusting vile filthy vermin pig pigs rat rats".split(),
    "mockery": "clown clowns joke laughingstock freak weirdo coward liar".split(),
    "hate": "hate kill die shut hell damn bastard bitch asshole".split(),
    "de": "idiot blödmann dummkopf arschloch abschaum versager trottel vollidiot mistkerl ekelhaft wertlos".split(),
    "fr": "idiot imbécile crétin connard salaud ordure minable débile abruti dégoûtant pathétique".split(),
    "es": "idiota imbécil estúpido basura escoria payaso asqueroso patético inútil perdedor tonto".split(),
}
#: Lexicons whose words are everyday words too; they vote only from two different ones on.
MILD = ("hate", "disgust", "mockery")
SECOND_PERSON = "you your yours yourself du dich dein tu toi vous te tú eres usted".split()
BEGINNING = 5
DIMENSIONS = 1 << 18
MINED_VOTERS = 4
#: Overall correlation from which two voters count as one.
TWINS = 0.8
#: Bounds of the fitting samples, in documents.
MOST_LABELLED, MOST_FITTED = 20_000, 8_000


def _hash_words(words: list[str]) -> np.ndarray:
    raw, offsets = text_bytes(pa.array(words))
    return np.unique(word_hashes(raw, *word_spans(raw, offsets, ALNUM)[:2]))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: row and hash of every word, hash of every word's first letters (0 for short words), words of each row."""
    raw, offsets = text_bytes(texts)
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, offsets, ALNUM)
    words = word_hashes(raw, starts, ends)
    begin = mixed(word_hashes(raw, starts, ends, BEGINNING) ^ np.uint64(7))
    begin[ends - starts <= BEGINNING] = 0
    n = np.diff(first)
    return np.repeat(np.arange(len(n)), n), words, begin, n


def member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted table."""
    if not len(table) or not len(keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys


@dataclass
class Voters:
    """Hand-written and mined voters; ``mined_words`` and ``mined_begins`` are sorted hashes."""

    mined_words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    mined_begins: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def __post_init__(self):
        self.lexicons = {k: _hash_words(w) for k, w in LEXICONS.items()}
        self.second = _hash_words(SECOND_PERSON)
        self.strong = np.unique(np.concatenate([v for k, v in self.lexicons.items() if k not in MILD]))
        self.names = [*self.lexicons, *(f"word{i}" for i in range(MINED_VOTERS)), *(f"begin{i}" for i in range(MINED_VOTERS)), "repeated", "dense", "addressed"]

    def votes(self, row: np.ndarray, words: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """rows x voters, True where a voter fires."""
        out = np.zeros((len(n), len(self.names)), bool)
        for j, (name, table) in enumerate(self.lexicons.items()):
            hit = member(words, table)
            if name in MILD:
                pairs = np.unique(np.stack((row[hit].astype(np.uint64), words[hit])), axis=1)
                out[:, j] = np.bincount(pairs[0].astype(np.int64), minlength=len(n)) >= 2
            else:
                out[row[hit], j] = True
        j = len(self.lexicons)
        hit_w, hit_b = member(words, self.mined_words), member(begin, self.mined_begins)
        for keys, hit in ((words, hit_w), (begin, hit_b)):
            for i in range(MINED_VOTERS):
                out[row[hit & (keys % np.uint64(MINED_VOTERS) == i)], j] = True
                j += 1
        insult = member(words, self.strong) | hit_w | hit_b
        count = np.bincount(row[insult], minlength=len(n))
        out[:, j] = count >= 2
        out[:, j + 1] = (count > 0) & (count * 40 >= n)
        near = np.flatnonzero(insult)
        second = member(words, self.second)
        for d in (-2, -1, 1, 2):
            other = np.clip(near + d, 0, max(len(words) - 1, 0))
            ok = (row[other] == row[near]) & second[other]
            out[row[near[ok]], j + 2] = True
        return out


def presence(row: np.ndarray, words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, dimension) of hashed words and beginnings."""
    dims = np.uint64(DIMENSIONS)
    r, k = np.concatenate((row, row[begin != 0])), np.concatenate((words % dims, begin[begin != 0] % dims)).astype(np.int64)
    key = np.unique(r * DIMENSIONS + k)
    return key // DIMENSIONS, key % DIMENSIONS


@dataclass
class LabelModel:
    """Class share, rates of firing per class and the weight of each voter's evidence."""

    prior: float
    rate: np.ndarray  # 2 x voters
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rate[1] / self.rate[0])
        off = np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        z = np.log(self.prior / (1 - self.prior)) + (np.where(votes, on, off) * self.weight).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 40) -> LabelModel:
    """Expectation maximisation over vote patterns and how many documents show each.

    It starts from the voters' majority: documents on which any voter fires lean to class 1, each more voter more so.
    """
    total = counts.sum()
    fired = votes.sum(1)
    p = np.where(fired == 0, 0.01, 1 - 0.3**fired)
    # voters that nearly always fire together are one voter before any class is assumed: else they would be the class
    mean = (counts @ votes) / max(total, 1)
    cov = (votes * counts[:, None]).T @ votes / max(total, 1) - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    twins = np.clip(cov / np.outer(dev, dev), 0, 1)
    np.fill_diagonal(twins, 0)
    twins[twins < TWINS] = 0
    weight = 1 / (1 + twins.sum(1))
    model = None
    for i in range(rounds):
        one, zero = (counts * p).sum(), (counts * (1 - p)).sum()
        prior = float(np.clip(one / max(total, 1), 1e-4, 0.5))
        # a voter may miss most of class 1, but fires rarely on class 0
        rate = np.stack([((counts * (1 - p)) @ votes + 0.1) / (zero + 20), ((counts * p) @ votes + 1) / (one + 2)])
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        rate[0] = np.minimum(rate[0], rate[1])
        if i >= 5:
            weight, corr = _weights(votes, counts, p, rate, twins)
        else:
            corr = twins
        model = LabelModel(prior, rate, weight, corr)
        p = model.posterior(votes)
    return model


def _weights(votes: np.ndarray, counts: np.ndarray, p: np.ndarray, rate: np.ndarray, twins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of voters within the classes, and each voter's share of a correlated group's one vote."""
    corr = np.zeros((votes.shape[1],) * 2)
    for y, q in ((0, 1 - p), (1, p)):
        w = counts * q
        n = max(w.sum(), 1)
        x = votes - rate[y]
        cov = (x * w[:, None]).T @ x / n
        dev = np.sqrt(np.maximum(rate[y] * (1 - rate[y]), 1e-6))
        corr += 0.5 * np.clip(cov / np.outer(dev, dev), 0, 1)
    np.fill_diagonal(corr, 0)
    corr = np.maximum(corr, twins)
    return 1 / (1 + np.where(corr > 0.1, corr, 0).sum(1)), corr


@dataclass
class Linear:
    """Logistic weights over hashed features and voters."""

    hashed: np.ndarray
    voters: np.ndarray
    bias: float

    def score(self, row: np.ndarray, dim: np.ndarray, votes: np.ndarray) -> np.ndarray:
        z = self.bias + votes @ self.voters + np.bincount(row, self.hashed[dim], minlength=len(votes))[: len(votes)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(rows: list[np.ndarray], votes: np.ndarray, target: np.ndarray, rounds: int = 250, l2: float = 2e-4) -> Linear:
    """Full-batch Adam on soft labels; features in fewer than 5 documents or most of them have no weight."""
    n = len(rows)
    count = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), minlength=DIMENSIONS)
    usable = (count >= 5) & (count <= 0.3 * n)
    # of these, the ones whose documents' mean label is farthest above the overall mean
    row = np.repeat(np.arange(n), [len(x) for x in rows])
    dim = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    lift = np.bincount(dim, target[row], minlength=DIMENSIONS) - count * target.mean()
    gain = np.where(usable, np.abs(lift) / np.sqrt(count + 1), 0)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:4096])
    chosen = chosen[gain[chosen] > 0]
    place = np.full(DIMENSIONS, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[dim] >= 0
    row, col = row[keep], place[dim[keep]]
    w, v, b = np.zeros(len(chosen)), np.zeros(votes.shape[1]), -2.0
    state = [np.zeros(len(chosen) + votes.shape[1] + 1) for _ in range(2)]
    x = votes.astype(float)
    for i in range(1, rounds + 1):
        z = b + x @ v + np.bincount(row, w[col], minlength=n)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.concatenate((np.bincount(col, err[row], minlength=len(w)) + l2 * w, err @ x + l2 * 0.1 * v, [err.sum()]))
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        step = 0.1 * state[0] / (1 - 0.9**i) / (np.sqrt(state[1] / (1 - 0.99**i)) + 1e-9)
        w, v, b = w - step[: len(w)], v - step[len(w) : -1], b - step[-1]
    hashed = np.zeros(DIMENSIONS)
    hashed[chosen] = w
    return Linear(hashed, v, float(b))


def fit(docs: DataFrame, training: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "label", most_labelled: int = MOST_LABELLED, most_fitted: int = MOST_FITTED) -> tuple[Voters, LabelModel, Linear]:
    """``training``: (id, label) of rows that may be learned from. Fitting samples are the rows of smallest hash, at most the given bounds.

    The texts are read twice: the labelled ones for mined words, then all for the vote patterns and the classifier's sample.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = training.where(F.col(label).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_y").limit(most_labelled)
    labelled = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id").select("_text", "_y")
    voters = Voters(*mined(labelled))
    total = docs.count()
    limit = (2**63 - 1) * min(most_fitted, total) // max(total, 1)
    whole = F.coalesce(F.col(text), F.lit(""))
    seen = docs.select(whole.alias("_text"), (F.shiftrightunsigned(F.xxhash64(whole), 1) <= limit).alias("_in"))

    def voted(batches):
        """Counts of vote patterns (no ``dims``), and the features of sampled rows (n = 0)."""
        patterns: dict[int, int] = {}
        weight = 1 << np.arange(len(voters.names), dtype=np.int64)
        for whole in batches:
            for b in slices(whole, "_text"):
                row, words, begin, n = features(b.column("_text"))
                code = voters.votes(row, words, begin, n) @ weight
                for k, c in zip(*(x.tolist() for x in np.unique(code, return_counts=True)), strict=True):
                    patterns[k] = patterns.get(k, 0) + c
                chosen = np.flatnonzero(b.column("_in").to_numpy(zero_copy_only=False))
                if len(chosen):
                    inside = np.isin(row, chosen)
                    at, dim = presence(np.searchsorted(chosen, row[inside]), words[inside], begin[inside])
                    cut = np.searchsorted(at, np.arange(len(chosen) + 1))
                    data = [dim[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(code[chosen]), pa.array(np.zeros(len(chosen), np.int64)), pa.array(data, pa.binary())], ["pattern", "n", "dims"])
        yield pa.RecordBatch.from_arrays([pa.array(patterns.keys(), pa.int64()), pa.array(patterns.values(), pa.int64()), pa.nulls(len(patterns), pa.binary())], ["pattern", "n", "dims"])

    found = written(seen.mapInArrow(voted, "pattern bigint, n bigint, dims binary"), "toxicity-votes")
    patterns = found.where("dims is null").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pattern").toArrow()
    keys, counts = np.array(patterns.column("pattern").to_pylist(), np.int64), np.array(patterns.column("n").to_pylist(), float)
    votes = ((keys[:, None] >> np.arange(len(voters.names))) & 1).astype(bool)
    model = fit_label_model(votes, counts) if len(keys) else fit_label_model(np.zeros((1, len(voters.names)), bool), np.ones(1))
    # copies of one text pass or fail the bound together, so distinct rows keep the sample bounded
    rows = found.where("dims is not null").select("dims", "pattern").distinct().orderBy(F.xxhash64("dims"), "pattern").limit(most_fitted).toArrow()
    dims = [np.frombuffer(x, np.int32) for x in rows.column("dims").to_pylist()]
    if not dims:
        return voters, model, Linear(np.zeros(DIMENSIONS), np.zeros(len(voters.names)), -2.0)
    votes = ((rows.column("pattern").to_numpy()[:, None] >> np.arange(len(voters.names))) & 1).astype(bool)
    return voters, model, fit_linear(dims, votes, model.posterior(votes))


def mined(labelled: DataFrame, least: int = 3, ratio: float = 12.0) -> tuple[np.ndarray, np.ndarray]:
    """Words and beginnings found in ``least`` documents labelled 1 or more and ``ratio`` times as often as in those labelled 0.

    ``labelled``: _text, _y. Tasks count, Spark adds up and selects; the driver gets the mined hashes alone.
    """

    def counted(batches):
        for whole in batches:
            for b in slices(whole, "_text"):
                row, words, begin, _ = features(b.column("_text"))
                y = b.column("_y").to_numpy()
                for kind, keys in ((0, words), (1, begin)):
                    full = keys != 0
                    pairs = np.unique(np.stack((keys[full], row[full].astype(np.uint64))), axis=1)
                    hashes, place = np.unique(pairs[0], return_inverse=True)
                    own = y[pairs[1].astype(np.int64)]
                    bad, good = (np.bincount(place, own == v, minlength=len(hashes)).astype(np.int64) for v in (1, 0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), kind, np.int32)), pa.array(hashes.view(np.int64)), pa.array(bad), pa.array(good)], ["kind", "hash", "bad", "good"])
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([int((y == 1).sum())], pa.int64()), pa.array([int((y == 0).sum())], pa.int64())], ["kind", "hash", "bad", "good"])

    words = labelled.mapInArrow(counted, "kind int, hash bigint, bad bigint, good bigint").groupBy("kind", "hash").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words = written(words.where((F.col("kind") < 0) | (F.col("bad") >= least)), "toxicity-words")
    total = words.where("kind < 0").first()
    if total is None or not total.bad:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rate = (F.col("bad") / F.lit(total.bad)) / ((F.col("good") + 0.5) / F.lit(total.good + 1))
    found = words.where("kind >= 0").where(rate >= ratio).select("kind", "hash").toArrow()
    kind, keys = found.column("kind").to_numpy(), found.column("hash").to_numpy().view(np.uint64)
    return np.sort(keys[kind == 0]), np.sort(keys[kind == 1])


def score(docs: DataFrame, voters: Voters, linear: Linear, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score``, one row a document. ``keep`` may hold the text itself."""
    refuse_clashes(keep, ("score",))
    bounded_batches(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast((voters, linear))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        v, model = send.value
        for whole in batches:
            for b in slices(whole, "_text"):
                row, words, begin, n = features(b.column("_text"))
                s = model.score(*presence(row, words, begin), v.votes(row, words, begin, n))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], [*keep, "score"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, score double")
