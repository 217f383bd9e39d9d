"""Admission of queued jobs: one run a source, exclusive jobs alone, and a budget of threads behind a gate with hysteresis.

The queue, what runs and the gate are the state of a pool; a pool's events are taken in the order of their creation, and every
one of them is followed by a pass over the queue. Pools are keys, so they spread over tasks; within one the rule is strictly
one job after another.

Defined cases: of events of one moment the smaller id comes first; a job asked for twice queues twice; the end of a job that
does not run changes nothing but still causes a pass; thread counts that are missing or zero mean the default; events of a
micro-batch may come in any order, those of a later one are taken after all earlier ones.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Where the gate closes and opens again, and the least, most and usual threads of a job.
CLOSE_AT, OPEN_AT = 30, 10
LEAST_THREADS, MOST_THREADS, USUAL_THREADS = 1, 16, 5

STATE = "gate int, jobs binary, sources binary, codes binary, running array<struct<job:bigint,source:bigint,threads:int,alone:boolean>>, passes bigint"
STARTED = "pool bigint, job bigint, at timestamp, pass bigint, threads_in_use int, gate_open boolean"
UNKNOWN, CLOSED, OPEN = -1, 0, 1
#: An event as a task holds it: 35 bytes, where a row of objects takes hundreds.
EVENT = np.dtype([("at", "M8[ns]"), ("id", "i8"), ("job", "i8"), ("source", "i8"), ("kind", "i1"), ("threads", "i1"), ("alone", "?")])
TICK, ASK, END, END_FIRST = range(4)
AT_ONCE = 1 << 15


def clamped(threads) -> int:
    return min(max(int(threads or USUAL_THREADS), LEAST_THREADS), MOST_THREADS)


class Queue:
    """Waiting jobs in three flat arrays, 17 bytes each; one that leaves from near the front moves only those before it."""

    def __init__(self, jobs: bytes = b"", sources: bytes = b"", codes: bytes = b""):
        self.jobs, self.sources, self.codes, self.first = array("q", jobs), array("q", sources), array("b", codes), 0

    def add(self, job: int, source: int, threads: int, alone: bool) -> None:
        self.jobs.append(job)
        self.sources.append(source)
        self.codes.append(threads * 2 + bool(alone))

    def remove(self, i: int) -> None:
        for x in (self.jobs, self.sources, self.codes):
            x[self.first + 1 : i + 1] = x[self.first : i]
        self.first += 1

    def trim(self) -> None:
        """Frees what has left, once that is most of the arrays; places change."""
        if self.first > AT_ONCE and self.first * 2 > len(self.jobs):
            self.drop_gone()

    def drop_gone(self) -> None:
        for x in (self.jobs, self.sources, self.codes):
            del x[: self.first]
        self.first = 0

    def packed(self) -> tuple[bytes, bytes, bytes]:
        self.drop_gone()
        return self.jobs.tobytes(), self.sources.tobytes(), self.codes.tobytes()


class Pool:
    """Jobs are (job, source, threads, alone)."""

    def __init__(self, gate: int = UNKNOWN, queue: Queue | list = (), running: list = (), passes: int = 0):
        self.gate, self.running, self.passes = gate, [tuple(x) for x in running], passes
        self.queue = queue if isinstance(queue, Queue) else Queue()
        for x in () if isinstance(queue, Queue) else queue:
            self.queue.add(*x)

    def threads(self) -> int:
        """Threads in use; exclusive jobs do not count."""
        return sum(t for _, _, t, alone in self.running if not alone)

    def admit(self) -> list[int]:
        """One pass: the jobs it starts, in order."""
        used, busy = self.threads(), {source for _, source, _, _ in self.running}
        blocked = any(alone for *_, alone in self.running)
        if self.gate == UNKNOWN:
            self.gate = OPEN if used <= OPEN_AT else CLOSED
        elif used >= CLOSE_AT or used <= OPEN_AT:
            self.gate = OPEN if used <= OPEN_AT else CLOSED
        started: list[tuple] = []
        q, places = self.queue, []
        for i in range(q.first, len(q.jobs)):
            source = q.sources[i]
            if source in busy:
                continue
            threads, alone = divmod(q.codes[i], 2)
            if alone:
                if not self.running and not started:
                    places.append(i)
                    started.append((q.jobs[i], source, threads, True))
                break
            if blocked or self.gate != OPEN or used + threads > CLOSE_AT:
                break
            places.append(i)
            started.append((q.jobs[i], source, threads, False))
            busy.add(source)
            used += threads
            if used >= CLOSE_AT:
                self.gate = CLOSED
        for i in places:  # in order: what leaves moves only those before it
            q.remove(i)
        q.trim()
        self.running += started
        self.passes += 1
        return [x[0] for x in started]

    def ask(self, job: int, source: int, threads, alone: bool) -> None:
        self.queue.add(job, source, clamped(threads), bool(alone))

    def end(self, job: int | None) -> None:
        """The end of a job; without one, of the job that has run longest."""
        at = next((i for i, x in enumerate(self.running) if job is None or x[0] == job), None)
        if at is not None:
            del self.running[at]


def admitted(events: DataFrame) -> DataFrame:
    """Started jobs (pool, job, at, pass, threads in use and the gate after the pass), of a stream of

    (pool, kind, job, source, threads, alone, at, id): kind ``ask`` queues a job, ``end`` ends one, anything else is a tick.
    """

    def packed(b: pd.DataFrame) -> np.ndarray:
        asks, ends = b["kind"].eq("ask"), b["kind"].eq("end")
        if (asks & (b["job"].isna() | b["source"].isna())).any():
            raise ValueError("a job that is asked for needs an id and a source")
        rows = np.zeros(len(b), EVENT)
        rows["at"], rows["id"] = b["at"].to_numpy("M8[ns]"), b["id"].fillna(np.iinfo("i8").max).astype("i8")
        rows["job"], rows["source"] = b["job"].fillna(0).astype("i8"), b["source"].fillna(0).astype("i8")
        rows["kind"] = np.select([asks, ends & b["job"].isna(), ends], [ASK, END_FIRST, END], TICK)
        threads = b["threads"].fillna(0).astype("i8")
        rows["threads"], rows["alone"] = threads.where(threads != 0, USUAL_THREADS).clip(LEAST_THREADS, MOST_THREADS), b["alone"].eq(True)
        return rows

    columns = [c.split()[0] for c in STARTED.split(", ")]

    def table(out: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=columns)
        return found.assign(at=np.array([x[2] for x in out], "i8").view("M8[ns]"))

    def step(names: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            gate, jobs, sources, codes, running, passes = state.get
            pool = Pool(gate, Queue(bytes(jobs), bytes(sources), bytes(codes)), running, passes)
        else:
            pool = Pool()
        now = np.concatenate([packed(b) for b in batches])
        order = np.lexsort((now["id"], now["at"]))
        out = []
        for n in range(0, len(order), AT_ONCE):
            for at, _, job, source, kind, threads, alone in now[order[n : n + AT_ONCE]].tolist():
                if kind == ASK:
                    pool.ask(job, source, threads, alone)
                elif kind in (END, END_FIRST):
                    pool.end(job if kind == END else None)
                out += [(names[0], x, at, pool.passes, pool.threads(), pool.gate == OPEN) for x in pool.admit()]
            if len(out) >= AT_ONCE:
                yield table(out)
                out = []
        state.update((pool.gate, *pool.queue.packed(), pool.running, pool.passes))
        yield table(out)

    asked = events.select("pool", "kind", "job", "source", "threads", "alone", "at", "id")
    return asked.groupBy("pool").applyInPandasWithState(step, STARTED, STATE, "append", "NoTimeout")
