"""Anchored windows, admission, silent keys and joined streams against plain Python."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from rallyframe.plans import streams
from rallyframe.plans.catalog import QUERIES, read
from rallyframe.streaming import admission, anchored, arrivals

SMALL = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 3, 1)


def folded(events, seconds):
    """One long fold a key."""
    out, start = {}, {}
    for k, at in sorted(((k, t) for k, t in events if t is not None), key=lambda x: (str(x[0]), x[1])):
        if k not in start or at >= start[k] + dt.timedelta(seconds=seconds):
            start[k] = at
        out[k, start[k]] = out.get((k, start[k]), 0) + 1
    return out


def test_windows_open_at_the_first_event(spark):
    rng = random.Random(4)
    at = [DAY + dt.timedelta(seconds=rng.choice([0, 1, 2]) * 450 + rng.randrange(40_000_000) / 100) for _ in range(10_000)]
    events = [("hot", t) for t in at]
    events += [("edge", DAY + dt.timedelta(minutes=m)) for m in (0, 14, 15, 29, 30, 44, 60, 200, 214, 215, 215)]
    events += [(None, DAY), (None, DAY + dt.timedelta(minutes=20)), ("none", None), ("old", dt.datetime(1969, 12, 31, 23, 50)), ("old", dt.datetime(1970, 1, 1, 0, 4)), ("old", dt.datetime(1970, 1, 1, 0, 5))]
    df = spark.createDataFrame(events, "k string, ts timestamp_ntz")
    got = anchored.anchored_counts(df, "k", "ts", 900).withColumn("start", F.col("start").cast("timestamp_ntz")).collect()
    assert {(r.k, r.start): r.n for r in got} == folded(events, 900) and len(got) == len(folded(events, 900))
    assert anchored.anchored_counts(df.limit(0), "k", "ts", 900).count() == 0


class Ledger:
    """The rule of admission once more, written from its card with counts instead of objects."""

    def __init__(self):
        self.gate, self.wait, self.live, self.passes = None, [], {}, 0

    def run(self):
        self.passes += 1
        load = sum(j["threads"] for j in self.live.values() if not j["alone"])
        self.gate = load <= 10 if self.gate is None else False if load >= 30 else True if load <= 10 else self.gate
        alone_runs, before, new = any(j["alone"] for j in self.live.values()), len(self.live), []
        for j in list(self.wait):
            if j["source"] in {x["source"] for x in self.live.values()}:
                continue
            if j["alone"]:
                if before == 0 and not new:
                    new.append(j)
                break
            if alone_runs or not self.gate or load + j["threads"] > 30:
                break
            new.append(j)
            self.live[j["job"]] = j
            load += j["threads"]
            self.gate = self.gate and load < 30
        for j in new:
            self.wait.remove(j)
            self.live[j["job"]] = j
        return new


def ledger(events):
    pools, out = {}, []
    for e in sorted(events, key=lambda e: (e.pool, e.at, e.id)):
        p = pools.setdefault(e.pool, Ledger())
        if e.kind == "ask":
            p.wait.append({"job": e.job, "source": e.source, "threads": max(1, min(16, e.threads or 5)), "alone": e.alone})
        elif e.kind == "end" and p.live:
            del p.live[e.job if e.job is not None else next(iter(p.live))]
        new = p.run()
        load = sum(j["threads"] for j in p.live.values() if not j["alone"])
        out += [(e.pool, j["job"], e.at, p.passes, load, bool(p.gate)) for j in new]
    return sorted(out)


def jobs(spark):
    return read(spark, SMALL, "events").selectExpr(*(f"{sql} AS {c}" for c, sql in streams.JOBS.items()))


def test_admission_of_the_whole_table(spark):
    got = sorted(tuple(r) for r in QUERIES["str05_admission"](spark, SMALL).collect())
    want = ledger(jobs(spark).collect())
    assert got == want and len({x[0] for x in want}) > 3 and {x[5] for x in want} == {True, False}


def test_admission_in_two_batches_with_a_restart(spark):
    e = jobs(spark).withColumn("at", F.col("at"))
    middle = dt.datetime(2024, 1, 14)
    parts = [e.where(F.col("at") < middle), e.where(F.col("at") >= middle)]
    found, _ = arrivals.fed(spark, parts, admission.admitted)
    assert sorted(tuple(r)[:6] for r in found.collect()) == ledger(e.collect())


def test_admission_rules():
    pool = admission.Pool()
    for job, threads in enumerate((16, 9, 16, 1), 1):
        pool.ask(job, job, threads, False)
    assert pool.admit() == [1, 2]  # 25 threads; 41 would be too many, and the last does not overtake
    pool.end(1)
    assert pool.admit() == [3, 4] and pool.threads() == 26
    pool.ask(9, 9, 5, True)
    assert pool.admit() == []  # the exclusive one waits for all
    pool.ask(10, 10, 1, False)
    for job in (2, 3, 4):
        pool.end(job)
    assert pool.admit() == [9] and pool.admit() == [] and pool.threads() == 0
    pool.end(None)
    assert pool.admit() == [10]
    held = admission.Pool(running=[(1, 1, 12, False)], queue=[(2, 2, 1, False), (3, 1, 1, False)])
    assert held.admit() == [] and held.gate == admission.CLOSED  # unknown at 12 threads: closed until 10 or fewer
    held.end(1)
    assert held.admit() == [2, 3]
    assert [admission.clamped(x) for x in (None, 0, -3, 99)] == [5, 5, 1, 16]


def test_silent_keys_at_each_watermark(spark):
    at = lambda *minutes: [DAY + dt.timedelta(minutes=m) for m in minutes]
    pieces = [[("a", t) for t in at(0, 5)] + [("b", t) for t in at(10, 20)] + [("none", None)], [("c", t) for t in at(36, 60)], [("a", t) for t in at(61)] + [("d", t) for t in at(89)], [("none", None), ("e", at(96)[0])]]
    frames = [spark.createDataFrame(p, "k string, at timestamp") for p in pieces]
    found, _ = arrivals.fed(spark, frames, lambda e: arrivals.silent(e, "k", "at", 30), "update")
    rows = found.collect()
    for run in range(len(pieces)):
        seen = [x for p in pieces[: run + 1] for x in p]
        now = max(t for _, t in seen if t)
        last = {k: max((t for j, t in seen if j == k and t), default=None) for k, _ in seen}
        state = {}
        for r in sorted((r for r in rows if r._batch < (run + 1) * 1_000_000), key=lambda r: r._batch):
            state[r.k] = r.out
        assert {k for k, out in state.items() if out} == {k for k, t in last.items() if t and t + dt.timedelta(minutes=30) < now}


def test_joined_streams_drop_late_rows(spark):
    got = QUERIES["str11_matched_in_time"](spark, SMALL).collect()
    assert [r.start_id for r in got if r.kind == "late"][0] > 0
    assert any(r.end_id is None for r in got if r.kind == "start")
