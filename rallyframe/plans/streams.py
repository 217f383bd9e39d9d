"""Stream flows as queries over ``events``; those that end in a table are run as streams over all of it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rallyframe.functions.dates import next_run
from rallyframe.plans.catalog import query, read
from rallyframe.streaming import arrivals, flows
from rallyframe.streaming.admission import admitted as admit_jobs
from rallyframe.streaming.anchored import anchored_counts


def _log(df):
    return df.withColumn("at", F.col("ts").cast("timestamp"))


@query("str01_tail_by_offset", "SELECT event_id, event_type FROM events WHERE event_id > 500")
def tail(spark, sf_dir):
    return flows.drained(spark, f"{sf_dir}/events.parquet", lambda e: flows.tail(e, "event_id", 500).select("event_id", "event_type"), "append")


@query("str02_inactive_users", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 30 MINUTE")
def inactive(spark, sf_dir):
    return flows.inactive(read(spark, sf_dir, "events"), "ts", "user_id", F.lit(dt.datetime(2024, 1, 30, 23)).cast("timestamp_ntz"), 30)


@query("str02_timed_out", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING epoch_ms(max(ts)) + 1800000 < (SELECT epoch_ms(max(ts)) FROM events)")
def timed_out(spark, sf_dir):
    """Users whom the stream itself reports as silent for 30 minutes when its watermark has reached the last event of all."""
    found = flows.drained(spark, f"{sf_dir}/events.parquet", lambda e: arrivals.silent(_log(e).select("user_id", "at"), "user_id", "at", 30), "update", ("user_id",))
    return found.where("out").select("user_id", F.col("last").cast("timestamp_ntz").alias("last"))


@query("str02_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN pause >= INTERVAL 6 HOUR OR pause IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pause FROM events)) GROUP BY user_id, s")
def sessions(spark, sf_dir):
    found = flows.sessions(_log(read(spark, sf_dir, "events")), "at", "user_id", "6 hours")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


#: Schedules of all four cadences; the SQL lists the candidates of each and takes the first one after the clock.
_NOW = "TIMESTAMP '1996-06-01 12:00:00'"
_SCHEDULE = "o_orderkey; CASE o_orderkey % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'biweekly' WHEN 3 THEN 'monthly' ELSE 'other' END AS frequency; CAST(o_orderkey * 37 % 86400 AS int) AS seconds; CAST(o_custkey % 7 AS int) AS weekday; CAST(o_custkey % 31 + 1 AS int) AS day; CAST(o_orderdate AS date) AS anchor; CAST(o_orderdate AS timestamp) AS due_at; o_orderkey % 11 <> 0 AS enabled".split("; ")


@query("str03_due_schedules", f"""WITH s AS (SELECT *, {_NOW} AS now, CAST({_NOW} AS date) AS today FROM (SELECT {', '.join(_SCHEDULE)} FROM orders) WHERE enabled AND due_at <= {_NOW}),
  c AS (SELECT *, CAST(anchor + CAST((weekday - (isodow(anchor) - 1) + 7) % 7 AS int) AS date) AS begin FROM s),
  d AS (SELECT *, unnest(range(0, 45)) AS i FROM c),
  e AS (SELECT *, CAST(today + CAST(i AS int) AS date) AS x FROM d),
  f AS (SELECT *, CAST(greatest(begin, today) + CAST(i AS int) AS date) AS y FROM e),
  g AS (SELECT *, CASE frequency WHEN 'daily' THEN x WHEN 'weekly' THEN CASE WHEN isodow(x) - 1 = weekday THEN x END WHEN 'biweekly' THEN CASE WHEN (y - begin) % 14 = 0 THEN y END
    ELSE CASE WHEN day(x) = least(day, day(last_day(x))) THEN x END END AS candidate FROM f)
  SELECT o_orderkey, due_at, min(CAST(candidate AS timestamp) + seconds * INTERVAL 1 SECOND) FILTER (WHERE CAST(candidate AS timestamp) + seconds * INTERVAL 1 SECOND > now) AS next_run FROM g GROUP BY ALL""")
def due(spark, sf_dir):
    """Enabled schedules that are due fire once, and move to the first instant strictly after the clock; what was missed is not made up."""
    now = F.lit(dt.datetime(1996, 6, 1, 12)).cast("timestamp")
    s = read(spark, sf_dir, "orders").selectExpr(*_SCHEDULE).where(F.col("enabled") & (F.col("due_at") <= now))
    following = next_run(F.col("frequency"), F.col("seconds"), F.col("weekday"), F.col("day"), F.col("anchor"), now)
    return s.select("o_orderkey", F.col("due_at").cast("timestamp_ntz").alias("due_at"), following.cast("timestamp_ntz").alias("next_run"))


_GATE = "CASE WHEN event_id % 40 >= 30 THEN false WHEN event_id % 40 <= 10 THEN true END"


@query("str05_gate_with_hysteresis", f"SELECT event_id, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), true) AS open FROM (SELECT *, {_GATE} AS d FROM events)")
def gate(spark, sf_dir):
    return flows.gated(read(spark, sf_dir, "events").select("event_id", "ts", "user_id"), F.col("event_id") % 40, ["ts", "event_id"], "user_id", 30, 10).select("event_id", "open")


JOBS = {
    "pool": "user_id % 8",
    "kind": "CASE event_type WHEN 'error' THEN 'end' WHEN 'view' THEN 'tick' ELSE 'ask' END",
    "job": "CASE WHEN event_type <> 'error' THEN event_id END",
    "source": "user_id",
    "threads": "CASE WHEN event_id % 6 = 0 THEN 0 ELSE CAST(event_id % 23 AS int) END",
    "alone": "event_type = 'signup' AND event_id % 4 = 0",
    "at": "CAST(ts AS timestamp)",
    "id": "event_id",
}


@query("str05_admission")
def admission(spark, sf_dir):
    """Jobs that start, pool by pool: one run a source, exclusive jobs alone, 30 threads behind the gate; kept as state of a stream.

    An error ends the job of its pool that has run longest. A strictly serial rule, which SQL can't express; a test compares it
    with plain Python over the whole table, in two micro-batches and after a restart too.
    """
    return flows.drained(spark, f"{sf_dir}/events.parquet", lambda e: admit_jobs(e.selectExpr(*(f"{sql} AS {c}" for c, sql in JOBS.items()))), "append")


@query("str07_promoted", "SELECT event_id, CASE WHEN event_type = 'signup' AND value < 20 THEN 'running' WHEN event_type = 'signup' THEN 'queued' ELSE 'done' END AS state FROM events")
def promoted(spark, sf_dir):
    """Queued jobs that fit are promoted, others keep waiting."""
    waits = F.col("event_type") == "signup"
    return read(spark, sf_dir, "events").select("event_id", F.when(waits & (F.col("value") < 20), "running").when(waits, "queued").otherwise("done").alias("state"))


@query("str08_rolling_days", "SELECT event_id FROM events WHERE CAST(ts AS date) BETWEEN DATE '2024-01-20' - 7 AND DATE '2024-01-20'")
def rolling_days(spark, sf_dir):
    day, as_of = F.col("ts").cast("date"), F.lit(dt.date(2024, 1, 20))
    return read(spark, sf_dir, "events").where(day.between(F.date_sub(as_of, 7), as_of)).select("event_id")


@query("str09_failures_in_15_minutes", """WITH RECURSIVE e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'),
  a AS (SELECT user_id, min(ts) AS start FROM e GROUP BY 1 UNION ALL SELECT a.user_id, (SELECT min(ts) FROM e WHERE e.user_id = a.user_id AND e.ts >= a.start + INTERVAL 15 MINUTE) FROM a WHERE a.start IS NOT NULL)
  SELECT e.user_id, a.start, count(*) AS n FROM e JOIN a ON a.user_id = e.user_id AND e.ts >= a.start AND e.ts < a.start + INTERVAL 15 MINUTE GROUP BY ALL""")
def failures(spark, sf_dir):
    """Failures of a user in windows of 15 minutes; the first one opens a window, the first after its end the next."""
    errors = read(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "ts")
    return anchored_counts(errors, "user_id", "ts", 900).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str10_progress_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def progress(spark, sf_dir):
    return flows.drained(spark, f"{sf_dir}/events.parquet", lambda e: e.groupBy("event_type").agg(F.count("*").alias("n")))


@query("str11_sliding_windows", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1")
def sliding(spark, sf_dir):
    return flows.windowed(_log(read(spark, sf_dir, "events")), "at", "1 hour", "1 hour", slide="30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


_LATE = "(day(ts) <= 10 AND event_id % 50 = 0)"


@query("str11_matched_in_time", f"""WITH e AS (SELECT event_id, user_id, event_type, ts, {_LATE} AS late FROM events WHERE event_type IN ('click', 'purchase')),
  c AS (FROM e WHERE NOT late AND event_type = 'click'), p AS (FROM e WHERE NOT late AND event_type = 'purchase')
  SELECT 'start' AS kind, c.event_id AS start_id, p.event_id AS end_id FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 2 HOUR
  UNION ALL SELECT 'late', count(*), NULL FROM e WHERE late""")
def matched_in_time(spark, sf_dir):
    """Clicks with the purchases of the same user within two hours, of two streams that arrive in ten-day pieces.

    Some rows of the first piece arrive with the third, when the watermark has passed them: they are dropped, and one more row
    counts them. A last arrival of two far moments lets every open click come out.
    """
    e = read(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"), F.expr(_LATE).alias("late"))
    piece = F.when(F.col("late"), 3).when(F.day("at") <= 10, 1).when(F.day("at") <= 20, 2).otherwise(3)
    end = spark.createDataFrame([(-1, -1, "click"), (-2, -1, "purchase")], "event_id bigint, user_id bigint, event_type string").withColumn("at", F.lit(dt.datetime(2024, 6, 1)).cast("timestamp"))

    def flow(stream):
        clicks = stream.where("event_type = 'click'").select(F.col("event_id").alias("start_id"), "user_id", F.col("at").alias("start_at"))
        buys = stream.where("event_type = 'purchase'").select(F.col("event_id").alias("end_id"), "user_id", F.col("at").alias("end_at"))
        return arrivals.matched(clicks, buys, "user_id", "start_at", "end_at", "2 HOURS", "1 hour").select("start_id", "end_id")

    found, dropped = arrivals.fed(spark, [*(e.where(piece == n).select(*end.columns) for n in (1, 2, 3)), end], flow)
    late = spark.createDataFrame([("late", dropped, None)], "kind string, start_id bigint, end_id bigint")
    return found.where("start_id > 0").select(F.lit("start").alias("kind"), "start_id", "end_id").unionByName(late)
