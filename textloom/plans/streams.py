"""Streaming twins of the listening queries, drained to the end over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.streaming import durable as D
from textloom.streaming import ingest as I
from textloom.streaming import progress as P

from .registry import Tables, query


def stream(t: Tables):
    """Events as a stream of files; the time column as a timestamp, which watermarks need."""
    schema = t.events.schema
    return t.spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*.parquet").load(_folder(t)).withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(t: Tables) -> str:
    """A glob that matches the table alone, whether it is one file or a folder of files."""
    return f"{t.sf_dir}/events.parque[t]"


@query("SELECT event_id, least(value * 60, 3600.0) AS seconds FROM events WHERE value > 0")
def streaming_ingest(t: Tables):
    rows = stream(t).withColumn("seconds", F.col("value") * 60)
    return I.drained(I.accepted_stream(rows)).select("event_id", "seconds")


@query("SELECT CAST(ts AS DATE) AS day, event_type, round(sum(value), 4) AS seconds, count(*) AS n FROM events GROUP BY ALL")
def streaming_day_totals(t: Tables):
    out = I.latest_drained(I.windowed_totals(stream(t), "ts", ["event_type"], "value"), ["window", "event_type"])
    return out.select(F.to_date("window.start").alias("day"), "event_type", F.round("seconds", 4).alias("seconds"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new_ FROM events), s AS (SELECT user_id, ts, sum(new_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(t: Tables):
    """Sessions of activity, in batch: the same expression as on a stream."""
    out = I.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")
    return out.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("started"), "n")


#: steps of a whole job, and seconds without an observation after which a job is over
TOTAL, IDLE = 100, 86_400
#: events that are steps; the others only look at the job
STEPS = ("click", "purchase")


@query(f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, CAST(event_type IN {STEPS} AS BIGINT) AS steps FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {IDLE * 1_000_000} THEN 1 ELSE 0 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS job FROM g),
d AS (SELECT *, sum(steps) OVER w AS done, min(CASE WHEN steps > 0 THEN us END) OVER w AS anchor FROM s WINDOW w AS (PARTITION BY user_id, job ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, min(CASE WHEN done > 1 AND us - anchor >= {P.LEAST_SECONDS * 1_000_000} THEN us END) OVER (PARTITION BY user_id, job, done ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS stamped FROM d),
r AS (SELECT *, (done - 1) / ((stamped - anchor) / 60e6) AS rate FROM m)
SELECT user_id, event_id, CAST(done AS BIGINT) AS done, round(rate, 4) AS per_minute, CAST(floor(greatest(0, {TOTAL} - done) / rate * 60 + 0.5) AS BIGINT) AS eta FROM r""")
def anchored_rates(t: Tables):
    """Rate and remaining time at each event of a user's job, by a stream that is stopped in the middle and started again."""
    events = t.events.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    table = P.RateTable(D.new_folder(t.spark), "user_id", "event_id", "ts", F.col("event_type").isin(*STEPS), TOTAL, IDLE)
    D.in_runs(D.halves(events, "ts"), lambda s: s, lambda stream, root, conf: D.run_batches(stream, root, table.sink))
    return table.told().select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "done", F.round("per_minute", 4).alias("per_minute"), "eta")


@query("SELECT CAST(ts AS DATE) AS day, event_type, round(sum(value), 4) AS seconds, count(*) AS n FROM events GROUP BY ALL")
def resumed_totals(t: Tables):
    """Day totals by a stream that ends in the middle of a day and goes on from its checkpoint."""
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    root = D.in_runs(D.halves(events, "ts"), lambda s: I.windowed_totals(s, "ts", ["event_type"], "value"), D.run_updated)
    out = D.latest(t.spark, root, ["window", "event_type"])
    return out.select(F.to_date("window.start").alias("day"), "event_type", F.round("seconds", 4).alias("seconds"), "n")


#: passes over the queue after the stream's end, and which deliveries fail: a server's every so many-th in a pass
PASSES = 4
FAILS = "(event_id + _pass * 7) % 97 = 13"


def _retry_sql() -> str:
    """Two batches, then passes over what waits; each pass delivers what stands before a server's first failure."""
    parts = ["e AS (SELECT event_id, event_type, ts, epoch_us(ts) <= (SELECT quantile_disc(epoch_us(ts), 0.5) FROM events) AS early FROM events)"]
    for n in range(PASSES):
        new = "SELECT event_id, event_type, ts FROM e WHERE early" if n == 0 else "SELECT event_id, event_type, ts FROM e WHERE NOT early" if n == 1 else None
        rows = " UNION ALL ".join(x for x in (f"SELECT event_id, event_type, ts FROM p{n - 1} WHERE NOT done" if n else None, new) if x)
        fails = FAILS.replace("_pass", str(n))
        parts.append(f"w{n} AS ({rows})")
        parts.append(f"p{n} AS (SELECT *, coalesce(row(ts, event_id) < min(CASE WHEN {fails} THEN row(ts, event_id) END) OVER (PARTITION BY event_type), true) AS done FROM w{n})")
    union = " UNION ALL ".join(f"SELECT event_id, event_type, CAST({n} AS INTEGER) AS n FROM p{n} WHERE done" for n in range(PASSES))
    return f"WITH {', '.join(parts)} {union}"


@query(_retry_sql())
def retried_deliveries(t: Tables):
    """Which pass delivers each event to its server, where some fail; the second batch is run twice, as after a stop."""
    events = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    queue = D.RetryQueue(t.spark, D.new_folder(t.spark), events.schema, "event_type", ["ts"], "event_id", lambda n: F.expr(FAILS.replace("_pass", str(n))))
    D.in_runs(D.halves(events, "ts"), lambda s: s, lambda stream, root, conf: _into(queue, stream, root))
    queue.flush(1, D.halves(events, "ts")[1])
    for n in range(2, PASSES):
        queue.flush(n)
    return queue.delivered().select("event_id", "event_type", F.col("_n").alias("n"))


def _into(queue: D.RetryQueue, stream, root: str) -> None:
    stream.writeStream.foreachBatch(queue.sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
