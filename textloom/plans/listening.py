"""Listening analytics over `events`: user_id reads, k in props is the book, value is seconds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.times import epoch
from textloom.operators import listening as L
from textloom.operators import measures as M

from .registry import Tables, query


def log(t: Tables):
    book = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", "user_id", "event_type", F.col("ts").alias("at"), F.to_date("ts").alias("day"), book.alias("book"), F.col("value").alias("seconds"))


LOG = "log AS (SELECT event_id, user_id, event_type, ts AS at_, CAST(ts AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS INTEGER) AS book, value AS seconds FROM events)"
HEARD = "heard AS (SELECT * FROM log WHERE event_type <> 'error'), gone AS (SELECT book, max(at_) AS cutoff FROM log WHERE event_type = 'error' GROUP BY book), kept AS (SELECT h.* FROM heard h LEFT JOIN gone g ON h.book = g.book WHERE g.cutoff IS NULL OR h.at_ > g.cutoff)"


def kept_events(t: Tables):
    all_ = log(t)
    return L.after_removals(all_.filter("event_type != 'error'"), all_.filter("event_type = 'error'"), "book")


@query(f"""WITH {LOG}, {HEARD} SELECT 'day' AS level, CAST(day AS VARCHAR) AS day, NULL AS key, round(sum(seconds), 4) AS seconds, count(*) AS n FROM kept GROUP BY day
UNION ALL SELECT 'key', NULL, book, round(sum(seconds), 4), count(*) FROM kept GROUP BY book UNION ALL SELECT 'all', NULL, NULL, round(sum(seconds), 4), count(*) FROM kept""")
def listening_analytics(t: Tables):
    return L.totals(kept_events(t), "day", "book", "seconds").withColumn("seconds", F.round("seconds", 4))


@query(f"""WITH {LOG}, {HEARD} SELECT book, round(sum(seconds), 4) AS seconds, min(day) AS first_day, max(day) AS last_day, arg_max(user_id, event_id) AS latest_user FROM kept GROUP BY book""")
def listening_by_book(t: Tables):
    return kept_events(t).groupBy("book").agg(F.round(F.sum("seconds"), 4).alias("seconds"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max_by("user_id", "event_id").alias("latest_user"))


@query(f"WITH {LOG}, {HEARD} SELECT event_id, user_id, book FROM kept")
def tombstone_anti_join(t: Tables):
    return kept_events(t).select("event_id", "user_id", "book")


@query(f"WITH {LOG} SELECT day, round(sum(seconds), 4) AS seconds, count(*) AS n FROM log GROUP BY day")
def merged_server_totals(t: Tables):
    parts = [log(t).filter(F.col("user_id") % 3 == k).groupBy("day").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n")) for k in range(3)]
    return L.merged_totals(parts, ["day"], ["seconds", "n"]).withColumn("seconds", F.round("seconds", 4))


@query(f"WITH {LOG} SELECT event_id, least(seconds * 60, 3600.0) AS seconds FROM log WHERE seconds > 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seconds) = 1")
def idempotent_ingest(t: Tables):
    twice = log(t).unionByName(log(t)).withColumn("seconds", F.col("seconds") * 60)
    return L.accepted(twice).select("event_id", "seconds")


@query(f"""WITH {LOG} SELECT user_id, book, event_id, event_type FROM log QUALIFY row_number() OVER (PARTITION BY user_id, book ORDER BY at_ DESC, event_id DESC) = 1""")
def last_writer_wins(t: Tables):
    return L.last_writer(log(t), ["user_id", "book"], [F.col("at"), F.col("event_id")]).select("user_id", "book", "event_id", "event_type")


@query(f"""WITH {LOG}, i AS (SELECT user_id, CAST(floor(epoch(at_)) AS BIGINT) AS lo, CAST(floor(epoch(at_)) AS BIGINT) + CAST(seconds * 60 AS BIGINT) AS hi FROM log),
m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM i),
r AS (SELECT *, sum(CASE WHEN reached IS NULL OR lo > reached + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi) AS run FROM m)
SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM r GROUP BY user_id, run""")
def interval_union(t: Tables):
    lo = F.unix_timestamp(F.date_trunc("second", "at"))
    spans = log(t).select("user_id", lo.alias("lo"), (lo + F.round(F.col("seconds") * 60).cast("long")).alias("hi"))
    return L.coalesced(spans, ["user_id"], "lo", "hi")


@query(f"""WITH {LOG} SELECT event_type, coalesce(n, 0) AS n FROM (SELECT unnest(['click', 'view', 'skip', 'error']) AS event_type) LEFT JOIN (SELECT event_type, count(*) AS n FROM log GROUP BY event_type) USING (event_type)""")
def zero_filled_counts(t: Tables):
    levels = t.spark.createDataFrame([("click",), ("view",), ("skip",), ("error",)], "event_type string")
    return L.zero_filled(log(t).groupBy("event_type").agg(F.count("*").alias("n")), levels, ["event_type"], "n")


@query(f"""WITH {LOG}, days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-31' - INTERVAL 13 DAY, DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, coalesce(round(sum(seconds), 4), 0) AS seconds FROM days LEFT JOIN log USING (day) GROUP BY day""")
def day_buckets(t: Tables):
    days = t.spark.sql("SELECT explode(sequence(DATE '2024-01-31' - INTERVAL 13 DAY, DATE '2024-01-31', INTERVAL 1 DAY)) AS day")
    per = log(t).groupBy("day").agg(F.round(F.sum("seconds"), 4).alias("seconds"))
    return days.join(per, "day", "left").select("day", F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


@query(f"WITH {LOG} SELECT CAST(date_trunc('week', day) AS DATE) AS week, CAST(date_trunc('month', day) AS DATE) AS month, round(sum(seconds), 4) AS seconds FROM log GROUP BY ALL")
def week_month_buckets(t: Tables):
    week, month = F.date_trunc("week", "day").cast("date"), F.date_trunc("month", "day").cast("date")
    return log(t).groupBy(week.alias("week"), month.alias("month")).agg(F.round(F.sum("seconds"), 4).alias("seconds"))


@query("""SELECT user_id, count(*) AS samples, max(value) AS hottest, round(avg(value), 1) AS mean_temp, count(*) FILTER (WHERE event_type = 'error') * 20 AS throttled_s FROM events GROUP BY user_id""")
def thermal_summary(t: Tables):
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("samples"), F.max("value").alias("hottest"), (F.round(M.steady_sum("value") / F.count("value") * 10) / 10).alias("mean_temp"), (F.count_if(F.col("event_type") == "error") * 20).alias("throttled_s")
    )


@query("""WITH g AS (SELECT user_id, event_type, event_id, value, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT user_id, count(*) AS samples, max(value) AS hottest, CAST(round(sum(CASE WHEN event_type = 'error' THEN gap END), 0) AS BIGINT) AS throttled_s FROM g GROUP BY user_id""")
def thermal_accumulation(t: Tables):
    seconds = epoch("ts")
    gap = seconds - F.lag(seconds).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("gap", gap).groupBy("user_id").agg(F.count("*").alias("samples"), F.max("value").alias("hottest"), F.round(F.sum(F.when(F.col("event_type") == "error", F.col("gap"))), 0).cast("long").alias("throttled_s"))


@query("""WITH m AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS clamped FROM events) SELECT event_id, clamped FROM m""")
def monotone_clamp(t: Tables):
    return t.events.select("event_id", F.max("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("clamped"))


@query("""WITH a AS (SELECT event_id, user_id, ts, value, CASE WHEN event_type = 'click' THEN epoch(ts) END AS anchor FROM events),
b AS (SELECT *, last_value(anchor IGNORE NULLS) OVER w1 AS before, first_value(anchor IGNORE NULLS) OVER w2 AS after, sum(value) OVER w1 AS mass FROM a
 WINDOW w1 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, max(CASE WHEN anchor IS NOT NULL THEN mass END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m0, min(CASE WHEN anchor IS NOT NULL THEN mass END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m1 FROM b)
SELECT event_id, round(coalesce(anchor, before + (after - before) * (mass - m0) / (m1 - m0)), 1) AS placed FROM c WHERE before IS NOT NULL AND after IS NOT NULL""")
def gap_interpolation(t: Tables):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    # what follows is what stands before in the other order, which a window reads once
    back = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    past, next_ = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (order, back))
    a = t.events.withColumn("anchor", F.when(F.col("event_type") == "click", epoch("ts"))).withColumn("mass", F.sum("value").over(past))
    at_anchor = F.when(F.col("anchor").isNotNull(), F.col("mass"))
    a = a.withColumn("before", F.last("anchor", True).over(past)).withColumn("after", F.last("anchor", True).over(next_)).withColumn("m0", F.max(at_anchor).over(past)).withColumn("m1", F.min(at_anchor).over(next_))
    placed = F.coalesce("anchor", F.col("before") + (F.col("after") - F.col("before")) * (F.col("mass") - F.col("m0")) / (F.col("m1") - F.col("m0")))
    return a.filter("before is not null and after is not null").select("event_id", F.round(placed, 1).alias("placed"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS ahead FROM events""")
def buffered_ahead(t: Tables):
    return t.events.select("event_id", F.round(F.sum("value").over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)), 4).alias("ahead"))


@query("""SELECT event_id, CAST(greatest(0, floor(epoch(coalesce(nxt, TIMESTAMP '2024-02-01')) - epoch(ts))) AS BIGINT) AS elapsed FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)""")
def elapsed_seconds(t: Tables):
    nxt = F.coalesce(F.lead(F.col("ts").cast("timestamp")).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit("2024-02-01").cast("timestamp"))
    return t.events.select("event_id", F.greatest(F.lit(0), F.floor(nxt.cast("double") - epoch("ts"))).cast("long").alias("elapsed"))


@query("""WITH s AS (SELECT event_id, CAST(value * 60 AS BIGINT) AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || 'h ' || CAST(s % 3600 // 60 AS VARCHAR) || 'm' WHEN s >= 60 THEN CAST(s // 60 AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's' ELSE CAST(s AS VARCHAR) || 's' END AS shown FROM s""")
def duration_format(t: Tables):
    s = F.round(F.col("value") * 60).cast("long")
    part = lambda of, unit: F.concat(F.floor(of).cast("string"), F.lit(unit))
    shown = F.when(s >= 3600, F.concat(part(s / 3600, "h "), part(s % 3600 / 60, "m"))).when(s >= 60, F.concat(part(s / 60, "m "), part(s % 60, "s"))).otherwise(part(s, "s"))
    return t.events.select("event_id", shown.alias("shown"))


@query("""SELECT user_id, CAST(sum(value) AS BIGINT) AS completed, count(*) FILTER (WHERE event_type = 'view') AS running, round(100.0 * count(*) FILTER (WHERE event_type = 'purchase') / count(*), 2) AS percent FROM events GROUP BY user_id""")
def worker_progress(t: Tables):
    is_ = lambda x: F.count_if(F.col("event_type") == x)
    return t.events.groupBy("user_id").agg(F.rint(F.sum("value")).cast("long").alias("completed"), is_("view").alias("running"), F.round(100.0 * is_("purchase") / F.count("*"), 2).alias("percent"))


@query("""SELECT user_id, sum(CASE WHEN value > 400 THEN value END) AS seconds FROM events GROUP BY user_id""")
def measurable_duration(t: Tables):
    return t.events.groupBy("user_id").agg(F.sum(F.when(F.col("value") > 400, F.col("value"))).alias("seconds"))


@query("""SELECT array_agg(DISTINCT event_type ORDER BY event_type) AS tags, count(DISTINCT user_id) AS users FROM events""")
def distinct_tags(t: Tables):
    return t.events.agg(F.array_sort(F.collect_set("event_type")).alias("tags"), F.count_distinct("user_id").alias("users"))


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-15'""")
def finished_since(t: Tables):
    return t.events.filter(F.col("event_type").isin("error", "purchase") & (F.col("ts") >= F.lit("2024-01-15").cast("timestamp"))).orderBy(F.desc("ts")).select("event_id", "user_id", "event_type")


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS slot FROM events),
s AS (SELECT event_type, unnest(range(1, 5)) AS slot FROM (SELECT DISTINCT event_type FROM events)) SELECT s.event_type, s.slot, r.event_id FROM s LEFT JOIN r USING (event_type, slot)""")
def lane_occupancy(t: Tables):
    taken = t.events.select("event_type", "event_id", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id")).cast("long").alias("slot"))
    lanes = t.events.select("event_type").distinct().withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))))
    return lanes.join(taken, ["event_type", "slot"], "left").select("event_type", "slot", "event_id")
