"""Trees, dependency graphs and operation logs. The tree: event n hangs below event n // 3 of the first thousand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import listening as L
from textloom.operators import trees as R
from textloom.operators import windows as W

from .registry import Tables, query

STEPS = "steps AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent, p_type AS action, p_size % 5 = 0 AS stale FROM part)"
UP = "up AS (SELECT id, parent AS ancestor, 1 AS distance FROM steps WHERE parent IS NOT NULL UNION ALL SELECT u.id, s.parent, u.distance + 1 FROM up u JOIN steps s ON s.id = u.ancestor WHERE s.parent IS NOT NULL)"


def steps(t: Tables) -> DataFrame:
    parent = F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3))
    return t.part.select(F.col("p_partkey").alias("id"), parent.alias("parent"), F.col("p_type").alias("action"), (F.col("p_size") % 5 == 0).alias("stale"))


@query(f"WITH RECURSIVE {STEPS}, {UP} SELECT id, ancestor, distance FROM up")
def ancestry(t: Tables):
    return R.ancestors(steps(t))


@query(f"WITH {STEPS} SELECT parent, count(*) AS n, array_agg(id ORDER BY id) AS children FROM steps WHERE parent IS NOT NULL GROUP BY parent")
def children(t: Tables):
    return steps(t).filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("children"))


@query(f"WITH RECURSIVE {STEPS}, {UP} SELECT 7 AS id UNION ALL SELECT id FROM up WHERE ancestor = 7")
def subtree(t: Tables):
    return R.subtree(steps(t), 7)


@query(f"WITH RECURSIVE {STEPS}, {UP} SELECT id, action FROM steps WHERE id <> 7 AND id NOT IN (SELECT id FROM up WHERE ancestor = 7)")
def delete_subtree(t: Tables):
    s = steps(t)
    return s.join(R.subtree(s, 7), "id", "left_anti").select("id", "action")


@query(f"WITH RECURSIVE {STEPS}, {UP}, line AS (SELECT id, ancestor, distance FROM up UNION ALL SELECT id, id, 0 FROM steps) SELECT l.id, s.action, arg_min(s.id, l.distance) AS step FROM line l JOIN steps s ON s.id = l.ancestor WHERE NOT s.stale GROUP BY l.id, s.action")
def standard_in_effect(t: Tables):
    s = steps(t)
    line = R.ancestors(s).unionByName(s.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance")))
    live = s.filter("not stale").select(F.col("id").alias("ancestor"), "action")
    return line.join(live, "ancestor").groupBy("id", "action").agg(F.min_by("ancestor", "distance").alias("step"))


@query(f"WITH RECURSIVE {STEPS}, {UP}, failed AS (SELECT id FROM steps WHERE action = 'PROMO' AND stale) SELECT DISTINCT u.id FROM up u JOIN failed f ON u.ancestor = f.id")
def cascade_cancel(t: Tables):
    s = steps(t)
    return R.below(s, s.filter("action = 'PROMO' and stale").select("id"))


@query("SELECT user_id, arg_max(event_id, epoch_us(ts)) AS position FROM events GROUP BY user_id")
def position(t: Tables):
    return L.last_writer(t.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", F.col("event_id").alias("position"))


@query("""WITH o AS (SELECT user_id, event_id % 40 AS row_id, event_type AS op, ts, event_id FROM events) SELECT user_id, row_id, op, op IN ('error', 'view') AS struck FROM o QUALIFY row_number() OVER (PARTITION BY user_id, row_id ORDER BY ts DESC, event_id DESC) = 1""")
def op_log_fold(t: Tables):
    o = t.events.select("user_id", (F.col("event_id") % 40).alias("row_id"), F.col("event_type").alias("op"), "ts", "event_id")
    return L.last_writer(o, ["user_id", "row_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "row_id", "op", F.col("op").isin("error", "view").alias("struck"))


@query("""WITH r AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'signup') AS reset_at, max(ts) FILTER (WHERE event_type = 'view') AS heard_at FROM events GROUP BY user_id)
SELECT e.user_id, count(*) FILTER (WHERE event_type = 'view' AND (reset_at IS NULL OR ts > reset_at)) AS heard, arg_max(event_id, ts) FILTER (WHERE event_type = 'click') AS bookmark FROM events e JOIN r ON e.user_id = r.user_id GROUP BY e.user_id""")
def record_merge(t: Tables):
    resets = t.events.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("reset_at"))
    e = t.events.join(resets, "user_id", "left")
    fresh = (F.col("event_type") == "view") & (F.col("reset_at").isNull() | (F.col("ts") > F.col("reset_at")))
    click = F.col("event_type") == "click"
    return e.groupBy("user_id").agg(F.count_if(fresh).alias("heard"), F.max_by(F.when(click, F.col("event_id")), F.when(click, F.col("ts"))).alias("bookmark"))


@query("""WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('error', 'signup', 'purchase') GROUP BY user_id) SELECT user_id, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n FROM a FULL JOIN b USING (user_id)""")
def store_merge(t: Tables):
    part = lambda kinds, name: t.events.filter(F.col("event_type").isin(*kinds)).groupBy("user_id").agg(F.count("*").alias(name))
    return part(("click", "view", "purchase"), "left_n").join(part(("error", "signup", "purchase"), "right_n"), "user_id", "full").na.fill(0)


@query(f"WITH {STEPS} SELECT c.id, c.action AS consumes, p.action AS produces, c.action = p.action AS sound FROM steps c JOIN steps p ON c.parent = p.id")
def lineage_check(t: Tables):
    s = steps(t)
    p = s.select(F.col("id").alias("parent"), F.col("action").alias("produces"))
    return s.join(p, "parent").select("id", F.col("action").alias("consumes"), "produces", (F.col("action") == F.col("produces")).alias("sound"))


@query("""WITH q AS (SELECT o_orderkey, o_orderpriority AS resource, o_orderdate FROM orders WHERE o_orderstatus = 'O'), d AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT q.* FROM q JOIN d ON d.o_orderkey = q.o_orderkey - 1) SELECT o_orderkey, resource FROM r QUALIFY row_number() OVER (PARTITION BY resource ORDER BY o_orderdate, o_orderkey) <= CASE WHEN resource = '1-URGENT' THEN 1 ELSE 2 END""")
def ready_set(t: Tables):
    o = t.orders
    done = o.filter("o_orderstatus = 'F'").select((F.col("o_orderkey") + 1).alias("o_orderkey"))
    ready = o.filter("o_orderstatus = 'O'").join(done, "o_orderkey", "left_semi").withColumnRenamed("o_orderpriority", "resource")
    place = F.row_number().over(Window.partitionBy("resource").orderBy("o_orderdate", "o_orderkey"))
    return ready.withColumn("place", place).filter(F.col("place") <= F.when(F.col("resource") == "1-URGENT", 1).otherwise(2)).select("o_orderkey", "resource")


@query("""SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag = 'R')""")
def orphaned_payloads(t: Tables):
    """Orders of which every line is destroyed."""
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "R").alias("gone")).filter("gone").select("l_orderkey")


@query("""SELECT l_orderkey, array_agg(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS chain FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey""")
def chains_without_destroyed(t: Tables):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("chain"))
    live = F.transform(F.filter("chain", lambda x: x["l_returnflag"] != "R"), lambda x: x["l_linenumber"])
    return rows.select("l_orderkey", live.alias("chain")).filter(F.size("chain") > 0)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_step(t: Tables):
    return W.top(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 1).select("o_custkey", "o_orderkey", "o_totalprice")
