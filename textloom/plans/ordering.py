"""Window functions, sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import windows as W

from .registry import Tables, query


@query("""WITH p AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), r AS (SELECT *, sum(CASE WHEN event_type = prev THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run""")
def run_length_groups(t: Tables):
    same = F.col("event_type") == F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return W.runs(t.events, ["user_id"], ["ts", "event_id"], same).groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), r AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM d)
SELECT l_orderkey, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line, count(*) AS n FROM r GROUP BY l_orderkey, island""")
def consecutive_line_runs(t: Tables):
    d = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    island = F.col("l_linenumber") - F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return d.withColumn("island", island).groupBy("l_orderkey", "island").agg(F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"), F.count("*").alias("n")).drop("island")


@query("""WITH p AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, round(avg(CASE WHEN value >= prev THEN 1.0 ELSE 0 END), 6) AS share, bool_and(value > prev) AS rising FROM p WHERE prev IS NOT NULL GROUP BY user_id""")
def monotone_share(t: Tables):
    return W.monotone_share(t.events, ["user_id"], ["ts", "event_id"], "value").withColumn("share", F.round("share", 6))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS nxt FROM l)
SELECT doc_id, count(*) FILTER (WHERE NOT regexp_matches(line, '[.!?:;]\\s*$') AND nxt IS NOT NULL AND NOT regexp_matches(nxt, '^[a-z]')) AS lost, count(*) FILTER (WHERE len(string_split(trim(line), ' ')) <= 3 AND NOT regexp_matches(line, '[.!?]$') AND regexp_matches(nxt, '^[a-z]')) AS broken FROM p GROUP BY doc_id""".replace("\\\\", "\\"))
def lost_continuations(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("nxt", F.lead("line").over(Window.partitionBy("doc_id").orderBy("n")))
    line, nxt = F.col("line"), F.col("nxt")
    lost = ~line.rlike(r"[.!?:;]\s*$") & nxt.isNotNull() & ~nxt.rlike("^[a-z]")
    broken = (F.size(F.split(F.trim(line), " ")) <= 3) & ~line.rlike("[.!?]$") & nxt.rlike("^[a-z]")
    return lines.groupBy("doc_id").agg(F.count_if(lost).alias("lost"), F.count_if(broken).alias("broken"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders)
SELECT o_custkey, o_orderkey FROM c WHERE before < 300000""")
def running_budget(t: Tables):
    return W.within_budget(t.orders, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")], "o_totalprice", 300000).select("o_custkey", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) <= 2""")
def top_per_group(t: Tables):
    return W.top(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_linenumber")], 2).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at_ FROM conversations)
SELECT a.conv_id, a.at_ // 2 AS batch, array_agg(md5(a.text) ORDER BY a.at_) AS items, (SELECT coalesce(array_agg(md5(b.text) ORDER BY b.at_), []) FROM r b WHERE b.conv_id = a.conv_id AND b.at_ < min(a.at_) AND b.at_ >= min(a.at_) - 3) AS context FROM r a GROUP BY a.conv_id, a.at_ // 2""")
def batches_with_context(t: Tables):
    return W.batches_with_context(t.conversations.withColumn("digest", F.md5("text")), ["conv_id"], "turn", "digest", 2)


@query("""WITH c AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, turn AS split_after FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY abs(upto - total / 2.0), turn) = 1""")
def cumulative_split_point(t: Tables):
    w = Window.partitionBy("conv_id")
    c = t.conversations.withColumn("upto", F.sum(F.length("text")).over(w.orderBy("turn"))).withColumn("total", F.sum(F.length("text")).over(w))
    return W.top(c, ["conv_id"], [F.abs(F.col("upto") - F.col("total") / 2.0), F.col("turn")], 1).select("conv_id", F.col("turn").alias("split_after"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice - lag(l_extendedprice) OVER w AS gap_above, lead(l_extendedprice) OVER w - l_extendedprice AS gap_below FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def neighbour_gaps(t: Tables):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    v = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (v - F.lag(v).over(w)).alias("gap_above"), (F.lead(v).over(w) - v).alias("gap_below"))


@query("""WITH s AS (SELECT doc_id, length(text) AS n, text FROM documents), w AS (SELECT doc_id, unnest(range(0, greatest(1, n), 500)) AS start, text FROM s), c AS (SELECT doc_id, start, length(regexp_replace(substr(text, CAST(start AS INTEGER) + 1, 1000), '[^,]', '', 'g')) AS score FROM w)
SELECT doc_id, start, score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) = 1""")
def observation_window(t: Tables):
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.length("text")) - 1, F.lit(500).cast("long")))
    w = t.documents.withColumn("start", starts).withColumn("score", F.length(F.regexp_replace(F.substring(F.col("text"), F.col("start").cast("int") + 1, F.lit(1000)), "[^,]", "")))
    return W.top(w, ["doc_id"], [F.desc("score"), F.asc("start")], 1).select("doc_id", "start", "score")


@query("SELECT label, n, dense_rank() OVER (ORDER BY n DESC, label) AS place FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def relabel_by_size(t: Tables):
    n = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("n"), "label")))


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey")
def title_sort(t: Tables):
    return t.part.orderBy(F.lower("p_name"), "p_partkey").select("p_partkey", "p_name")


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY CASE WHEN n_name = 'NATION_7' THEN 0 ELSE 1 END, n_name) AS place FROM nation")
def pinned_order(t: Tables):
    first = F.when(F.col("n_name") == "NATION_7", 0).otherwise(1)
    return t.nation.select("n_nationkey", "n_name", F.row_number().over(Window.orderBy(first, "n_name")).alias("place"))


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def most_common_words(t: Tables):
    w = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query("SELECT l_orderkey, round(sum(l_extendedprice * l_discount), 2) AS missing FROM lineitem GROUP BY l_orderkey ORDER BY missing DESC, l_orderkey DESC LIMIT 15")
def worst_report(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("missing")).orderBy(F.desc("missing"), F.desc("l_orderkey")).limit(15)


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place FROM lineitem")
def reading_order(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).alias("place"))


@query("SELECT doc_id, md5('7:' || doc_id) AS draw FROM documents ORDER BY draw, doc_id LIMIT 64")
def seeded_sample(t: Tables):
    return t.documents.select("doc_id", F.md5(F.concat(F.lit("7:"), F.col("doc_id"))).alias("draw")).orderBy("draw", "doc_id").limit(64)


@query("SELECT doc_id, source, md5(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def ordered_distinct(t: Tables):
    return W.top(t.documents.select("doc_id", "source", F.md5("text").alias("digest")), ["digest"], [F.col("doc_id")], 1)


@query("""SELECT p_brand, arg_min(p_partkey, (CASE WHEN p_type = 'ECONOMY' THEN 0 WHEN p_name LIKE '%ring%' THEN 1 ELSE 2 END) * 1000000 + length(p_name) * 10000 + p_partkey) AS best FROM part GROUP BY p_brand""")
def best_candidate(t: Tables):
    rank = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_name").contains("ring"), 1).otherwise(2)
    return W.top(t.part, ["p_brand"], [rank * 1000000 + F.length("p_name") * 10000 + F.col("p_partkey")], 1).select("p_brand", F.col("p_partkey").alias("best"))


@query("""WITH used AS (SELECT DISTINCT p_brand, p_size AS n FROM part), next AS (SELECT p_brand, n + 1 AS n FROM used WHERE n >= 2 UNION SELECT DISTINCT p_brand, 2 FROM part) SELECT p_brand, min(n) AS next_free FROM next ANTI JOIN used USING (p_brand, n) GROUP BY p_brand""")
def next_free_name(t: Tables):
    """The least number from 2 that a brand has not used: 2, or the one after a used number."""
    used = t.part.select("p_brand", F.col("p_size").cast("long").alias("n")).distinct()
    following = used.filter("n >= 2").select("p_brand", (F.col("n") + 1).alias("n"))
    free = following.unionByName(used.select("p_brand", F.lit(2).cast("long").alias("n")).distinct())
    return free.join(used, ["p_brand", "n"], "left_anti").groupBy("p_brand").agg(F.min("n").alias("next_free"))


@query("""SELECT event_id, CASE WHEN lag(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) IS DISTINCT FROM user_id THEN user_id END AS shown FROM events""")
def chronological_listing(t: Tables):
    prev = F.lag("user_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return t.events.select("event_id", F.when(~prev.eqNullSafe(F.col("user_id")), F.col("user_id")).alias("shown"))
