"""Join operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.times import epoch
from textloom.operators import joins as J
from textloom.operators import windows as W

from .registry import Tables, query

WORDS_SQL = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


def words(text: str = "text"):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


@query("""SELECT u.conv_id, u.turn, length(u.text) AS n_user, length(coalesce(a.text, '')) AS n_answer, coalesce(a.text, '') <> u.text AS changed FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def chapter_comparison(t: Tables):
    c = t.conversations
    answer = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = c.filter("role = 'user'").join(answer, ["conv_id", "turn"], "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    return both.select("conv_id", "turn", F.length("text").alias("n_user"), F.length("answer").alias("n_answer"), (F.col("answer") != F.col("text")).alias("changed"))


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS_SQL}) AS word FROM documents), v AS (SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 2),
p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+[.] [a-z]+')) AS pair FROM documents), q AS (SELECT DISTINCT doc_id, split_part(pair, '. ', 1) AS a, split_part(pair, '. ', 2) AS b FROM p)
SELECT doc_id, a, b, CASE WHEN j.n IS NOT NULL THEN 'join' WHEN k.n IS NOT NULL THEN 'hyphen' END AS verdict FROM q LEFT JOIN v j ON j.word = a || b LEFT JOIN v k ON k.word = b || a""")
def attestation_join(t: Tables):
    w = t.documents.select(F.explode(words()).alias("word"))
    v = w.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")
    pairs = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+[.] [a-z]+"), F.lit(0))).alias("pair"))
    q = pairs.select("doc_id", F.split_part("pair", F.lit(". "), F.lit(1)).alias("a"), F.split_part("pair", F.lit(". "), F.lit(2)).alias("b")).distinct()
    q = q.join(v.select(F.col("word").alias("_j"), F.col("n").alias("nj")), F.concat("a", "b") == F.col("_j"), "left").join(v.select(F.col("word").alias("_k"), F.col("n").alias("nk")), F.concat("b", "a") == F.col("_k"), "left")
    return q.select("doc_id", "a", "b", F.when(F.col("nj").isNotNull(), "join").when(F.col("nk").isNotNull(), "hyphen").alias("verdict"))


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest({WORDS_SQL}) AS word FROM documents), v AS (SELECT DISTINCT unnest({WORDS_SQL}) AS word FROM benchmark) SELECT doc_id, word FROM w WHERE length(word) >= 6 AND word IN (SELECT word FROM v)""")
def vocabulary_semi_join(t: Tables):
    w = t.documents.select("doc_id", F.explode(words()).alias("word")).filter(F.length("word") >= 6).distinct()
    return w.join(t.benchmark.select(F.explode(words()).alias("word")).distinct(), "word", "left_semi").select("doc_id", "word")


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS_SQL}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL), v AS (SELECT * FROM c WHERE n >= 2 AND length(word) >= 3),
k AS (SELECT doc_id, word, unnest(range(3, length(word) - 2)) AS cut FROM c WHERE length(word) >= 12), h AS (SELECT k.doc_id, k.word, k.cut FROM k JOIN v a ON a.doc_id = k.doc_id AND a.word = substr(k.word, 1, CAST(cut AS INTEGER)) JOIN v b ON b.doc_id = k.doc_id AND b.word = substr(k.word, CAST(cut AS INTEGER) + 1))
SELECT doc_id, word, min(cut) AS cut FROM h GROUP BY ALL""")
def self_vocabulary_split(t: Tables):
    c = t.documents.select("doc_id", F.explode(words()).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    v = c.filter((F.col("n") >= 2) & (F.length("word") >= 3)).select("doc_id", "word")
    k = c.filter(F.length("word") >= 12).select("doc_id", F.col("word").alias("whole"), F.explode(F.sequence(F.lit(3), F.length("word") - 3)).alias("cut"))
    k = k.withColumn("left", F.expr("substring(whole, 1, cut)")).withColumn("right", F.expr("substring(whole, cut + 1)"))
    k = k.join(v.withColumnRenamed("word", "left"), ["doc_id", "left"], "left_semi").join(v.withColumnRenamed("word", "right"), ["doc_id", "right"], "left_semi")
    return k.groupBy("doc_id", F.col("whole").alias("word")).agg(F.min("cut").alias("cut"))


def _shingle_sql(table: str, id_: str, n: int) -> str:
    return f"(SELECT {id_}, s - 1 AS pos, array_to_string(ws[s : s + {n - 1}], ' ') AS shingle FROM (SELECT {id_}, ws, unnest(range(1, len(ws) - {n} + 2)) AS s FROM (SELECT {id_}, {WORDS_SQL} AS ws FROM {table}) WHERE len(ws) >= {n}))"


@query(f"""WITH a AS (SELECT shingle, min(doc_id) AS doc_id, min(pos) AS pos_a FROM {_shingle_sql('documents', 'doc_id', 5)} GROUP BY shingle HAVING count(*) = 1), b AS (SELECT shingle, min(item_id) AS item_id, min(pos) AS pos_b FROM {_shingle_sql('benchmark', 'item_id', 5)} GROUP BY shingle HAVING count(*) = 1)
SELECT doc_id, item_id, pos_a, pos_b FROM a JOIN b USING (shingle)""")
def unique_shingle_anchors(t: Tables):
    a, b = J.shingles(t.documents, "doc_id", words(), 5), J.shingles(t.benchmark, "item_id", words(), 5)
    # only benchmark shingles can be anchors, so the document side shrinks before it is counted
    a = a.join(b.select("shingle").distinct(), "shingle", "left_semi")
    return J.unique_anchors(a, b, "doc_id", "item_id").select("doc_id", "item_id", "pos_a", "pos_b")


@query(f"""WITH a AS {_shingle_sql('documents', 'doc_id', 4)}, b AS {_shingle_sql('benchmark', 'item_id', 4)}, r AS (SELECT shingle FROM b GROUP BY shingle HAVING count(*) <= 4)
SELECT doc_id, item_id, a.pos - b.pos AS "offset", count(*) AS votes FROM a JOIN b USING (shingle) SEMI JOIN r USING (shingle) GROUP BY ALL HAVING count(*) >= 2""")
def offset_votes(t: Tables):
    a, b = J.shingles(t.documents, "doc_id", words(), 4), J.shingles(t.benchmark, "item_id", words(), 4)
    return J.offset_votes(a, b, "doc_id", "item_id", 4).filter("votes >= 2")


@query(f"""WITH a AS {_shingle_sql('documents', 'doc_id', 5)}, b AS {_shingle_sql('benchmark', 'item_id', 5)}, r AS (SELECT shingle FROM b GROUP BY shingle HAVING count(*) <= 4), v AS (SELECT item_id, doc_id, CAST(floor((a.pos - b.pos) / 50.0) * 50 AS BIGINT) AS place, count(*) AS votes FROM a JOIN b USING (shingle) SEMI JOIN r USING (shingle) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, doc_id, place) AS n, lead(votes) OVER (PARTITION BY item_id ORDER BY votes DESC, doc_id, place) AS second FROM v) SELECT item_id, doc_id, place, votes, coalesce(second >= 0.6 * votes, false) AS ambiguous FROM k WHERE n = 1""")
def clip_anchoring(t: Tables):
    a, b = J.shingles(t.documents, "doc_id", words(), 5), J.shingles(t.benchmark, "item_id", words(), 5)
    votes = J.offset_votes(a, b, "doc_id", "item_id", 4, 50).withColumnRenamed("offset", "place")
    order = Window.partitionBy("item_id").orderBy(F.desc("votes"), "doc_id", "place")
    ranked = votes.withColumn("second", F.lead("votes").over(order))
    best = W.top(ranked, ["item_id"], [F.desc("votes"), F.asc("doc_id"), F.asc("place")], 1)
    return best.select("item_id", "doc_id", "place", "votes", F.coalesce(F.col("second") >= 0.6 * F.col("votes"), F.lit(False)).alias("ambiguous"))


@query("""WITH s AS (SELECT event_id AS cue, user_id, epoch(ts) AS lo, epoch(ts) + value * 60 AS hi FROM events WHERE event_type = 'view'), p AS (SELECT event_id, user_id AS reader, epoch(ts) AS at_ FROM events WHERE event_type = 'click')
SELECT event_id, cue FROM p JOIN s ON reader = user_id AND at_ >= lo AND at_ < hi""")
def interval_containment(t: Tables):
    spans = t.events.filter("event_type = 'view'").select(F.col("event_id").alias("cue"), "user_id", epoch("ts").alias("lo"), (epoch("ts") + F.col("value") * 60).alias("hi"))
    points = t.events.filter("event_type = 'click'").select("event_id", "user_id", epoch("ts").alias("second"))
    return J.contained(points, F.col("second"), spans, "lo", "hi", 3600.0, ["user_id"]).select("event_id", "cue")


_BOXES = "SELECT l_partkey AS page, l_orderkey * 8 + l_linenumber AS id, l_suppkey % 20 AS x1, l_suppkey % 20 + l_quantity AS x2, l_orderkey % 20 AS y1, l_orderkey % 20 + l_linenumber * 4 AS y2, l_returnflag AS side FROM lineitem WHERE l_returnflag <> 'N'"


def boxes(t: Tables):
    x, y = F.col("l_suppkey") % 20, F.col("l_orderkey") % 20
    li = t.lineitem.filter("l_returnflag <> 'N'")
    return li.select(F.col("l_partkey").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), x.alias("x1"), (x + F.col("l_quantity")).alias("x2"), y.alias("y1"), (y + F.col("l_linenumber") * 4).alias("y2"), F.col("l_returnflag").alias("side"))


@query(f"""WITH b AS ({_BOXES}), p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS ox, greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS oy, least(a.x2 - a.x1, b.x2 - b.x1) AS w, least(a.y2 - a.y1, b.y2 - b.y1) AS h FROM b a JOIN b b ON a.page = b.page AND a.side = 'A' AND b.side = 'R')
SELECT a, b, round(ox * oy, 4) AS area FROM p WHERE ox >= 0.5 * w AND oy >= 0.5 * h""")
def box_overlap(t: Tables):
    b = boxes(t)
    side = lambda s, x: b.filter(F.col("side") == s).select("page", *[F.col(c).alias(x + c) for c in ("id", "x1", "x2", "y1", "y2")])
    c = F.col
    p = side("A", "a_").join(side("R", "b_"), "page")
    ox, oy = J.overlap(c("a_x1"), c("a_x2"), c("b_x1"), c("b_x2")), J.overlap(c("a_y1"), c("a_y2"), c("b_y1"), c("b_y2"))
    w, h = F.least(c("a_x2") - c("a_x1"), c("b_x2") - c("b_x1")), F.least(c("a_y2") - c("a_y1"), c("b_y2") - c("b_y1"))
    return p.filter((ox >= 0.5 * w) & (oy >= 0.5 * h)).select(c("a_id").alias("a"), c("b_id").alias("b"), F.round(ox * oy, 4).alias("area"))


@query(f"""WITH b AS ({_BOXES}), p AS (SELECT a.id AS word, b.id AS line, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS area, (a.x2 - a.x1) * (a.y2 - a.y1) AS own FROM b a JOIN b b ON a.page = b.page AND a.side = 'A' AND b.side = 'R')
SELECT word, line FROM p WHERE area >= 0.3 * own QUALIFY row_number() OVER (PARTITION BY word ORDER BY area DESC, line) = 1""")
def word_to_line(t: Tables):
    b = boxes(t)
    side = lambda s, x: b.filter(F.col("side") == s).select("page", *[F.col(c).alias(x + c) for c in ("id", "x1", "x2", "y1", "y2")])
    c = F.col
    area = J.overlap(c("a_x1"), c("a_x2"), c("b_x1"), c("b_x2")) * J.overlap(c("a_y1"), c("a_y2"), c("b_y1"), c("b_y2"))
    p = side("A", "a_").join(side("R", "b_"), "page").withColumn("area", area).filter(c("area") >= 0.3 * (c("a_x2") - c("a_x1")) * (c("a_y2") - c("a_y1")))
    return W.top(p.select(c("a_id").alias("word"), c("b_id").alias("line"), "area"), ["word"], [F.desc("area"), F.asc("line")], 1).select("word", "line")


@query("""SELECT p.event_id, arg_max(e.event_id, e.ts) AS last_error FROM events p LEFT JOIN events e ON e.user_id = p.user_id AND e.event_type = 'error' AND e.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def as_of_join(t: Tables):
    e = t.events.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("last_error"))
    return J.as_of(t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e, "user_id", "ts", ["last_error"]).select("event_id", "last_error")


@query("""WITH a AS (SELECT p_brand, min(p_type) AS p_type FROM part GROUP BY p_brand) SELECT p_partkey, a.p_type AS target FROM part JOIN a USING (p_brand)""")
def alias_lookup(t: Tables):
    aliases = t.part.groupBy("p_brand").agg(F.min("p_type").alias("target"))
    return t.part.join(J.checked_aliases(aliases, "p_brand", "target"), "p_brand").select("p_partkey", "target")


@query("SELECT n_regionkey, array_agg(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def multimap_inversion(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))


@query("SELECT p_brand, p_size, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS p_type, CASE WHEN count(DISTINCT p_type) > 1 THEN 'ambiguous' END AS refused FROM part GROUP BY p_brand, p_size")
def resolve_or_refuse(t: Tables):
    return J.one_or_refuse(t.part, ["p_brand", "p_size"], "p_type")


@query("""WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) % 7 AS sig FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) % 7 AS sig FROM conversations WHERE role = 'assistant')
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, CASE WHEN count(*) FILTER (WHERE a.n IS NULL OR b.n IS NULL) > 0 THEN 'count' WHEN NOT bool_and(a.sig = b.sig) THEN 'signature' ELSE 'paired' END AS pairing FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.n = b.n GROUP BY 1""")
def positional_pairing(t: Tables):
    def side(role: str, x: str):
        n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
        return t.conversations.filter(F.col("role") == role).select("conv_id", n.alias("n"), (F.length("text") % 7).alias(f"sig_{x}"))

    both = side("user", "a").join(side("assistant", "b"), ["conv_id", "n"], "full")
    lone = F.count_if(F.col("sig_a").isNull() | F.col("sig_b").isNull())
    return both.groupBy("conv_id").agg(F.when(lone > 0, "count").when(~F.bool_and(F.col("sig_a") == F.col("sig_b")), "signature").otherwise("paired").alias("pairing"))


@query(f"""WITH h AS (SELECT page_id, list_distinct(list_filter(string_split_regex(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+'), lambda w: w <> '')) AS ws FROM pages), b AS (SELECT item_id, list_distinct({WORDS_SQL}) AS ws FROM benchmark),
s AS (SELECT page_id, item_id, round(len(list_intersect(h.ws, b.ws)) / least(len(h.ws), len(b.ws)), 6) AS score FROM h JOIN b ON len(h.ws) > 0 AND len(b.ws) > 0)
SELECT page_id, item_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, item_id) = 1""")
def title_match(t: Tables):
    """The benchmark item that shares most of a page title's words; pairs meet over shared words only."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    h = t.pages.select("page_id", F.array_distinct(F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda w: w != "")).alias("hw"))
    b = t.benchmark.select("item_id", F.array_distinct(words()).alias("bw"))
    met = h.withColumn("w", F.explode("hw")).join(b.withColumn("w", F.explode("bw")), "w").groupBy("page_id", "item_id").agg(F.count("*").alias("shared"), F.first(F.least(F.size("hw"), F.size("bw"))).alias("least"))
    scored = met.withColumn("score", F.round(F.col("shared") / F.col("least"), 6))
    return W.top(scored, ["page_id"], [F.desc("score"), F.asc("item_id")], 1).select("page_id", "item_id", "score")
