"""Components, even samples, density windows and titles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import graphs as G
from textloom.operators import joins as J
from textloom.operators import windows as W

from .joining import boxes
from .registry import Tables, query

_BOXES = "b AS (SELECT l_partkey AS page, l_orderkey * 8 + l_linenumber AS id, l_suppkey % 20 AS x1, l_suppkey % 20 + l_quantity AS x2, l_orderkey % 20 AS y1, l_orderkey % 20 + l_linenumber * 4 AS y2, l_returnflag AS side FROM lineitem WHERE l_returnflag <> 'N')"


@query(f"""WITH RECURSIVE {_BOXES}, n AS (SELECT DISTINCT page * 1000000000 + id AS node, page, x1, x2, y1, y2, side FROM b), e AS (SELECT o.node AS a, r.node AS c FROM n o JOIN n r ON o.page = r.page AND o.side = 'A' AND r.side = 'R' AND least(o.x2, r.x2) - greatest(o.x1, r.x1) >= 0.5 * least(o.x2 - o.x1, r.x2 - r.x1) AND least(o.y2, r.y2) - greatest(o.y1, r.y1) >= 0.5 * least(o.y2 - o.y1, r.y2 - r.y1)),
s AS (SELECT a, c FROM e UNION SELECT c, a FROM e), reach AS (SELECT DISTINCT node AS a, node AS c FROM n UNION SELECT reach.a, s.c FROM reach JOIN s ON reach.c = s.a) SELECT a AS id, min(c) AS component FROM reach GROUP BY a""")
def overlap_components(t: Tables):
    c = F.col
    n = boxes(t).withColumn("node", c("page") * 1000000000 + c("id"))
    side = lambda s, x: n.filter(c("side") == s).select("page", *[c(k).alias(x + k) for k in ("node", "x1", "x2", "y1", "y2")])
    p = side("A", "o_").join(side("R", "r_"), "page")
    enough = [J.overlap(c(f"o_{k}1"), c(f"o_{k}2"), c(f"r_{k}1"), c(f"r_{k}2")) >= 0.5 * F.least(c(f"o_{k}2") - c(f"o_{k}1"), c(f"r_{k}2") - c(f"r_{k}1")) for k in "xy"]
    edges = p.filter(enough[0] & enough[1]).select(c("o_node").alias("a"), c("r_node").alias("b"))
    return G.components(n.select(c("node").alias("id")).distinct(), edges)


@query(f"""WITH RECURSIVE {_BOXES}, n AS (SELECT DISTINCT page * 1000000000 + id AS node, page, x1, x2, y1, y2, side FROM b), e AS (SELECT o.node AS a, r.node AS c FROM n o JOIN n r ON o.page = r.page AND o.side = 'A' AND r.side = 'R' AND least(o.x2, r.x2) - greatest(o.x1, r.x1) >= 0.5 * least(o.x2 - o.x1, r.x2 - r.x1) AND least(o.y2, r.y2) - greatest(o.y1, r.y1) >= 0.5 * least(o.y2 - o.y1, r.y2 - r.y1)),
s AS (SELECT a, c FROM e UNION SELECT c, a FROM e), reach AS (SELECT DISTINCT node AS a, node AS c FROM n UNION SELECT reach.a, s.c FROM reach JOIN s ON reach.c = s.a), g AS (SELECT a AS id, min(c) AS component FROM reach GROUP BY a),
k AS (SELECT component, count(DISTINCT CASE WHEN side = 'A' THEN id END) AS read_, count(DISTINCT CASE WHEN side = 'R' THEN id END) AS known FROM g JOIN n ON node = g.id GROUP BY component)
SELECT component, read_, known, CASE WHEN known = 0 THEN 'spurious' WHEN read_ = 0 THEN 'missed' WHEN known = 1 AND read_ = 1 THEN 'one_to_one' WHEN read_ = 1 THEN 'merged' WHEN known = 1 THEN 'split' ELSE 'tangled' END AS kind FROM k""")
def overlap_kinds(t: Tables):
    """What each component of overlapping boxes is: side A was read, side R is known."""
    nodes = boxes(t).select((F.col("page") * 1000000000 + F.col("id")).alias("id"), "side").distinct()
    return G.kinds(overlap_components(t).join(nodes, "id"), "component", F.col("side") == "A")


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS at_, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM r WHERE n <= 5 OR at_ IN (n * 0 // 5, n * 1 // 5, n * 2 // 5, n * 3 // 5, n * 4 // 5)""")
def even_page_sample(t: Tables):
    w = Window.partitionBy("source")
    r = t.documents.select("source", "doc_id", (F.row_number().over(w.orderBy("doc_id")) - 1).alias("at"), F.count("*").over(w).alias("n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(F.col("n") * i / 5))
    return r.filter((F.col("n") <= 5) | F.array_contains(picks, F.col("at").cast("long"))).select("source", "doc_id")


@query("""WITH d AS (SELECT source, doc_id, length(text) AS n, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS odd FROM documents), w AS (SELECT source, doc_id, sum(odd) OVER o / nullif(sum(n) OVER o, 0) AS density, count(*) OVER o AS k FROM d WINDOW o AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT source, doc_id AS first_doc, round(density, 6) AS density FROM w WHERE k = 10 QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(density, 6) DESC, doc_id) = 1""".replace("\\\\", "\\"))
def density_window(t: Tables):
    d = t.documents.select("source", "doc_id", F.length("text").alias("n"), F.length(F.regexp_replace("text", r"[\x00-\x7F]", "")).alias("odd"))
    o = Window.partitionBy("source").orderBy("doc_id").rowsBetween(0, 9)
    w = d.withColumn("density", F.round(F.sum("odd").over(o) / F.nullif(F.sum("n").over(o), F.lit(0)), 6)).withColumn("k", F.count("*").over(o)).filter("k = 10")
    return W.top(w, ["source"], [F.desc("density"), F.asc("doc_id")], 1).select("source", F.col("doc_id").alias("first_doc"), "density")


@query("""WITH k AS (SELECT DISTINCT trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) AS key FROM pages), l AS (SELECT doc_id, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents) SELECT doc_id, key, count(*) AS n FROM l SEMI JOIN k USING (key) WHERE key <> '' GROUP BY ALL""")
def furniture_titles(t: Tables):
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    known = t.pages.select(plain(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("key")).distinct()
    each = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", plain(F.col("line")).alias("key")).filter("key <> ''")
    return each.join(known, "key", "left_semi").groupBy("doc_id", "key").agg(F.count("*").alias("n"))


@query("""SELECT source, doc_id, lang FROM documents WHERE lang IN ('de', 'fr') ORDER BY doc_id DESC""")
def project_list(t: Tables):
    return t.documents.filter(F.col("lang").isin("de", "fr")).orderBy(F.desc("doc_id")).select("source", "doc_id", "lang")


@query("""SELECT l_orderkey, count(*) AS flags, CAST(sum(l_linenumber + 1) AS BIGINT) AS skipped_width, count(*) FILTER (WHERE l_returnflag = 'R') AS severe FROM lineitem GROUP BY l_orderkey""")
def payload_stats(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("flags"), F.sum(F.col("l_linenumber") + 1).alias("skipped_width"), F.count_if(F.col("l_returnflag") == "R").alias("severe"))


@query("""SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b, greatest(0, least(a.l_quantity, b.l_quantity) - greatest(a.l_linenumber, b.l_linenumber)) AS overlap FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""")
def interval_overlap_length(t: Tables):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").distinct()
    b = d.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_quantity").alias("q"))
    line = F.col("l_linenumber").cast("double")
    return d.join(b, ["l_orderkey", "l_linenumber"]).select("l_orderkey", F.col("l_linenumber").alias("line_a"), (F.col("l_linenumber") + 1).alias("line_b"), J.overlap(line, F.col("l_quantity"), line + 1, F.col("q")).alias("overlap"))
