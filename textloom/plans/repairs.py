"""Repairs, edit lists, answers and rates over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.times import epoch
from textloom.operators import measures as M
from textloom.operators import repairs as R

from .joining import boxes
from .registry import Tables, query

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), p AS (SELECT doc_id, n, line, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS nxt FROM l)"


def lines(t: Tables):
    each = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    return each.withColumn("nxt", F.lead("line").over(Window.partitionBy("doc_id").orderBy("n")))


@query(f"""WITH {_LINES} SELECT doc_id, n, md5(CASE WHEN regexp_matches(line, '[a-z]-$') AND regexp_matches(nxt, '^[a-z]') THEN line || nxt ELSE line || ' ' || nxt END) AS digest FROM p WHERE nxt IS NOT NULL""")
def line_joins(t: Tables):
    return lines(t).filter("nxt is not null").select("doc_id", "n", F.md5(R.joined_line(F.col("line"), F.col("nxt"))).alias("digest"))


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, n, rtrim(regexp_replace(line, '[ ]*\\|[ ]*$', '')) AS cut, line FROM p) SELECT doc_id, n, md5(CASE WHEN trim(cut) <> '' THEN cut ELSE line END) AS digest FROM c""".replace("\\\\", "\\"))
def band_edges(t: Tables):
    return lines(t).select("doc_id", "n", F.md5(R.without_edge_bar(F.col("line"))).alias("digest"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) SELECT doc_id, count(*) FILTER (WHERE trim(w, '.,;:!?"''()[]') <> w) AS edged, count(DISTINCT trim(w, '.,;:!?"''()[]')) AS forms FROM w GROUP BY doc_id""")
def token_edges(t: Tables):
    w = t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return w.groupBy("doc_id").agg(F.count_if(R.bare_edges(F.col("w")) != F.col("w")).alias("edged"), F.count_distinct(R.bare_edges(F.col("w"))).alias("forms"))


@query("""WITH v AS (SELECT doc_id, text AS ocr, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN lower(text) WHEN 2 THEN replace(text, '.', ' . ') ELSE text || 'x' END AS truth FROM documents)
SELECT doc_id, CASE WHEN ocr = truth THEN NULL WHEN lower(ocr) = lower(truth) THEN 'case' WHEN regexp_replace(lower(ocr), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(truth), '[^a-z0-9]+', '', 'g') THEN 'typography' END AS lie FROM v""".replace("\\\\", "\\"))
def inverted_lies(t: Tables):
    c, k = F.col("text"), F.col("doc_id") % 4
    truth = F.when(k == 0, c).when(k == 1, F.lower(c)).when(k == 2, F.replace(c, F.lit("."), F.lit(" . "))).otherwise(F.concat(c, F.lit("x")))
    return t.documents.select("doc_id", R.lie(c, truth).alias("lie"))


@query("""WITH v AS (SELECT doc_id, text AS ocr, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^([^ ]*) ', '\\1') ELSE text || '.' END AS truth FROM documents) SELECT doc_id, md5(CASE WHEN replace(ocr, ' ', '') = replace(truth, ' ', '') AND length(truth) < length(ocr) THEN ocr ELSE truth END) AS digest FROM v""")
def space_loss(t: Tables):
    c = F.col("text")
    truth = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(c, "^([^ ]*) ", "$1")).otherwise(F.concat(c, F.lit(".")))
    return t.documents.select("doc_id", F.md5(R.undo_space_loss(c, truth)).alias("digest"))


@query(
    "SELECT doc_id, regexp_matches(text, '\\p{L}!\\p{L}') AS ligature, md5("
    + "replace(" * len(R.ABBREVIATIONS)
    + "text || ' Mr. Li of the U.S.A. met Dr. Wu, vs. Co., at 5 p.m.'"
    + "".join(f", '{a}', '{a.replace('.', '')}')" for a in R.ABBREVIATIONS)
    + ") AS plain FROM documents"
)
def ligatures_and_abbreviations(t: Tables):
    """The documents have few abbreviations, so each text gets a sentence of them."""
    text = F.concat("text", F.lit(" Mr. Li of the U.S.A. met Dr. Wu, vs. Co., at 5 p.m."))
    return t.documents.select("doc_id", R.letter_inside(F.col("text")).alias("ligature"), F.md5(R.without_stops(text)).alias("plain"))


@query("SELECT c_custkey, trim(regexp_replace(regexp_replace(c_name || 'Of' || c_mktsegment, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_#]+', ' ', 'g')) AS name FROM customer".replace("\\\\", "\\"))
def humanized_names(t: Tables):
    return t.customer.select("c_custkey", R.humanized(F.concat("c_name", F.lit("Of"), "c_mktsegment")).alias("name"))


@query(r"""WITH q AS (SELECT c.conv_id, c.turn, regexp_extract(regexp_replace(c.text, '[^ -~]', '', 'g'), '^[^.]*[.]?') AS quote, regexp_replace(d.text, '[^ -~]', '', 'g') AS text FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn IN (c.turn, c.turn + 1)),
n AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(quote), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS q, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS t FROM q),
w AS (SELECT *, string_split(t, ' ') AS ws, len(string_split(q, ' ')) AS n FROM n)
SELECT conv_id, turn, round(CASE WHEN length(q) < 3 OR length(t) < 3 THEN 0 WHEN contains(t, q) THEN 1 WHEN length(left(q, 50)) >= 15 AND contains(t, left(q, 50)) THEN 0.96 WHEN length(left(q, 25)) >= 15 AND contains(t, left(q, 25)) THEN 0.92
  ELSE coalesce(list_max(flatten(list_transform(list_filter(range(n - 2, n + 3), lambda k: k >= 1 AND k <= len(ws)), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: 1 - levenshtein(q, array_to_string(ws[i : i + k - 1], ' ')) / greatest(length(q), length(array_to_string(ws[i : i + k - 1], ' '))))))), 0) END, 6) AS score FROM w""")
def quote_scores(t: Tables):
    """The first sentence of each turn as a quote from its own turn and from the next; ASCII, where DuckDB's distance counts alike."""
    c = t.conversations.withColumn("text", F.regexp_replace("text", "[^ -~]", ""))
    d = c.select("conv_id", F.col("text").alias("other"), F.explode(F.array("turn", F.col("turn") - 1)).alias("turn"))
    quote = F.regexp_extract("text", "^[^.]*[.]?", 0)
    # windows are dear, turns are few: dealt to all tasks
    both = c.join(d, ["conv_id", "turn"]).repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn", "other")
    return both.select("conv_id", "turn", F.round(R.quote_score(quote, F.col("other")), 6).alias("score"))


@query()
def quoted_turns(t: Tables):
    """Whether the first sentence of each turn is quoted by the next turn, over whole texts; tested against a plain walk."""
    c = t.conversations
    following = c.select("conv_id", F.col("text").alias("other"), (F.col("turn") - 1).alias("turn"))
    quote = F.regexp_extract("text", "^[^.]*[.]?", 0)
    both = c.join(following, ["conv_id", "turn"]).repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn", "other")
    return both.select("conv_id", "turn", R.is_quoted(quote, F.col("other")).alias("quoted"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 3) AS ws FROM documents) SELECT doc_id, CASE WHEN len(ws) > 0 THEN round(len(list_filter(ws, lambda w: regexp_matches(w, '[aeiouy]') AND NOT regexp_matches(w, '[bcdfghjklmnpqrstvwxz]{4}'))) / len(ws), 6) ELSE 0 END AS share FROM w WHERE ws IS NOT NULL""")
def english_share(t: Tables):
    return t.documents.filter("text is not null").select("doc_id", F.round(R.vowel_share(F.split(F.lower("text"), "[^a-z]+")), 6).alias("share"))


@query(r"""WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents)
SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE w IN (SELECT word FROM d) OR rtrim(w, 's') IN (SELECT word FROM d) OR w || 's' IN (SELECT word FROM d)) AS known FROM w GROUP BY doc_id""")
def dictionary_share(t: Tables):
    """Words that a dictionary holds, as they are, without their last s or with one more; each form is an equi-join."""
    known = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    words = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    forms = words.select("w").distinct().withColumn("form", F.explode(F.array("w", F.rtrim("w", F.lit("s")), F.concat("w", F.lit("s")))))
    held = forms.join(known, forms.form == known.word, "left_semi").select(F.col("w").alias("k")).distinct()
    both = words.join(held, words.w == held.k, "left")
    return both.groupBy("doc_id").agg(F.sum("n").alias("words"), F.sum(F.when(F.col("k").isNotNull(), F.col("n")).otherwise(0)).alias("known"))


@query("SELECT p_brand, CASE WHEN count(*) FILTER (WHERE p_size > 45) = 0 THEN 'none' ELSE string_agg(p_name || ' → ' || p_type, chr(10) ORDER BY p_partkey) FILTER (WHERE p_size > 45) END AS edits, count(*) FILTER (WHERE p_size > 45) AS n FROM part GROUP BY p_brand")
def edit_lists(t: Tables):
    large = F.when(F.col("p_size") > 45, F.struct("p_partkey", F.col("p_name").alias("before"), F.col("p_type").alias("after")))
    grouped = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_list(large)).alias("pairs")).withColumn("edits", R.edit_lines(F.col("pairs")))
    return grouped.select("p_brand", "edits", F.size(R.parsed_edits(F.col("edits"))).cast("long").alias("n"))


@query("""SELECT conv_id, turn % 3 AS n, arg_max(md5(trim(text)), turn) AS paragraph FROM conversations GROUP BY ALL""")
def block_answers(t: Tables):
    marked = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("<<<"), (x["turn"] % 3).cast("string"), F.lit(">>>"), x["text"]))
    whole = t.conversations.groupBy("conv_id").agg(F.array_join(marked, "").alias("text"))
    return whole.select("conv_id", F.explode(R.answers(F.col("text"))).alias("a")).select("conv_id", F.col("a.n").cast("long").alias("n"), F.md5("a.paragraph").alias("paragraph"))


@query("SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 4 < 3 THEN p_size END AS page FROM part")
def toc_lines(t: Tables):
    """Parts as lines of a table of contents: with leaders, a wide gap, a single space, and without a page."""
    gap = F.element_at(F.array(*map(F.lit, (" ..... ", "    ", " "))), (F.pmod(F.col("p_partkey"), F.lit(4)) + 1).cast("int"))
    line = F.when(F.col("p_partkey") % 4 < 3, F.concat("p_name", F.when(F.col("p_partkey") % 4 < 3, gap), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    return t.part.withColumn("entry", R.toc_entry(line)).select("p_partkey", "entry.title", "entry.page")


@query("""WITH m AS (SELECT page_id, generate_subscripts(regexp_extract_all(html, '[a-z]{3,} [a-z]{3,}'), 1) AS n, unnest(regexp_extract_all(html, '[a-z]{3,} [a-z]{3,}')) AS hit FROM pages) SELECT page_id, count(*) AS hits, count(DISTINCT hit) AS kinds FROM m GROUP BY page_id""")
def regex_span_search(t: Tables):
    m = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("[a-z]{3,} [a-z]{3,}"), F.lit(0))).alias("hit"))
    return m.groupBy("page_id").agg(F.count("*").alias("hits"), F.count_distinct("hit").alias("kinds"))


@query("""WITH n AS (SELECT 'no-guard' AS policy, 100 AS most UNION ALL SELECT 'whole-unit', 20 UNION ALL SELECT 'per-run', 50), s AS (SELECT p_partkey, p_size AS edits, length(p_name) AS n FROM part)
SELECT policy, count(*) FILTER (WHERE edits <= most) AS accepted, round(sum(CASE WHEN edits <= most THEN edits ELSE 0 END) / sum(n), 6) AS rate FROM s, n GROUP BY policy""")
def policy_comparison(t: Tables):
    policies = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(m).alias("most")) for p, m in (("no-guard", 100), ("whole-unit", 20), ("per-run", 50))])
    s = t.part.select(F.col("p_size").alias("edits"), F.length("p_name").alias("n"), F.explode(policies).alias("p")).select("edits", "n", "p.*")
    ok = F.col("edits") <= F.col("most")
    return s.groupBy("policy").agg(F.count_if(ok).alias("accepted"), F.round(F.sum(F.when(ok, F.col("edits")).otherwise(0)) / F.sum("n"), 6).alias("rate"))


@query("""WITH c AS (SELECT p_size / 50.0 AS cer FROM part), b AS (SELECT CASE WHEN cer <= 0.02 THEN '<=0.02' WHEN cer <= 0.05 THEN '<=0.05' WHEN cer <= 0.1 THEN '<=0.1' WHEN cer <= 0.2 THEN '<=0.2' WHEN cer <= 0.3 THEN '<=0.3' ELSE 'over' END AS bucket, count(*) AS n FROM c GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM (SELECT unnest(['<=0.02', '<=0.05', '<=0.1', '<=0.2', '<=0.3', 'over']) AS bucket) LEFT JOIN b USING (bucket)""")
def cer_histogram(t: Tables):
    return M.histogram(t.part, F.col("p_size") / 50.0, [0.02, 0.05, 0.1, 0.2, 0.3])


_BOXES = "b AS (SELECT l_partkey AS page, l_orderkey * 8 + l_linenumber AS id, l_suppkey % 20 AS x1, l_suppkey % 20 + l_quantity AS x2, l_orderkey % 20 AS y1, l_orderkey % 20 + l_linenumber * 4 AS y2, l_returnflag AS side FROM lineitem WHERE l_returnflag <> 'N')"


@query(f"""WITH {_BOXES}, p AS (SELECT n.id AS new_id, o.id AS old_id, o.x1 - 2 <= n.x1 AND o.x2 + 2 >= n.x2 AND o.y1 - 2 <= n.y1 AND o.y2 + 2 >= n.y2 AS inside, greatest(0, least(n.x2, o.x2) - greatest(n.x1, o.x1)) * greatest(0, least(n.y2, o.y2) - greatest(n.y1, o.y1)) AS area, (n.x2 - n.x1) * (n.y2 - n.y1) AS own FROM b n JOIN b o ON n.page = o.page AND n.side = 'A' AND o.side = 'R')
SELECT new_id, old_id, inside FROM p WHERE inside OR area >= 0.5 * own QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN 0 ELSE -area END, old_id) = 1""")
def label_projection(t: Tables):
    b, c = boxes(t), F.col
    side = lambda s, x: b.filter(c("side") == s).select("page", *[c(k).alias(x + k) for k in ("id", "x1", "x2", "y1", "y2")])
    p = side("A", "n_").join(side("R", "o_"), "page")
    inside = (c("o_x1") - 2 <= c("n_x1")) & (c("o_x2") + 2 >= c("n_x2")) & (c("o_y1") - 2 <= c("n_y1")) & (c("o_y2") + 2 >= c("n_y2"))
    gap = lambda k: F.greatest(F.lit(0), F.least(c(f"n_{k}2"), c(f"o_{k}2")) - F.greatest(c(f"n_{k}1"), c(f"o_{k}1")))
    p = p.withColumn("inside", inside).withColumn("area", gap("x") * gap("y")).filter(c("inside") | (c("area") >= 0.5 * (c("n_x2") - c("n_x1")) * (c("n_y2") - c("n_y1"))))
    order = Window.partitionBy("n_id").orderBy(F.when(c("inside"), 0).otherwise(1), F.when(c("inside"), 0).otherwise(-c("area")), "o_id")
    return p.withColumn("k", F.row_number().over(order)).filter("k = 1").select(c("n_id").alias("new_id"), c("o_id").alias("old_id"), "inside")


@query("""WITH d AS (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER w) AS dt, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(least(8.0, greatest(0.8, sum(value) / sum(dt))), 6) AS rate FROM d WHERE dt < 36000 GROUP BY user_id""")
def narration_rate(t: Tables):
    dt = epoch("ts") - F.lag(epoch("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    close = t.events.select("user_id", "value", dt.alias("dt")).filter("dt < 36000")
    return close.groupBy("user_id").agg(F.round(F.least(F.lit(8.0), F.greatest(F.lit(0.8), F.sum("value") / F.sum("dt"))), 6).alias("rate"))


@query("""WITH p AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_id FROM events), r AS (SELECT *, sum(CASE WHEN prev IS NULL OR value < prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, round((max(value) - min(value)) / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 8) AS rate FROM r GROUP BY user_id, run HAVING count(*) > 1""")
def conversion_rates(t: Tables):
    """Rates between the points where a count falls and so starts anew."""
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.lag("value").over(over).isNull() | (F.col("value") < F.lag("value").over(over))
    r = t.events.withColumn("fresh", F.when(fresh, 1).otherwise(0)).withColumn("run", F.sum("fresh").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    seconds = epoch(F.max("ts")) - epoch(F.min("ts"))
    return r.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.round((F.max("value") - F.min("value")) / F.nullif(seconds, F.lit(0.0)), 8).alias("rate")).filter("n > 1")


@query("""SELECT o_custkey, round(sum(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0 END * o_totalprice) / sum(o_totalprice) * 100, 4) AS percent FROM orders GROUP BY o_custkey""")
def stage_weighted_progress(t: Tables):
    done = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0)
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum(done * F.col("o_totalprice")) / F.sum("o_totalprice") * 100, 4).alias("percent"))
