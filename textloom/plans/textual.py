"""String scalars over documents, pages, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X

from .registry import Tables, query

_HTML = [("(?is)<(script|style|head|title)[^>]*>.*?</(script|style|head|title)>", " "), ("(?i)<(p|div|br|li|h[1-6]|tr|ul|ol|table|section|article|nav|footer|header)[^>]*>", "\n"), ("<[^>]*>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), ("[ \t]+", " "), (" ?\n ?", "\n"), ("\n{2,}", "\n")]


def _html_sql() -> str:
    out = "html"
    for pattern, new in _HTML:
        flags = "gs" if pattern.startswith("(?is)") else "g"
        out = f"regexp_replace({out}, '{pattern}', '{new.replace(chr(39), chr(39) * 2)}', '{flags}')"
    return out


@query(f"SELECT page_id, md5({_html_sql()}) AS digest, length({_html_sql()}) AS n FROM pages")
def html_to_text(t: Tables):
    c = F.col("html")
    for pattern, new in _HTML:
        c = F.regexp_replace(c, pattern, new)
    return t.pages.select("page_id", c.alias("text")).select("page_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


@query("""SELECT doc_id, pos, md5(block) AS digest FROM (SELECT doc_id, unnest(string_split_regex(text, '\n+')) AS block, generate_subscripts(string_split_regex(text, '\n+'), 1) - 1 AS pos FROM documents) WHERE block <> ''""")
def text_blocks(t: Tables):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n+")).alias("pos", "block")).filter("block <> ''").select("doc_id", "pos", F.md5("block").alias("digest"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_name), 'red')")
def loose_search(t: Tables):
    return t.part.filter(X.loosely_matches(F.col("p_name"), F.lit("Red  ring"))).select("p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 1000 AND contains(lower(c_name), '7')")
def faceted_filter(t: Tables):
    return t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 1000) & X.loosely_matches(F.col("c_name"), F.lit("7"))).select("c_custkey", "c_name")


@query("SELECT page_id, CASE WHEN length(url) < 5 THEN true WHEN length(url) > 500 THEN false ELSE regexp_matches(lower(url), 'page=|ref=|[?]|#') END AS boilerplate FROM pages")
def boilerplate_predicate(t: Tables):
    url = F.col("url")
    return t.pages.select("page_id", F.when(F.length(url) < 5, True).when(F.length(url) > 500, False).otherwise(F.lower(url).rlike("page=|ref=|[?]|#")).alias("boilerplate"))


@query("""WITH r AS (SELECT min(p_size) AS lo, max(p_size) AS hi, min(p_retailprice) AS p0, max(p_retailprice) AS p1, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS kind FROM part WHERE p_partkey IN (3, 14, 159)) SELECT p_partkey FROM part, r WHERE p_size BETWEEN lo AND hi AND p_retailprice BETWEEN p0 AND p1 AND (kind IS NULL OR p_type = kind)""")
def query_by_example(t: Tables):
    """A predicate learned from three sample rows: ranges, and a value where they agree; null constrains nothing."""
    r = t.part.filter(F.col("p_partkey").isin(3, 14, 159)).agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.min("p_retailprice").alias("p0"), F.max("p_retailprice").alias("p1"), F.when(F.count_distinct("p_type") == 1, F.min("p_type")).alias("kind")).first()
    same = F.lit(True) if r["kind"] is None else F.col("p_type") == r["kind"]
    return t.part.filter(F.col("p_size").between(r["lo"], r["hi"]) & F.col("p_retailprice").between(r["p0"], r["p1"]) & same).select("p_partkey")


@query("""SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN regexp_matches(substr(text, 1, 200), '(?i)^(sure|certainly|of course|here is)') THEN 'preamble' WHEN length(text) < 20 THEN 'short' WHEN contains(text, '!!') THEN 'shouting' END AS reason FROM conversations WHERE role = 'assistant'""")
def rewrite_gate(t: Tables):
    c = F.col("text")
    reason = F.when(c.isNull() | (F.trim(c) == ""), "empty").when(F.substring(c, 1, 200).rlike("(?i)^(sure|certainly|of course|here is)"), "preamble").when(F.length(c) < 20, "short").when(c.contains("!!"), "shouting")
    return t.conversations.filter("role = 'assistant'").select("conv_id", "turn", reason.alias("reason"))


@query("""SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches(text, '(and|or|und|et|y)$') THEN 'hanging' END, CASE WHEN regexp_matches(text, '[a-z][.] [a-z]') THEN 'period' END, CASE WHEN regexp_matches(text, ',,| ,') THEN 'comma' END, CASE WHEN length(text) < 100 THEN 'short' END], lambda x: x IS NOT NULL) AS warnings FROM conversations""")
def translation_warnings(t: Tables):
    c = F.col("text")
    tests = [(c.rlike("(and|or|und|et|y)$"), "hanging"), (c.rlike("[a-z][.] [a-z]"), "period"), (c.rlike(",,| ,"), "comma"), (F.length(c) < 100, "short")]
    return t.conversations.select("conv_id", "turn", F.array_compact(F.array(*[F.when(x, n) for x, n in tests])).alias("warnings"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN substr(text, 1, 100) || ' … ' || right(text, 100) ELSE text END) AS digest FROM documents")
def clip_text(t: Tables):
    return t.documents.select("doc_id", F.md5(X.clipped(F.col("text"), 200)).alias("digest"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g'))) AS digest FROM documents".replace("\\\\", "\\"))
def squeeze_space(t: Tables):
    return t.documents.select("doc_id", F.md5(X.squeezed(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')) AS folded, md5(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')) AS german FROM documents")
def search_folds(t: Tables):
    return t.documents.select("doc_id", F.md5(X.folded(F.col("text"))).alias("folded"), F.md5(X.german(F.col("text"))).alias("german"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(t: Tables):
    return t.part.select("p_partkey", X.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("SELECT doc_id, md5(regexp_replace(replace(translate(text, '\u2018\u2019\u201c\u201d\u2013\u2014', '''''\"\"--'), '\u2026', '...'), '[.]{3,}', '...', 'g')) AS digest FROM documents")
def typographic_fold(t: Tables):
    return t.documents.select("doc_id", F.md5(X.typographic(F.col("text"))).alias("digest"))


@query("""WITH p AS (SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT p_partkey, levenshtein(x, y) AS distance, round(levenshtein(x, y) / length(y), 6) AS cer, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS similarity FROM p""")
def edit_distances(t: Tables):
    b = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y"))
    x, y = F.col("p_name"), F.col("y")
    return t.part.join(b, "p_partkey").select("p_partkey", F.levenshtein(x, y).cast("long").alias("distance"), F.round(F.levenshtein(x, y) / F.length(y), 6).alias("cer"), F.round(X.edit_share(x, y), 6).alias("similarity"))


@query("""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?]) ', '\\1\n', 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '')) AS s FROM documents) SELECT doc_id, count(*) AS sentences, max(length(s)) AS longest, round(avg(length(s)), 4) AS mean FROM s GROUP BY doc_id""".replace("\\\\", "\\"))
def sentence_split(t: Tables):
    s = t.documents.select("doc_id", F.explode(F.split(F.regexp_replace("text", "([.!?]) ", "$1\n"), "\n+")).alias("s")).withColumn("s", F.trim("s")).filter("s <> ''")
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).alias("longest"), F.round(F.avg(F.length("s")), 4).alias("mean"))


@query("""SELECT doc_id, regexp_matches(text, '[.!?][\"'')]*\\s*$') AND NOT regexp_matches(text, '(Mr|Dr|No|St)[.]\\s*$') AS ends FROM documents""".replace("\\\\", "\\"))
def sentence_end(t: Tables):
    return t.documents.select("doc_id", (F.col("text").rlike("[.!?][\"')]*\\s*$") & ~F.col("text").rlike("(Mr|Dr|No|St)[.]\\s*$")).alias("ends"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_valid(props) AS valid FROM events""")
def json_fields(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$").isNotNull().alias("valid"))


@query("""SELECT conv_id, '{"messages":[' || string_agg('{"role":"' || role || '","chars":' || length(text) || '}', ',' ORDER BY turn) || ']}' AS line FROM conversations GROUP BY conv_id""")
def chat_lines(t: Tables):
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("chars")))), lambda x: F.struct(x["role"].alias("role"), x["chars"].alias("chars")))
    return t.conversations.groupBy("conv_id").agg(F.to_json(F.struct(m.alias("messages"))).alias("line"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 40 AND p_type = 'PROMO' THEN 'title' WHEN p_retailprice > 1000 AND p_size > 20 THEN 'heading' WHEN regexp_matches(p_name, '^[aeiou]') THEN 'caption' WHEN length(p_name) < 9 THEN 'footer' ELSE 'body' END AS category, CASE WHEN regexp_matches(p_brand, '^[0-9]+$') THEN 'digits' WHEN regexp_matches(p_brand, '^[a-z]+$') THEN 'lower' WHEN regexp_matches(p_brand, '^[A-Z]+$') THEN 'upper' ELSE 'mixed' END AS chars FROM part""")
def block_classifier(t: Tables):
    c = F.col
    category = F.when((c("p_size") >= 40) & (c("p_type") == "PROMO"), "title").when((c("p_retailprice") > 1000) & (c("p_size") > 20), "heading").when(c("p_name").rlike("^[aeiou]"), "caption").when(F.length("p_name") < 9, "footer").otherwise("body")
    chars = F.when(c("p_brand").rlike("^[0-9]+$"), "digits").when(c("p_brand").rlike("^[a-z]+$"), "lower").when(c("p_brand").rlike("^[A-Z]+$"), "upper").otherwise("mixed")
    return t.part.select("p_partkey", category.alias("category"), chars.alias("chars"))


@query("""SELECT p_partkey, (CASE WHEN p_size > 30 THEN 2 ELSE 0 END) + (CASE WHEN length(p_name) < 10 THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice > 950 THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(p_name, '^s') THEN 1 ELSE 0 END) AS score FROM part""")
def header_score(t: Tables):
    signals = [(F.col("p_size") > 30, 2), (F.length("p_name") < 10, 1), (F.col("p_retailprice") > 950, 1), (F.col("p_name").rlike("^s"), 1)]
    return t.part.select("p_partkey", sum((F.when(c, w).otherwise(0) for c, w in signals), F.lit(0)).alias("score"))


@query("""WITH v AS (SELECT DISTINCT l_partkey % 20 || '.' || l_suppkey % 30 AS a, l_suppkey % 20 || '.' || l_partkey % 30 AS b FROM lineitem)
SELECT a, b, (CAST(split_part(a, '.', 1) AS INT), CAST(split_part(a, '.', 2) AS INT)) >= (CAST(split_part(b, '.', 1) AS INT), CAST(split_part(b, '.', 2) AS INT)) AS enough FROM v""")
def version_compare(t: Tables):
    dotted = lambda x, y: F.concat((F.col(x) % 20).cast("string"), F.lit("."), (F.col(y) % 30).cast("string"))
    v = t.lineitem.select(dotted("l_partkey", "l_suppkey").alias("a"), dotted("l_suppkey", "l_partkey").alias("b")).distinct()
    parts = lambda x: F.transform(F.split(x, "[.]"), lambda p: p.cast("int"))
    return v.select("a", "b", (parts("a") >= parts("b")).alias("enough"))


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^(www|m)[.]', '') AS host, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages""")
def page_hosts(t: Tables):
    return t.pages.select("page_id", F.regexp_replace(F.regexp_extract("url", "^https?://([^/]+)", 1), "^(www|m)[.]", "").alias("host"), F.regexp_count("html", F.lit("<a [^>]*href=")).cast("long").alias("links"))


@query("""SELECT page_id, length(regexp_replace(html, '<sup[^>]*>[ 0-9,;*]*</sup>', '', 'g')) AS n FROM pages""")
def strip_sup_markers(t: Tables):
    return t.pages.select("page_id", F.length(F.regexp_replace("html", "<sup[^>]*>[ 0-9,;*]*</sup>", "")).alias("n"))


@query("""WITH p AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations) SELECT conv_id, turn, list_filter(list_transform(ls, lambda x: trim(regexp_replace(x, '^[ ]*[0-9]+[.)] ?', ''))), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$')) AS items FROM p""")
def numbered_replies(t: Tables):
    items = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "^[ ]*[0-9]+[.)] ?", "")))
    return t.conversations.select("conv_id", "turn", F.filter(items, lambda x: (x != "") & ~x.rlike("^[0-9]+$")).alias("items"))
