"""Document quality checks, graded to a verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import windows as W
from textloom.sources.staging import staged

from .registry import Tables, query

@query("""WITH r AS (SELECT doc_id, length(regexp_replace(text, '[^\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g')) / greatest(1, length(text)) AS control, length(regexp_replace(text, '[^#*$%&|]', '', 'g')) / greatest(1, length(text)) AS symbols, length(regexp_replace(text, '[^!]', '', 'g')) / greatest(1, length(text)) AS shouts, length(regexp_replace(text, '[^\ufffd]', '', 'g')) / greatest(1, length(text)) AS broken FROM documents),
g AS (SELECT *, CASE WHEN control >= 0.01 THEN 4 WHEN control >= 0.001 THEN 3 WHEN control > 0.0001 THEN 2 ELSE 1 END AS g1, CASE WHEN symbols >= 0.1 THEN 4 WHEN symbols >= 0.03 THEN 3 WHEN symbols >= 0.005 THEN 2 ELSE 1 END AS g2, CASE WHEN shouts >= 0.1 THEN 4 WHEN shouts >= 0.05 THEN 3 WHEN shouts >= 0.01 THEN 2 ELSE 1 END AS g3 FROM r)
SELECT doc_id, round(symbols, 6) AS symbol_rate, round(shouts, 6) AS shout_rate, round(broken, 6) AS broken_rate, CASE WHEN greatest(g1, g2, g3) >= 4 THEN 'unusable' WHEN greatest(g1, g2, g3) >= 3 THEN 'suspect' ELSE 'clean' END AS verdict FROM g""".replace("\\\\", "\\"))
def quality_report(t: Tables):
    c = F.col("text")
    rate = lambda keep: F.length(F.regexp_replace(c, keep, "")) / F.greatest(F.lit(1), F.length(c))
    d = t.documents.select("doc_id", rate(r"[^\x00-\x08\x0E-\x1F\x7F]").alias("control"), rate("[^#*$%&|]").alias("symbols"), rate("[^!]").alias("shouts"), rate("[^\ufffd]").alias("broken"))
    grades = [X.graded(F.col("control"), 0.00010000001, 0.001, 0.01), X.graded(F.col("symbols"), 0.005, 0.03, 0.1), X.graded(F.col("shouts"), 0.01, 0.05, 0.1)]
    return d.select("doc_id", F.round("symbols", 6).alias("symbol_rate"), F.round("shouts", 6).alias("shout_rate"), F.round("broken", 6).alias("broken_rate"), X.verdict(grades).alias("verdict"))


#: words of a language by which it is told
STOPWORDS = 32
#: listed words that go to every task; more are joined by a shuffle
MOST_LISTED = 100_000


@query(f"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL), f AS (SELECT lang AS told, word, count(*) AS n FROM w WHERE lang IS NOT NULL GROUP BY lang, word QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {STOPWORDS}),
s AS (SELECT doc_id, told, sum(c.n) AS hits FROM c JOIN f USING (word) GROUP BY ALL), n AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
SELECT doc_id, told, round(hits / total, 6) AS share FROM s JOIN n USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, told) = 1""")
def stopword_language(t: Tables):
    """The language whose most common words make up most of a text; the word lists come from the labelled documents."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("word")
    seen = t.documents.filter("lang is not null").select(F.col("lang").alias("told"), words).groupBy("told", "word").agg(F.count("*").alias("n"))
    lists = staged(W.top(seen, ["told"], [F.desc("n"), F.asc("word")], STOPWORDS).groupBy("word").agg(F.collect_list("told").alias("tolds")))
    # a word meets the lists where its text is read; a row a text and language leaves there
    lists = F.broadcast(lists) if lists.count() <= MOST_LISTED else lists
    met = t.documents.filter("doc_id is not null").select("doc_id", words).join(lists, "word", "left").select("doc_id", F.posexplode_outer("tolds").alias("at", "told"))
    hits = met.groupBy("doc_id", "told").agg(F.count("*").alias("hits"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("words"))
    named = F.when(F.col("told").isNotNull(), F.struct(-F.col("hits"), F.col("told")))
    best = hits.groupBy("doc_id").agg(F.min_by(F.struct("told", "hits"), named).alias("b"), F.sum("words").alias("total")).filter("b is not null")
    return best.select("doc_id", "b.told", F.round(F.col("b.hits") / F.col("total"), 6).alias("share"))


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), k AS (SELECT d.source, l.doc_id, regexp_replace(line, '[0-9]+', '#', 'g') AS key FROM l JOIN documents d USING (doc_id) WHERE length(line) BETWEEN 1 AND 80), n AS (SELECT source, count(*) AS docs FROM documents GROUP BY source), c AS (SELECT source, key, count(DISTINCT doc_id) AS pages FROM k GROUP BY ALL)
SELECT source, md5(key) AS line, pages FROM c JOIN n USING (source) WHERE pages >= greatest(3, 0.05 * docs)""")
def page_furniture(t: Tables):
    lines = t.documents.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).filter(F.length("line").between(1, 80))
    c = lines.groupBy("source", F.regexp_replace("line", "[0-9]+", "#").alias("key")).agg(F.count_distinct("doc_id").alias("pages"))
    n = t.documents.groupBy("source").agg(F.count("*").alias("docs"))
    return c.join(n, "source").filter(F.col("pages") >= F.greatest(F.lit(3), 0.05 * F.col("docs"))).select("source", F.md5("key").alias("line"), "pages")


@query("""SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z]+[#*$%&][a-zA-Z]+')) AS welded, len(regexp_extract_all(text, '[a-zA-Z]+[0-9]+[a-zA-Z]+')) AS digits_inside FROM documents""")
def word_interior_junk(t: Tables):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[a-zA-Z]+[#*$%&][a-zA-Z]+")).cast("long").alias("welded"), F.regexp_count("text", F.lit("[a-zA-Z]+[0-9]+[a-zA-Z]+")).cast("long").alias("digits_inside"))


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')) AS w FROM documents) SELECT doc_id, count(*) AS tokens, count(*) FILTER (WHERE regexp_matches(w, '@|://|^/|[0-9]+[.][0-9]+[.]')) AS identifiers, count(DISTINCT w) AS forms, round(avg(length(w)), 4) AS mean_length FROM w GROUP BY doc_id""")
def token_profile(t: Tables):
    # rows of one doc_id are one text: whole texts are dealt, not their words
    whole = t.documents.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    w = whole.select("doc_id", F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    identifiers = F.filter("w", lambda w: w.rlike(r"@|://|^/|[0-9]+[.][0-9]+[.]"))
    letters = F.aggregate("w", F.lit(0).cast("long"), lambda n, w: n + F.length(w))
    n = F.size("w").cast("long")
    return w.select("doc_id", n.alias("tokens"), F.size(identifiers).cast("long").alias("identifiers"), F.size(F.array_distinct("w")).cast("long").alias("forms"), F.round(letters / n, 4).alias("mean_length"))


@query("""WITH v AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents) SELECT word, count(*) AS n FROM v GROUP BY word""")
def vocabulary_count(t: Tables):
    v = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    return v.groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, round(len(regexp_extract_all(text, '[A-Za-z]- ?[\\n]?[a-z]')) * 1000.0 / greatest(1, len(regexp_extract_all(text, '[A-Za-z]+'))), 4) AS split_rate FROM documents""".replace("\\\\", "\\"))
def hyphen_split_rate(t: Tables):
    count = lambda p: F.regexp_count("text", F.lit(p))
    return t.documents.select("doc_id", F.round(count("[A-Za-z]- ?\n?[a-z]") * 1000.0 / F.greatest(F.lit(1), count("[A-Za-z]+")), 4).alias("split_rate"))


@query("""SELECT doc_id, 'fp:' || sha256('v1' || chr(10) || coalesce(text, '')) AS digest, nullif(substr(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), 1, 80), '') AS fingerprint FROM documents""")
def content_digest(t: Tables):
    head = F.substring(F.trim(F.regexp_replace("text", "[ \t\n\r]+", " ")), 1, 80)
    return t.documents.select("doc_id", F.concat(F.lit("fp:"), F.sha2(F.concat(F.lit("v1\n"), F.coalesce("text", F.lit(""))), 256)).alias("digest"), F.nullif(head, F.lit("")).alias("fingerprint"))
