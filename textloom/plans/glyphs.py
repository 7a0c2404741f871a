"""Cut text runs, and signs that stand for letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import damage as D
from textloom.operators import intervals as I
from textloom.sources.staging import staged

from .registry import Tables, query

@query(r"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, unnest(range(0, least(length(text), 4000), 37)) AS lo, text FROM d),
c AS (SELECT doc_id, lo, lo + 3 + CAST((lo * 7 + doc_id) % 53 AS BIGINT) AS hi FROM m WHERE (lo + doc_id) % 5 < 2),
g AS (SELECT d.doc_id, d.text, ch, i, EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id AND c.lo <= i - 1 AND i - 1 < c.hi) AS gone FROM d, (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM d) x WHERE x.doc_id = d.doc_id)
SELECT doc_id, md5(coalesce(string_agg(ch, '' ORDER BY i) FILTER (WHERE NOT gone), '')) AS digest, count(*) FILTER (WHERE gone) AS n_gone FROM g GROUP BY doc_id""")
def cut_text_runs(t: Tables):
    """Texts without the runs that struck references cover; runs overlap and reach beyond the end."""
    texts = t.documents.filter("text is not null and text <> ''").select("doc_id", "text")
    places = texts.select("doc_id", F.explode(F.sequence(F.lit(0), F.least(F.length("text"), F.lit(4000)) - 1, F.lit(37))).alias("lo"))
    cuts = places.filter((F.col("lo") + F.col("doc_id")) % 5 < 2).select("doc_id", F.col("lo").cast("int"), (F.col("lo") + 3 + (F.col("lo") * 7 + F.col("doc_id")) % 53).cast("int").alias("hi"))
    cut = I.cut_texts(texts, cuts, "doc_id").withColumnRenamed("text", "kept").join(texts, "doc_id")
    return cut.select("doc_id", F.md5("kept").alias("digest"), (F.length("text") - F.length("kept")).cast("long").alias("n_gone"))


#: a scan that reads a letter and a pair of letters as signs, in every third text
READ_AS = (("h", "¤"), ("qu", "€"))
TOKEN = r"[^\s]+"


def _tokens_sql() -> str:
    text = "text"
    for letters, sign in READ_AS:
        text = f"replace({text}, '{letters}', '{sign}')"
    return rf"""t AS (SELECT lower(regexp_replace(w, '[.,;:!?()\[\]]+$', '')) AS token FROM (SELECT unnest(regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN {text} ELSE text END, '{TOKEN}')) AS w FROM documents)),
v AS (SELECT token AS word, count(*) AS n FROM t WHERE regexp_full_match(token, '[a-z]{{2,}}') GROUP BY token)"""


def _tokens(t: Tables):
    """(token, n): the tokens of the texts as they are read; each form is counted before it is looked at."""
    text = F.col("text")
    for letters, sign in READ_AS:
        text = F.replace(text, F.lit(letters), F.lit(sign))
    read = F.when(F.col("doc_id") % 3 == 0, text).otherwise(F.col("text"))
    raw = t.documents.select(F.explode(F.regexp_extract_all(read, F.lit(TOKEN), F.lit(0))).alias("w"))
    forms = raw.groupBy("w").agg(F.count("*").alias("n"))
    return forms.select(F.lower(F.regexp_replace("w", r"[.,;:!?()\[\]]+$", "")).alias("token"), "n")


_W = D.WELDED.replace("'", "''")


@query(rf"""WITH {_tokens_sql()}, d AS (SELECT token, regexp_extract(token, '{_W}', 1) AS prefix, regexp_extract(token, '{_W}', 2) AS sign, regexp_extract(token, '{_W}', 3) AS suffix, count(*) AS n FROM t WHERE regexp_matches(token, '{_W}') GROUP BY token),
e AS (SELECT * FROM d WHERE length(prefix) + length(suffix) >= 3 AND NOT (prefix = '' AND suffix IN (SELECT word FROM v))),
g AS (SELECT word[1:i] AS prefix, word[i + k + 1:] AS suffix, word[i + 1:i + k] AS fill, n FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v), (SELECT unnest([1, 2]) AS k) WHERE i + k < length(word)),
f AS (SELECT prefix, suffix, fill, sum(n) AS n FROM g SEMI JOIN e USING (prefix, suffix) GROUP BY ALL),
b AS (SELECT prefix, suffix, sum(n) AS total, arg_min(fill, row(-n, fill)) AS fill, max(n) AS n FROM f GROUP BY ALL),
s AS (SELECT e.token, e.sign, e.n, b.fill FROM e JOIN b USING (prefix, suffix) WHERE b.n >= {D.LEAST_SEEN} AND b.n >= {D.LEAST_SHARE} * b.total),
h AS (SELECT sign, fill, sum(n) AS n FROM s GROUP BY ALL), q AS (SELECT sign, sum(n) AS total, count(DISTINCT token) AS words FROM s GROUP BY sign), r AS (SELECT sign, arg_min(fill, row(-n, fill)) AS fill, max(n) AS n FROM h GROUP BY sign)
SELECT sign, fill, CAST(r.n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, words, r.n >= {D.SIGN_SHARE} * total AND words >= {D.SIGN_WORDS} AS sure FROM r JOIN q USING (sign)""")
def substitution_table(t: Tables):
    """What each sign inside words stands for, by the words that the documents themselves hold."""
    tokens = staged(_tokens(t))
    words = tokens.filter(F.col("token").rlike("^[a-z]{2,}$")).groupBy(F.col("token").alias("word")).agg(F.sum("n").alias("n"))
    return D.substitutions(staged(words), staged(D.welded(tokens, "token", "n")))


@query(rf"""WITH {_tokens_sql()} SELECT regexp_extract(token, '{_W}', 2) AS sign, CASE WHEN regexp_extract(token, '{_W}', 1) = '' THEN 'begin' ELSE 'inside' END AS place, count(*) AS n, count(DISTINCT token) AS words FROM t
WHERE regexp_matches(token, '{_W}') AND length(regexp_extract(token, '{_W}', 1)) + length(regexp_extract(token, '{_W}', 3)) >= 3 GROUP BY ALL""")
def welded_signs(t: Tables):
    """Signs at the begin of and inside words, with how often they occur."""
    found = D.welded(_tokens(t), "token", "n")
    place = F.when(F.col("prefix") == "", "begin").otherwise("inside").alias("place")
    return found.groupBy("sign", place).agg(F.sum("n").alias("n"), F.count("*").alias("words"))
