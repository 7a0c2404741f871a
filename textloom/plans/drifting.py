"""Cues against what is heard. Documents are read out at RATE words a second; a sentence's cue is put where its share of
the characters puts it, which is off wherever words are longer or shorter than in the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import drift as D

from .registry import Tables, query

RATE = 2.5

_AUDIT = rf"""WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\p{{L}}+') AS ws, string_split_regex(text, '[.!?]') AS ss FROM documents WHERE length(text) > 0),
h AS (SELECT doc_id, pos, pos / {RATE} AS at_, ws[pos + 1 : pos + {D.SPAN}] AS ahead FROM (SELECT doc_id, ws, unnest(range(len(ws) - 2)) AS pos FROM d)),
p AS (SELECT doc_id, length(text) AS n_chars, len(ws) AS n_words, unnest(ss) AS piece, generate_subscripts(ss, 1) - 1 AS sent FROM d),
s AS (SELECT doc_id, sent, regexp_extract_all(lower(piece), '\p{{L}}+') AS tk, (sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY sent) - length(piece) - 1) / n_chars * (n_words / {RATE}) AS start FROM p),
b AS (SELECT doc_id, sent, start, o, tk[o + 1 : o + {D.CONFIRMED}] AS rest FROM (SELECT *, unnest(range(least(len(tk) - 2, {D.STARTS}))) AS o FROM s)),
m AS (SELECT b.*, pos, at_, at_ - o / {RATE} AS found FROM b JOIN h ON b.doc_id = h.doc_id AND rest[1] = ahead[1] AND rest[2] = ahead[2] AND rest[3] = ahead[3] AND abs(at_ - o / {RATE} - start) <= {D.AROUND} WHERE CAST(list_reduce(list_prepend('0', ahead), lambda n, w: CASE WHEN w = rest[CAST(n AS INT) + 1] THEN CAST(CAST(n AS INT) + 1 AS VARCHAR) ELSE n END) AS INT) >= greatest(3, len(rest) - 1)),
g AS (SELECT doc_id, sent, o, arg_min(found, pos) AS found, max(at_) - min(at_) AS apart FROM m GROUP BY ALL),
f AS (SELECT doc_id, sent, arg_min(found, o) AS found, arg_min(apart, o) AS apart FROM g GROUP BY ALL),
o AS (SELECT s.doc_id, s.sent, start, len(tk) AS n, found, CASE WHEN apart <= {D.APART} THEN greatest(0.0, found) - start END AS off FROM s LEFT JOIN f ON s.doc_id = f.doc_id AND s.sent = f.sent),
a AS (SELECT doc_id, sent, start, off, CASE WHEN n < 3 THEN 'short' WHEN found IS NULL THEN 'unheard' WHEN off IS NULL THEN 'ambiguous' WHEN abs(off) > {D.MOVED} THEN 'moved' ELSE 'kept' END AS status, CASE WHEN abs(off) > {D.MOVED} THEN greatest(0.0, found) ELSE start END AS moved_to FROM o)"""


def read_out(t: Tables) -> DataFrame:
    """The cues of all documents, audited."""
    # dealt once, so that all tasks have texts whatever the files are; after that a text is a row
    docs = t.documents.filter(F.length("text") > 0).select("doc_id", "text").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return D.audited_texts(docs, "doc_id", RATE)


@query(_AUDIT + "SELECT doc_id, sent, status, round(off, 3) + 0.0 AS off, round(moved_to, 3) + 0.0 AS moved_to FROM a")
def drift_audit(t: Tables):
    return read_out(t).select("doc_id", "sent", "status", F.round("offset", 3).alias("off"), F.round("moved_to", 3).alias("moved_to"))


@query(
    _AUDIT
    + """, r AS (SELECT doc_id, status, round(abs(off), 3) AS was, CASE WHEN status = 'moved' THEN 0.0 ELSE round(abs(off), 3) END AS left_ FROM a)
SELECT doc_id, count(was) AS checked, count(*) FILTER (WHERE status = 'moved') AS moved, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous, coalesce(max(was), 0) AS largest, coalesce(max(left_), 0) AS largest_left,
  coalesce(list_sort(list(was) FILTER (WHERE was IS NOT NULL))[count(was) // 2 + 1], 0) AS middle, coalesce(list_sort(list(was) FILTER (WHERE was IS NOT NULL))[CAST(floor(0.95 * (count(was) - 1)) AS BIGINT) + 1], 0) AS p95,
  coalesce(list_sort(list(left_) FILTER (WHERE left_ IS NOT NULL))[count(was) // 2 + 1], 0) AS middle_left, coalesce(list_sort(list(left_) FILTER (WHERE left_ IS NOT NULL))[CAST(floor(0.95 * (count(was) - 1)) AS BIGINT) + 1], 0) AS p95_left FROM r GROUP BY doc_id"""
)
def drift_report(t: Tables):
    """To the millisecond, so that offsets repeat and are counted before they are ranked."""
    return D.report(read_out(t).withColumn("offset", F.round("offset", 3)), "doc_id")
