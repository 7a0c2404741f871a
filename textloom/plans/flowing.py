"""Continuation signals of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import flows as L

from .registry import Tables, query

_LINES = "SELECT l_suppkey % 40 AS book, l_suppkey // 40 AS page, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 52 ELSE 40 + l_orderkey % 2 END AS DOUBLE) AS x0, CAST(400 + (l_quantity % 7) * 4 AS DOUBLE) AS x1 FROM lineitem"


@query(f"""WITH l AS ({_LINES}), a AS (SELECT book, page, round(x0) AS x, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT book, page, arg_min(x, row(-n, x)) AS left_, sum(n) AS n FROM a GROUP BY ALL),
r AS (SELECT book, page, x1, row_number() OVER (PARTITION BY book, page ORDER BY x1) - 1 AS rank FROM l), e AS (SELECT r.book, r.page, CASE WHEN n >= {L.LEAST_LINES} THEN left_ END AS left_, CASE WHEN n >= {L.LEAST_LINES} THEN x1 END AS right_ FROM r JOIN b USING (book, page) WHERE rank = floor((n - 1) * {L.EDGE})),
p AS (SELECT l.*, left_, right_, lag(x1) OVER w AS px1, lag(right_) OVER w AS pright, lag(l_orderkey) OVER w IS NULL AS alone FROM l JOIN e USING (book, page) WINDOW w AS (PARTITION BY book ORDER BY page, l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
s AS (SELECT *, CASE WHEN left_ IS NULL THEN 'page_unmeasured' WHEN alone THEN 'no_line_before' WHEN pright IS NULL THEN 'page_before_unmeasured' WHEN x0 > left_ + {L.INDENT} AND px1 < pright - {L.SHORT} THEN 'both' WHEN NOT x0 > left_ + {L.INDENT} AND NOT px1 < pright - {L.SHORT} THEN 'neither' WHEN x0 > left_ + {L.INDENT} THEN 'indent_only' ELSE 'short_only' END AS reason FROM p)
SELECT book, page, l_orderkey, l_linenumber, reason, CASE reason WHEN 'both' THEN 'new' WHEN 'neither' THEN 'continues' ELSE 'undecided' END AS decision FROM s""")
def paragraph_continuations(t: Tables):
    """Whether each line begins a paragraph or goes on one, across the pages of a book."""
    c = F.col
    x0 = F.when((c("l_orderkey") + c("l_linenumber")) % 5 == 0, 52).otherwise(40 + c("l_orderkey") % 2).cast("double")
    lines = t.lineitem.select((c("l_suppkey") % 40).alias("book"), F.floor(c("l_suppkey") / 40).alias("page"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", x0.alias("x0"), (400 + (c("l_quantity") % 7) * 4).cast("double").alias("x1"))
    return L.continuations(lines, "book", "page", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).select("book", "page", "l_orderkey", "l_linenumber", "reason", "decision")
