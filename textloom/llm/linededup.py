"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. Each line's hash gets a HyperLogLog sketch of its sites, merged by
the aggregation; lines whose estimate is far below SITES stay, those far above go, and those near it get an exact
distinct count. Of a line that goes, one copy stays, at its first place (smallest doc_id, then line number), so
that no text leaves the corpus altogether.

Lines are split at newlines and compared unchanged; lines of white space only never count. A site is a document's
`source`; a null one is no site. SITES does not depend on the number of sources: a corpus of fewer sites loses no line.

Defined cases: a null text stays null and has no lines; an empty text is one blank line; rows without a doc_id are
kept as they are in the operator and left out of the query; rows that share a doc_id lose the lines at the places
where any of them would lose one. An empty table gives an empty result. All other columns are carried, whatever
their names. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, unstage
from .decontam import let

SITES = 10
#: estimates within this share of SITES are checked exactly; sketches of 2^9 registers err by 5 % or less as a rule
BAND, REGISTERS = 0.5, 9


def lines_of(text: Column) -> Column:
    return F.split(text.cast("string"), "\n")


def spread_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h1, h2) of the lines (h1, h2, site) that stand on at least `sites` distinct sites; staged."""
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch"))
    spread = stage(sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("about")).filter(F.col("about") >= sites * (1 - BAND)))
    near = spread.filter(F.col("about") <= sites * (1 + BAND)).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= sites)
    out = stage(spread.filter(F.col("about") > sites * (1 + BAND)).select("h1", "h2").unionByName(exact.select("h1", "h2")))
    unstage(spread)
    return out


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(gone_from, gone): doc_id and numbers, from 0, of the lines that go from each document that loses any; staged."""
    lines = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("site"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    lines = lines.filter(F.trim(F.translate("line", "\t\r\x0b\x0c", "    ")) != "")
    lines = stage(lines.select("doc_id", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))
    bad = spread_lines(lines.filter("site is not null").select("h1", "h2", "site"), sites)
    found = stage(lines.join(bad, ["h1", "h2"]).select("h1", "h2", "doc_id", "at"))
    first_doc = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    own = found.groupBy("h1", "h2", "doc_id").agg(F.min("at").alias("first_at"))
    first = first_doc.join(own, ["h1", "h2"]).filter(F.col("doc_id") == F.col("first_doc")).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first_doc", "first_at")
    kept = (F.col("doc_id") == F.col("first_doc")) & (F.col("at") == F.col("first_at"))
    gone = found.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).filter(~kept)
    out = stage(gone.groupBy("doc_id").agg(F.collect_set("at").alias("gone")).withColumnRenamed("doc_id", "gone_from"))
    unstage(lines, bad, found)
    return out


def without_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(row, kept, n_gone): row is a struct of all of docs' columns, kept the array of lines that stay (null for a null text)."""
    gone = boilerplate(docs, sites)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("of"))
    # what goes grows with the input: a merge join at every size, not a broadcast while it happens to be small
    out = rows.join(gone.hint("merge"), F.col("of") == F.col("gone_from"), "left")
    all_ = lines_of(F.col("row.text"))
    # places by a set difference, lines by their place: linear in the lines
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "gone")
    rest = let(all_, lambda x: F.transform(left(x), lambda i: x[i]))
    out = out.withColumn("kept", F.when(F.col("gone").isNull() | F.col("row.text").isNull(), all_).otherwise(rest))
    return out.select("row", "kept", F.coalesce(F.size(all_) - F.size("kept"), F.lit(0)).alias("n_gone"))


def op8_distinct_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").filter("doc_id is not null")
    out = without_boilerplate(docs)
    kept = F.sha2(F.coalesce(F.concat_ws("\n", "kept"), F.lit("")), 256).alias("kept_sha256")
    n_lines = F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept") + F.col("n_gone")).cast("long")
    return out.select("row.doc_id", n_lines.alias("n_lines"), F.col("n_gone").cast("long").alias("n_removed"), kept)


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE doc_id IS NOT NULL
), spread AS (
  SELECT line FROM lines WHERE trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> '' GROUP BY line HAVING count(DISTINCT source) >= {SITES}
), marked AS (
  SELECT l.*, s.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY doc_id, pos) > 1 AS gone FROM lines l LEFT JOIN spread s ON l.line = s.line
)
SELECT d.doc_id, count(m.pos) AS n_lines, count(m.pos) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id WHERE d.doc_id IS NOT NULL GROUP BY d.doc_id
"""
