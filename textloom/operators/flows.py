"""Lines that go on a paragraph or begin one, and quotes found in runs of cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .repairs import quote_score

#: fixed values: points of an indent, points by which a line is short, lines that a page needs to be measured, and the
#: rank of its right edge
INDENT, SHORT, LEAST_LINES, EDGE = 5.0, 8.0, 6, 0.90
#: fixed values: cues of a window, the score of a match, and the distance of scores that are as good
MOST_CUES, LEAST_SCORE, AS_GOOD = 8, 0.65, 0.05


def page_edges(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left_, right_): a page's most frequent left place, the lowest of equal ones, and its right edge; null for pages of few lines.

    Both come from counts of places and values, which tasks add up first; a page's sorted rows never stand in one list.
    """
    lefts = lines.groupBy(*keys, F.round("x0").alias("x")).agg(F.count("*").alias("n"))
    left = lefts.groupBy(*keys).agg(F.min_by("x", F.struct(-F.col("n"), "x")).alias("left_"), F.sum("n").alias("n"))
    rights = lines.groupBy(*keys, F.col("x1").alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    ranked = rights.withColumn("upto", upto).join(left.select(*keys, F.floor((F.col("n") - 1) * EDGE).alias("rank")), keys)
    right = ranked.filter(F.col("upto") > F.col("rank")).groupBy(*keys).agg(F.min("v").alias("right_"))
    enough = F.col("n") >= LEAST_LINES
    return left.join(right, keys).select(*keys, F.when(enough, F.col("left_")).alias("left_"), F.when(enough, F.col("right_")).alias("right_"))


def continuations(lines: DataFrame, book: str, page: str, order: list[str]) -> DataFrame:
    """lines (book, page, order, x0, x1) with `decision` and `reason`: whether a line begins a paragraph or goes on one.

    It begins one if it is indented and the line before it, also the last one of the page before, is short against its
    own page's edge; it goes on one if neither holds. One signal alone decides nothing.
    """
    rows = lines.join(page_edges(lines, [book, page]), [book, page])
    before = Window.partitionBy(book).orderBy(page, *order)
    rows = rows.withColumn("_prev", F.lag(F.struct("x1", "right_")).over(before))
    indent = F.col("x0") > F.col("left_") + INDENT
    short = F.col("_prev.x1") < F.col("_prev.right_") - SHORT
    reason = F.when(F.col("left_").isNull(), "page_unmeasured").when(F.col("_prev").isNull(), "no_line_before").when(F.col("_prev.right_").isNull(), "page_before_unmeasured")
    reason = reason.when(indent & short, "both").when(~indent & ~short, "neither").when(indent, "indent_only").otherwise("short_only")
    rows = rows.withColumn("reason", reason)
    decision = F.when(F.col("reason") == "both", "new").when(F.col("reason") == "neither", "continues").otherwise("undecided")
    return rows.withColumn("decision", decision).drop("_prev", "left_", "right_")


def quote_ranges(quotes: DataFrame, cues: DataFrame, key: str, order: str) -> DataFrame:
    """quotes (key, quote, ...) with `first`, `last` (places of cues, from 0) and `score` of the run of cues that holds each.

    Every run of up to MOST_CUES cues is scored. The best has the highest score, then the fewest cues, the nearest
    length, the first place. Where another run that shares no cue with it is as good, none is chosen.
    """
    place = Window.partitionBy(key).orderBy(order)
    rows = cues.select(key, (F.row_number().over(place) - 1).alias("first"), F.collect_list(F.coalesce("text", F.lit(""))).over(place.rowsBetween(0, MOST_CUES - 1)).alias("texts"))
    runs = rows.select(key, "first", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("texts")), lambda n: F.array_join(F.slice("texts", 1, n), " "))).alias("more", "text"))
    # a quote's text is its key: a quote asked for twice is looked for once
    asked = quotes.filter("quote is not null").select(key, "quote").distinct()
    scored = asked.join(runs, key).select(key, "quote", "first", (F.col("first") + F.col("more")).alias("last"), quote_score(F.col("quote"), F.col("text")).alias("score"), F.abs(F.length("text") - F.length("quote")).alias("apart"))
    scored = scored.filter(F.col("score") >= LEAST_SCORE)
    best = scored.groupBy(key, "quote").agg(F.min_by(F.struct("first", "last", "score"), F.struct(-F.col("score"), F.col("last") - F.col("first"), "apart", "first")).alias("b"))
    other = scored.join(best, [key, "quote"])
    rival = ((F.col("last") < F.col("b.first")) | (F.col("first") > F.col("b.last"))) & (F.abs(F.col("score") - F.col("b.score")) < AS_GOOD)
    chosen = other.groupBy(key, "quote").agg(F.first("b").alias("b"), F.max(rival).alias("rival")).filter(~F.col("rival"))
    return quotes.join(chosen.select(key, "quote", "b.*"), [key, "quote"], "left")
