"""Intervals on texts: characters that are cut out, by a sweep over begin and end events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def remaining(spans: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi, to): the parts of `spans` that no cut covers, in their order, and where each begins after the cuts.

    Spans and cuts are (keys, lo, hi), hi exclusive; spans of one key do not overlap, cuts may, and may reach beyond.
    Each begin and end is an event; between two events next to each other nothing changes, so a running count of open
    cuts and spans decides the stretch. The work is that of sorting the events of a key.
    """
    ends = lambda df, what: df.select(*keys, F.col("lo").alias("at"), F.lit(1).alias(what)).unionByName(df.select(*keys, F.col("hi").alias("at"), F.lit(-1).alias(what)))
    events = ends(spans.filter("lo < hi"), "span").unionByName(ends(cuts.filter("lo < hi"), "cut"), allowMissingColumns=True)
    events = events.groupBy(*keys, "at").agg(F.coalesce(F.sum("span"), F.lit(0)).alias("span"), F.coalesce(F.sum("cut"), F.lit(0)).alias("cut"), F.max(F.when(F.col("span") == 1, 1).otherwise(0)).alias("fresh"))
    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = events.select(*keys, F.col("at").alias("lo"), F.lead("at").over(order).alias("hi"), F.sum("span").over(upto).alias("in_span"), F.sum("cut").over(upto).alias("in_cut"), "fresh")
    parts = parts.filter("hi is not null")
    # stretches that meet without a cut or a new span between them are one
    held = (F.col("in_span") > 0) & (F.col("in_cut") == 0)
    before = F.lag(held).over(Window.partitionBy(*keys).orderBy("lo"))
    parts = parts.withColumn("_held", held).withColumn("_new", F.when(F.coalesce(before, F.lit(False)) & held & (F.col("fresh") == 0), 0).otherwise(1))
    parts = parts.withColumn("_run", F.sum("_new").over(Window.partitionBy(*keys).orderBy("lo"))).filter("_held")
    out = parts.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")
    kept = F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy(*keys).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("to", F.coalesce(kept, F.lit(0)))


def cut_texts(texts: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """texts (key, text) without the characters that the cuts (key, lo, hi) cover."""
    spans = texts.select(key, F.lit(0).alias("lo"), F.length("text").alias("hi"))
    parts = remaining(spans, cuts.join(texts.select(key), key, "left_semi"), [key])
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_parts"))
    pieces = F.transform("_parts", lambda p: F.substring("text", p["lo"] + 1, p["hi"] - p["lo"]))
    return texts.join(lists, key, "left").withColumn("text", F.when(F.col("text").isNotNull(), F.coalesce(F.array_join(pieces, ""), F.lit("")))).drop("_parts")


def moved(points: DataFrame, cuts: DataFrame, keys: list[str], at: str) -> DataFrame:
    """points with `at` counted without the cut characters before it; one inside a cut stands at its seam."""
    order = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = points.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1))
    begins = _union(cuts, keys).select(*keys, F.col("lo").alias("_at"), F.lit(0).alias("_kind"), "lo", "hi", "gone")
    both = rows.unionByName(begins, allowMissingColumns=True)
    last = F.last(F.when(F.col("_kind") == 0, F.struct("lo", "hi", "gone")), True).over(order)
    both = both.withColumn("_last", last).filter("_kind = 1")
    shift = F.coalesce(F.col("_last.gone") + F.least(F.col(at), F.col("_last.hi")) - F.col("_last.lo"), F.lit(0))
    return both.withColumn(at, F.col(at) - shift).select(points.columns)


def _union(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi, gone): cuts that overlap or touch made one, and the characters that those before took."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = cuts.filter("lo < hi").select(*keys, "lo", "hi").withColumn("_new", F.when(F.col("lo") <= reach, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = rows.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")
    before = Window.partitionBy(*keys).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    return one.withColumn("gone", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(before), F.lit(0)))
