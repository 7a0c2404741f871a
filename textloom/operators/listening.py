"""Append-only listening logs: ingest rules, removals, totals, mergeable state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_SECONDS = 3600.0


def accepted(events: DataFrame, id_: str = "event_id", seconds: str = "seconds", most: float = MOST_SECONDS) -> DataFrame:
    """Idempotent ingest: non-positive or non-finite seconds go, the rest is capped, the first row of an id counts."""
    fine = events.filter((F.col(seconds) > 0) & ~F.isnan(seconds) & (F.col(seconds) < float("inf")))
    return fine.withColumn(seconds, F.least(F.col(seconds), F.lit(most))).dropDuplicates([id_])


def after_removals(events: DataFrame, removals: DataFrame, key: str, at: str = "at") -> DataFrame:
    """Events of keys that were never removed, or that came after the key's last removal."""
    last = removals.groupBy(F.col(key).alias("_key")).agg(F.max(at).alias("_cutoff"))
    kept = events.join(last, F.col(key) == F.col("_key"), "left").filter(F.col("_cutoff").isNull() | (F.col(at) > F.col("_cutoff")))
    return kept.drop("_key", "_cutoff")


def totals(events: DataFrame, day: str, key: str, seconds: str) -> DataFrame:
    """Sums for each day, for each key and over all, in one pass of grouping sets; level names the kind of row."""
    out = events.groupingSets([[F.col(day)], [F.col(key)], []], F.col(day), F.col(key)).agg(
        F.sum(seconds).alias("seconds"), F.count("*").alias("n"), F.grouping_id().alias("_g")
    )
    level = F.when(F.col("_g") == 1, "day").when(F.col("_g") == 2, "key").otherwise("all")
    return out.select(level.alias("level"), F.col(day).cast("string").alias("day"), F.col(key).alias("key"), "seconds", "n")


def merged_totals(parts: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """Final sums over partial ones."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def last_writer(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key; ties go to the row that the order puts last."""
    latest = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def coalesced(intervals: DataFrame, keys: list[str], lo: str, hi: str, gap: float = 1) -> DataFrame:
    """Union of the intervals of each key: one row for each run whose members overlap or are at most gap apart."""
    fine = intervals.filter(F.col(lo) <= F.col(hi))
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    reached = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reached.isNull() | (F.col(lo) > reached + gap), 1).otherwise(0)
    runs = fine.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(*keys, "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_run")


def zero_filled(counts: DataFrame, labels: DataFrame, on: list[str], value: str) -> DataFrame:
    """A row for each label, with 0 where counts has none."""
    return labels.join(counts, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))
