"""Joins with a rule: ambiguity is refused, ranges meet by bins, votes pick offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def one_or_refuse(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The only value of each group, null with a reason where there are several."""
    n = F.count_distinct(value)
    return df.groupBy(*keys).agg(F.when(n == 1, F.min(value)).alias(value), F.when(n > 1, "ambiguous").when(n == 0, "missing").alias("refused"))


def checked_aliases(aliases: DataFrame, old: str, new: str) -> DataFrame:
    """An alias map in which a key with contradicting targets is an error, not a choice."""
    one = aliases.groupBy(old).agg(F.min(new).alias(new), F.count_distinct(new).alias("_n"))
    return one.select(old, F.when(F.col("_n") == 1, F.col(new)).otherwise(F.raise_error(F.concat(F.lit("contradicting alias "), F.col(old).cast("string")))).alias(new))


def contained(points: DataFrame, at: Column, spans: DataFrame, lo: str, hi: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Points joined to the spans of the same keys that hold them: spans enter every bin of `width` they reach, points one."""
    p = points.withColumn("_at", at).withColumn("_bin", F.floor(F.col("_at") / width))
    s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(s, [*(keys or []), "_bin"]).filter((F.col("_at") >= F.col(lo)) & (F.col("_at") < F.col(hi))).drop("_bin", "_at")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, carry: list[str]) -> DataFrame:
    """Each left row with the columns of the last right row of its key that is not later."""
    a = left.withColumn("_side", F.lit(1))
    b = right.select(key, at, *carry, F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    seen = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(*carry)), True).over(seen)
    return both.withColumn("_last", last).filter("_side = 1").select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in carry])


def shingles(df: DataFrame, id_: str, words: Column, size: int) -> DataFrame:
    """(id, pos, shingle): strings of `size` words, joined by spaces, from pos 0."""
    w = df.select(id_, words.alias("_w")).filter(F.size("_w") >= size)
    at = F.sequence(F.lit(0), F.size("_w") - size)
    return w.select(id_, F.posexplode(F.transform(at, lambda i: F.array_join(F.slice("_w", i + 1, size), " "))).alias("pos", "shingle"))


def unique_anchors(a: DataFrame, b: DataFrame, id_a: str, id_b: str) -> DataFrame:
    """Pairs of places whose shingle occurs once in a and once in b."""
    once = lambda df, i, x: df.groupBy("shingle").agg(F.count("*").alias("_n"), F.min(i).alias(i), F.min("pos").alias(f"pos_{x}")).filter("_n = 1").drop("_n")
    return once(a, id_a, "a").join(once(b, id_b, "b"), "shingle")


def offset_votes(a: DataFrame, b: DataFrame, id_a: str, id_b: str, most: int, bucket: int = 1) -> DataFrame:
    """Votes for each offset pos_a - pos_b of a pair; shingles that occur over `most` times in b do not vote."""
    n = b.groupBy("shingle").agg(F.count("*").alias("_n")).filter(F.col("_n") <= most).drop("_n")
    rare = b.join(n, "shingle", "left_semi").select(F.col(id_b), F.col("pos").alias("pos_b"), "shingle")
    # the larger side keeps only what can vote, before its strings are dealt
    a = a.join(n, "shingle", "left_semi")
    return a.join(rare, "shingle").groupBy(id_a, id_b, (F.floor((F.col("pos") - F.col("pos_b")) / bucket) * bucket).alias("offset")).agg(F.count("*").alias("votes"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
