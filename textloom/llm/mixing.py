"""Mixing sources to target weights, in blocks of words.

The words of each source stand end to end, packed into blocks of BLOCK words. Targets share the corpus size among
the sources by weight; a source stops at CAP times its size and the rest is shared again. The output is a row of
shards of SHARD slots. In each shard every source first gets the whole part of its expected number of slots; the
slots that remain are drawn multinomially from the fractional parts. A source's k-th slot takes the block that a
pseudorandom permutation of its block numbers has at k, another permutation for each pass over the source, so
blocks join slots by index and no block comes twice before all came once.

All draws are hashes of (SEED, shard or slot), so reruns agree. Only DataFrame functions run.

Defined cases: a null text has size 0 and is never taken; null sources form one source, last in the order; an
empty corpus has no slots; rows without a doc_id are left out; rows that share a doc_id are each a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, n_parts, running_total, stage, table, unstage

BLOCK, SHARD, CAP, SEED = 64, 1024, 3, 20240607
WEIGHTS = (5, 2, 1)
ROUNDS = 8
#: documents of one source are ordered within this many buckets, so that no task sorts a whole source
BUCKETS = 1024


def unit(*of) -> Column:
    """A uniform number in [0, 1) from a hash of columns and literals."""
    return F.pmod(F.xxhash64(F.lit(SEED), *of), F.lit(1 << 52)) / float(1 << 52)


def targets(sources: DataFrame, cap: int = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """sources (source, source_size), one row each, with its weight and target.

    The targets are min(cap * size, level * weight) for the one level at which they add up to all sizes. Sources
    reach their caps in the order of cap to weight, so running sums over that order find it.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    rows = sources.withColumn("weight", w).withColumn("most", (cap * F.col("source_size")).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    by_cap, all_ = Window.orderBy("ratio", F.col("source").asc_nulls_last()), Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    # the level if exactly the sources before this one are full
    full, closed = (F.coalesce(F.sum(x).over(before), F.lit(0.0)) for x in ("most", "weight"))
    rows = rows.withColumn("level", (F.sum("source_size").over(all_) - full) / (F.sum("weight").over(all_) - closed)).withColumn("at", F.row_number().over(by_cap))
    holds = F.col("level") <= F.col("ratio")
    rows = rows.withColumn("level", F.min_by(F.when(holds, F.col("level")), F.when(holds, F.col("at"))).over(all_))
    return rows.select("source", "source_size", "weight", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))


def permuted(i: Column, n: Column, *key) -> Column:
    """A permutation of 0..n-1, another for each key: rounds that swap i with its mirror at a hashed point, or do not."""

    def swap(x: Column, turn: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), turn, *key), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, mirror), turn, *key), F.lit(2)) == 0, mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), i.cast("long"), swap)


def placed(sized: DataFrame) -> DataFrame:
    """sized (doc_id, source, size) with `at`, the number of words of its source before the document; staged."""
    return stage(running_total(sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))), "source", "bucket", ["doc_id", "size"], "size", "at"))


def source_plan(docs: DataFrame) -> DataFrame:
    """One row for each source of placed documents: target, number of blocks, and slots wanted; staged."""
    plan = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long")).withColumn("id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    return stage(plan.withColumn("want", F.coalesce(F.try_divide("target", "source_size") * F.col("blocks"), F.lit(0.0))))


def pieces(docs: DataFrame) -> DataFrame:
    """Each block that a placed document reaches into, with the number of its words there."""
    first, last = F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK)
    out = docs.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    return out.withColumn("words", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest(F.col("at"), F.col("block") * BLOCK))


def slots(plan: DataFrame) -> DataFrame:
    """(source, block, slot): the blocks that the shards' slots take, slots numbered within each source."""
    spark = plan.sparkSession
    shards = int(-(-(plan.agg(F.sum("want")).first()[0] or 0.0) // SHARD))
    mean = F.col("want") / F.lit(max(1, shards))
    upto = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = plan.filter("blocks > 0").withColumn("whole", F.floor(mean)).withColumn("part", mean - F.floor(mean)).withColumn("upto", F.sum("part").over(upto))
    share = stage(share.select("id", "source", "blocks", "whole", "part", "upto"))  # read by the result
    left = share.agg(F.max("upto")).first()[0] or 0.0
    # the shard's draws: as many as fractional parts add up to, rounded at random so as to keep the mean
    draws = F.lit(int(left)) + (unit("shard", F.lit("n")) < (left - int(left))).cast("int")
    drawn = spark.range(shards).withColumnRenamed("id", "shard").withColumn("n", draws).filter("n > 0")
    drawn = drawn.withColumn("k", F.explode(F.sequence(F.lit(1), "n"))).withColumn("u", unit("shard", "k") * left)
    # u falls in one source's part of the line; unit cells make that an equality join
    line = share.withColumn("from", F.col("upto") - F.col("part")).withColumn("cell", F.explode(F.sequence(F.floor("from"), F.floor("upto"))))
    met = drawn.withColumn("cell", F.floor("u")).join(line, "cell").filter("u >= from and u < upto")
    extra = met.groupBy("shard", "id").agg(F.count("*").alias("drawn"))
    extra = running_total(extra.withColumn("bucket", F.floor(F.col("shard") / 4096)), "id", "bucket", ["shard"], "drawn", "before")
    sure = shards * F.col("whole")  # slots of whole parts are numbered first
    start = sure + F.col("before")
    extra = extra.join(share, "id").withColumn("slot", F.explode(F.sequence(start, start + F.col("drawn") - 1)))
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((sure - 1) / 4096)))
    # one row for each run of 4096 slots, dealt to all tasks before the slots are made
    even = share.filter(sure > 0).withColumn("run", run).repartition(n_parts(spark), "id", "run")
    even = even.withColumn("slot", F.explode(F.sequence(F.col("run") * 4096, F.least((F.col("run") + 1) * 4096, sure) - 1)))
    out = even.select("source", "blocks", "slot").unionByName(extra.select("source", "blocks", "slot")).filter(F.col("slot") < CAP * F.col("blocks"))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    return out.withColumn("block", permuted(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"), turn, F.col("source"))).select("source", "block", "slot")


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, source, text)."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(SPACE)).cast("long")
    sized = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    at = placed(stage(sized))
    plan = source_plan(at)
    times = slots(plan).groupBy("source", "block").agg(F.count("*").alias("times")).withColumnRenamed("source", "ts").withColumnRenamed("block", "tb")
    cut = pieces(at)
    taken = cut.join(times, cut.source.eqNullSafe(times.ts) & (cut.block == times.tb)).groupBy("doc_id", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    taken = taken.withColumnRenamed("doc_id", "td").withColumnRenamed("at", "ta")
    p = plan.select(F.col("source").alias("ps"), "source_size", "target")
    out = at.join(p, at.source.eqNullSafe(p.ps))
    out = out.join(taken, (F.col("doc_id") == F.col("td")) & (F.col("at") == F.col("ta")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op1_multinomial_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
