"""Mix scores, clusters of a block, and fits of lines to bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import fitting as G

from .registry import Tables, query


@query()
def mix_scores(t: Tables):
    """How far apart the two halves of each label's vectors are."""
    out = G.mix_scores(t.embeddings, "label", "vec_id", "embedding")
    return out.select("label", "n", F.round("score", 4).alias("score"), F.round("share", 4).alias("share"))


@query()
def linked_clusters(t: Tables):
    """Vectors of each label clustered by average linkage."""
    out = G.average_linkage(t.embeddings, "label", "vec_id", "embedding", 0.6)
    return out.select(F.col("id").alias("vec_id"), F.col("block").cast("int").alias("label"), "cluster")


@query()
def nearest_fits(t: Tables):
    """Scale and offset between an order's prices as lines and the same as bands, shifted and partly lost."""
    li = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") % 700).alias("r"))
    li = li.withColumn("page", F.col("l_suppkey") * 1000 + F.col("l_orderkey") % 7)
    shift = F.col("page") % 17 - 8.0
    bands = li.filter("l_linenumber <> 3").select("page", (F.col("r") * (1 + (F.col("page") % 5 - 2) * 0.01) + shift).alias("c"))
    out = G.nearest_fits(li.select("page", "r"), bands, "page")
    return out.select("page", F.round("a", 3).alias("a"), F.round("b", 1).alias("b"), "votes")
