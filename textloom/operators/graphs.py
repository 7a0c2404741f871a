"""Connected components by contraction."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources.staging import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (x, y) of each batch as stars: every id of a component of the batch with the smallest id there."""
    for batch in batches:
        ids, ends = np.unique(np.concatenate([batch["x"].to_numpy(), batch["y"].to_numpy()]), return_inverse=True)
        if not len(ids):
            continue
        x, y = ends[: batch.num_rows], ends[batch.num_rows :]
        least = np.arange(len(ids))
        while True:
            low = np.minimum(least[x], least[y])
            before = least.copy()
            for side in (x, y):
                np.minimum.at(least, before[side], low)  # the smallest id of a tree, then of its ids
            least = least[least]
            if (least == before).all():
                break
        own = np.flatnonzero(least != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[least[own]])], ["x", "y"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id) with `component`, the smallest id that edges (a, b) reach from it.

    Tasks first put stars for the edges that they hold. An id that hangs on several centres joins these; what joins
    centres is contracted in rounds, each of which sends every label to a random one among itself and its neighbours,
    which merges a constant share of them whatever the shape of the graph. Only centres take part in the rounds.
    """
    edges = edges.select(F.col("a").cast("long").alias("x"), F.col("b").cast("long").alias("y")).filter("x != y")
    stars = edges.mapInArrow(_stars, "x long, y long")
    hung = staged(stars.groupBy("x").agg(F.collect_set("y").alias("ys")).select("x", F.array_min("ys").alias("y"), F.filter("ys", lambda v: v > F.array_min("ys")).alias("more")))
    centres = hung.select("y").distinct()
    left = hung.filter(F.size("more") > 0).select("y", F.explode("more").alias("x")).select("x", "y")
    left = staged(left.unionByName(hung.join(centres.select(F.col("y").alias("x")), "x", "left_semi").select("x", "y")).distinct())
    ends = left.select("x").unionByName(left.select(F.col("y").alias("x"))).distinct()
    names = _contracted(ends.select(F.col("x").alias("id")), left).select(F.col("id").alias("y"), "component")
    labels = hung.select("x", "y").join(names, "y", "left").select(F.col("x").alias("id"), F.coalesce("component", "y").alias("component"))
    # a centre that hangs nowhere has its name from the rounds, or is the smallest of its own
    tops = names.join(hung.select(F.col("x").alias("y")), "y", "left_anti").select(F.col("y").alias("id"), "component")
    known = labels.unionByName(tops)
    return nodes.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _contracted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """components, by rounds over all nodes; edges (x, y) are distinct, and their ends are nodes."""
    labels, left = staged(nodes.select("id", F.col("id").alias("label"))), edges
    turn = 0
    while not left.isEmpty():
        turn += 1
        back = left.select(F.col("y").alias("x"), F.col("x").alias("y"))
        ends = left.unionByName(back)
        ends = ends.unionByName(ends.select("x", F.col("x").alias("y")).distinct())
        to = staged(ends.groupBy("x").agg(F.min_by("y", F.xxhash64("y", F.lit(turn))).alias("m")))
        labels = staged(labels.join(to, labels.label == to.x, "left").select("id", F.coalesce("m", "label").alias("label")))
        mx, my = to.select("x", F.col("m").alias("mx")), to.select(F.col("x").alias("y"), F.col("m").alias("my"))
        left = staged(left.join(mx, "x").join(my, "y").select(F.col("mx").alias("x"), F.col("my").alias("y")).filter("x != y").distinct())
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return staged(labels.join(least, "label").select("id", "component"))


def kinds(members: DataFrame, component: str, is_read: Column) -> DataFrame:
    """(component, read_, known, kind): how many ids of each side a component has, and what that makes it.

    Rows that are not read are known. One read id with several known ones is merged, one known id with several read
    ones split, several of both tangled; one side alone is spurious or missed.
    """
    n = members.groupBy(component).agg(F.count_distinct(F.when(is_read, F.col("id"))).alias("read_"), F.count_distinct(F.when(~is_read, F.col("id"))).alias("known"))
    kind = F.when(F.col("known") == 0, "spurious").when(F.col("read_") == 0, "missed").when((F.col("known") == 1) & (F.col("read_") == 1), "one_to_one")
    return n.withColumn("kind", kind.when(F.col("read_") == 1, "merged").when(F.col("known") == 1, "split").otherwise("tangled"))
