"""Parent trees and operation logs. Depth is bounded by pointer doubling: log2(depth) joins, not depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.staging import staged


def ancestors(nodes: DataFrame, id_: str = "id", parent: str = "parent", most_depth: int = 1 << 20) -> DataFrame:
    """(id, ancestor, distance) for every proper ancestor of every node.

    Each round joins the pairs found so far with themselves, which doubles the distance they reach. A cycle would
    reach a node from itself, which is an error.
    """
    pairs = nodes.filter(F.col(parent).isNotNull()).select(F.col(id_).alias("id"), F.col(parent).alias("ancestor"), F.lit(1).cast("long").alias("distance"))
    pairs = staged(pairs)
    reach = 1
    while reach < most_depth:
        # of the pairs at exactly `reach`, everything that their ends reach, and no pair twice
        edge = pairs.filter(F.col("distance") == reach)
        more = edge.alias("a").join(pairs.alias("b"), F.col("a.ancestor") == F.col("b.id")).select("a.id", F.col("b.ancestor").alias("ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        more = staged(more)
        if more.isEmpty():
            break
        if not more.filter("id = ancestor").isEmpty():
            raise ValueError("the parents form a cycle")
        pairs, reach = pairs.unionByName(more), 2 * reach
    return pairs


def below(nodes: DataFrame, marked: DataFrame, id_: str = "id", parent: str = "parent") -> DataFrame:
    """(id) of the nodes that have a marked node (id) among their proper ancestors.

    Each node looks up a pointer and knows whether a marked node was passed; a round doubles what it has passed. All
    rounds together read the nodes log2(depth) times, and no pairs of nodes and ancestors are written. A cycle, from
    which no pointer gets out, is an error.
    """
    marks = marked.select(F.col("id").alias("_marked")).distinct()
    rows = nodes.select(F.col(id_).alias("id"), F.col(parent).alias("up")).join(marks, F.col("up") == F.col("_marked"), "left")
    rows = staged(rows.select("id", "up", F.col("_marked").isNotNull().alias("hit")))
    most = rows.count()
    passed = 1
    while not rows.filter("up is not null").isEmpty():
        if passed > most:
            raise ValueError("the parents form a cycle")
        next_ = rows.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("hit").alias("_hit"))
        rows = staged(rows.join(next_, F.col("up") == F.col("_id"), "left").select("id", F.col("_up").alias("up"), (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit")))
        passed *= 2
    return rows.filter("hit").select("id")


def subtree(nodes: DataFrame, root) -> DataFrame:
    """Ids of the root's descendants and itself."""
    own = nodes.sparkSession.createDataFrame([(root,)], "id long")
    return below(nodes, own).unionByName(own)
