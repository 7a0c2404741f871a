"""Operators on small literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import joins, listening, measures, trees, windows


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_ingest_drops_caps_and_ignores_repeats(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 10.0), (2, -1.0), (3, 9999.0), (4, float("nan")), (5, float("inf")), (6, None)], "event_id long, seconds double")
    assert rows(listening.accepted(df), "event_id", "seconds") == [(1, 10.0), (3, 3600.0)]


def test_late_removal_retracts_earlier_events(spark):
    events = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1)], "book string, at int")
    gone = spark.createDataFrame([("a", 3), ("a", 1)], "book string, at int")
    assert rows(listening.after_removals(events, gone, "book"), "book", "at") == [("a", 5), ("b", 1)]


def test_intervals_touching_within_one_merge(spark):
    df = spark.createDataFrame([("r", 1, 3), ("r", 4, 6), ("r", 9, 8), ("r", 10, 12), ("r", 1, 2)], "k string, lo int, hi int")
    assert rows(listening.coalesced(df, ["k"], "lo", "hi"), "lo", "hi") == [(1, 6), (10, 12)]


def test_contradicting_alias_is_an_error(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "old string, new string")
    with pytest.raises(Exception, match="contradicting"):
        joins.checked_aliases(df, "old", "new").collect()


def test_cycle_is_an_error(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        trees.ancestors(df)


def test_below_marked_nodes(spark):
    rng = random.Random(1)
    nodes = [(k, rng.randrange(k) if k and rng.random() < 0.95 else None) for k in range(300)] + [(1000 + k, 999 + k if k else 7777) for k in range(200)]
    marked = {3, 17, 40, 1050, 7777}
    parent = dict(nodes)

    def hit(k):
        while (k := parent.get(k)) is not None:
            if k in marked:
                return True
        return False

    df = spark.createDataFrame(nodes, "id long, parent long")
    found = sorted(r["id"] for r in trees.below(df, spark.createDataFrame([(m,) for m in marked], "id long")).collect())
    assert found == sorted(k for k, _ in nodes if hit(k))
    with pytest.raises(ValueError, match="cycle"):
        trees.below(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id long, parent long"), spark.createDataFrame([(9,)], "id long"))


def test_ancestors_of_a_chain(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)], "id long, parent long")
    assert rows(trees.ancestors(df), "id", "ancestor", "distance") == sorted((i, j, i - j) for i in range(9) for j in range(i))


def test_percentile_rules_differ(spark):
    df = spark.createDataFrame([("k", float(i)) for i in (1, 2, 3, 4)], "k string, v double")
    pick = lambda rule: measures.ranked_value(df, ["k"], "v", [0.5], rule).first()["q50"]
    assert [pick(r) for r in ("nearest", "floor_n", "floor_n1", "upper_middle")] == [3.0, 3.0, 2.0, 3.0]


def test_budget_takes_the_row_that_crosses_it(spark):
    df = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 5.0), ("k", 3, 5.0)], "k string, i int, cost double")
    assert rows(windows.within_budget(df, ["k"], [F.col("i")], "cost", 6.0), "i") == [(1,), (2,)]


def test_contained_meets_by_bins(spark):
    points = spark.createDataFrame([(1, 5.0), (2, 25.0)], "p int, at double")
    spans = spark.createDataFrame([(1, 0.0, 10.0), (2, 4.0, 26.0)], "s int, lo double, hi double")
    assert rows(joins.contained(points, F.col("at"), spans, "lo", "hi", 3.0), "p", "s") == [(1, 1), (1, 2), (2, 2)]
