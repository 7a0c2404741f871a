"""Sequential helpers, and the Spark functions that apply them."""

import random
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import sequences as S


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=9))
def test_rising_indices_are_longest(values):
    found = S.rising_indices(values)
    assert all(values[a] < values[b] and a < b for a, b in zip(found, found[1:], strict=False))
    best = max((k for k in range(len(values) + 1) for c in combinations(values, k) if all(x < y for x, y in zip(c, c[1:], strict=False))), default=0)
    assert len(found) == best


def test_packing_keeps_the_cap():
    assert S.pack([5, 5, 5, 30, 2], 11) == [0, 0, 1, 2, 3]
    assert S.pack([], 10) == []


def test_changes_round_trip(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(12))]
        b = [w for w in a if rng.random() > 0.3] + [rng.choice("xyz") for _ in range(rng.randrange(3))]
        rows.append((i, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "i int, a string, b string").withColumn("c", S.changes(F.col("a"), F.col("b")))
    for r in df.withColumn("old", S.hydrated(F.col("b"), F.col("c"))).collect():
        assert r["old"] == r["a"].split()


def test_long_texts_have_changes(spark):
    a = [f"w{i}" for i in range(1200)]
    b = [*a[:500], "new", *a[503:], "end"]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string").withColumn("c", S.changes(F.col("a"), F.col("b")))
    found = df.withColumn("old", S.hydrated(F.col("b"), F.col("c"))).first()
    assert [tuple(c) for c in found["c"]] == [(500, 1, "new", "w500 w501 w502"), (1198, 1, "end", "")]
    assert found["old"] == a


def test_kept_cues_look_at_kept_ones_only(spark):
    df = spark.createDataFrame([("g", 1, 0.0, 10.0), ("g", 2, 5.0, 30.0), ("g", 3, 12.0, 14.0), ("h", 4, 1.0, 2.0)], "k string, id long, lo double, hi double")
    assert sorted(r["id"] for r in S.kept_cues(df, "k").collect()) == [1, 3, 4]
