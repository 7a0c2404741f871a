"""Ranked values against a sorted list: groups of any size, null and odd values, and no group sorted whole."""

import random

import pytest

from textloom.operators import measures


@pytest.mark.parametrize("rule", ["nearest", "floor_n", "floor_n1", "upper_middle"])
def test_ranks_of_odd_groups(spark, rule):
    rng = random.Random(3)
    inf, nan = float("inf"), float("nan")
    groups = {"a": [rng.gauss(0, 1) ** 3 for _ in range(3000)], None: [1.0, 2.0, 2.0, 7.5], "same": [4.0] * 9, "wide": [-1e308, 1e308, 0.0, inf, -inf], "nan": [1.0, nan, 3.0], "one": [5.0], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    out = {r["k"]: r for r in measures.ranked_value(df, ["k"], "v", [0.0, 0.5, 0.95], rule).collect()}
    at = {"nearest": lambda q, n: round(q * (n - 1)), "floor_n": lambda q, n: min(n - 1, int(n * q)), "floor_n1": lambda q, n: int(q * (n - 1)), "upper_middle": lambda q, n: n // 2}[rule]
    assert set(out) == set(groups) - {"none"}
    for k, r in out.items():
        order = sorted(groups[k], key=lambda v: (v != v, v))
        for q, name in ((0.0, "q0"), (0.5, "q50"), (0.95, "q95")):
            assert str(r[name]) == str(order[at(q, len(order))]), (k, name)


def test_no_group_is_sorted_whole(spark):
    df = spark.range(100000).selectExpr("id % 2 AS k", "CAST(id AS double) AS v")
    out = measures.ranked_value(df, ["k"], "v", [0.5], "floor_n1")
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "_bin" in plan.split("Window")[1].split("\n")[0]
