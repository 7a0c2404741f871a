"""Halves and last places: what rounds as the SQL of a query has it, whatever the order of the rows."""

import datetime

import duckdb
import pytest

from textloom import catalog

BEGUN = datetime.datetime(2024, 1, 1, 0, 0, 59, 999500)


def both(spark, folder, rows, name):
    """A query's rows and its SQL's on the same events, each dealt to a task of its own."""
    path = f"{folder}/events.parquet"
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, kinds).repartition(len(rows)).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/*.parquet'")
    cursor = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    return sorted(tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, folder).collect()), sorted(cursor.fetchall())


@pytest.mark.parametrize("ts", [BEGUN, BEGUN - datetime.timedelta(microseconds=1), datetime.datetime(1969, 12, 31, 23, 59, 0, 500), datetime.datetime(1969, 12, 31, 23, 57, 30)])
def test_spans_begin_at_the_nearest_millisecond(spark, tmp_path, ts):
    found, wanted = both(spark, str(tmp_path), [(1, ts, 1, "view", 1.0, "{}")], "adjacent_spans")
    assert found == wanted


@pytest.mark.parametrize("values", [[2.5], [3.5], [-2.5], [2.0, 0.25, 0.25]])
def test_completed_rounds_halves_to_even(spark, tmp_path, values):
    found, wanted = both(spark, str(tmp_path), [(k, BEGUN, 1, "view", v, "{}") for k, v in enumerate(values)], "worker_progress")
    assert found == wanted


def test_sums_at_a_half_are_those_of_the_decimals(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    # 41.75 on average; added in this order, doubles make less of them
    values = [67.01, 35.63, 1.72, 39.66, 35.96, 57.72, 56.9, 10.75, 0.17, 9.67, 24.27, 34.62, 36.77, 66.4, 70.6, 63.1, 2.32, 51.38, 18.65, 30.5, 17.74, 17.5, 17.33, 18.3, 39.63, 2.04, 23.18, 75.13, 35.03, 14.87, 43.31, 60.98, 75.62, 57.72, 208.79, 53.62, 18.47, 2.27, 33.77, 7.51, 44.52, 52.13, 72.11, 47.01, 68.8, 67.79, 20.41, 66.86, 74.92, 26.62, 79.4, 33.77, 61.1, 2.45]
    rows = [(k, BEGUN, 1, "view", v, "{}") for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
    assert catalog.QUERIES["thermal_summary"](spark, str(tmp_path)).first()["mean_temp"] == 41.8


def test_sums_that_no_decimal_holds(spark):
    from pyspark.sql import functions as F

    from textloom.operators import measures

    df = spark.createDataFrame([("a", 1e300), ("a", 1.0), ("b", float("nan")), ("c", None), ("d", None), ("d", 0.5), ("e", 1e-12), ("e", 2e-12)], "k string, v double")
    out = {r["k"]: r["s"] for r in df.groupBy("k").agg(measures.steady_sum("v").alias("s")).collect()}
    assert out["a"] == 1e300 and out["b"] != out["b"] and out["c"] is None and out["d"] == 0.5 and out["e"] == pytest.approx(3e-12)
    assert df.filter("false").agg(measures.steady_sum("v").alias("s"), F.count("*")).first()["s"] is None
