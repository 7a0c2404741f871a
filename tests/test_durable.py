"""Streams that stop and start again, and deliveries that are tried until they are made."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.streaming import durable as D
from textloom.streaming import progress as P

SECOND = 1_000_000


def observed(rows):
    """Brute force: (key, id) -> (done, rate, eta) with total 10 and jobs over after 600 seconds."""
    out, jobs = {}, {}
    for key, at, id_, steps in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        job = jobs.get(key)
        if job is None or at - job["last"] > 600:
            job = jobs[key] = {"done": 0, "anchor": None, "held": None}
        job["done"] += steps
        job["last"] = at
        if job["anchor"] is None and steps:
            job["anchor"] = (at, job["done"])
        if job["held"] is None or job["held"][0] != job["done"]:
            job["held"] = None
            if job["anchor"] and job["done"] > job["anchor"][1] and at - job["anchor"][0] >= 45:
                rate = (job["done"] - job["anchor"][1]) / ((at - job["anchor"][0]) / 60)
                job["held"] = (job["done"], rate, int(max(0, 10 - job["done"]) / rate * 60 + 0.5))
        out[key, id_] = (job["done"], *(job["held"][1:] if job["held"] else (None, None)))
    return out


@pytest.mark.parametrize("cuts", [[], [300], [100, 101, 400, 2500]])
def test_rates_of_resumed_streams(spark, cuts):
    rng = random.Random(1)
    rows = [(k, t, 1000 * k + n, rng.choice([0, 0, 1, 2])) for k in range(4) for n, t in enumerate(sorted(rng.sample(range(4000), 60)))]
    df = spark.createDataFrame(rows, "k long, t long, i long, s long").withColumn("ts", F.timestamp_seconds("t"))
    bounds = [-1, *cuts, 10_000]
    parts = [df.filter((F.col("t") > a) & (F.col("t") <= b)).drop("t") for a, b in zip(bounds, bounds[1:], strict=False)]
    root = D.in_runs(parts, lambda s: P.rates(s, "k", "i", "ts", F.col("s"), 10, 600), D.run_appended, P.STORE)
    found = {(r["key"], r["id"]): (r["done"], r["per_minute"], r["eta"]) for r in spark.read.parquet(f"{root}/rows").collect()}
    want = observed(rows)
    assert found.keys() == want.keys()
    for k, (done, rate, eta) in want.items():
        assert found[k][0] == done and found[k][2] == eta and found[k][1] == pytest.approx(rate)
    assert sum(r is not None for _, r, _ in want.values()) > 50


@pytest.mark.parametrize("cuts", [[], [300, 301], [100, 101, 2500]])
def test_rates_of_whole_batches(spark, cuts):
    rng = random.Random(2)
    rows = [(k, t, 1000 * k + n, rng.choice([0, 0, 1, 2])) for k in range(4) for n, t in enumerate(sorted(rng.choices(range(4000), k=60)))]
    rows += [(9, 50, 9000, 1), (9, 3000, 9001, 1), (9, 3050, 9002, 3)]  # over before it comes again
    df = spark.createDataFrame(rows, "k long, t long, i long, s long").withColumn("ts", F.timestamp_seconds("t"))
    df = df.unionByName(spark.createDataFrame([(None, 1, 1, 1), (1, None, 2, 1)], "k long, t long, i long, s long").withColumn("ts", F.timestamp_seconds("t")))
    bounds = [-1, *cuts, 10_000]
    parts = [df.filter((F.col("t") > a) & (F.col("t") <= b)).drop("t") for a, b in zip(bounds, bounds[1:], strict=False)]
    table = P.RateTable(D.new_folder(spark), "k", "i", "ts", F.col("s"), 10, 600)
    D.in_runs(parts, lambda s: s, lambda stream, root, conf: D.run_batches(stream, root, table.sink))
    table.sink(parts[-1], len(cuts))  # run again, as after a stop
    found = {(r["key"], r["id"]): (r["done"], r["per_minute"], r["eta"]) for r in table.told().collect()}
    want = observed(rows)
    assert table.told().count() == len(rows) and found.keys() == want.keys()
    for k, (done, rate, eta) in want.items():
        assert found[k][0] == done and found[k][2] == eta and found[k][1] == pytest.approx(rate)
    assert all(r["at"] >= (max(x[1] for x in rows) - 600) * SECOND for r in table.kept(len(cuts)).collect())


def test_anchored_rates_calls_nothing_for_each_key(spark, monkeypatch):
    from textloom import catalog

    monkeypatch.setattr(P, "rates", None)
    assert catalog.QUERIES["anchored_rates"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def queue_of(spark, rows, fails):
    df = spark.createDataFrame(rows, "id long, server string, at long")
    return df, D.RetryQueue(spark, D.new_folder(spark), df.schema, "server", ["at"], "id", fails)


def made(queue):
    return sorted((r["_n"], r["id"]) for r in queue.delivered().collect())


def test_a_server_that_fails_is_put_off_and_others_are_not(spark):
    df, queue = queue_of(spark, [(1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "b", 1), (5, None, 1)], lambda n: (F.col("id") == 2) & F.lit(n < 2))
    queue.sink(df, 0)
    assert made(queue) == [(0, 1), (0, 4), (0, 5)]
    assert [r["id"] for r in queue.waits(0).orderBy("id").collect()] == [2, 3]
    queue.flush(1)
    assert made(queue) == [(0, 1), (0, 4), (0, 5)]
    queue.flush(2)
    assert made(queue) == [(0, 1), (0, 4), (0, 5), (2, 2), (2, 3)]
    assert queue.waits(2).count() == 0


def test_a_pass_that_is_run_again_changes_nothing(spark):
    df, queue = queue_of(spark, [(k, "ab"[k % 2], k) for k in range(20)], lambda n: F.col("id") % 7 == 3 + n)
    queue.sink(df, 0)
    queue.sink(df.filter("id < 5").unionByName(df.withColumn("id", F.col("id") + 100)), 1)  # old ids come again
    before = made(queue)
    queue.sink(df.filter("id < 5").unionByName(df.withColumn("id", F.col("id") + 100)), 1)
    assert made(queue) == before
    for n in range(2, 9):
        queue.flush(n)
    assert sorted(i for _, i in made(queue)) == [*range(20), *range(100, 120)]


def test_the_same_id_twice_in_a_batch_is_one_delivery(spark):
    df, queue = queue_of(spark, [(1, "a", 5), (1, "a", 4), (1, "b", 9)], lambda n: F.lit(False))
    queue.sink(df, 0)
    assert [(r["server"], r["at"]) for r in queue.delivered().collect()] == [("a", 4)]
