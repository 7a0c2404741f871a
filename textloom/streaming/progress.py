"""Rates and remaining times of running jobs, from observations that arrive one by one."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: fixed value: seconds that a window must span before a rate is told
LEAST_SECONDS = 45
#: Spark's state store with timers and several state variables a key
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "key long, id long, done long, per_minute double, eta long"
STATE = "anchor_at long, anchor_done long, done long, last_at long, held_done long, per_minute double, eta long"


class AnchoredRate(StatefulProcessor):
    """One job a key.

    The first step that is seen anchors the job, with its time and the count at it. A rate is that of the steps since
    the anchor, over a window of at least LEAST_SECONDS, and is held until the count moves. A job that was idle for
    longer than `idle` seconds is over: the next observation begins another one, and a timer frees the state of those
    that never come back.
    """

    def __init__(self, total: int, idle: int):
        self.total, self.idle = total, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # rows of one key and one batch: the source's limits on a batch bound them
        seen = pd.concat(list(rows)).sort_values(["at", "id"])
        state = self.job.get() if self.job.exists() else None
        anchor_at, anchor_done, done, last, held_done, rate, eta = state if state else (None, None, 0, None, None, None, None)
        if last is not None:
            self.handle.deleteTimer(self._over(last))
        out = []
        for at, id_, steps in zip(seen["at"].tolist(), seen["id"].tolist(), seen["steps"].tolist(), strict=True):
            if last is not None and at - last > self.idle * 1_000_000:
                anchor_at, anchor_done, done, held_done, rate, eta = None, None, 0, None, None, None
            done, last = done + steps, at
            if anchor_at is None and steps:
                anchor_at, anchor_done = at, done
            if held_done != done:
                rate = eta = held_done = None
                if anchor_at is not None and done > anchor_done and at - anchor_at >= LEAST_SECONDS * 1_000_000:
                    rate = (done - anchor_done) / ((at - anchor_at) / 60e6)
                    held_done, eta = done, int(max(0, self.total - done) / rate * 60 + 0.5)
            out.append((key[0], id_, done, rate, eta))
        self.job.update((anchor_at, anchor_done, done, last, held_done, rate, eta))
        self.handle.registerTimer(self._over(last))
        frame = pd.DataFrame(out, columns=["key", "id", "done", "per_minute", "eta"])
        yield frame.astype({"eta": "Int64"})

    def _over(self, last: int) -> int:
        """The time in milliseconds from which a job last seen at `last` is over."""
        return last // 1000 + self.idle * 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        yield pd.DataFrame(columns=["key", "id", "done", "per_minute", "eta"]).astype({"key": "int64", "id": "int64", "done": "int64", "per_minute": "float64", "eta": "Int64"})

    def close(self) -> None:
        pass


def rates(stream: DataFrame, key: str, id_: str, at: str, steps, total: int, idle: int, late: str = "0 seconds") -> DataFrame:
    """OUT for each row of the stream: steps done in its job, their rate and the seconds that are left of `total` steps.

    Rows of one key must not arrive in a batch before older ones; those of one batch may stand in any order.
    """
    rows = stream.withWatermark(at, late).select(F.col(key).cast("long").alias("key"), F.col(id_).cast("long").alias("id"), F.col(at).alias("event_time"), F.unix_micros(at).alias("at"), F.coalesce(steps.cast("long"), F.lit(0)).alias("steps"))
    rows = rows.filter("key is not null and at is not null")
    return rows.groupBy("key").transformWithStateInPandas(AnchoredRate(total, idle), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


class RateTable:
    """The same rates of large batches, for foreachBatch: all jobs of a batch at once by windows, and their state as a table.

    `rates` takes some milliseconds of Python for each key of a batch, whatever its rows; here a key costs what its rows do.
    A batch goes on from the state that the one before it left, and overwrites what it left itself, so a batch that is run
    again, after a stop anywhere, changes nothing. No row may arrive in a batch before older ones, and steps are 0 or more.
    The state of jobs that are over is left out.
    """

    KEPT = "key long, at long, done long, anchor_at long, anchor_done long, stamped long"

    def __init__(self, root: str, key: str, id_: str, at: str, steps: Column, total: int, idle: int):
        self.root, self.total, self.idle = root, total, idle
        self.rows = [F.col(key).cast("long").alias("key"), F.col(id_).cast("long").alias("id"), F.unix_micros(at).alias("at"), F.coalesce(steps.cast("long"), F.lit(0)).alias("steps")]

    def sink(self, batch: DataFrame, number: int) -> None:
        spark, place = batch.sparkSession, ("new", "at", F.col("id").isNull(), "id")
        new = batch.select(*self.rows).filter("key is not null and at is not null").withColumn("new", F.lit(True))
        if number:
            # a job's state stands before its new rows, as one step of all that was done
            new = new.unionByName(self.kept(number - 1).withColumnsRenamed({"done": "steps", "anchor_at": "_at", "anchor_done": "_done", "stamped": "_stamped"}).withColumn("new", F.lit(False)), allowMissingColumns=True)
        else:
            new = new.withColumns({c: F.lit(None).cast("long") for c in ("_at", "_done", "_stamped")})
        so_far = lambda *keys: Window.partitionBy(*keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
        told = lambda old, when, value: F.when(F.col("new"), F.when(when, value)).otherwise(F.col(old))
        gap = F.col("at") - F.lag("at").over(Window.partitionBy("key").orderBy(*place)) > self.idle * 1_000_000
        rows = new.withColumn("_over", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("_job", F.sum("_over").over(so_far("key")))
        job = so_far("key", "_job")
        rows = rows.withColumn("done", F.sum("steps").over(job)).withColumn("anchor_at", F.first(told("_at", F.col("steps") > 0, F.col("at")), True).over(job))
        rows = rows.withColumn("anchor_done", F.first(told("_done", F.col("steps") > 0, F.col("done")), True).over(job))
        wide = (F.col("done") > F.col("anchor_done")) & (F.col("at") - F.col("anchor_at") >= LEAST_SECONDS * 1_000_000)
        rows = rows.withColumn("stamped", F.first(told("_stamped", wide, F.col("at")), True).over(so_far("key", "_job", "done")))
        rows.select("key", "id", "at", "new", "done", "anchor_at", "anchor_done", "stamped").write.mode("overwrite").parquet(f"{self.root}/rated/_n={number}")
        rated = spark.read.parquet(f"{self.root}/rated/_n={number}")
        last = rated.groupBy("key").agg(F.max_by(F.struct("at", "done", "anchor_at", "anchor_done", "stamped"), F.struct(*place)).alias("s")).select("key", "s.*")
        latest = rated.agg(F.max("at")).first()[0]
        last.filter(F.col("at") + self.idle * 1_000_000 >= F.lit(latest)).write.mode("overwrite").parquet(f"{self.root}/kept/_n={number}")

    def kept(self, number: int) -> DataFrame:
        """The state of the jobs that go on after batch `number`."""
        spark = SparkSession.active()
        return spark.read.schema(self.KEPT).parquet(f"{self.root}/kept/_n={number}")

    def told(self) -> DataFrame:
        """OUT for each row of all batches."""
        rows = SparkSession.active().read.schema(f"id long, new boolean, {self.KEPT}, _n int").option("basePath", f"{self.root}/rated").parquet(f"{self.root}/rated").filter("new")
        rate = (F.col("done") - F.col("anchor_done")) / ((F.col("stamped") - F.col("anchor_at")) / F.lit(60e6))
        eta = F.floor(F.greatest(F.lit(0), self.total - F.col("done")) / F.col("per_minute") * 60 + 0.5).cast("long")
        return rows.withColumn("per_minute", rate).select("key", "id", "done", "per_minute", eta.alias("eta"))
