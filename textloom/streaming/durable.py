"""Streams that are stopped and started again: resumed runs, and deliveries that are tried until they are made.

What a run leaves in the folder of its checkpoint is all that the next one needs; no state stands in the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from textloom.sources.staging import work_folder

Build = Callable[[DataFrame], DataFrame]


def new_folder(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/{uuid.uuid4().hex}"


def arrived(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def run_appended(stream: DataFrame, root: str, conf: dict[str, str] | None = None) -> None:
    """Runs the stream over what is there and was not read by earlier runs with the same root; adds its rows to root/rows."""
    _run(stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/rows"), root, stream.sparkSession, conf)


def run_updated(stream: DataFrame, root: str, conf: dict[str, str] | None = None) -> None:
    """The same for an aggregate: each batch leaves its changed rows under its number, and writes them anew if it is run again."""

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/changed/_n={number}")

    _run(stream.writeStream.outputMode("update").foreachBatch(add), root, stream.sparkSession, conf)


def run_batches(stream: DataFrame, root: str, sink: Callable[[DataFrame, int], None]) -> None:
    """The same for a sink that takes batches by their numbers."""
    _run(stream.writeStream.foreachBatch(sink), root, stream.sparkSession, None)


def _run(writer, root: str, spark: SparkSession, conf: dict[str, str] | None) -> None:
    """Settings count for the run alone; a stream keeps those of its first run in its checkpoint."""
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        query = writer.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def latest(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """The last row of each key that run_updated left: a key's batch numbers are compared, not its rows gathered."""
    rows = spark.read.parquet(f"{root}/changed").drop("_n")
    last = rows.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return rows.join(last, [*keys, "_batch"]).drop("_batch")


def in_runs(parts: list[DataFrame], build: Build, run: Callable[..., None], conf: dict[str, str] | None = None) -> str:
    """Lets the parts arrive one after the other, each read by a run of its own that starts where the last one stopped."""
    spark, root = parts[0].sparkSession, new_folder(parts[0].sparkSession)
    for part in parts:
        part.write.mode("append").parquet(f"{root}/arrived")
        run(build(arrived(spark, f"{root}/arrived", part.schema)), root, conf)
    return root


def halves(rows: DataFrame, at: str) -> list[DataFrame]:
    """Rows up to about the middle of their times, and those after."""
    cut = rows.agg(F.percentile_approx(F.unix_micros(at), 0.5)).first()[0]
    return [rows.filter(F.unix_micros(at) <= F.lit(cut)), rows.filter(F.unix_micros(at) > F.lit(cut))] if cut is not None else [rows]


class RetryQueue:
    """Deliveries to servers, each tried until it is made.

    A pass goes through all that waits, oldest first for each server. The first delivery that fails puts off the
    server's later ones to the next pass, other servers' go on. `fails` gives, for the number of a
    pass, the Column that is true for a row whose delivery fails in it.

    A pass reads what pass n - 1 left and overwrites what pass n left, so a pass that is run again, after a stop
    anywhere, changes nothing. Rows of the same id are one delivery: of rows that come together the oldest is taken,
    and one that was delivered or waits already is dropped.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, server: str, order: list[str], id_: str, fails: Callable[[int], Column]):
        self.spark, self.root, self.schema = spark, root, schema
        self.server, self.order, self.id_, self.fails = server, order, id_, fails

    def _left(self, name: str, number: int) -> DataFrame:
        """What pass `number` delivered or put off."""
        if number < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}/_n={number}")

    def delivered(self, passes: int | None = None) -> DataFrame:
        """All deliveries of the passes before `passes`, with the number of the pass as _n."""
        if passes == 0:
            return self.spark.createDataFrame([], self.schema).withColumn("_n", F.lit(0))
        rows = self.spark.read.schema(StructType([*self.schema.fields, StructField("_n", IntegerType())])).option("basePath", f"{self.root}/delivered").parquet(f"{self.root}/delivered")
        return rows.filter(F.col("_n") < passes) if passes is not None else rows

    def flush(self, number: int, batch: DataFrame | None = None) -> None:
        """Pass `number`, from 0 on, over what waits and the new rows of batch."""
        waiting = self._left("waiting", number - 1)
        if batch is not None:
            first = F.min_by(F.struct(*batch.columns), F.struct(*self.order)).alias("r")
            new = batch.groupBy(self.id_).agg(first).select("r.*")
            seen = waiting.select(self.id_).unionByName(self.delivered(number).select(self.id_))
            waiting = waiting.unionByName(new.join(seen, self.id_, "left_anti").select(waiting.columns))
        place = F.struct(*self.order, self.id_)
        tried = waiting.withColumn("_fails", self.fails(number))
        # one row a server: which of its deliveries fails first
        failed = tried.filter("_fails").groupBy(self.server).agg(F.min(place).alias("_first")).withColumnRenamed(self.server, "_server")
        marked = tried.join(failed, F.col(self.server).eqNullSafe(F.col("_server")), "left").withColumn("_done", F.col("_first").isNull() | (place < F.col("_first")))
        for name, kept in (("delivered", F.col("_done")), ("waiting", ~F.col("_done"))):
            marked.filter(kept).select(self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.root}/{name}/_n={number}")

    def sink(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: one pass for each batch, under its number."""
        self.flush(number, batch)

    def waits(self, number: int) -> DataFrame:
        return self._left("waiting", number)
