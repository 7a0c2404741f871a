"""Order-aware operators: runs, neighbours, budgets, batches with context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(df: DataFrame, keys: list[str], order: list[str], same: Column, name: str = "run") -> DataFrame:
    """Numbers runs of neighbouring rows from 1 in each group; `same` says whether a row goes on its predecessor's run."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn(name, F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def within_budget(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows in order until the costs before a row reach the budget; the row that crosses it still counts."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(cost).over(before), F.lit(0.0))).filter(F.col("_before") < budget).drop("_before")


def batches_with_context(df: DataFrame, keys: list[str], order: str, value: str, size: int, context: int = 3) -> DataFrame:
    """One row for each batch of `size` rows: its values, and those of the `context` rows before it."""
    over = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_at", F.row_number().over(over) - 1).withColumn("batch", F.floor(F.col("_at") / size)).withColumn("_before", F.collect_list(value).over(over.rowsBetween(-context, -1)))
    head = F.min_by("_before", "_at")
    return rows.groupBy(*keys, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("items"), head.alias("context"))


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def monotone_share(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Share of neighbouring pairs that do not fall; and whether all strictly rise."""
    over = Window.partitionBy(*keys).orderBy(*order)
    pairs = df.withColumn("_prev", F.lag(value).over(over)).filter("_prev is not null")
    return pairs.groupBy(*keys).agg(F.avg(F.when(F.col(value) >= F.col("_prev"), 1.0).otherwise(0.0)).alias("share"), F.bool_and(F.col(value) > F.col("_prev")).alias("rising"))
