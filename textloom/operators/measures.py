"""Percentile rules, histograms, confusion counts and other summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.sources.staging import staged

#: stretches that a group's range of values is counted in
BINS = 1000
#: how a quantile q of n sorted values picks an index from 0
RULES = {
    "nearest": lambda q, n: F.bround(q * (n - 1)),
    "floor_n": lambda q, n: F.least(n - 1, F.floor(n * q)),
    "floor_n1": lambda q, n: F.floor(q * (n - 1)),
    "upper_middle": lambda q, n: F.floor(n / 2),
    "ceil_n1": lambda q, n: F.ceil(q * (n - 1)),
}


def steady_sum(value: str) -> Column:
    """The sum of a group's doubles as their decimals have it, whatever the order of the rows.

    A sum of doubles is off in its last places by the order in which tasks add, which decides a rounding at a half.
    Where a value has over 10 decimals, or 18 digits before them, the group's sum is that of the doubles.
    """
    exact = F.col(value).try_cast("decimal(28,10)")
    kept = F.coalesce(exact.cast("double") == F.col(value), F.col(value).isNull())
    return F.when(F.bool_and(kept), F.try_sum(exact).cast("double")).otherwise(F.sum(value))


def ranked_value(df: DataFrame, keys: list[str], value: str, quantiles: list[float], rule: str = "nearest") -> DataFrame:
    """One column q<percent> for each quantile: the value whose place in its group's order the rule names.

    Values are counted in BINS equal stretches of their group's range; only the stretches that hold a wanted place are
    sorted, so a group of any size is counted by all tasks. A range that has no finite width is one stretch.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    as_double = F.col(value).cast("double")
    finite = F.when(~F.isnan(as_double), as_double)
    bounds = staged(rows.groupBy(*keys).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.count("*").alias("_n")))
    same = lambda a, b, columns: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])
    wide = F.col("_hi") - F.col("_lo")
    # neither rounding nor the cast puts a larger value in an earlier stretch
    stretch = F.when(F.isnan(as_double), BINS + 1).when((wide > 0) & (wide < float("inf")), F.floor((as_double - F.col("_lo")) / wide * BINS)).otherwise(0)
    met = rows.join(bounds, same(rows, bounds, keys)).select(*[rows[k] for k in keys], rows[value], stretch.cast("int").alias("_bin"), "_n")
    counts = met.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_c"))
    places = [RULES[rule](F.lit(q), F.col("_n")).cast("long") for q in quantiles]
    near = staged(counts.filter(reduce(lambda x, y: x | y, [(at >= F.col("_before")) & (at < F.col("_before") + F.col("_c")) for at in places])).select(*keys, "_bin", "_before"))
    held = met.join(near, same(met, near, [*keys, "_bin"])).select(*[met[k] for k in keys], met[value], met["_bin"], met["_n"], near["_before"])
    ranked = held.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(value)) - 1 + F.col("_before"))
    picks = [F.max(F.when(F.col("_at") == at, F.col(value))).alias(f"q{round(q * 100)}") for q, at in zip(quantiles, places, strict=True)]
    return ranked.groupBy(*keys).agg(*picks)


def interpolated(df: DataFrame, keys: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """(keys, n, q<percent>...): quantiles between the two values around their place; n counts the values that are there.

    The values are those of ranked_value, so no task holds the distinct values of a group.
    """
    low, high = (ranked_value(df, keys, value, quantiles, rule) for rule in ("floor_n1", "ceil_n1"))
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    parts = {"low": low, "high": high, "n": n}
    names = [f"q{round(q * 100)}" for q in quantiles]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select(*keys, *[F.col(c).alias(f"_{side}_{c}") for c in df.columns if c not in keys]) for side, df in parts.items()])
    one = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rows.columns if c not in keys])

    def between(q: float, name: str) -> Column:
        at = F.lit(q) * (F.col("_n_n") - 1)
        a, b = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return F.when(a == b, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b).cast("double").alias(name)

    return one.select(*keys, F.col("_n_n").alias("n"), *[between(q, name) for q, name in zip(quantiles, names, strict=True)])


def histogram(df: DataFrame, value: Column, edges: list[float], label: str = "bucket") -> DataFrame:
    """Counts by the first edge that is not below the value, all edges present, the rest under 'over'."""
    names = [f"<={e:g}" for e in edges] + ["over"]
    bucket = F.lit(None).cast("string")
    for e, name in reversed(list(zip(edges, names, strict=False))):
        bucket = F.when(value <= e, name).otherwise(bucket)
    counts = df.filter(value.isNotNull()).groupBy(F.coalesce(bucket, F.lit("over")).alias(label)).agg(F.count("*").alias("n"))
    all_ = df.sparkSession.createDataFrame([(n,) for n in names], f"{label} string")
    return all_.join(F.broadcast(counts), label, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rank_of(df: DataFrame, value: str, of: float, inclusive: bool = False) -> Column:
    """Percent of values strictly below (or up to) `of`, as an aggregate."""
    hit = F.col(value) <= of if inclusive else F.col(value) < of
    return F.avg(F.when(hit, 1.0).otherwise(0.0)) * 100


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(truth, pred).agg(F.count("*").alias("n"))


def per_class(counts: DataFrame, truth: str, pred: str) -> DataFrame:
    """Support, precision, recall and F1 of each class of confusion counts; undefined ones are 0."""
    right = F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0))
    t = counts.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), right.alias("tp"))
    p = counts.groupBy(F.col(pred).alias("class")).agg(F.sum("n").alias("predicted"))
    both = t.join(p, "class", "full").na.fill(0)
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    both = both.withColumn("precision", safe(F.col("tp"), F.col("predicted"))).withColumn("recall", safe(F.col("tp"), F.col("support")))
    return both.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def modal(df: DataFrame, keys: list[str], value: str, weight: Column | None = None, highest_tie: bool = False) -> DataFrame:
    """The most frequent (or heaviest) value of each group; ties go to the smallest, or the highest."""
    heavy = df.groupBy(*keys, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("_w"))
    order = Window.partitionBy(*keys).orderBy(F.desc("_w"), F.desc(value) if highest_tie else F.asc(value))
    return heavy.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*keys, value, F.col("_w").alias("weight"))


def nice_step(raw: Column) -> Column:
    """The least of 1, 2, 2.5, 5, 10 times a power of ten that is not below raw."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    share = raw / unit
    return F.when(share <= 1, 1.0).when(share <= 2, 2.0).when(share <= 2.5, 2.5).when(share <= 5, 5.0).otherwise(10.0) * unit
