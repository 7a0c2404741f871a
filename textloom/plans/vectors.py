"""Embedding operators: normalised centroids, margins, sweeps. Dot products run in the engine, pair by pair with
the few centroids, whose number is that of the labels and is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import windows as W

from .registry import Tables, query

MOST_CENTROIDS = 10_000


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: str | Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """The normalised mean of each label's vectors, summed place by place."""
    places = df.select(label, F.posexplode(normalised(F.col(vector))).alias("at", "x")).groupBy(label, "at").agg(F.avg("x").alias("x"))
    return places.groupBy(label).agg(normalised(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"])).alias("centroid"))


def similarities(df: DataFrame, id_: str, label: str, vector: str) -> DataFrame:
    """(id, label, other, cosine) of every vector with every centroid."""
    c = centroids(df, label, vector).withColumnRenamed(label, "other")
    c = F.broadcast(c) if df.select(label).distinct().limit(MOST_CENTROIDS + 1).count() <= MOST_CENTROIDS else c
    return df.select(id_, label, normalised(F.col(vector)).alias("_v")).join(c, F.lit(True)).select(id_, label, "other", dot("_v", "centroid").alias("cosine"))


_NORM = "n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings)"
_CENT = "p AS (SELECT label, i, avg(v[i]) AS x FROM n, range(1, 65) r(i) GROUP BY label, i), m AS (SELECT label, array_agg(x ORDER BY i) AS c FROM p GROUP BY label), cent AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM m)"
_SIM = "sim AS (SELECT n.vec_id, n.label, cent.label AS other, list_dot_product(n.v, cent.c) AS cosine FROM n, cent)"


@query(f"WITH {_NORM}, {_CENT} SELECT label, list_transform(c, lambda x: round(x, 6)) AS centroid FROM cent")
def label_centroids(t: Tables):
    return centroids(t.embeddings, "label", "embedding").select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query(f"""WITH {_NORM}, {_CENT}, {_SIM} SELECT vec_id, label, round(max(cosine) FILTER (WHERE other = label) - max(cosine) FILTER (WHERE other <> label), 6) AS margin, max(cosine) FILTER (WHERE other = label) - max(cosine) FILTER (WHERE other <> label) < 0.05 AS uncertain FROM sim GROUP BY vec_id, label""")
def margin_gate(t: Tables):
    own = F.col("other") == F.col("label")
    margin = F.max(F.when(own, F.col("cosine"))) - F.max(F.when(~own, F.col("cosine")))
    return similarities(t.embeddings, "vec_id", "label", "embedding").groupBy("vec_id", "label").agg(F.round(margin, 6).alias("margin"), (margin < 0.05).alias("uncertain"))


@query(f"""WITH {_NORM}, {_CENT}, {_SIM} SELECT label, round(median(cosine), 6) AS mid, round(quantile_cont(cosine, 0.9), 6) AS p90, round(max(cosine), 6) AS most, round(min(cosine), 6) AS least FROM sim WHERE label = other GROUP BY label""")
def similarity_stats(t: Tables):
    own = similarities(t.embeddings, "vec_id", "label", "embedding").filter("label = other")
    return own.groupBy("label").agg(*[F.round(f, 6).alias(n) for f, n in ((F.median("cosine"), "mid"), (F.percentile("cosine", 0.9), "p90"), (F.max("cosine"), "most"), (F.min("cosine"), "least"))])


@query(f"WITH {_NORM}, {_CENT}, {_SIM} SELECT vec_id, cosine < 0.40 AS outlier FROM sim WHERE label = other")
def speaker_outliers(t: Tables):
    return similarities(t.embeddings, "vec_id", "label", "embedding").filter("label = other").select("vec_id", (F.col("cosine") < 0.40).alias("outlier"))


@query(f"""WITH {_NORM}, {_CENT}, {_SIM}, b AS (SELECT vec_id, label, arg_max(other, cosine) AS best, max(cosine) AS top, max(cosine) - (list_sort(array_agg(cosine), 'DESC'))[2] AS margin FROM sim GROUP BY vec_id, label), g AS (SELECT a / 20.0 AS threshold, m / 20.0 AS margin_gate FROM range(0, 11) x(a), range(0, 4) y(m))
SELECT threshold, margin_gate, count(*) FILTER (WHERE top >= threshold AND margin >= margin_gate AND best = label) AS right_n, count(*) FILTER (WHERE top >= threshold AND margin >= margin_gate AND best <> label) AS wrong_n FROM b, g GROUP BY threshold, margin_gate""")
def threshold_sweep(t: Tables):
    sims = similarities(t.embeddings, "vec_id", "label", "embedding")
    b = sims.groupBy("vec_id", "label").agg(F.sort_array(F.collect_list(F.struct("cosine", "other")), False).alias("s"))
    b = b.select("label", F.col("s")[0]["other"].alias("best"), F.col("s")[0]["cosine"].alias("top"), (F.col("s")[0]["cosine"] - F.col("s")[1]["cosine"]).alias("margin"))
    grid = [F.struct(F.lit(a / 20.0).alias("threshold"), F.lit(m / 20.0).alias("margin_gate")) for a in range(11) for m in range(4)]
    e = b.withColumn("g", F.explode(F.array(*grid)))
    sure = (F.col("top") >= F.col("g.threshold")) & (F.col("margin") >= F.col("g.margin_gate"))
    return e.groupBy("g.threshold", "g.margin_gate").agg(F.count_if(sure & (F.col("best") == F.col("label"))).alias("right_n"), F.count_if(sure & (F.col("best") != F.col("label"))).alias("wrong_n"))


@query(f"""WITH {_NORM}, {_CENT}, {_SIM} SELECT label, vec_id FROM sim WHERE label = other QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(cosine, 9) DESC, vec_id) <= 3""")
def top_exemplars(t: Tables):
    own = similarities(t.embeddings, "vec_id", "label", "embedding").filter("label = other")
    return W.top(own, ["label"], [F.round("cosine", 9).desc(), F.col("vec_id").asc()], 3).select("label", "vec_id")
