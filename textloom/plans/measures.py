"""Percentiles, histograms, confusion matrices and roll-ups over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import measures as M

from .registry import Tables, query


def _percentile_sql(index: str) -> str:
    return f"""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS at_, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(CASE WHEN at_ = {index.replace('Q', '0.5')} THEN v END) AS q50, max(CASE WHEN at_ = {index.replace('Q', '0.95')} THEN v END) AS q95 FROM r GROUP BY l_returnflag"""


def _ranked(t: Tables, rule: str):
    return M.ranked_value(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.5, 0.95], rule)


@query(_percentile_sql("round_even(Q * (n - 1), 0)"))
def percentile_nearest(t: Tables):
    return _ranked(t, "nearest")


@query(_percentile_sql("least(n - 1, floor(n * Q))"))
def percentile_floor_n(t: Tables):
    return _ranked(t, "floor_n")


@query(_percentile_sql("floor(Q * (n - 1))"))
def percentile_floor_n1(t: Tables):
    return _ranked(t, "floor_n1")


@query("SELECT l_returnflag, median(l_quantity) AS mid FROM lineitem GROUP BY l_returnflag")
def median_midpoint(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.median("l_quantity").alias("mid"))


@query("SELECT l_linestatus, count(*) AS n, round(avg(l_extendedprice), 2) AS mean, median(l_extendedprice) AS mid, max(l_extendedprice) AS most, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_linestatus")
def summary_stats(t: Tables):
    v = "l_extendedprice"
    plain = t.lineitem.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg(v), 2).alias("mean"), F.max(v).alias("most"))
    places = M.interpolated(t.lineitem, ["l_linestatus"], v, [0.5, 0.95]).select(F.col("l_linestatus").alias("_k"), "q50", "q95")
    both = plain.join(places, F.col("l_linestatus").eqNullSafe(F.col("_k")), "left")
    return both.select("l_linestatus", "n", "mean", F.col("q50").alias("mid"), "most", F.col("q95").alias("p95"))


@query("SELECT round(avg(CASE WHEN l_extendedprice < 30000 THEN 1.0 ELSE 0 END) * 100, 4) AS below, round(avg(CASE WHEN l_quantity <= 10 THEN 1.0 ELSE 0 END) * 100, 4) AS upto FROM lineitem")
def rank_of_value(t: Tables):
    d = t.lineitem
    return d.agg(F.round(M.rank_of(d, "l_extendedprice", 30000), 4).alias("below"), F.round(M.rank_of(d, "l_quantity", 10, True), 4).alias("upto"))


@query("""WITH b AS (SELECT CASE WHEN n_chars <= 100 THEN '<=100' WHEN n_chars <= 1000 THEN '<=1000' WHEN n_chars <= 10000 THEN '<=10000' WHEN n_chars <= 1e6 THEN '<=1e+06' ELSE 'over' END AS bucket, count(*) AS n FROM documents GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n FROM (SELECT unnest(['<=100', '<=1000', '<=10000', '<=1e+06', 'over']) AS bucket) LEFT JOIN b USING (bucket)""")
def edge_histogram(t: Tables):
    return M.histogram(t.documents, F.col("n_chars"), [100, 1000, 10000, 1000000])


@query("SELECT round(avg(CASE WHEN l_discount > 0.02 THEN 1.0 ELSE 0 END), 6) AS over2, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END), 6) AS over5, round(avg(CASE WHEN l_discount > 0.08 THEN 1.0 ELSE 0 END), 6) AS over8 FROM lineitem")
def tail_shares(t: Tables):
    return t.lineitem.agg(*[F.round(F.avg(F.when(F.col("l_discount") > x / 100, 1.0).otherwise(0.0)), 6).alias(f"over{x}") for x in (2, 5, 8)])


@query("SELECT source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 1) AS mean, quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.9) AS p90 FROM documents GROUP BY source")
def quantile_profile(t: Tables):
    v = "n_chars"
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 1).alias("mean"), F.percentile(v, 0.1).alias("p10"), F.percentile(v, 0.9).alias("p90"))


_CONFUSION = "SELECT quality AS truth, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id)"


def _judged(t: Tables):
    return t.labels.join(t.documents, "doc_id").select(F.col("quality").alias("truth"), F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("pred"))


@query(f"SELECT truth, pred, count(*) AS n FROM ({_CONFUSION}) GROUP BY ALL")
def confusion_matrix(t: Tables):
    return M.confusion(_judged(t), "truth", "pred")


@query(f"""WITH c AS ({_CONFUSION}), k AS (SELECT unnest([0, 1]) AS class), s AS (SELECT class, CAST(count(*) FILTER (WHERE truth = class) AS BIGINT) AS support, count(*) FILTER (WHERE pred = class) AS predicted, count(*) FILTER (WHERE truth = class AND pred = class) AS tp FROM k, c GROUP BY class),
p AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS pr, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS re FROM s)
SELECT class, support, predicted, tp, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM p""")
def class_scores(t: Tables):
    out = M.per_class(M.confusion(_judged(t), "truth", "pred"), "truth", "pred")
    return out.select("class", "support", "predicted", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("WITH w AS (SELECT p_brand, p_size, sum(length(p_name)) AS weight FROM part GROUP BY ALL) SELECT p_brand, p_size, CAST(weight AS BIGINT) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY weight DESC, p_size) = 1")
def weighted_mode(t: Tables):
    return M.modal(t.part, ["p_brand"], "p_size", F.length("p_name"))


@query("WITH w AS (SELECT p_type, p_size, count(*) AS weight FROM part GROUP BY ALL) SELECT p_type, p_size, weight FROM w QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY weight DESC, p_size) = 1")
def modal_value(t: Tables):
    return M.modal(t.part, ["p_type"], "p_size")


@query("SELECT p_brand, CASE WHEN bool_and(p_size > 3) THEN true WHEN NOT bool_or(p_size > 3) THEN false END AS all_large FROM part GROUP BY p_brand")
def all_none_or_mixed(t: Tables):
    large = F.col("p_size") > 3
    return t.part.groupBy("p_brand").agg(F.when(F.bool_and(large), True).when(~F.bool_or(large), False).alias("all_large"))


@query("""WITH s AS (SELECT l_orderkey, l_returnflag AS f, l_linestatus AS l FROM lineitem) SELECT l_orderkey, CASE WHEN bool_or(f = 'R' AND l = 'O') THEN 'running' WHEN bool_or(f = 'R') THEN 'failed' WHEN bool_and(l = 'F') THEN 'done' ELSE 'queued' END AS status,
CAST(round(avg(CASE WHEN l = 'F' THEN 100 ELSE 40 END)) AS BIGINT) AS percent FROM s GROUP BY l_orderkey""")
def job_status(t: Tables):
    f, line = F.col("l_returnflag"), F.col("l_linestatus")
    status = F.when(F.bool_or((f == "R") & (line == "O")), "running").when(F.bool_or(f == "R"), "failed").when(F.bool_and(line == "F"), "done").otherwise("queued")
    return t.lineitem.groupBy("l_orderkey").agg(status.alias("status"), F.round(F.avg(F.when(line == "F", 100).otherwise(40))).cast("long").alias("percent"))


@query("""SELECT coalesce(CAST(nullif(o_custkey % 50, 0) AS VARCHAR), 'job-' || o_orderkey) AS project, count(*) AS open_steps, bool_and(o_orderstatus = 'O') AS all_held, array_agg(o_orderkey ORDER BY o_orderkey) AS steps FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def group_by_project(t: Tables):
    project = F.coalesce(F.nullif(F.col("o_custkey") % 50, F.lit(0)).cast("string"), F.concat(F.lit("job-"), F.col("o_orderkey")))
    return t.orders.filter("o_orderstatus <> 'F'").groupBy(project.alias("project")).agg(F.count("*").alias("open_steps"), F.bool_and(F.col("o_orderstatus") == "O").alias("all_held"), F.array_sort(F.collect_list("o_orderkey")).alias("steps"))


@query("""SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN l_returnflag END) = 3""")
def complete_set(t: Tables):
    need = F.array(*map(F.lit, "ANR"))
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("have")).filter(F.size(F.array_except(need, "have")) == 0).select("l_orderkey")


@query("SELECT source, lang, grouping(source, lang) AS level, count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS long_, sum(n_chars) AS chars FROM documents GROUP BY GROUPING SETS ((source), (lang), ())")
def paragraph_audit(t: Tables):
    cols = [F.col("source"), F.col("lang")]
    return t.documents.groupingSets([[cols[0]], [cols[1]], []], *cols).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long_"), F.sum("n_chars").alias("chars"))


@query("""SELECT source, count(*) AS docs, count(DISTINCT lang) AS langs, array_agg(DISTINCT lang ORDER BY lang) AS lang_set FROM documents GROUP BY source""")
def book_stats(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("docs"), F.count_distinct("lang").alias("langs"), F.array_sort(F.collect_set("lang")).alias("lang_set"))


@query("""WITH k AS (SELECT lang, quality, toxic, source FROM labels JOIN documents USING (doc_id)), a AS (SELECT quality, toxic, count(*) AS n, count(DISTINCT source) AS books FROM k GROUP BY ALL), b AS (SELECT quality, count(DISTINCT source) AS all_books FROM k GROUP BY quality)
SELECT quality, toxic, n, books, round(books / all_books, 6) AS share, CASE WHEN books > 1 AND books >= 0.6 * all_books THEN 'systematic' ELSE 'local' END AS verdict FROM a JOIN b USING (quality)""")
def systematic_confusion(t: Tables):
    k = t.labels.join(t.documents, "doc_id")
    a = k.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_distinct("source").alias("books"))
    b = k.groupBy("quality").agg(F.count_distinct("source").alias("all_books"))
    share = F.col("books") / F.col("all_books")
    return a.join(b, "quality").select("quality", "toxic", "n", "books", F.round(share, 6).alias("share"), F.when((F.col("books") > 1) & (share >= 0.6), "systematic").otherwise("local").alias("verdict"))


@query("""WITH k AS (SELECT source, regexp_replace(split_part(text, chr(10), 1), '[0-9]', '#', 'g') AS line, doc_id FROM documents), n AS (SELECT source, count(*) AS docs FROM documents GROUP BY source), c AS (SELECT source, line, count(DISTINCT doc_id) AS pages FROM k WHERE line <> '' GROUP BY ALL)
SELECT source, md5(line) AS line, pages, round(pages / docs, 6) AS share FROM c JOIN n USING (source) WHERE pages >= 2""")
def repeated_band_share(t: Tables):
    d = t.documents.select("source", "doc_id", F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), "[0-9]", "#").alias("line"))
    n = d.groupBy("source").agg(F.count("*").alias("docs"))
    c = d.filter("line <> ''").groupBy("source", "line").agg(F.count_distinct("doc_id").alias("pages"))
    return c.join(n, "source").filter("pages >= 2").select("source", F.md5("line").alias("line"), "pages", F.round(F.col("pages") / F.col("docs"), 6).alias("share"))


@query("""WITH s AS (SELECT l_returnflag, l_linestatus, max(l_extendedprice) / 7.0 AS raw FROM lineitem GROUP BY ALL), u AS (SELECT *, pow(10.0, floor(log10(raw))) AS unit FROM s)
SELECT l_returnflag, l_linestatus, CASE WHEN raw / unit <= 1 THEN 1.0 WHEN raw / unit <= 2 THEN 2.0 WHEN raw / unit <= 2.5 THEN 2.5 WHEN raw / unit <= 5 THEN 5.0 ELSE 10.0 END * unit AS step FROM u""")
def nice_axis_step(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg((F.max("l_extendedprice") / 7.0).alias("raw")).select("l_returnflag", "l_linestatus", M.nice_step(F.col("raw")).alias("step"))


@query("""WITH a AS (SELECT source, sum(length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g'))) AS chars, count(*) AS lines FROM documents GROUP BY source), b AS (SELECT source, sum(length(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]', '', 'g'))) AS chars, count(*) AS lines FROM documents GROUP BY source)
SELECT source, a.lines = b.lines AND a.chars = b.chars AS same FROM a FULL JOIN b USING (source)""")
def character_parity(t: Tables):
    chars = lambda text: F.sum(F.length(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0b]", "")))
    both = t.documents.groupBy("source").agg(chars(F.col("text")).alias("a"), chars(F.lower("text")).alias("b"))
    return both.select("source", (F.col("a") == F.col("b")).alias("same"))


@query("""WITH m AS (SELECT p_brand, median(p_retailprice) AS mid FROM part GROUP BY p_brand) SELECT p_partkey, list_filter([CASE WHEN p_retailprice > 1.5 * mid THEN 'large' END, CASE WHEN p_retailprice < 0.7 * mid THEN 'small' END, CASE WHEN p_size >= 45 THEN 'wide' END, CASE WHEN length(p_name) < 8 THEN 'short' END], lambda x: x IS NOT NULL) AS suspects FROM part JOIN m USING (p_brand)""")
def shape_suspects(t: Tables):
    mid = t.part.groupBy("p_brand").agg(F.median("p_retailprice").alias("mid"))
    tests = [(F.col("p_retailprice") > 1.5 * F.col("mid"), "large"), (F.col("p_retailprice") < 0.7 * F.col("mid"), "small"), (F.col("p_size") >= 45, "wide"), (F.length("p_name") < 8, "short")]
    return t.part.join(mid, "p_brand").select("p_partkey", F.array_compact(F.array(*[F.when(c, n) for c, n in tests])).alias("suspects"))


@query("""WITH g AS (SELECT avg(CASE WHEN n_chars < 300 THEN 1.0 ELSE 0 END) AS p FROM documents), h AS (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text)) AS at_, count(*) OVER () AS n FROM conversations)
SELECT max(CASE WHEN at_ - 1 = floor(p * (n - 1)) THEN v END) AS threshold FROM h, g""")
def threshold_transfer(t: Tables):
    share = t.documents.agg(F.avg(F.when(F.col("n_chars") < 300, 1.0).otherwise(0.0))).first()[0] or 0.0
    lengths = t.conversations.select(F.lit(1).alias("all"), F.length("text").alias("v"))
    return M.ranked_value(lengths, ["all"], "v", [share], "floor_n1").toDF("all", "threshold").drop("all")
