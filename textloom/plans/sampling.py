"""Set operations, sampling, splits and drop ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import windows as W

from .registry import Tables, query


@query("SELECT 'document' AS kind, doc_id AS id, source AS origin FROM documents UNION ALL SELECT 'page', page_id, NULL FROM pages")
def union_of_sources(t: Tables):
    docs = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("source").alias("origin"))
    return docs.unionByName(t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id")), allowMissingColumns=True)


@query("SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def intersect_keys(t: Tables):
    return t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey").intersect(t.orders.filter("o_orderstatus = 'F'").select("o_orderkey"))


@query("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def unknown_names(t: Tables):
    return t.orders.select("o_custkey").subtract(t.customer.filter("c_acctbal > 0").select("c_custkey"))


_WANT = "SELECT CAST(floor(count(*) FILTER (WHERE n_chars > 1500) * 0.25 / 0.75) AS BIGINT) AS want FROM documents"


@query(f"""WITH i AS (SELECT doc_id, source, md5('s' || doc_id) AS h FROM documents WHERE n_chars <= 1500), w AS ({_WANT}), a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS in_book FROM i),
b AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN in_book <= 5 THEN 0 ELSE 1 END, h, doc_id) AS place FROM a) SELECT doc_id, source FROM b, w WHERE place <= want""")
def identity_downsample(t: Tables):
    want = t.documents.agg(F.floor(F.count_if(F.col("n_chars") > 1500) * 0.25 / 0.75)).first()[0]
    rows = t.documents.filter("n_chars <= 1500").select("doc_id", "source", F.md5(F.concat(F.lit("s"), F.col("doc_id"))).alias("h"))
    capped = F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id")) <= 5
    rows = rows.withColumn("refill", F.when(capped, 0).otherwise(1)).withColumn("bin", F.concat("refill", F.substring("h", 1, 3)))
    # two levels: the counts of at most 8192 bins of the order tell which bin the last place is in, ranks inside it the rest
    bins = rows.groupBy("bin").agg(F.count("*").alias("size"))
    bins = bins.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = bins.filter(F.col("before") < want).select("bin", (F.lit(want) - F.col("before")).alias("left"), "size")
    whole = rows.join(F.broadcast(left), "bin")
    place = F.row_number().over(Window.partitionBy("bin").orderBy("h", "doc_id"))
    cut = whole.filter(F.col("left") < F.col("size")).withColumn("place", place).filter("place <= left").select("doc_id", "source")
    return whole.filter(F.col("left") >= F.col("size")).select("doc_id", "source").unionByName(cut)


@query("SELECT doc_id, CASE WHEN md5(regexp_replace(source, '[0-9]$', '')) < '4' THEN 'eval' ELSE 'train' END AS split FROM documents")
def family_holdout(t: Tables):
    family = F.md5(F.regexp_replace("source", "[0-9]$", ""))
    return t.documents.select("doc_id", F.when(family < "4", "eval").otherwise("train").alias("split"))


@query("SELECT CASE WHEN source IN ('src1', 'src7') THEN 'eval' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT source) AS books FROM documents GROUP BY 1")
def allow_list_split(t: Tables):
    return t.documents.groupBy(F.when(F.col("source").isin("src1", "src7"), "eval").otherwise("train").alias("split")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("books"))


@query("SELECT d.doc_id, coalesce(l.quality, 1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 1) = 1 OR d.source = 'src0'")
def quality_gated(t: Tables):
    q = F.coalesce("quality", F.lit(1))
    return t.documents.join(t.labels, "doc_id", "left").filter((q == 1) | (F.col("source") == "src0")).select("doc_id", q.alias("quality"))


_LADDER = "CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN n_chars < 100 THEN 'short' WHEN contains(text, '|') THEN 'table' WHEN contains(text, '!!') THEN 'shouting' WHEN lang <> 'en' THEN 'language' END"


@query(f"SELECT coalesce({_LADDER}, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def drop_ledger(t: Tables):
    return t.documents.groupBy(F.coalesce(_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _reason():
    text = F.col("text")
    return F.when(text.isNull() | (text == ""), "empty").when(F.col("n_chars") < 100, "short").when(text.contains("|"), "table").when(text.contains("!!"), "shouting").when(F.col("lang") != "en", "language")


@query(f"SELECT doc_id, {_LADDER} AS dropped FROM documents")
def unit_gates(t: Tables):
    return t.documents.select("doc_id", _reason().alias("dropped"))


@query("SELECT doc_id, twin FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(lower(text))) AS twin FROM documents) WHERE doc_id <> twin")
def fold_equal_pairs(t: Tables):
    """Texts that a fold makes equal, each linked to the first of its group."""
    folded = t.documents.select("doc_id", F.md5(F.lower("text")).alias("fold"))
    first = folded.groupBy("fold").agg(F.min("doc_id").alias("twin"))
    return folded.join(first, "fold").filter("doc_id <> twin").select("doc_id", "twin")


@query("SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last_line, count(*) = max(l_linenumber) AS sound FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey")
def unit_soundness(t: Tables):
    d = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    return d.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last_line"), (F.count("*") == F.max("l_linenumber")).alias("sound"))


@query("SELECT doc_id FROM documents ORDER BY source, doc_id LIMIT 25")
def trial_limit(t: Tables):
    return t.documents.orderBy("source", "doc_id").select("doc_id").limit(25)


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def exemplars_per_source(t: Tables):
    return W.top(t.documents, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("source", "doc_id", "n_chars")
