"""Benchmark decontamination by winnowing.

Words are maximal runs of letters, digits and non-ASCII characters, with A-Z lower-cased. In every window of SPAN
words the least hash of its GRAM-word strings is the window's fingerprint, so a span of SPAN words or more that a
document shares with a benchmark item also shares a fingerprint. Fingerprints of documents and items join; each
hit extends to the windows around it, and those that equal an item's window, word by word, count.

An item of fewer words is one window of its own; for each such length the windows of that length are their own
fingerprints, made in the same scan. Fingerprints and windows of the benchmark are each counted, and broadcast only
up to BROADCAST_ROWS of them and BROADCAST_BYTES.

Defined cases: a null text has no words; an item without words never occurs; repeated items each count; rows
without a doc_id are left out; rows that share a doc_id are reported alike, with the hits of all. Null item_ids
are left out. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, unstage

SPAN, GRAM = 10, 5
#: more fingerprints or windows than this are joined by shuffles
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words as they stand in the text."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), BREAK), lambda w: w != "")


def lowered(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.translate(w, UPPER, LOWER))


def hashed(ws: Column) -> Column:
    """A hash of each word, the same for words that differ in A-Z only."""
    return F.transform(ws, lambda w: F.xxhash64(F.lower(w)))


def gram_hashes(h: Column, size: int) -> Column:
    """Hash of each string of size words."""
    at = F.sequence(F.lit(0), F.size(h) - size)
    return F.when(F.size(h) >= size, F.transform(at, lambda i: F.xxhash64(*[h[i + k] for k in range(size)])))


def window_minima(g: Column, size: int) -> Column:
    """The least of each run of size neighbours."""
    if size == 1:
        return g
    at = F.sequence(F.lit(0), F.size(g) - size)
    return F.when(F.size(g) >= size, F.transform(at, lambda i: F.least(*[g[i + k] for k in range(size)])))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, wherever the optimiser moves the expression."""
    return F.transform(F.array(value), body)[0]


def gram_of(span: int) -> int:
    """Words of the strings that windows of span words are winnowed by."""
    return GRAM if span == SPAN else span


def fingerprints(docs: DataFrame, spans: list[int]) -> DataFrame:
    """docs (…, ws) with a row for each run of windows whose least gram is the same one: `span`, `fp` and `s`, the run's first window.

    The leftmost of equal least grams counts. Where it opens a window, it leaves with that window and the next starts
    a new run, also if the same hash stands there again: no run is longer than a window has grams. The words are
    hashed once, whatever the number of spans.
    """

    def runs(m: Column, g: Column, span: int) -> Column:
        before = lambda x, i: x[F.greatest(i - 1, F.lit(0))]
        row = lambda x, i: F.struct(F.lit(span).alias("span"), x.alias("fp"), i.alias("s"))
        first = lambda x, i: F.when((i == 0) | (x != before(m, i)) | (x == before(g, i)), row(x, i))
        none = F.array().cast("array<struct<span:int,fp:bigint,s:int>>")
        return F.coalesce(F.filter(F.transform(m, first), lambda r: r.isNotNull()), none)

    def of(h: Column, span: int) -> Column:
        gram = gram_of(span)
        return let(gram_hashes(h, gram), lambda g: let(window_minima(g, span - gram + 1), lambda m: runs(m, g, span)))

    run = let(hashed(F.col("ws")), lambda h: F.concat(*[of(h, span) for span in spans]))
    # an outer explode: for an inner one the optimiser would compute the whole expression twice, to filter empty arrays
    rows = docs.withColumn("r", F.explode_outer(run))
    return rows.withColumn("span", F.col("r.span")).withColumn("fp", F.col("r.fp")).withColumn("s", F.col("r.s")).drop("r")


def small(rows: DataFrame, bytes_: Column) -> bool:
    """Whether all of rows may be broadcast, by their number and the sum of bytes_."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(bytes_), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, s, span, win): occurrences in docs (doc_id, ws) of windows (span, win: arrays of span words); one scan of docs."""
    spans = sorted(r[0] for r in windows.select("span").distinct().collect())  # SPAN lengths at most
    if not spans:
        return docs.select("doc_id", F.lit(0).alias("s"), F.lit(0).alias("span"), F.col("ws").alias("win")).limit(0)
    wins = stage(windows.select("span", "win").distinct())
    prints = fingerprints(wins.select("win", F.col("span").alias("own"), F.col("win").alias("ws")), spans).filter("span = own")
    wanted = stage(prints.select(F.col("span").alias("wspan"), F.col("fp").alias("wfp")).distinct())
    few_prints, few_wins = small(wanted, F.lit(12)), small(wins, 8 * F.size("win") + F.octet_length(F.array_join("win", " ")))
    wanted_ = F.broadcast(wanted) if few_prints else wanted
    wins_ = F.broadcast(wins) if few_wins else wins
    found = fingerprints(docs.select("doc_id", "ws"), spans).join(wanted_, (F.col("fp") == F.col("wfp")) & (F.col("span") == F.col("wspan")))
    # a run of windows of one least gram is no longer than reach
    reach = F.when(F.col("span") == SPAN, SPAN - GRAM + 1).otherwise(1)
    near = found.select("doc_id", "s", "span", lowered(F.slice("ws", F.col("s") + 1, F.col("span") + reach - 1)).alias("near"))
    each = near.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("near") - F.col("span"))))
    each = each.select("doc_id", (F.col("s") + F.col("k")).alias("s"), F.col("span").alias("ns"), F.slice("near", F.col("k") + 1, F.col("span")).alias("near"))
    return each.join(wins_, (F.col("near") == F.col("win")) & (F.col("ns") == F.col("span"))).select("doc_id", "s", "span", "win").distinct()


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, span, win): the windows of each item; staged."""
    items = benchmark.filter("item_id is not null").select("item_id", lowered(words(F.col("text"))).alias("ws")).filter(F.size("ws") > 0)
    span = F.least(F.size("ws"), F.lit(SPAN))
    items = items.withColumn("span", span).withColumn("s", F.explode(F.sequence(F.lit(1), F.size("ws") - span + 1)))
    return stage(items.select("item_id", "span", F.slice("ws", F.col("s"), F.col("span")).alias("win")).distinct())


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs (doc_id, text)."""
    text = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("ws"))
    marked = hit_documents(text, benchmark)
    out = text.select("doc_id", F.size("ws").cast("long").alias("n_words")).join(marked, "doc_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def hit_documents(text: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_hit, n_items, items) of the documents (doc_id, ws) that any benchmark window occurs in; staged."""
    windows = benchmark_windows(benchmark)
    found = stage(hits(text, windows))
    covered = found.select("doc_id", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("span") - 1)).alias("at")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    items = found.select("doc_id", "win").distinct().join(windows.select("item_id", "win"), "win").select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = stage(covered.join(items, "doc_id").select("doc_id", "n_hit", F.size("items").alias("n_items"), F.concat_ws(",", "items").alias("items")))
    unstage(windows, found)
    return out


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents WHERE doc_id IS NOT NULL
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s : s + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM b WHERE len(ws) > 0)
), lengths AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, s, n, array_to_string(ws[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, lengths WHERE len(ws) >= n)
), hit AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hit) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
