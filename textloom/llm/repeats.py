"""Repeated spans of texts: what the suffix-array and the anchor operators share.

Both look for windows of a fixed length whose content also starts earlier (in a smaller doc_id, or earlier in the
same document). Both pick anchors from the content, so that equal windows share an equal anchor at the same place.
An anchor's row carries a hash of the anchor, h, and one of its context, that is of all the windows that the
anchor stands for. Then

1. anchors are counted by h, with partial sums before the shuffle: most occur once and are done with;
2. the rest are joined back. If all contexts of an h are equal, all windows of each occurrence but the first go;
3. where contexts differ, the first of each context stands for the others, which go, and only these few
   representatives are compared window by window;
4. the ranges to remove meet their documents again.

No group is ever collected: hot anchors shrink in partial aggregates, and the joins back are plain sort-merge
joins of which Spark splits skewed partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

#: h, doc_id, pos of the anchor; windows start from pos - reach to pos - least; again: the document has the same context earlier
ANCHORS = "h long, doc_id long, pos long, reach int, least int, ctx long, again boolean"
Batches = Iterator[pa.RecordBatch]


def bare(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")


def first_in_document(owner: np.ndarray, h: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """False where an earlier row of the same owner has the same h and ctx; rows come in order."""
    order = np.lexsort((np.arange(len(h)), ctx, h, owner))
    o, a, c = owner[order], h[order], ctx[order]
    first = np.ones(len(h), bool)
    first[order[1:]] = (o[1:] != o[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    return first


def anchor_batch(doc_ids: np.ndarray, owner: np.ndarray, h: np.ndarray, pos: np.ndarray, reach: np.ndarray, least: np.ndarray, ctx: np.ndarray) -> pa.RecordBatch:
    again = ~first_in_document(owner, h, ctx)
    columns = [h.view(np.int64), doc_ids[owner], pos.astype(np.int64), reach.astype(np.int32), least.astype(np.int32), ctx.view(np.int64), again]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["h", "doc_id", "pos", "reach", "least", "ctx", "again"])


def decided(docs: DataFrame, scan: Callable[[Batches], Batches], window: int) -> tuple[DataFrame, DataFrame]:
    """Ranges (doc_id, lo, hi) to remove that whole contexts decide, and the representatives that windows must decide.

    Representatives: h, ctx, doc_id, pos, reach, least. Both staged.
    """
    text = bare(docs)
    anchors = text.mapInArrow(scan, ANCHORS)
    counts = anchors.filter("not again").groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
    repeated = stage(counts.filter("n > 1").select(F.col("h").alias("rh"), "first_doc", (F.col("c0") != F.col("c1")).alias("differ")), heavy=True)
    back = anchors.join(repeated, anchors.h == repeated.rh, "left").filter("again or rh is not null")
    back = back.withColumn("gone", F.col("again") | (~F.col("differ") & (F.col("doc_id") != F.col("first_doc")))).filter("gone or differ")
    back = stage(back.select("h", "doc_id", "pos", "reach", "least", "ctx", "gone"), heavy=True)
    span = (F.col("doc_id"), (F.col("pos") - F.col("reach")).alias("lo"), (F.col("pos") - F.col("least") + window).alias("hi"))
    open_ = back.filter("not gone")
    firsts = open_.groupBy("h", "ctx").agg(F.min("doc_id").alias("rep"))
    firsts = stage(firsts)
    marked = open_.alias("o").join(firsts.alias("f"), (F.col("o.h") == F.col("f.h")) & (F.col("o.ctx") == F.col("f.ctx")))
    marked = marked.select("o.h", "o.ctx", "o.doc_id", "o.pos", "o.reach", "o.least", (F.col("o.doc_id") != F.col("f.rep")).alias("gone"))
    marked = stage(marked)
    gone = back.filter("gone").select(*span).unionByName(marked.filter("gone").select(*span))
    gone = stage(gone.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), heavy=True)
    kept = stage(marked.filter("not gone").drop("gone"))
    unstage(repeated, back, firsts, marked)
    return gone, kept


def by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each doc_id of rows, with an array `marks` of structs of the columns."""
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("marks"))


def later_windows(windows: DataFrame, length: int) -> DataFrame:
    """Ranges of the windows (w1, w2, doc_id, start, again) of which an earlier one is equal."""
    counts = windows.filter("not again").groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")
    counts = counts.select(F.col("w1").alias("a1"), F.col("w2").alias("a2"), "first_doc")
    back = windows.join(counts, (F.col("w1") == F.col("a1")) & (F.col("w2") == F.col("a2")), "left").filter("again or doc_id != first_doc")
    return back.select("doc_id", F.col("start").alias("lo"), (F.col("start") + length).alias("hi"))


def window_batch(doc_ids: list[int], owner: np.ndarray, start: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> pa.RecordBatch:
    again = ~first_in_document(owner, w1, w2)
    ids = np.array(doc_ids, np.int64)
    columns = [w1.view(np.int64), w2.view(np.int64), ids[owner], start.astype(np.int64), again]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["w1", "w2", "doc_id", "start", "again"])


WINDOWS = "w1 long, w2 long, doc_id long, start long, again boolean"


def removed_units(spans: list[dict] | None, n: int) -> np.ndarray:
    """Marks of the n units that any of the spans covers."""
    step = np.zeros(n + 1, np.int32)
    for s in spans or ():
        step[min(n, s["lo"])] += 1
        step[min(n, s["hi"])] -= 1
    return np.cumsum(step[:n]) > 0


def with_removals(docs: DataFrame, removals: list[DataFrame]) -> DataFrame:
    """docs (doc_id, text) with `spans`, the array of ranges (lo, hi) of all the removals, null if there are none."""
    all_ = removals[0]
    for r in removals[1:]:
        all_ = all_.unionByName(r)
    per = all_.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumnRenamed("doc_id", "of")
    text = bare(docs)
    return text.join(per, text.doc_id == per.of, "left").select("doc_id", "text", "spans")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
