"""Substring dedup: words that a repeated window of 20 words covers, found by difference-cover anchors.

Strings of 8 words are hashed only where their place modulo 13 is in {0, 1, 3, 9}. Every residue is a difference
of two of these, so for any two places there is a shift of under 13 that brings both to a hashed place: any two
equal windows of 8 + 13 - 1 = 20 words share an equal, aligned anchor. Anchors that occur once are dropped; those
with equal contexts are settled by counting, and the windows around the others are compared by hashes of their 20
words (see repeats).

Defined cases: a null text has no words; a document of under 20 words loses nothing; equal documents all lose
everything but the first, if 20 words long or longer; rows without a doc_id are left out. Rows that share a doc_id
stand at the same places of one document: none of them is earlier than another, and the ranges that one loses go from
each. An empty table gives an empty result. Columns other than doc_id and text are not read.

Exactness: words, anchors and windows are compared by hashes, contexts by 64 bits within groups of one 64-bit anchor
hash, windows by two words of 64 bits. Among m contexts of an anchor, two that differ pass for equal with a chance of
about m^2 / 2^65 (a million: 3e-8), and of w distinct words in the corpus two share a hash with w^2 / 2^65, if the text
is not made to defeat the hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, mixed, stage, table, unstage
from .repeats import WINDOWS, Batches, anchor_batch, bare, by_document, decided, later_windows, removed_units, sha256, window_batch, with_removals
from .suffix_dedup import _pair

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
GRAM = WINDOW - PERIOD + 1
AT_ONCE = 400_000


def _long(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the strings of size words (a power of two) that start at each place."""
    k, step = 0, 1
    while step < size:
        h = _pair(h[:-step], h[step:], k) if len(h) > step else h[:0]
        k, step = k + 1, 2 * step
    return h


def scan(batches: Batches) -> Batches:
    hashes = WordHashes()

    def anchors(ids: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(p) for p in parts])
        h, ends = np.concatenate(parts), np.repeat(np.cumsum(lengths), lengths)
        owner = np.repeat(np.arange(len(parts)), lengths)
        begins = ends - lengths[owner]
        at = np.arange(len(h))
        at = at[np.isin((at - begins) % PERIOD, COVER) & (ends - at >= GRAM)]
        lo, hi = np.maximum(begins[at], at - PERIOD + 1), np.minimum(ends[at], at + WINDOW)
        last = np.minimum(at, ends[at] - WINDOW)
        ok = last >= lo
        at, lo, hi, last = at[ok], lo[ok], hi[ok], last[ok]
        eight, sixteen = _long(h, 8), _long(h, 16)
        ctx = mixed(_pair(sixteen[lo], sixteen[hi - 16], 4) + (at - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (hi - at).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        return anchor_batch(np.array(ids, np.int64), owner[at], mixed(eight[at]), at - begins[at], at - lo, at - last, ctx)

    for batch in batches:
        ids, parts, size = [], [], 0
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = (text or "").encode().split()
            if len(words) < WINDOW:
                continue
            ids.append(doc_id)
            parts.append(hashes.of(words))
            size += len(words)
            if size >= AT_ONCE:
                yield anchors(ids, parts)
                ids, parts, size = [], [], 0
        if parts:
            yield anchors(ids, parts)


def cut_windows(batches: Batches) -> Batches:
    """Hashes of the windows that the representatives stand for, from rows (doc_id, text, marks)."""
    hashes = WordHashes()
    for batch in batches:
        for doc_id, text, marks in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["marks"].to_pylist(), strict=True):
            h = hashes.of((text or "").encode().split())
            if len(h) < WINDOW:
                continue
            wanted = np.zeros(len(h) + 1, np.int32)
            for m in marks:
                wanted[min(len(h), m["pos"] - m["reach"])] += 1
                wanted[min(len(h), m["pos"] - m["least"] + 1)] -= 1
            start = np.flatnonzero(np.cumsum(wanted)[: len(h) - WINDOW + 1] > 0)
            four, sixteen = _long(h, 4), _long(h, 16)
            w1, w2 = _pair(sixteen[start], four[start + 16], 5), _pair(four[start + 16], sixteen[start], 6)
            yield window_batch([doc_id], np.zeros(len(start), np.int64), start, mixed(w1), mixed(w2))


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def removal_report(batches: Batches) -> Batches:
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for doc_id, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            words = (text or "").encode().split()
            gone = removed_units(spans, len(words))
            left = [w for w, g in zip(words, gone, strict=True) if not g] if spans else words
            for column, x in zip(rows, (doc_id, len(words), int(gone.sum()), sha256(b" ".join(left))), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_words(docs: DataFrame) -> list[DataFrame]:
    """Staged tables (doc_id, spans) of the word ranges that repeated windows cover."""
    gone, open_ = decided(docs, scan, WINDOW)
    marks = by_document(open_, "pos", "reach", "least")
    text = bare(docs)
    windows = marks.withColumnRenamed("doc_id", "of").join(text, F.col("of") == text.doc_id).select("doc_id", "text", "marks").mapInArrow(cut_windows, WINDOWS)
    windows = stage(windows, heavy=True)
    later = stage(later_windows(windows, WINDOW).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), heavy=True)
    unstage(open_, windows)
    return [gone, later]


def op9_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_removals(docs, repeated_words(docs)).mapInArrow(removal_report, OUT)
