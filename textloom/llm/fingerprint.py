"""Document fingerprints: a digest of quartile buckets of hashed byte triplets, and a bounded difference score.

Each text's UTF-8 bytes give three triplets at every position (adjacent, and two with gaps). The triplets are
hashed into 128 buckets; each bucket is coded by the quartile its count falls in, and the length by a byte on a
logarithmic scale. Digests compare by the sum of the buckets' code distances and the lengths' distance, cut off
at a bound.

Defined cases: a null text is the empty text; texts of under three bytes have no triplets, so all buckets are in
the lowest quartile and only the length byte differs; equal texts have equal digests, wherever they stand. Rows
of equal doc_id are ordered by text, null first; rows without a doc_id are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_parts, slices, table, text_bytes

BUCKETS = 128
GAPS = ((1, 2), (1, 3), (2, 4))
WORST = 260.0
LENGTH_STEPS = 8


def digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (texts x 128, 0 to 3) and length bytes of texts that stand end to end in data."""
    n = len(offsets) - 1
    codes = np.zeros((n, BUCKETS), np.uint8)
    lengths = np.diff(offsets)
    for first, end in slices(offsets):
        lo, hi = offsets[first], offsets[end]
        part = data[lo:hi].astype(np.uint32)
        owner = np.repeat(np.arange(end - first, dtype=np.int64), lengths[first:end])
        counts = np.zeros((end - first) * BUCKETS, np.int64)
        for k, (a, b) in enumerate(GAPS):
            if len(part) <= b:
                continue
            h = part[:-b] * np.uint32(0x01000193) + part[a : len(part) - b + a] * np.uint32(0x85EBCA6B) + part[b:] * np.uint32(0xC2B2AE35) + np.uint32(k * 0x27D4EB2F)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            within = owner[:-b] == owner[b:]
            counts += np.bincount(owner[:-b][within] * BUCKETS + (h >> np.uint32(25))[within], minlength=len(counts))
        counts = counts.reshape(-1, BUCKETS)
        ordered = np.sort(counts, axis=1)
        codes[first:end] = sum((counts > ordered[:, [at]]).astype(np.uint8) for at in (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))
    return codes, np.minimum(255, np.round(LENGTH_STEPS * np.log2(1.0 + lengths))).astype(np.uint8)


def as_text(codes: np.ndarray, lengths: np.ndarray) -> list[str]:
    packed = codes.reshape(len(codes), -1, 4).astype(np.uint8)
    packed = packed[:, :, 0] << 6 | packed[:, :, 1] << 4 | packed[:, :, 2] << 2 | packed[:, :, 3]
    return [f"{n:02x}{row.tobytes().hex()}" for n, row in zip(lengths, packed, strict=True)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 for equal digests, falling with their difference, 0 from WORST on. Opposite quartiles count twice over."""
    d = np.abs(a[0].astype(np.int16) - b[0].astype(np.int16))
    total = d.sum(1) + 3 * (d == 3).sum(1) + np.abs(a[1].astype(np.int16) - b[1].astype(np.int16)) // 2
    return 1.0 - np.minimum(total, WORST) / WORST


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.large_string()))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of rows that come sorted, each with the row after it. Marked rows only stand after others."""

    def rows():
        for batch in batches:
            yield from zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["ends"].to_pylist(), strict=True)

    def flush(pairs: list[tuple[int, str, str]]) -> pa.RecordBatch:
        texts, nexts = [p[1] for p in pairs], [p[2] for p in pairs]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
        own, other, after = (digests(*joined(x)) for x in (texts, edited, nexts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(as_text(*own)), pa.array(as_text(*other)),
                pa.array(likeness(own, other)), pa.array(likeness(own, after)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    held, pairs, size = None, [], 0
    for part, doc_id, text, ends in rows():
        text = text or ""
        if held is not None and held[0] == part:
            pairs.append((held[1], held[2], text))
            size += len(held[2]) + len(text)
            if size > 4_000_000 or len(pairs) >= 5000:
                yield flush(pairs)
                pairs, size = [], 0
        held = None if ends else (part, doc_id, text)
    if pairs:
        yield flush(pairs)


def fingerprints(docs: DataFrame) -> DataFrame:
    """OUT for each row of docs (doc_id, text): digests of the text and of its edit with the next row's text.

    Rows are dealt by ranges of doc_id. The first row of each range is also sent to the range before it, where it
    ends the range's rows; the ranges' bounds and first ids are all that the driver sees.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    parts = n_parts(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), "left").astype(np.int32))

    dealt = docs.withColumn("part", part_of("doc_id"))
    firsts = sorted((first, part) for part, first in dealt.groupBy("part").agg(F.min("doc_id")).collect())
    if not firsts:
        return spark.createDataFrame([], OUT)
    before = {first: firsts[k - 1][1] for k, (first, _) in enumerate(firsts)}
    extra = dealt.filter(F.col("doc_id").isin(list(before))).withColumn("part", F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("doc_id")))
    both = dealt.withColumn("ends", F.lit(False)).unionByName(extra.withColumn("ends", F.lit(True)))
    return both.repartitionByRange(parts, "part").sortWithinPartitions("part", "ends", "doc_id", "text").mapInArrow(neighbours, OUT)


def op3_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
