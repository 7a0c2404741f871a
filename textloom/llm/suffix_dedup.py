"""Suffix-array dedup: bytes that a repeated string of 100 bytes covers, found column by column.

A collection's Burrows-Wheeler transform is built by inserting one symbol of every document each round. Over whole
documents that takes as many rounds as the longest document has bytes, each over files as large as the collection;
here the rounds run over short contexts. Winnowing picks, for each 100-byte window, the least hash of its 24-byte
strings; equal windows pick the same string at the same offset, so windows that repeat lie in contexts that are
aligned at an equal anchor. Contexts that are equal as a whole are settled by counting (see repeats). The
remaining ones are the collection: one task takes the contexts of many anchors in sequence, and each round adds
one column, updating the contexts' sorted order (the positional transform) and where each context's match with
its neighbour in that order began. Wherever the match has reached 100 bytes, the windows are equal.

Anchors with more than MANY differing contexts would gather in one task. Such a group is split: windows that begin
far before the anchor all hold the bytes left of it, the others those right of it, so each half is grouped by the
longer string that its windows share. What has become equal as a whole is settled by its first row, what is still
crowded is split again, and the columns run over the parts.

Exactness: contexts are first settled by 64-bit hashes within groups of one 64-bit anchor hash. Among m contexts of
an anchor, two that differ pass for equal with a chance of about m^2 / 2^65 (a million: 3e-8), if the text is not made
to defeat the hash. The columns, and the halves of crowded groups, compare bytes.

Defined cases: a null text is empty; a text of under 100 bytes loses nothing; equal documents all lose everything
but the first, if 100 bytes long or longer; rows without a doc_id are left out. Rows that share a doc_id stand at the
same places of one document: none of them is earlier than another, and the ranges that one loses go from each. An
empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, slices, stage, table, text_bytes, unstage
from .repeats import Batches, anchor_batch, bare, by_document, decided, removed_units, sha256, with_removals

WINDOW, GRAM = 100, 24
SPREAD = WINDOW - GRAM
WIDTH = WINDOW + SPREAD
MANY = 2000
CHUNK = 20_000
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _pair(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    x = a * _ODD[k]
    x += b
    x ^= x >> np.uint64(31)
    return x


def grams(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the strings of 8, 16, 24, 32 and 64 bytes that start at each place."""
    h, out = _BYTE[data], {}
    for k, size in enumerate((1, 2, 4, 8, 16, 32)):
        h = _pair(h[:-size], h[size:], k) if len(h) > size else h[:0]
        out[2 * size] = h
    n = max(0, len(data) - GRAM + 1)
    out[GRAM] = _pair(out[16][:n], out[8][16 : 16 + n], 6)
    return out


def spans_of_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor place, first and last window start, text number and the two hashes, of texts end to end in data."""
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    room = np.repeat(offsets[1:], lengths) - np.arange(len(data))
    starts = np.flatnonzero(room >= WINDOW)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    g = grams(data)
    least = mixed(g[GRAM]) & np.uint64(0xFFFFFFFF00000000) | (np.uint64(0xFFFFFFFF) - np.arange(len(g[GRAM]), dtype=np.uint64))
    size = 1
    while 2 * size <= SPREAD + 1:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = SPREAD + 1 - size
    least = np.minimum(least[: len(least) - rest], least[rest:])
    at = (np.uint64(0xFFFFFFFF) - (least[starts] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    new = np.flatnonzero(new)
    lo, hi, at = starts[new], starts[np.append(new[1:], len(starts)) - 1], at[new]
    long = g[64]
    middle = np.minimum(lo + 64, hi + WINDOW - 64)
    ctx = _pair(_pair(long[lo], long[middle], 0), long[hi + WINDOW - 64], 1)
    ctx = mixed(ctx + (at - lo).astype(np.uint64) * _ODD[2] + (at - hi).astype(np.uint64) * _ODD[3])
    return at, lo, hi, owner[lo], mixed(g[GRAM][at]), ctx


def scan(batches: Batches) -> Batches:
    for batch in batches:
        ids = np.asarray(batch["doc_id"])
        data, offsets = text_bytes(batch["text"])
        for first, end in slices(offsets):
            off = offsets[first : end + 1] - offsets[first]
            at, lo, hi, owner, h, ctx = spans_of_anchors(data[offsets[first] : offsets[end]], off)
            yield anchor_batch(ids[first:end], owner, h, at - off[owner], at - lo, at - hi, ctx)


CONTEXTS = "h long, doc_id long, pos long, reach int, least int, context binary"


def cut_contexts(batches: Batches) -> Batches:
    """The representatives' contexts, from rows (doc_id, text, marks)."""
    for batch in batches:
        rows: list[list] = [[] for _ in range(6)]
        for doc_id, text, marks in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["marks"].to_pylist(), strict=True):
            raw = (text or "").encode()
            for m in marks:
                lo, hi = m["pos"] - m["reach"], m["pos"] - m["least"] + WINDOW
                for column, x in zip(rows, (m["h"], doc_id, m["pos"], m["reach"], m["least"], raw[lo:hi]), strict=True):
                    column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["h", "doc_id", "pos", "reach", "least", "context"])


def equal_windows(group: np.ndarray, rank: np.ndarray, reach: np.ndarray, least: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """Marks (context, offset) of windows that equal a window of lower rank in their group.

    Contexts stand aligned at their anchors. Round k adds column k to every context: `order` sorts the contexts of
    each group by their columns up to k read backwards, and began[j] is the first column of the match of order[j]
    with order[j - 1] that lasts up to column k.
    """
    m = len(contexts)
    column = np.zeros((m, WIDTH), np.uint8)
    for i, c in enumerate(contexts):
        column[i, SPREAD - reach[i] : SPREAD - reach[i] + len(c)] = np.frombuffer(c, np.uint8)
    column = np.ascontiguousarray(column.T)
    later = np.zeros((m, SPREAD + 1), bool)
    order = np.argsort(group, kind="stable")
    began = np.zeros(m + 1, np.int64)
    began[:-1][np.append(True, group[order][1:] != group[order][:-1])] = WIDTH
    far = np.iinfo(np.int64).max
    for k in range(WIDTH):
        key = group[order] * 256 + column[k][order]
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        same = np.append(False, key[1:] == key[:-1])
        before = np.append(0, moved[:-1])
        new = np.full(m + 1, k + 1, np.int64)
        near = same & (moved == before + 1)
        new[:-1][near] = began[moved[near]]
        apart = np.flatnonzero(same & ~near)
        if len(apart):
            new[apart] = np.maximum.reduceat(began, np.stack([before[apart] + 1, moved[apart] + 1], 1).ravel())[::2]
        order, began = order[moved], new
        offset = WIDTH - (k + 1)
        if offset <= SPREAD:
            runs = np.flatnonzero(began[:-1] > k + 1 - WINDOW)
            runs = runs if len(runs) and runs[0] == 0 else np.append(0, runs)
            valid = (reach[order] >= offset) & (least[order] <= offset)
            ranks = np.where(valid, rank[order], far)
            lowest = np.repeat(np.minimum.reduceat(ranks, runs), np.diff(np.append(runs, m)))
            later[order, offset] = valid & (ranks > lowest)
    return later


def compare(batches: Batches) -> Batches:
    """Ranges (doc_id, lo, hi) of windows that equal earlier ones, from contexts that come sorted by h."""

    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        h, doc, pos, reach, least = (t[c].to_numpy() for c in ("h", "doc_id", "pos", "reach", "least"))
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((pos, doc))] = np.arange(len(h))
        group = np.unique(h, return_inverse=True)[1]
        later = equal_windows(group, rank, reach.astype(np.int64), least.astype(np.int64), t["context"].to_pylist())
        edge = np.diff(np.pad(later.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (i, first), last = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
        return pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(pos[i] - (last - 1)), pa.array(pos[i] - first + WINDOW)], ["doc_id", "lo", "hi"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch)
            size += batch.num_rows
            batch = batch.slice(batch.num_rows)
            if size >= CHUNK:
                h = held[-1]["h"].to_numpy()
                cut = int(np.searchsorted(h == h[-1], True))
                last = held.pop()
                if cut:
                    yield settle([*held, last.slice(0, cut)])
                    held, size = [last.slice(cut)], last.num_rows - cut
                else:
                    held.append(last)
    if held:
        yield settle(held)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal_report(batches: Batches) -> Batches:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            raw = (text or "").encode()
            gone = removed_units(spans, len(raw))
            left = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
            rows.append((doc_id, len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), sha256(left)))
        yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


GROUP = ("h", "a", "b", "key")


def halved(rows: DataFrame) -> DataFrame:
    """Contexts of crowded groups, each cut into the windows of the nearer and of the farther half of its group's offsets.

    All windows of offsets a to b hold the bytes from a before the anchor to 100 - b after it; these name the new group.
    """
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    part = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b").alias("b"))))
    rows = rows.withColumn("part", part).withColumn("most", F.least("reach", "part.b")).withColumn("fewest", F.greatest("least", "part.a")).filter("fewest <= most")
    cut = lambda first, n: F.expr(f"substring(context, {first}, {n})")
    core = F.xxhash64(cut("reach - part.a + 1", f"{WINDOW} - part.b + part.a"))
    context = cut("reach - most + 1", f"most - fewest + {WINDOW}")
    return rows.select("h", "part.a", "part.b", core.alias("key"), "doc_id", "pos", F.col("most").alias("reach"), F.col("fewest").alias("least"), context.alias("context"))


def repeated_bytes(docs: DataFrame) -> list[DataFrame]:
    """Staged tables (doc_id, spans) of the byte ranges that repeated strings cover."""
    gone, open_ = decided(docs, scan, WINDOW)
    marks = by_document(open_, "h", "pos", "reach", "least")
    text = bare(docs)
    contexts = marks.withColumnRenamed("doc_id", "of").join(text, F.col("of") == text.doc_id).select("doc_id", "text", "marks").mapInArrow(cut_contexts, CONTEXTS)
    contexts = stage(contexts.select("h", F.lit(0).alias("a"), F.lit(SPREAD).alias("b"), F.lit(0).cast("long").alias("key"), "doc_id", "pos", "reach", "least", "context"), heavy=True)
    rows, used = contexts, [open_, contexts]
    few = later = None
    while True:  # offsets halve each time: seven times at most
        hot = stage(rows.groupBy(*GROUP).agg(F.count("*").alias("n")).filter(F.col("n") > MANY).drop("n"))
        used.append(hot)
        part = rows.join(hot, list(GROUP), "left_anti").select(F.xxhash64(*GROUP).alias("h"), "doc_id", "pos", "reach", "least", "context")
        few = part if few is None else few.unionByName(part)
        if hot.isEmpty():
            break
        halves = stage(halved(rows.join(hot, list(GROUP), "left_semi")))
        same = [*GROUP, "reach", "least", "context"]
        first = halves.groupBy(*same).agg(F.min(F.struct("doc_id", "pos")).alias("first"))
        marked = stage(halves.join(first, same).withColumn("gone", (F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos"))).drop("first"))
        used += [halves, marked]
        found = marked.filter("gone").select("doc_id", (F.col("pos") - F.col("reach")).alias("lo"), (F.col("pos") - F.col("least") + WINDOW).alias("hi"))
        later = found if later is None else later.unionByName(found)
        rows = marked.filter("not gone").drop("gone")
    compared = few.repartition("h").sortWithinPartitions("h").mapInArrow(compare, "doc_id long, lo long, hi long")
    later = compared if later is None else compared.unionByName(later)
    later = stage(later.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), heavy=True)
    unstage(*used)
    return [gone, later]


def op2_column_wise_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_removals(docs, repeated_bytes(docs)).mapInArrow(removal_report, OUT)
