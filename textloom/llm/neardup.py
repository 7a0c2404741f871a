"""MinHash near-dedup with bottom-k sketches.

A document's set is its distinct word shingles, and its sketch the K least of their hashes under one hash
function. Documents of equal sets form classes first. Between class representatives,

1. inverted lists of retained values bring candidates together. Two sets at or above the threshold share, but for
   a chance of one in two million, at least SHARED of K values, so each sketch enters only the lists of its
   K - SHARED + 1 values that fewest sketches hold: very common passages make no lists;
2. in each list every document meets a pivot, not every other document. Links merge documents into components,
   lists with documents of several components get other pivots, and at last all pairs across components that are
   still in one list and that their sizes, places in it and parity bitmaps leave possible;
3. the K least values of the union of two sketches estimate the similarity; pairs far below the threshold go;
4. the exact similarity of the full sets decides the rest.

Pairs inside one component need no further test, so a group of n copies costs about n tests, not n squared, and
no link between different components is lost.

Shingles are compared by 64-bit hashes (two of w distinct ones agree with a chance of about w^2 / 2^65); equal sets
are told by a 128-bit digest of the whole set, other links by the whole sets. A list that stays crowded after its
documents were listed anew forms all pairs that can still be alike: documents put together from few common passages
are the worst case, and Spark splits such lists over tasks.

Defined cases: null texts and texts without words have an empty set, no links and are kept; equal texts are linked;
rows without a doc_id are left out; rows that share a doc_id count as one document with the links of all, each
reported with its own set's size. An empty table gives an empty result. Columns other than doc_id and text are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER_TO_LOWER, WordHashes, mixed, stage, table, unstage
from .repeats import Batches, bare
from .suffix_dedup import _pair

K, SHARED = 64, 34
PIVOT_ROUNDS = 2
#: lists of more documents than this are split by full sets before their pairs are formed
FEW = 32
#: shingles for a task to unpack, so that tasks grow in number before they grow in size
UNPACKED = 20_000
#: an estimate this far below the threshold, six standard errors, rules a pair out
MARGIN = 0.3
#: bits of a set's parity bitmap, a power of two; no row depends on it
BITS = 512


def shingles(text: str | None, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles, as signed numbers."""
    h = hashes.of((text or "").encode().translate(UPPER_TO_LOWER).split())
    if not len(h):
        return np.zeros(0, np.int64)
    width = min(size, len(h))
    x = h[: len(h) - width + 1] + np.uint64(size - width)
    for k in range(1, width):
        x = _pair(x, h[k : len(h) - width + 1 + k], k)
    return np.unique(mixed(x).view(np.int64))


def whole(items: np.ndarray) -> bytes:
    """A digest of a full sorted set: equal for equal sets only."""
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def parities(items: np.ndarray) -> np.ndarray:
    """BITS bits as signed 64-bit numbers: for each remainder of the hashes, whether an odd number of items has it.

    An item of only one of two sets changes one bit, so two bitmaps differ in no more bits than their sets do in items.
    """
    odd = np.bincount(items & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def scanner(size: int):
    def scan(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, hashes, size) for t in batch["text"].to_pylist()]
            columns = [
                batch["row"], batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([whole(s) for s in sets], pa.binary()),
                pa.array([s[:K] for s in sets], pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "same", "sketch", "bits"])

    return scan


def set_maker(size: int):
    """Full sets of rows (node, same, text) whose text has the set that `same` names."""

    def make(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            nodes, items = [], []
            for node, same, text in zip(batch["node"].to_pylist(), batch["same"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = shingles(text, hashes, size)
                if whole(found) == same:
                    nodes.append(node)
                    items.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(items, pa.binary())], ["node", "items"])

    return make


def confirmer(percent: int):
    def confirm(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for x, y in zip(batch["items_a"], batch["items_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) with the labels of linked nodes made one, by contraction to random neighbours."""
    at = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    edges = stage(links.join(at("a"), "a").join(at("b"), "b").select(F.col("la").alias("x"), F.col("lb").alias("y")).filter("x != y").distinct())
    turn = 0
    while not edges.isEmpty():
        turn += 1
        ends = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        ends = ends.unionByName(edges.select("x", F.col("x").alias("y"))).unionByName(edges.select(F.col("y").alias("x"), "y"))
        to = stage(ends.groupBy("x").agg(F.min_by("y", F.xxhash64("y", F.lit(turn))).alias("m")))
        old = labels
        labels = stage(labels.join(to, labels.label == to.x, "left").select("node", F.coalesce("m", "label").alias("label")))
        mx, my = to.select("x", F.col("m").alias("mx")), to.select(F.col("x").alias("y"), F.col("m").alias("my"))
        left = stage(edges.join(mx, "x").join(my, "y").select(F.col("mx").alias("x"), F.col("my").alias("y")).filter("x != y").distinct())
        unstage(edges, to, *([old] if turn > 1 else []))
        edges = left
    unstage(edges)
    return labels


def inverted_lists(reps: DataFrame) -> DataFrame:
    """(v, doc, n): nodes under the rarest values of their sketches, values of one document left out."""
    postings = reps.select(F.col("node").alias("doc"), "n", F.explode("sketch").alias("v"))
    common = postings.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1").withColumnRenamed("v", "cv")
    ranked = postings.join(common, postings.v == common.cv, "left")
    # values of a single document come first in the order, so only their number matters
    held = ranked.groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "v")))).alias("shared"))
    size = F.least(F.col("n"), F.lit(K))
    room = size - F.greatest(F.lit(1), F.floor(size * SHARED / K)) + 1 - (size - F.size("shared"))
    return held.filter(room > 0).select("doc", "n", F.explode(F.slice("shared", 1, room.cast("int"))).alias("p")).select(F.col("p.v").alias("v"), "doc", "n")


def shared_ids(member: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with the labels of rows that share a doc_id made one."""
    twice = stage(member.groupBy("doc_id").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).filter("r0 != r1").select("doc_id", "r0"))
    if twice.isEmpty():
        unstage(twice)
        return labels
    links = stage(member.join(twice, "doc_id").filter("rep != r0").select(F.col("r0").alias("a"), F.col("rep").alias("b")).distinct())
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    new = ends.join(labels, "node", "left_anti").withColumn("label", F.col("node"))
    out = merged(stage(labels.unionByName(new)), links)
    unstage(twice, links)
    return out


def near_components(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    text = bare(docs)
    rows = text.withColumn("row", F.monotonically_increasing_id())  # fixed once staged
    scanned = stage(rows.mapInArrow(scanner(size), "row long, doc_id long, n long, same binary, sketch array<long>, bits array<long>"))
    classes = stage(scanned.filter("n > 0").groupBy("same").agg(F.min("row").alias("rep")))
    member = scanned.select("row", "doc_id", "same", "n").join(classes, "same", "left").select("doc_id", "n", F.coalesce("rep", "row").alias("rep"))
    member = stage(member)
    reps = stage(scanned.join(classes.select(F.col("rep").alias("node")), F.col("row") == F.col("node")).select("node", "doc_id", "n", "same", "sketch", "bits"))
    unstage(scanned, classes)
    lists = stage(inverted_lists(reps), heavy=True)
    crowded = lists.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1").select("v")
    lists_ = stage(lists.join(crowded, "v"))
    unstage(lists)
    lists = lists_
    known = lists.select(F.col("doc").alias("node")).distinct()
    wanted = reps.filter(F.col("n") > K).join(known, "node", "left_semi").select("node", "same", F.col("doc_id").alias("of"))
    sets = wanted.join(text, F.col("of") == text.doc_id).select("node", "same", "text").mapInArrow(set_maker(size), "node long, items binary")
    sets = stage(sets.dropDuplicates(["node"]), heavy=True)
    sketches = stage(reps.join(known, "node", "left_semi").select("node", "n", "sketch", "bits"))
    unstage(reps)
    labels = stage(known.withColumn("label", F.col("node")))
    tested, used = None, [lists, sets, sketches]
    for turn in range(PIVOT_ROUNDS + 1):
        at = lists.join(labels, lists.doc == labels.node).select("v", "doc", "n", "label")
        order = F.col("doc") if turn == 0 else F.xxhash64("doc", "v", F.lit(turn))
        pivots = at.groupBy("v").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min_by("doc", order).alias("pivot"), F.min_by("label", order).alias("pl"), F.min_by("n", order).alias("pn")).filter("l0 != l1").drop("l0", "l1")
        alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
        if turn < PIVOT_ROUNDS:
            pairs = at.join(pivots, "v").filter((F.col("label") != F.col("pl")) & alike(F.col("n"), F.col("pn"))).select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b"))
        else:
            pairs = crossing_pairs(at.join(pivots.select("v"), "v", "left_semi"), sets, sketches, percent)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs)
        used.append(pairs)
        links = stage(linked(pairs, sketches, sets, percent), heavy=True)
        labels_ = merged(labels, links)
        if labels_ is not labels:
            unstage(labels)
        labels = labels_
        unstage(links)
        tested = pairs if tested is None else tested.unionByName(pairs)
    labels = shared_ids(member, labels)
    unstage(*used)
    joined = member.join(labels, member.rep == labels.node, "left").select("doc_id", "n", "rep", F.coalesce("label", "rep").alias("label"))
    smallest = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return joined.join(smallest, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def crossing_pairs(lists: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of one list of lists (v, doc, n, label) that are in different components and can be alike.

    Lists of more than FEW documents mostly hold documents that share a passage and nothing else. Their documents
    are listed anew under the rarest fifth of their full sets, which two sets at the threshold can't fail to share.
    """
    lists = stage(lists)
    size = lists.groupBy("v").agg(F.count("*").alias("m"))
    short = lists.join(size.filter(F.col("m") <= FEW), "v", "left_semi").select("v", "doc", "n", "label", F.lit(0).alias("rank"))
    long = lists.join(size.filter(F.col("m") > FEW), "v", "left_semi").select("doc", "n", "label").distinct()
    long = stage(long)
    small = sketches.filter(F.col("n") <= K).select("node", F.col("sketch").alias("small"))
    items = sets.unionByName(small.mapInArrow(_packed, "node long, items binary"))
    # sets stand unevenly in their files: dealt anew before each row becomes many; no more tasks than a shuffle has
    shingles_ = long.agg(F.sum("n")).first()[0] or 0
    tasks = min(int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-shingles_ // UNPACKED)))
    dealt = items.join(long, items.node == long.doc, "left_semi").repartition(tasks)
    # read twice below: written once, so that the sets are unpacked once
    items = stage(dealt.mapInArrow(_unpacked, "id long, v long"))
    common = items.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1").withColumnRenamed("v", "cv")
    # items of one document come first in the order, and are all that most documents need
    single = items.join(common, items.v == common.cv, "left_anti").groupBy("id").agg(F.count("*").alias("alone"))
    alone = F.coalesce("alone", F.lit(0))
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    more = stage(long.join(single, long.doc == single.id, "left").select("doc", "n", "label", alone.alias("alone"), room.alias("room")).filter("room > 0"))
    # then those of few documents; only documents that these do not fill look up those of many
    shared = lambda df, many: df.join(common.filter(F.col("df") > FEW if many else F.col("df") <= FEW), F.col("v") == F.col("cv")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("many" if many else "few"))
    held = stage(more.join(shared(items, False), F.col("doc") == F.col("id"), "left").drop("id"))
    still = held.filter(F.col("room") > F.coalesce(F.size("few"), F.lit(0))).select(F.col("doc").alias("still"))
    rest = shared(items.join(still, F.col("id") == F.col("still"), "left_semi"), True)
    none = F.array().cast("array<struct<df:bigint,v:bigint>>")
    held = held.join(rest, F.col("doc") == F.col("id"), "left").withColumn("shared", F.concat(F.coalesce("few", none), F.coalesce("many", none)))
    anew = held.select("doc", "n", "label", "alone", F.posexplode(F.slice("shared", 1, F.col("room").cast("int"))).alias("at", "p"))
    anew = anew.select(F.col("p.v").alias("v"), "doc", "n", "label", (F.col("alone") + F.col("at")).alias("rank"))
    bits = sketches.select("node", "bits")
    both = short.unionByName(anew)
    both = stage(both.join(bits, F.col("doc") == F.col("node")).drop("node"))
    other = both.select(F.col("v").alias("w"), F.col("doc").alias("b"), F.col("n").alias("bn"), F.col("label").alias("bl"), F.col("rank").alias("br"), F.col("bits").alias("bb"))
    alike = 100 * F.least("n", "bn") >= percent * F.greatest("n", "bn")
    # at the first value that a pair shares, what is left of both sets must suffice
    enough = F.least(F.col("n") - F.col("rank"), F.col("bn") - F.col("br")) * (100 + percent) >= percent * (F.col("n") + F.col("bn"))
    # bits that differ are items that differ: a bound that no pair at the threshold fails
    apart = sum(F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("bb", F.lit(k)))) for k in range(BITS // 64))
    within = (F.col("n") + F.col("bn") - apart) * (100 + percent) >= 2 * percent * (F.col("n") + F.col("bn"))
    return both.join(other, (F.col("v") == F.col("w")) & (F.col("label") != F.col("bl")) & (F.col("doc") < F.col("b")) & alike & enough & within).select(F.col("doc").alias("a"), "b")


def linked(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    least = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, F.least(F.lit(K), F.greatest(F.size("sa"), F.size("sb"))))
    found = F.array_intersect("sa", "sb")
    whole = (F.col("na") <= K) & (F.col("nb") <= K)
    exact = F.when(whole, 100 * F.size(found) >= percent * (F.col("na") + F.col("nb") - F.size(found)))
    estimate = F.size(F.array_intersect(least, found)) / F.size(least)
    near = stage(both.withColumn("exact", exact).filter(F.coalesce("exact", estimate >= percent / 100 - MARGIN)).select("a", "b", "exact"))
    small = sketches.filter(F.col("n") <= K).select("node", F.col("sketch").alias("small"))
    rest = near.filter("exact is null").select("a", "b")
    unpacked = full_sets(rest, sets, small)
    return near.filter("exact").select("a", "b").unionByName(unpacked.mapInArrow(confirmer(percent), "a long, b long"))


def full_sets(pairs: DataFrame, sets: DataFrame, small: DataFrame) -> DataFrame:
    """pairs with both full sets; the few small ones are packed from their sketches."""
    all_ = sets.unionByName(small.mapInArrow(_packed, "node long, items binary"))
    side = lambda x: all_.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b")


def _unpacked(batches: Batches) -> Batches:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch["items"]]
        for first in range(0, len(sets), 500):
            part = sets[first : first + 500]
            ids = np.repeat(np.asarray(batch["node"])[first : first + 500], [len(s) for s in part])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(part))], ["id", "v"])


def _packed(batches: Batches) -> Batches:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array([np.array(s, np.int64).tobytes() for s in batch["small"].to_pylist()], pa.binary())], ["node", "items"])


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
