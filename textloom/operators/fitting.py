"""Fits and clusterings of many groups at once: rounds of joins and aggregates over all of them, not a loop over groups."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from textloom.sources.staging import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: rounds of two-means and of a fit at most
ROUNDS, FIT_ROUNDS = 20, 8
#: fixed values: a group's fewest vectors for a score; how far a centre may be from its line while fitting and at the
#: end, the fewest pairs of a fit, the scales it may take, and the offsets that it starts from
LEAST_VECTORS, REACH, HIT, LEAST_PAIRS, SCALES, STARTS = 4, 10.0, 6.0, 4, (0.94, 1.06), (0.0, -13.0, 13.0, -26.0, 26.0)
#: vectors up to which a block of average_linkage is a square table of 8 bytes a pair in one task; vectors that a task
#: compares with as many others where it is not
MOST_IN_BLOCK, PART = 5000, 2000
#: lines and bands up to which a page is fitted in one task; rows that a task fits together
MOST_ON_PAGE, AT_ONCE = 200_000, 100_000


def distance2(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda s, x: s + x)


def mean_vectors(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, centre, n): means place by place, by partial sums."""
    places = rows.select(*keys, F.posexplode(vector).alias("at", "x")).groupBy(*keys, "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centre"), F.max("n").alias("n"))


def mix_scores(rows: DataFrame, group: str, id_: str, vector: str) -> DataFrame:
    """(group, n, score, share): each group split in two by Lloyd rounds; the cosine of the centres, and the smaller part's share.

    The first centre begins at the vector of the smallest id, the second at the one farthest from it (ties: smallest
    id). All groups take their rounds together; a round is one join with two centres a group and one aggregate, and
    they end when no centre moves. Groups of under LEAST_VECTORS, and those of equal vectors, score 1 with share 0.
    """
    v = staged(rows.filter(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(id_).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")))
    sizes = v.groupBy("g").agg(F.count("*").alias("n"))
    first = v.groupBy("g").agg(F.min_by("v", "id").alias("c0"))
    far = v.join(first, "g").groupBy("g").agg(F.first("c0").alias("c0"), F.max_by("v", F.struct(distance2("v", "c0"), -F.col("id"))).alias("c1"))
    centres = staged(far.join(sizes.filter(F.col("n") >= LEAST_VECTORS), "g").select("g", "c0", "c1"))
    for _ in range(ROUNDS):
        part = v.join(centres, "g").select("g", "v", (distance2("v", "c1") < distance2("v", "c0")).cast("int").alias("part"))
        means = mean_vectors(part, ["g", "part"], "v")
        side = lambda k: F.max(F.when(F.col("part") == k, F.col("centre")))  # noqa: E731, B023
        moved = means.groupBy("g").agg(F.max_by("centre", F.when(F.col("part") == 0, 1)).alias("m0"), F.max_by("centre", F.when(F.col("part") == 1, 1)).alias("m1"), F.sum(F.when(F.col("part") == 1, F.col("n")).otherwise(0)).alias("n1"))
        new = staged(centres.join(moved, "g").select("g", F.coalesce("m0", "c0").alias("c0"), F.coalesce("m1", "c1").alias("c1"), "n1", ((F.coalesce("m0", "c0") != F.col("c0")) | (F.coalesce("m1", "c1") != F.col("c1"))).alias("moved")))
        centres = new.select("g", "c0", "c1")
        if new.filter("moved").isEmpty():
            break
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0).cast("double"), lambda s, x: s + x * x))
    cosine = F.aggregate(F.zip_with("c0", "c1", lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x) / (norm("c0") * norm("c1"))
    one = (F.col("n1") == 0) | (F.col("n1") == F.col("n")) | F.col("n1").isNull()
    out = sizes.join(new.select("g", "n1", cosine.alias("cosine")), "g", "left")
    return out.select(F.col("g").alias(group), "n", F.when(one, 1.0).otherwise(F.col("cosine")).alias("score"), F.when(one, 0.0).otherwise(F.least("n1", F.col("n") - F.col("n1")) / F.col("n")).alias("share"))


def _nearest(points: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, ..., y) with `c`, the nearest of targets (keys, c) of the same keys, the smaller of two as near; one beyond REACH is any or none.

    Points and targets stand in one order, and a point looks at the last target before it and the first after it. The
    order is cut into cells as wide as REACH, so that no task holds all of a key; a cell's first target and its last one
    stand in the cells beside it too.
    """
    cell = lambda at: F.floor(at / REACH).cast("double")
    own = targets.select(*keys, cell(F.col("c")).alias("_cell"), F.col("c").alias("_c")).filter("_c is not null")
    ends = own.groupBy(*keys, "_cell").agg(F.max("_c").alias("last"), F.min("_c").alias("first"))
    beside = ends.select(*keys, F.explode(F.array(F.struct((F.col("_cell") + 1).alias("_cell"), F.col("last").alias("_c")), F.struct((F.col("_cell") - 1).alias("_cell"), F.col("first").alias("_c")))).alias("e")).select(*keys, "e.*")
    own = own.unionByName(beside).withColumn("_at", F.col("_c"))
    both = points.withColumn("_at", F.col("y")).withColumn("_cell", cell(F.col("y"))).withColumn("_c", F.lit(None).cast("double")).unionByName(own, allowMissingColumns=True)
    up = Window.partitionBy(*keys, "_cell").orderBy("_at", F.col("_c").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_cell").orderBy(F.desc("_at"), F.col("_c").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_low", F.last("_c", True).over(up)).withColumn("_high", F.last("_c", True).over(down)).filter("_c is null")
    near = F.when(F.col("_low").isNull() | (F.abs(F.col("_high") - F.col("y")) < F.abs(F.col("y") - F.col("_low"))), F.col("_high")).otherwise(F.col("_low"))
    return both.withColumn("c", near).drop("_at", "_cell", "_c", "_low", "_high")


def fits_in_rounds(lines: DataFrame, bands: DataFrame, key: str) -> DataFrame:
    """nearest_fits of pages of any size: a round is joins, windows and aggregates over the lines and bands of all pages."""
    lines, bands = staged(lines.select(key, F.col("r").cast("double").alias("r"))), staged(bands.select(key, F.col("c").cast("double").alias("c")))
    enough = lambda df: df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n >= 3").select(key)
    pages = enough(lines).join(enough(bands), key)
    starts = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.lit(b).alias("b")) for i, b in enumerate(STARTS)]))
    fits = staged(pages.select(key, starts.alias("s")).select(key, "s.start", F.lit(1.0).alias("a"), "s.b", F.lit(True).alias("open")))
    keys = [key, "start"]
    for _ in range(FIT_ROUNDS):
        going = fits.filter("open")
        if going.isEmpty():
            break
        points = lines.join(going, key).withColumn("y", F.col("a") * F.col("r") + F.col("b"))
        pairs = _nearest(points, bands.join(going.select(*keys), key), keys).filter(F.abs(F.col("c") - F.col("y")) <= REACH)
        sums = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("r").alias("mr"), F.avg("c").alias("mc"), F.covar_pop("r", "c").alias("rc"), F.var_pop("r").alias("rr"))
        scale = F.when(F.col("rr") * F.col("n") > 1e-6, F.least(F.lit(SCALES[1]), F.greatest(F.lit(SCALES[0]), F.col("rc") / F.col("rr")))).otherwise(F.col("a"))
        new = fits.join(sums, keys, "left").withColumn("a2", scale).withColumn("b2", F.col("mc") - F.col("a2") * F.col("mr"))
        fitted = F.col("open") & (F.coalesce("n", F.lit(0)) >= LEAST_PAIRS)
        still = fitted & ~((F.abs(F.col("a2") - F.col("a")) < 1e-6) & (F.abs(F.col("b2") - F.col("b")) < 0.05))
        fits = staged(new.select(*keys, F.when(fitted, F.col("a2")).otherwise(F.col("a")).alias("a"), F.when(fitted, F.col("b2")).otherwise(F.col("b")).alias("b"), still.alias("open")))
    placed = lines.join(fits.drop("open"), key).withColumn("y", F.col("a") * F.col("r") + F.col("b"))
    own = bands.join(fits.select(*keys), key)
    of_lines = _nearest(placed, own, keys).withColumn("d", F.abs(F.col("c") - F.col("y"))).filter(F.col("d") <= HIT).groupBy(*keys).agg(F.count("*").alias("n_lines"), F.median("d").alias("residual"))
    back = _nearest(own.withColumnRenamed("c", "y"), placed.select(*keys, F.col("y").alias("c")), keys)
    of_bands = back.filter(F.abs(F.col("c") - F.col("y")) <= HIT).groupBy(*keys).agg(F.count("*").alias("n_bands"))
    scored = fits.join(of_lines, keys, "left").join(of_bands, keys, "left").withColumn("votes", F.coalesce("n_lines", F.lit(0)) + F.coalesce("n_bands", F.lit(0)))
    order = F.struct(-F.col("votes"), F.coalesce("residual", F.lit(99.0)), "start")
    return scored.groupBy(key).agg(F.min_by(F.struct("a", "b", "votes", F.coalesce("residual", F.lit(99.0)).alias("residual")), order).alias("f")).select(key, "f.*")


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges that begin at `first`: the number of the range, and the place, of each of their items."""
    owner = np.repeat(np.arange(len(first)), size)
    return owner, np.arange(len(owner)) + (first - np.cumsum(size) + size)[owner]


def _in_order(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Groups and values as one array: complex numbers are compared by the real part, then by the imaginary one."""
    out = np.empty(len(value), complex)
    out.real, out.imag = group, value
    return out


def _beside(group: np.ndarray, y: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """How far each y is from, and which is, the nearest target of its group, the smaller of two as near; infinite where there is none."""
    after = np.searchsorted(targets, _in_order(group, y), "right")
    padded = np.concatenate([[-1], targets, [-1]])
    low = np.where(padded.real[after] == group, padded.imag[after], -np.inf)
    high = np.where(padded.real[after + 1] == group, padded.imag[after + 1], np.inf)
    return np.where(high - y < y - low, high, low)


def _fits_of_pages(page: np.ndarray, is_line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pages that have a fit, and their a, b, votes and residual; values ascend inside pages 0, 1, ... of lines and of bands."""
    n_pages = int(page[-1]) + 1
    count = lambda some: np.bincount(page[some], minlength=n_pages)
    pages = np.flatnonzero((count(is_line) >= 3) & (count(~is_line) >= 3))
    fine = np.isfinite(at)
    first = lambda n: np.cumsum(n) - n
    n_r, n_c = count(is_line & fine), count(~is_line & fine)
    r, c = at[is_line & fine], at[~is_line & fine]
    on = np.repeat(pages, len(STARTS))
    first_r, first_c, n_r, n_c, bands = first(n_r)[on], first(n_c)[on], n_r[on], n_c[on], _in_order(page[~is_line & fine], c)
    a, b, going = np.ones(len(on)), np.tile(STARTS, len(pages)), np.arange(len(on))
    for _ in range(FIT_ROUNDS):
        if not len(going):
            break
        owner, place = _spread(first_r[going], n_r[going])
        x = r[place]
        y = a[going][owner] * x + b[going][owner]
        near = _beside(on[going][owner], y, bands)
        kept = np.abs(near - y) <= REACH
        owner, x, near = owner[kept], x[kept], near[kept]
        n = np.bincount(owner, minlength=len(going))
        mean = lambda v: np.bincount(owner, v, len(going)) / np.maximum(n, 1)  # noqa: E731, B023
        mr, mc = mean(x), mean(near)
        x -= mr[owner]
        rr, rc = mean(x * x), mean(x * (near - mc[owner]))
        wide = rr * n > 1e-6
        a2 = np.where(wide, np.clip(rc / np.where(wide, rr, 1), *SCALES), a[going])
        b2 = mc - a2 * mr
        fitted = n >= LEAST_PAIRS
        still = fitted & ~((np.abs(a2 - a[going]) < 1e-6) & (np.abs(b2 - b[going]) < 0.05))
        a[going[fitted]], b[going[fitted]] = a2[fitted], b2[fitted]
        going = going[still]
    owner, place = _spread(first_r, n_r)
    y = a[owner] * r[place] + b[owner]
    d = np.abs(_beside(on[owner], y, bands) - y)
    placed = _in_order(owner, y)
    hit = d <= HIT
    owner, d = owner[hit], d[hit]
    n_hit = np.bincount(owner, minlength=len(on))
    back, place = _spread(first_c, n_c)
    votes = n_hit + np.bincount(back[np.abs(_beside(back, c[place], placed) - c[place]) <= HIT], minlength=len(on))
    # medians only where they decide or are told
    best = votes == np.repeat(votes.reshape(-1, len(STARTS)).max(1), len(STARTS))
    owner, d = owner[best[owner]], d[best[owner]]
    d = d[np.lexsort((d, owner))]
    residual, some = np.where(best, 99.0, np.inf), np.flatnonzero(best & (n_hit > 0))
    middle = first(n_hit[some])
    residual[some] = (d[middle + (n_hit[some] - 1) // 2] + d[middle + n_hit[some] // 2]) / 2
    won = residual.reshape(-1, len(STARTS)).argmin(1) + np.arange(len(pages)) * len(STARTS)
    return pages, a[won], b[won], votes[won], residual[won]


def _fits_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, b, votes, residual) of rows (key, line, at) in this order; whole pages of about AT_ONCE rows are fitted together."""

    def fits(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        page = np.zeros(len(rows), np.int64)
        page[starts] = 1
        values = [rows.column(k).to_numpy() for k in (1, 2)]
        pages, *out = _fits_of_pages(np.cumsum(page), values[0].astype(bool), values[1].astype(float))
        ids = rows.column(0).take(pa.array(np.concatenate([[0], starts])[pages])).combine_chunks()
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, out)], [rows.column_names[0], "a", "b", "votes", "residual"])

    held, n, wanted = [], 0, AT_ONCE
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n += len(batch)
            if n < wanted:
                continue
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows.column(0)
            starts = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy()) + 1
            if batch is None:
                yield fits(rows, starts)
            elif len(starts):
                yield fits(rows[: starts[-1]], starts[:-1])
                rows = rows[starts[-1] :]
            held, n, wanted = rows.to_batches(), len(rows), max(AT_ONCE, 2 * len(rows))


def nearest_fits(lines: DataFrame, bands: DataFrame, key: str) -> DataFrame:
    """(key, a, b, votes, residual): the scale and offset that bring each page's lines (key, r) onto its bands (key, c).

    Each page tries every start; a round pairs each line with its nearest band and fits a straight line to the pairs,
    until none changes. The fit with the most lines and bands in place wins. Lines and bands are shuffled once, sorted by
    page and value, and all rounds of many pages are taken where they are read; pages of over MOST_ON_PAGE lines and
    bands go by fits_in_rounds.
    """
    rows = lines.select(key, F.lit(True).alias("line"), F.col("r").cast("double").alias("at")).unionByName(bands.select(key, F.lit(False).alias("line"), F.col("c").cast("double").alias("at"))).filter(F.col(key).isNotNull())
    large = staged(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > MOST_ON_PAGE).select(key))
    some = not large.isEmpty()
    rows = rows.join(large, key, "left_anti") if some else rows
    schema = StructType([StructField(key, rows.schema[key].dataType), *(StructField(n, DoubleType()) for n in "ab"), StructField("votes", LongType()), StructField("residual", DoubleType())])
    out = rows.repartition(key).sortWithinPartitions(key, "line", "at").mapInArrow(_fits_of_rows, schema)
    return out.unionByName(fits_in_rounds(lines.join(large, key, "left_semi"), bands.join(large, key, "left_semi"), key)) if some else out


def linkage(x: np.ndarray, cut: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers of unit vectors, or of means of `sizes` unit vectors, by average linkage of cosine distances, merged up to `cut`.

    Chains of nearest neighbours: a pair that is nearest to each other merges, and the distances of the merged cluster
    are the means of its parts', weighted by their sizes, written over those of one part. Time in proportion to n squared.
    """
    n = len(x)
    d = 1.0 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, parent, alive = np.ones(n) if sizes is None else sizes.astype(float), np.arange(n), np.ones(n, bool)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            row = d[chain[-1]]
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
                break
            chain.append(near)
        a, b = chain.pop(), chain.pop()
        merges.append((d[a, b], a, b))
        mixed = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[b], d[:, b], d[a], d[:, a] = mixed, mixed, np.inf, np.inf
        d[b, b] = np.inf
        size[b] += size[a]
        alive[a] = False
    for distance, a, b in merges:
        if distance <= cut:
            roots = []
            for k in (a, b):
                while parent[k] != k:
                    k = parent[k]
                roots.append(k)
            parent[max(roots)] = min(roots)
    for k in range(n):  # a smaller number never hangs below a larger one
        parent[k] = parent[parent[k]]
    return np.unique(parent, return_inverse=True)[1]


def _nearest_of_parts(frame: pd.DataFrame) -> pd.DataFrame:
    """(block, id, d, partner) of each cluster of two parts of a block: the nearest of the other part, of equal ones the smallest id."""
    out = []
    frame = frame.sort_values("id")
    one, two = frame[frame["part"] == frame["i"]], frame[frame["part"] == frame["j"]]
    means = lambda f: np.array(f["s"].tolist()) / f["n"].to_numpy()[:, None]
    if len(one) and len(two):
        d = 1.0 - means(one) @ means(two).T
        if frame["i"].iloc[0] == frame["j"].iloc[0]:
            d = np.minimum(d, d.T)
            np.fill_diagonal(d, np.inf)
        for own, other, table in ((one, two, d), (two, one, d.T)):
            near = table.argmin(1)
            out.append(pd.DataFrame({"block": own["block"].to_numpy(), "id": own["id"].to_numpy(), "d": table[np.arange(len(own)), near], "partner": other["id"].to_numpy()[near]}))
    frame = pd.concat(out) if out else pd.DataFrame({"block": [], "id": [], "d": [], "partner": []})
    return frame[np.isfinite(frame["d"].astype(float))].astype({"id": "int64", "partner": "int64"})


def linked_in_rounds(rows: DataFrame, cut: float, most: int = MOST_IN_BLOCK) -> DataFrame:
    """(block, id, cluster) of unit vectors (block, id, v) as linkage has them, for blocks of any size.

    The mean distance of two clusters is that of their mean vectors, so no table of all pairs is kept. A round looks for
    the nearest cluster of each, PART against PART vectors a task, and merges those that are nearest to each other; a
    cluster with none up to `cut` is ready, as no merge of others comes nearer. Equal vectors begin as one. The first
    round compares all pairs of different vectors of a block, so the time is in proportion to their square. When no
    block has over `most` clusters that may still merge, one table a block does the rest.
    """

    def rest(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        n, ids = frame["n"].to_numpy(), frame["id"].to_numpy()
        numbers = linkage(np.array(frame["s"].tolist()) / n[:, None], cut, n)
        first = np.unique(numbers, return_index=True)[1]
        return pd.DataFrame({"block": frame["block"], "cluster": ids, "into": ids[first][numbers]})

    rows = staged(rows)
    keys = ["block", "id"]
    equal = staged(rows.groupBy("block", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    labels = rows.join(equal, ["block", "v"]).select(*keys, F.col("rep").alias("cluster"))
    labels = staged(labels)
    live = staged(equal.select("block", F.col("rep").alias("id"), F.transform("v", lambda x: x * F.col("n")).alias("s"), "n"))
    while True:
        parts = staged(live.groupBy("block").agg(F.count("*").alias("m"), F.ceil(F.count("*") / PART).cast("int").alias("k")))
        if parts.filter(F.col("m") > most).isEmpty():
            gone = live.groupBy("block").applyInPandas(rest, "block string, cluster long, into long")
            return labels.join(gone, ["block", "cluster"], "left").select(*keys, F.coalesce("into", "cluster").alias("cluster"))
        dealt = live.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
        met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("block", "id", "s", "n", "part", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))
        near = met.groupBy("block", "i", "j").applyInPandas(_nearest_of_parts, "block string, id long, d double, partner long")
        near = staged(near.groupBy(*keys).agg(F.min(F.struct("d", "partner")).alias("m")).filter(F.col("m.d") <= cut).select(*keys, "m.partner"))
        other = near.select("block", F.col("id").alias("partner"), F.col("partner").alias("id"))
        gone = staged(near.join(other, [*keys, "partner"]).filter("id < partner").select("block", F.col("partner").alias("id"), F.col("id").alias("into")))
        if gone.isEmpty():
            return labels
        moved = live.join(near.select(*keys), keys, "left_semi").join(gone, keys, "left").withColumn("id", F.coalesce("into", "id"))
        two = F.collect_list(F.struct("n", "s"))  # a cluster, or the two that are one now
        live = staged(moved.groupBy(*keys).agg(two.alias("p")).select(*keys, F.aggregate(F.slice("p", 2, 1), F.col("p")[0]["s"], lambda x, y: F.zip_with(x, y["s"], lambda a, b: a + b)).alias("s"), F.aggregate("p", F.lit(0).cast("long"), lambda x, y: x + y["n"]).alias("n")))
        labels = staged(labels.join(gone.select("block", F.col("id").alias("cluster"), "into"), ["block", "cluster"], "left").select(*keys, F.coalesce("into", "cluster").alias("cluster")))


def average_linkage(rows: DataFrame, block: str, id_: str, vector: str, cut: float) -> DataFrame:
    """(block, id, cluster): the smallest id of the cluster that each vector falls in, within its block.

    A block of up to MOST_IN_BLOCK vectors is one task's square table; a larger one goes by linked_in_rounds.
    """
    rows = rows.filter(F.col(block).isNotNull() & F.col(vector).isNotNull()).select(F.col(block).cast("string").alias("block"), F.col(id_).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    sizes = staged(rows.groupBy("block").agg(F.count("*").alias("n")))

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        x = np.array(frame["v"].tolist(), float)
        labels = linkage(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), cut)
        ids = frame["id"].to_numpy()
        least = np.full(labels.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, labels, ids)
        return pd.DataFrame({"block": frame["block"], "id": ids, "cluster": least[labels]})

    whole = rows.join(sizes.filter(F.col("n") <= MOST_IN_BLOCK).select("block"), "block").groupBy("block").applyInPandas(cluster, "block string, id long, cluster long")
    large = sizes.filter(F.col("n") > MOST_IN_BLOCK).select("block")
    if large.isEmpty():
        return whole
    norm = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0).cast("double"), lambda s, x: s + x * x)), F.lit(1e-12))
    units = rows.join(large, "block").withColumn("_norm", norm).select("block", "id", F.transform("v", lambda x: x / F.col("_norm")).alias("v"))
    return whole.unionByName(linked_in_rounds(units, cut))
